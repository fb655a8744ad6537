"""Registered round trips: what a sink wrote under the shared folder is read back whole.

Each query writes a table of the test data with one of the library's sinks, reads it with the
matching reader and returns the rows, so that the pair is compared with the source by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.operators import joins as J
from pawgrid.operators import rerank as R
from pawgrid.plans import adapters as A
from pawgrid.plans.catalog import composed_replies, prepared, register
from pawgrid.session import run_path
from pawgrid.sources import readers as RD
from pawgrid.sources import sinks as SK
from pawgrid.sources.marks import read_round
from pawgrid.streaming.incremental import late_rows, stream_files, windowed_table


@register("csv_roundtrip", "SELECT doc_id, text, lang FROM documents")
def q_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SNK1 + SRC4: every document (line breaks, quotes, commas) through a header CSV."""
    path = run_path(spark, "csv")
    SK.export_csv(A.table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return RD.read_csv(spark, path, "doc_id long, text string, lang string")


@register("orc_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def q_orc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SRC6: a stored table of another format, with its schema given."""
    path = run_path(spark, "orc")
    ev = A.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    ev.write.orc(path)
    return RD.read_table(spark, path, "orc", ev.schema)


@register("vectors_roundtrip", "SELECT vec_id AS uid, false AS failed, 'stand-in' AS model, 64 AS dim, "
          "embedding FROM embeddings")
def q_vectors_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SNK4: the vector table with its model and dimension."""
    path = run_path(spark, "vectors")
    SK.save_vectors(A.vectors(spark, d).select("uid", "embedding", F.lit(False).alias("failed")), path, "stand-in", 64)
    return RD.read_table(spark, path).select("uid", "failed", "model", "dim", "embedding")


@register("processed_roundtrip", "SELECT count(*) AS total_records, 'description' AS type, 'uid,state,kind' AS columns FROM part")
def q_processed_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SNK3: the processed table and the metadata row written beside it."""
    path = run_path(spark, "processed")
    SK.save_processed(prepared(spark, d).select("uid", "state", "kind"), path)
    return RD.read_table(spark, path + "_meta")


@register("append_log_roundtrip", "SELECT event_id, event_type FROM events")
def q_append_log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SET2 / SNK2: a log grown by several runs holds every row once, though one run was started twice."""
    path = run_path(spark, "log")
    ev = A.table(spark, d, "events").select("event_id", "event_type")
    for part in (0, 1, 1, 2):
        SK.append_log(ev.where(F.pmod("event_id", F.lit(3)) == part), path, run=part)
    return RD.read_table(spark, path).drop("run_id")


@register("union_records", "SELECT event_id, user_id, value FROM events WHERE event_type = 'view' UNION ALL "
          "SELECT event_id, user_id, NULL FROM events WHERE event_type = 'click' UNION ALL "
          "SELECT event_id, NULL, value FROM events WHERE event_type NOT IN ('view', 'click')")
def q_union_records(spark: SparkSession, d: str) -> DataFrame:
    """SET1: record frames with different columns become one; absent columns are null."""
    ev = A.table(spark, d, "events")
    kind = F.col("event_type")
    return RD.union_records([ev.where(kind == "view").select("event_id", "user_id", "value"),
                             ev.where(kind == "click").select("event_id", "user_id"),
                             ev.where(~kind.isin("view", "click")).select("event_id", "value")])


@register("windowed_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, "
          "round(sum(value), 4) AS value_sum FROM events GROUP BY 1, 2")
def q_windowed_stream(spark: SparkSession, d: str) -> DataFrame:
    """STR2: daily counts per type over the append-only log as a stream, drained once."""
    src = f"{d}/events.parquet"
    stream = stream_files(spark, src[:-1] + "[t]", spark.read.parquet(src).schema)
    out = windowed_table(stream, run_path(spark, "windows"), run_path(spark, "windows-checkpoint"), "ts", "event_type")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value_sum", 4).alias("value_sum"))


@register("stage_reuse", "SELECT count(*) AS n, true AS reused FROM part")
def q_stage_reuse(spark: SparkSession, d: str) -> DataFrame:
    """SNK7 + PIPE3: the first call builds the stage, the second finds it and builds nothing."""
    path, built = run_path(spark, "stage"), []

    def build() -> DataFrame:
        built.append(1)
        return prepared(spark, d).select("uid", "state")

    SK.materialise(spark, path, build)
    again = SK.materialise(spark, path, build)
    return again.agg(F.count(F.lit(1)).alias("n")).withColumn("reused", F.lit(len(built) == 1))


@register("log_timestamp", "SELECT count(*) AS n, count(*) AS stamped FROM part")
def q_log_timestamp(spark: SparkSession, d: str) -> DataFrame:
    """SC22: log rows carry the time of the run, to the second, when none is given."""
    rep = composed_replies(spark, d)
    first = R.parse_replies(rep).where(F.col("item") == 1)
    log = R.pick_log(first, rep.select("qid", "text"))
    at = F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm:ss")
    fresh = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(at)) < 3600
    return log.agg(F.count(F.lit(1)).alias("n"), F.count_if(fresh).alias("stamped"))


_MARK_DAY, _MARK_ID = "2024-01-15", 5000


@register("incremental_rounds", f"SELECT event_id, CASE WHEN date_trunc('day', ts) < TIMESTAMP '{_MARK_DAY}' OR (date_trunc('day', ts) = "
          f"TIMESTAMP '{_MARK_DAY}' AND event_id <= {_MARK_ID}) THEN 0 ELSE 1 END AS run_id FROM events")
def q_incremental_rounds(spark: SparkSession, d: str) -> DataFrame:
    """SRC2 + STR1 with a stored mark: hundreds of events share each time (their day); the first round finds
    the table as it was part-way through a day, the second the whole table, a third nothing new.  Every
    event is read once, with the number of its round."""
    ev = A.table(spark, d, "events").select("event_id", F.date_trunc("day", "ts").alias("day"))
    out, log = run_path(spark, "rounds"), run_path(spark, "rounds-marks")
    early = ev.where((F.col("day") < F.lit(_MARK_DAY).cast("timestamp"))
                     | ((F.col("day") == F.lit(_MARK_DAY).cast("timestamp")) & (F.col("event_id") <= _MARK_ID)))
    for source in (early, ev, ev):
        read_round(spark, source, "day", "event_id", out, log, lambda rows: rows.select("event_id"))
    return RD.read_table(spark, out).select("event_id", "run_id")


_LATE = "ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03' AND event_type = 'view'"


@register("windowed_late", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value_sum, "
          f"(SELECT count(*) FROM events WHERE {_LATE}) AS rows_late FROM events WHERE NOT ({_LATE}) GROUP BY 1, 2")
def q_windowed_late(spark: SparkSession, d: str) -> DataFrame:
    """STR2 over three files in the order of time, but for one day's views, which arrive with the third: their
    windows were closed by then, so they are not counted but accounted for."""
    ev = A.table(spark, d, "events").select("ts", "event_type", "value")
    home, late = run_path(spark, "late-in"), F.expr(_LATE)
    cut = [F.lit(f"2024-01-{day}").cast("timestamp") for day in (11, 21)]
    for part in (F.col("ts") < cut[0]) & ~late, (F.col("ts") >= cut[0]) & (F.col("ts") < cut[1]), (F.col("ts") >= cut[1]) | late:
        ev.where(part).coalesce(1).write.mode("append").parquet(home)
    stream = stream_files(spark, home, ev.schema, max_files_per_trigger=1)
    out = windowed_table(stream, run_path(spark, "late-out"), run_path(spark, "late-checkpoint"), "ts", "event_type", delay="2 days")
    report = late_rows(spark.read.parquet(home), out).select("rows_late").scalar()
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value_sum", 4).alias("value_sum"),
                      report.alias("rows_late"))


@register("stage_manifest", "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, true)) v(call, built), "
          "(SELECT count(*) AS part_rows FROM part)")
def q_stage_manifest(spark: SparkSession, d: str) -> DataFrame:
    """SNK7 + PIPE3: a stage is built for a new input, found again for an equal one, and rebuilt when the input's
    files change and when a parameter does."""
    source, path, built, calls = run_path(spark, "manifest-in"), run_path(spark, "manifest"), [], []
    part = A.table(spark, d, "part").select("p_partkey")

    def build() -> DataFrame:
        built.append(1)
        return spark.read.parquet(source).distinct()

    for params, change in (({"k": 1}, True), ({"k": 1}, False), ({"k": 1}, True), ({"k": 2}, False)):
        if change:
            part.write.mode("append").parquet(source)
        before = len(built)
        out = SK.materialise(spark, path, build, inputs=[spark.read.parquet(source)], params=params)
        calls.append((len(calls) + 1, len(built) > before))
    n = out.agg(F.count(F.lit(1)).alias("part_rows")).scalar()
    return spark.createDataFrame(calls, "call int, built boolean").withColumn("part_rows", n)


@register("flat_written", "SELECT true AS full_written, false AS empty_written, count(*) AS n FROM part")
def q_flat_written(spark: SparkSession, d: str) -> DataFrame:
    """SNK6: the flat export of all listings, and of none (which leaves no table)."""
    listings = A.structured_listings(spark, d).withColumn("match_score", F.lit(1.0))
    full, empty = run_path(spark, "flat"), run_path(spark, "flat-empty")
    wrote = SK.write_flat(listings, full), SK.write_flat(listings.where(F.col("uid") < 0), empty)
    n = RD.read_csv(spark, full, "id long, name string").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit(wrote[0]).alias("full_written"), F.lit(wrote[1] or SK.path_exists(spark, empty)).alias("empty_written"), "n")


def bucketed_pair(spark: SparkSession, d: str, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """The open listings and the stored vectors as tables bucketed by uid."""
    listings = RD.open_listings(A.raw_listings(spark, d, long_text=False)).select("uid", "kind", "addinfo07")
    vectors = A.vectors(spark, d).select("uid", "embedding")
    return (SK.save_bucketed(listings, run_path(spark, "bucketed-listings"), "uid", buckets),
            SK.save_bucketed(vectors, run_path(spark, "bucketed-vectors"), "uid", buckets))


@register("bucketed_vectors", "SELECT p_partkey AS uid, v.embedding FROM part LEFT JOIN embeddings v ON v.vec_id = p_partkey "
          "WHERE p_partkey % 4 <> 3")
def q_bucketed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """JN3 on stored tables: listings and their vectors meet bucket by bucket, nothing is shuffled for the join."""
    listings, vectors = bucketed_pair(spark, d)
    return listings.join(vectors.hint("merge"), "uid", "left").select("uid", "embedding")


@register("heavy_keys", "SELECT event_type AS event_key, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type "
          "HAVING count(*) > (SELECT count(event_type) FROM events) * 0.01")
def q_heavy_keys(spark: SparkSession, d: str) -> DataFrame:
    """JN1: keys that hold more than a hundredth of the rows; a sketch that is not full counts exactly."""
    return J.heavy_keys(A.table(spark, d, "events").withColumnRenamed("event_type", "event_key"), "event_key", 0.01)
