"""Sources, sinks, streaming twin (SRC2, SRC4, SNK1–SNK7, STR1) and statistics (AGG1–AGG11)."""

import os
import tempfile

from pyspark.sql import functions as F

from pawgrid.operators import stats as ST
from pawgrid.session import shared_path
from pawgrid.sources import readers as RD
from pawgrid.sources import sinks as SK
from pawgrid.streaming.incremental import drain_to_table, stream_files


def test_csv_roundtrip_and_append(spark):
    d = tempfile.mkdtemp(prefix="pawgrid-t-")
    df = spark.createDataFrame([(1, "a,b\nc"), (2, "\"q\"")], "uid long, t string")
    SK.export_csv(df, f"{d}/out")
    back = RD.read_csv(spark, f"{d}/out", "uid long, t string")
    assert sorted(back.collect()) == sorted(df.collect())
    SK.append_log(df, f"{d}/log")
    SK.append_log(df, f"{d}/log")
    assert spark.read.parquet(f"{d}/log").count() == 4


def test_incremental_and_mark(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "id long, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    inc = RD.read_incremental(df, "ts", "2024-01-01 00:00:00")
    assert [r.id for r in inc.collect()] == [2]
    assert RD.read_incremental(df, "ts", None).count() == 2
    assert str(RD.next_mark(df, "ts").first().mark) == "2024-01-02 00:00:00"


def test_stream_drain_is_exactly_once(spark):
    d = tempfile.mkdtemp(prefix="pawgrid-s-")
    src = f"{d}/in"
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(src)
    out = f"{d}/out"
    name = "t-" + os.path.basename(d)
    drain_to_table(stream_files(spark, src, "id long"), out, shared_path(spark, f"streams/{name}"))
    drain_to_table(stream_files(spark, src, "id long"), out, shared_path(spark, f"streams/{name}"))   # nothing new: no duplicates
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([(3,)], "id long").write.mode("append").parquet(src)
    drain_to_table(stream_files(spark, src, "id long"), out, shared_path(spark, f"streams/{name}"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_materialise_skips_existing(spark):
    path = shared_path(spark, "stages/test-" + next(tempfile._get_candidate_names()))
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    SK.materialise(spark, path, build)
    SK.materialise(spark, path, build)
    assert len(calls) == 1 and SK.materialise(spark, path, build, skip_existing=False).count() == 3


def test_export_flat(spark):
    df = spark.createDataFrame([(1, "a", "m", 1.0, 2.0, "c", "r", ["x", "y"], None)],
                               "uid long, name string, gender string, age double, weight double, care_type string, "
                               "rescue_location string, hashtags array<string>, detail_link string")
    r = SK.export_flat(df).first()
    assert r.hashtags == "x|y" and r.match_score == 0.0 and r.detail_link == ""


def test_facets_empty_and_counts(spark):
    df = spark.createDataFrame([("m", 1.0, 8.5, "일반임보", "서울")],
                               "gender string, age double, weight double, care_type string, rescue_location string")
    got = {(r.facet, r.key): r.n for r in ST.result_facets(df).collect()}
    assert got == {("total", "all"): 1, ("gender", "m"): 1, ("age", "1세 이하"): 1, ("weight", "중형견"): 1,
                   ("care_type", "일반임보"): 1, ("region", "서울"): 1}
    empty = ST.result_facets(df.limit(0)).collect()
    assert [(r.facet, r.n) for r in empty] == [("total", 0)]


def test_share_and_null_profile(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", None), (None, "y")], "s string, t string")
    sh = {r.key: (r.n, r.pct) for r in ST.share(df, "s").collect()}
    assert sh == {"a": (2, 50.0), "b": (1, 25.0), None: (1, 25.0)}
    assert {r.column: r.nulls for r in ST.null_profile(df).collect()} == {"s": 1, "t": 2}


def test_crawl_summary(spark):
    items = spark.createDataFrame([(1, 0, "b"), (1, 1, None), (2, 0, "")], "page long, pos long, n string")
    got = {r.page: (r.collected_count, r.animal_names) for r in
           ST.crawl_summary(items, "page", name_col="n", order_col="pos").collect()}
    assert got == {1: (2, "b, N/A"), 2: (1, "N/A")}


def test_spread_only_when_few_splits(spark):
    df = spark.range(0, 1000, numPartitions=1).withColumnRenamed("id", "k")
    wide = RD.spread(df, "k", tasks=4)
    assert wide.rdd.getNumPartitions() == 4
    assert sorted(r.k for r in wide.collect()) == list(range(1000))
    many = spark.range(0, 1000, numPartitions=6)
    assert RD.spread(many, tasks=4) is many                       # enough splits: unchanged, no shuffle


def test_stream_replay_does_not_duplicate(spark):
    d = tempfile.mkdtemp(prefix="pawgrid-r-")
    src, out = f"{d}/in", f"{d}/out"
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(src)
    name = "r-" + os.path.basename(d)
    drain_to_table(stream_files(spark, src, "id long"), out, shared_path(spark, f"streams/{name}"))
    # the driver "dies" after writing the last batch and before committing it: the batch is replayed
    commits = os.path.join(shared_path(spark, f"streams/{name}"), "commits")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (str(last), f".{last}.crc"):                   # the commit marker and its checksum file
        if os.path.exists(os.path.join(commits, f)):
            os.remove(os.path.join(commits, f))
    drain_to_table(stream_files(spark, src, "id long"), out, shared_path(spark, f"streams/{name}"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_materialise_rebuilds_uncommitted_table(spark):
    path = shared_path(spark, "stages/partial-" + next(tempfile._get_candidate_names()))
    spark.range(2).write.parquet(path)
    os.remove(os.path.join(path, "_SUCCESS"))        # a write that died before its job commit
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert SK.materialise(spark, path, build).count() == 5 and len(calls) == 1
