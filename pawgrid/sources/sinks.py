"""Sinks (SNK1–SNK7, SET2): CSV/parquet export, append logs, stage materialisation.

Writes are plain DataFrame writers: each task writes its own files, a failed task is retried
by Spark, and the commit protocol publishes only complete output.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pawgrid.operators.shaping import flat_export_columns


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: header CSV, UTF-8 (no BOM)."""
    (df.write.mode(mode).option("header", "true").option("encoding", "UTF-8")
     .option("quote", '"').option("escape", '"').csv(path))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there such a file or folder?  A store that cannot be asked raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_log(df: DataFrame, path: str, fmt: str = "parquet", run: int | str | None = None) -> None:
    """SNK2 / SNK5 / SET2: append rows to a log table (created on first write).

    With ``run`` (a number or name of the run that writes) the append happens once: the rows go to the folder
    ``run_id=<run>`` and replace what the same run wrote before, so a run that is started again after a
    failure leaves each row once.  Read ``path`` as a table; ``run_id`` is its partition column."""
    w = df.write.mode("append" if run is None else "overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", "true").option("escape", '"')
    w.save(path if run is None else f"{path.rstrip('/')}/run_id={run}")


def export_flat(df: DataFrame, score_col: str | None = "match_score") -> DataFrame:
    """SNK6 / PRJ10: the 10 flat export columns (tags '|'-joined, score default 0)."""
    if score_col and score_col not in df.columns:
        score_col = None
    return df.select(*flat_export_columns(score_col))


def write_flat(df: DataFrame, path: str, score_col: str | None = "match_score") -> bool:
    """SNK6: the flat export as CSV; an empty result leaves no table.  Returns whether there is one.

    The plan runs once: the rows are written and counted by the same job, and the folder of an empty
    result is removed."""
    seen = Observation()
    export_csv(export_flat(df, score_col).observe(seen, F.count(F.lit(1)).alias("n")), path)
    if seen.get["n"]:
        return True
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return False


def manifest(spark: SparkSession, inputs: Sequence[DataFrame], params: dict | None = None) -> str:
    """A digest of what a stage is made from: each input's schema and files (with sizes and times), and the
    parameters.  Files are listed by the driver, nothing is read."""
    conf = spark._jsc.hadoopConfiguration()
    parts = [json.dumps(params or {}, sort_keys=True, default=str, ensure_ascii=False)]
    for df in inputs:
        parts.append(df.schema.json())
        for name in sorted(df.inputFiles()):
            p = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
            status = p.getFileSystem(conf).getFileStatus(p)
            parts.append(f"{name}\t{status.getLen()}\t{status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame], skip_existing: bool = True,
                fmt: str = "parquet", inputs: Sequence[DataFrame] = (), params: dict | None = None) -> DataFrame:
    """SNK7: rebuild a stage table only when it is missing (or ``skip_existing=False``), then
    read it back — the written table also cuts the lineage for the next stage.

    A table counts as present only when its write committed (the ``_SUCCESS`` marker of the
    job commit): a folder left by a write that died part-way is rebuilt, not reused.

    ``inputs`` (frames read from files) and ``params`` make the stage notice a change: their digest
    (:func:`manifest`) is taken before the build and kept in ``_manifest-<digest>`` beside the data, and a table of
    another digest is rebuilt.  An overwrite removes the old digest with the old data, so a build that died
    has none."""
    home = path.rstrip("/")
    # a store that cannot be asked raises here; it is never taken for a missing table
    present = skip_existing and path_exists(spark, f"{home}/_SUCCESS")
    digest = f"{home}/_manifest-{manifest(spark, inputs, params)}" if inputs or params else None
    if not present or digest and not path_exists(spark, digest):
        build().write.mode("overwrite").format(fmt).save(path)
        if digest:
            p = spark._jvm.org.apache.hadoop.fs.Path(digest)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True).close()
    return spark.read.format(fmt).load(path)


def save_vectors(df: DataFrame, path: str, model: str, dim: int) -> None:
    """SNK4: ``(uid, embedding, failed, model, dim)``."""
    df.withColumns({"model": F.lit(model), "dim": F.lit(dim)}).write.mode("overwrite").parquet(path)


def save_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """JN3: the rows as a table bucketed and sorted by ``key`` in ``path``, read back as such.

    Rows are dealt by the hash that buckets use, so every bucket is one file.  Tables of equal ``buckets`` and key
    type join on ``key`` (and group by it) without a further exchange; choose about the table's size / 256 MB, the
    same for tables that are joined.  The table is known to this session's catalog under a name made from the
    path; a second call for the same path replaces it."""
    spark = df.sparkSession
    name = "pawgrid_bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet")
     .option("path", path).saveAsTable(name))
    return spark.table(name)


def save_processed(df: DataFrame, path: str, kind: str = "description") -> DataFrame:
    """SNK3: the processed table plus a one-row metadata frame (records, type, columns)."""
    df.write.mode("overwrite").parquet(path)
    meta = df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("total_records")) \
        .withColumns({"type": F.lit(kind), "columns": F.lit(",".join(df.columns))})
    meta.write.mode("overwrite").parquet(path.rstrip("/") + "_meta")
    return meta
