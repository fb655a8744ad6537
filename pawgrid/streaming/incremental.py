"""Structured Streaming twins of the incremental read and the append logs (STR1, STR2).

The checkpoint replaces the hand-kept high-water mark: a file-source stream processes each
new file once, and ``trigger(availableNow=True)`` drains what is there and stops, so the same
job runs as a scheduled batch.  The caller names the checkpoint folder, which has to be under a
shared folder (``session.shared_path``, ``session.run_path``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType



def stream_files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream with an explicit schema."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def drain_to_table(stream: DataFrame, out_path: str, checkpoint: str,
                   transform: Callable[[DataFrame, int], DataFrame] | None = None, fmt: str = "parquet") -> None:
    """STR1: process everything available once, adding each micro-batch to ``out_path``.

    ``foreachBatch`` lets the batch DataFrame API (joins, windows) run per micro-batch; the
    checkpoint makes a rerun skip committed batches.  A batch that ran but was not committed
    (the driver died in between) is replayed with the same id, so each batch is written to its
    own ``batch_id=<id>`` folder with overwrite: the replay replaces its output instead of
    appending it twice (exactly-once files).  Read ``out_path`` as a table; ``batch_id`` is its
    partition column."""
    def write(batch: DataFrame, epoch: int) -> None:
        out = transform(batch, epoch) if transform else batch
        out.write.mode("overwrite").format(fmt).save(f"{out_path.rstrip('/')}/batch_id={epoch}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def windowed_counts(stream: DataFrame, ts_col: str, key: str, window: str = "1 day",
                    watermark: str = "1 day") -> DataFrame:
    """STR2 aggregate over an append-only log: counts per key and event-time window, with a watermark.  In
    update or append mode state is dropped once a window can no longer change (complete mode keeps all)."""
    ts = F.col(ts_col).cast("timestamp")
    return (stream.withColumn("__ts", ts).withWatermark("__ts", watermark)
            .groupBy(F.window("__ts", window).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum")))


def windowed_table(stream: DataFrame, out_path: str, checkpoint: str, ts_col: str, key: str,
                   window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """STR2 drained once, with bounded state: the counts of all windows so far (see :func:`window_counts_upsert`)."""
    window_counts_upsert(stream, out_path, checkpoint, ts_col, key, window, delay)
    return latest_windows(stream.sparkSession, out_path, key)


def window_counts_upsert(stream: DataFrame, out_path: str, checkpoint: str, ts_col: str, key: str, window: str = "1 day",
                         delay: str = "1 day") -> int:
    """STR2: drains the log; each micro-batch adds the windows that it changed, whole, in its own
    ``batch_id=<id>`` folder (a replayed batch replaces its folder).  Returns the rows left in the state.

    A window leaves the state once the watermark (the latest time of earlier batches less ``delay``)
    passes its end, so the state holds the open windows only; rows that arrive for a closed window are not
    counted (see :func:`late_rows`).  No table is rewritten and no reader meets a half-written one."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={epoch}")

    query = (windowed_counts(stream, ts_col, key, window, delay).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    last = query.lastProgress
    return int(last["stateOperators"][0]["numRowsTotal"]) if last and last["stateOperators"] else 0


def latest_windows(spark: SparkSession, out_path: str, key: str) -> DataFrame:
    """The table that the batches of :func:`window_counts_upsert` make: of each window and key the last row written."""
    rows = spark.read.parquet(out_path)
    values = [c for c in rows.columns if c not in ("w", key, "batch_id")]
    last = rows.groupBy("w", key).agg(F.max_by(F.struct(*values), "batch_id").alias("last"))
    return last.select("w", key, *[F.col(f"last.{v}").alias(v) for v in values])


def late_rows(source: DataFrame, windows: DataFrame) -> DataFrame:
    """One row (rows_read, rows_counted, rows_late) for a drained stream: ``source`` reads the same files as a table,
    ``windows`` is :func:`latest_windows`.  What was read and is in no window came too late."""
    n = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    counted = windows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_counted"))
    return counted.select(n.alias("rows_read"), "rows_counted", (n - F.col("rows_counted")).alias("rows_late"))
