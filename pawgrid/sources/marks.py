"""The high-water mark of an incremental read, kept in a log (SRC2, STR1 in batch form).

A mark is (time, id): rows are read in that order, so of the rows that share the mark's time those with
a larger id are still new; none is lost and none is read twice.  (A row that arrives later has to have a
later time, or the same time and a larger id.)  The log holds one committed row per run; a run's output
lies in its own ``run_id=<n>`` folder.  A run that died after its output and before its mark is done again
under the same number and replaces its output, so the table holds every row once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.sources.sinks import append_log, path_exists


@dataclass(frozen=True)
class Mark:
    """The last row read (time and id) and the run that read it."""

    time: object
    id: object
    run_id: int


def current_mark(spark: SparkSession, log: str) -> Mark | None:
    """The mark of the last committed run; None before the first."""
    if not path_exists(spark, log):
        return None
    row = spark.read.parquet(log).orderBy(F.desc("run_id")).limit(1).collect()
    return Mark(row[0]["time"], row[0]["id"], int(row[0]["run_id"])) if row else None


def after_mark(ts_col: str, id_col: str, mark: Mark | None) -> Column:
    """Is a row new?  (Pushed into the scan: the time bound prunes files.)  Rows without a time or an id never are."""
    known = F.col(ts_col).isNotNull() & F.col(id_col).isNotNull()
    if mark is None:
        return known
    t = F.lit(mark.time)
    return known & (F.col(ts_col) >= t) & ((F.col(ts_col) > t) | (F.col(id_col) > F.lit(mark.id)))


def read_round(spark: SparkSession, source: DataFrame, ts_col: str, id_col: str, out_path: str, log: str,
               transform: Callable[[DataFrame], DataFrame] | None = None) -> Mark | None:
    """One run: the rows after the mark, up to the last one there now, to ``out_path``; then the new mark.

    Returns the mark of the run, or the old one when nothing is new (then nothing is written).  Rows that
    arrive while the run writes are beyond its upper end and belong to the next."""
    mark = current_mark(spark, log)
    new = source.where(after_mark(ts_col, id_col, mark))
    top = new.agg(F.max(F.struct(F.col(ts_col).alias("time"), F.col(id_col).alias("id"))).alias("top"), F.count(F.lit(1)).alias("n")).first()
    if top["top"] is None:
        return mark
    time, last = top["top"]["time"], top["top"]["id"]
    bounded = new.where((F.col(ts_col) < F.lit(time)) | (F.col(id_col) <= F.lit(last)))
    run = 0 if mark is None else mark.run_id + 1
    append_log(transform(bounded) if transform else bounded, out_path, run=run)
    types = source.schema
    row = spark.createDataFrame([(time, last, top["n"])], f"time {types[ts_col].dataType.simpleString()}, "
                                f"id {types[id_col].dataType.simpleString()}, n_rows long")
    append_log(row.coalesce(1), log, run=run)
    return Mark(time, last, run)
