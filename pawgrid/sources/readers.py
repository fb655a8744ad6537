"""Readers (SRC1–SRC8): parquet/CSV/JDBC tables with explicit schemas, and the incremental read.

Filters written after a read are pushed into the scan by Catalyst (parquet ``PushedFilters``,
JDBC ``WHERE``); only the columns a query uses are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pawgrid import constants as K


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None,
               **options) -> DataFrame:
    """SRC1 / SRC5 / SRC6: a stored table; pass ``schema`` for text formats (never inferred)."""
    r = spark.read.format(fmt).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """SRC4: CSV with header, quoted multi-line fields, explicit schema."""
    opts = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8"}
    opts.update(options)
    return spark.read.options(**opts).schema(schema).csv(path)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None, predicate: str | None = None) -> DataFrame:
    """SRC1 over JDBC, read in parallel ranges of ``partition_column`` when given.

    Connection settings come from the caller; nothing is stored in the library."""
    props = dict(properties or {})
    src = table if predicate is None else f"(SELECT * FROM {table} WHERE {predicate}) t"
    if partition_column:
        return spark.read.jdbc(url, src, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=props)
    return spark.read.jdbc(url, src, properties=props)


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Give a CPU-heavy per-row stage (text cleaning, page extraction, embedding) at least one
    task per core.

    A file scan yields one task per split, and a table stored as a few large row groups yields
    only a few.  When ``df`` has fewer partitions than ``tasks`` (default: the session's default
    parallelism) its rows are dealt over ``tasks`` partitions — hashed on ``keys`` when given (a
    later join or group on them reuses the partitioning), else round-robin.  Otherwise ``df`` is
    returned unchanged: a cluster reading many splits pays no shuffle.  Call it on a scan (or a
    projection of one), where counting partitions is planning only.
    """
    n = tasks or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, *keys) if keys else df.repartition(n)


def open_listings(df: DataFrame, state_col: str = "state", open_value: str = K.OPEN_STATE) -> DataFrame:
    """SRC3: the base table restricted to open listings (pushed into the scan)."""
    return df.where(F.col(state_col) == F.lit(open_value))


def read_incremental(df: DataFrame, ts_col: str, mark) -> DataFrame:
    """SRC2: rows strictly newer than the high-water ``mark`` (None = everything)."""
    if mark is None:
        return df
    return df.where(F.col(ts_col) > F.lit(mark))


def next_mark(df: DataFrame, ts_col: str) -> DataFrame:
    """SRC2: the next high-water mark as a one-row frame (``max`` of the batch)."""
    return df.agg(F.max(ts_col).alias("mark"))


def union_records(frames: list[DataFrame]) -> DataFrame:
    """SET1 / SRC8: concatenate record frames whose schemas differ (missing columns -> null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def wide_records(long_df: DataFrame, key: str, labels: list[str], label_col: str = "key",
                 value_col: str = "value") -> DataFrame:
    """SRC8: long ``(key, label, value)`` rows to one column per label (labels given, so the
    pivot needs no extra pass to discover them)."""
    return long_df.groupBy(key).pivot(label_col, labels).agg(F.first(value_col))


def ts_from_ntz(c: str | Column) -> Column:
    """``timestamp_ntz`` -> ``timestamp`` (UTC session), needed before ``withWatermark``."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")
