"""Helpers shared by the operators: table reads, staged tables, hash folds, block sums, worker state."""

from __future__ import annotations

import math
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pawgrid
from pawgrid.session import ensure_checkpoint_dir

# kernels are shipped to the workers by value: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(pawgrid)

WORD = r"[^\x20\x09-\x0D]+"  # the word pattern of every contract


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches (16 MB of texts and sets, not 64) between Spark and the Python workers, unless
    the session chose a size of its own; results do not depend on it."""
    if spark.conf.get(ARROW_BYTES) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(ARROW_BYTES, str(16 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of ``sf_dir``, read by Spark (any store that Spark can read)."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _stage_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pawgrid-llm/{spark.sparkContext.applicationId}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the table instead of redoing the work) and keeps a
    table used twice from being computed twice.  The tables live in a folder of the application;
    :func:`drop_stages` deletes it when its results have been consumed.
    """
    bounded_batches(spark)
    path = f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete the staged tables of this application (call it after the results were written)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int) -> Column:
    """True when the fold is 1; a null doc_id is never held out."""
    return F.coalesce(fold(doc_id, modulus) == 1, F.lit(False))


def worker_state(key: str, make: Callable[[], object]) -> object:
    """A value kept for the life of a Python worker, across the tasks it serves."""
    module = sys.modules.setdefault("_pawgrid_worker_state", types.ModuleType("_pawgrid_worker_state"))
    if not hasattr(module, key):
        setattr(module, key, make())
    return getattr(module, key)


FAN_IN = 64  # partial blocks added up in one task


def sum_blocks(partials: DataFrame, n_parts: int, dtype: str) -> DataFrame:
    """Add equal-length numeric arrays per block: ``(block int, part long, data binary)`` rows.

    ``part`` numbers the task that made the row (0 <= part < n_parts).  Arrays are added in a tree
    of fan-in 64, so no task ever holds more than 64 of them however many tasks there were.
    """
    def add(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in pdfs:
            for blob in pdf["data"]:
                one = np.frombuffer(blob, dtype=dtype)
                total = one.copy() if total is None else total + one
        yield pd.DataFrame({"block": [key[0]], "part": [key[1]], "data": [total.tobytes()]})

    out = partials
    for _ in range(max(1, math.ceil(math.log(max(n_parts, 2), FAN_IN)))):
        out = (out.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
               .groupBy("block", "part").applyInPandas(add, "block int, part long, data binary"))
    return out


def collect_blocks(partials: DataFrame, n_parts: int, dtype: str, n_blocks: int, width: int) -> np.ndarray:
    """The summed blocks as one ``n_blocks x width`` array; its size is fixed by the caller's parameters."""
    out = np.zeros((n_blocks, width), dtype=dtype)
    for row in sum_blocks(partials, n_parts, dtype).collect():
        out[row["block"]] = np.frombuffer(row["data"], dtype=dtype)
    return out


def task_index() -> int:
    """The number of the running task's partition."""
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


def split_count(df: DataFrame) -> int:
    """Partitions of a narrow plan over a scan (planning only, no job)."""
    return df.rdd.getNumPartitions()
