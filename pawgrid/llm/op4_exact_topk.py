"""Operator 4: exact top-k search by distributed histogram selection.

Vectors become whole numbers floor(256 * x).  Queries and items are cut into blocks of bounded
bytes; every (query block, item block) pair meets in one task, which scores it as a matrix product.
A pass counts, per query, how many scores fall into each of 1024 equal slices of an interval that
holds the k-th best score.  The counts are added up over all tasks, and the slice that holds the
k-th value becomes the interval of the next pass.  When slices are one wide the k-th value is known;
a last pass keeps the scores above it and, of those equal to it, the smallest vec_ids.

A task reports only slices from its own k-th best score up (lower ones cannot hold the k-th of
all), so what passes between tasks is a few rows per query and block.  Scores are never kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawgrid.llm.common import read, stage

K = 5
QUERY_EVERY = 50
SCALE = 256
SLICES = 1024
BLOCK_BYTES = 32 << 20  # largest block of either side
LEAST_BYTES = 1 << 20  # blocks are not cut finer than this to occupy more tasks
TILE_QUERIES, TILE_ITEMS = 256, 4096
EXACT = 1 << 53  # scores below this are exact in double precision


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim): whole-number vectors of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return (embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
            .withColumn("dim", F.size("v")))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in vectors], dtype=np.int64).reshape(len(vectors), -1)


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _tiles(q: pd.DataFrame, items: pd.DataFrame, exact: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, scores, item ids, which scores count) tile by tile."""
    qm, xm, ids = _matrix(q["v"]), _matrix(items["v"]), items["vec_id"].to_numpy(np.int64)
    for a in range(0, len(q), TILE_QUERIES):
        part = q.iloc[a:a + TILE_QUERIES]
        for b in range(0, len(items), TILE_ITEMS):
            own = ids[b:b + TILE_ITEMS]
            yield part, _products(qm[a:a + TILE_QUERIES], xm[b:b + TILE_ITEMS], exact), own, \
                part["vec_id"].to_numpy(np.int64)[:, None] != own[None, :]


def exact_topk(spark: SparkSession, embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY,
               scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best scores of each query row, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``query_every``.  Candidates are the rows of
    the same dimension with another vec_id.  Rows with a null vec_id, a null vector, or null or
    non-finite components take no part.  Equal rows are queried once and found as often as they
    occur.  Queries without candidates give no rows.
    """
    vectors = stage(spark, whole_vectors(embeddings, scale), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, e: t + e.cast("double") * e.cast("double")))
    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    shape = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("int")).alias("q"),
                                       F.max(norm).alias("norm")).collect()  # one row per dimension
    n_bytes = sum(r["n"] * max(r["dim"], 1) * 8 for r in shape)
    q_bytes = sum(r["q"] * max(r["dim"], 1) * 8 for r in shape)
    bound = math.ceil(max([r["norm"] ** 2 for r in shape], default=0.0) * (1 + 1e-9)) + 1
    exact = bound < EXACT
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    item_blocks = max(1, math.ceil(n_bytes / BLOCK_BYTES), min(tasks, n_bytes // LEAST_BYTES))
    query_blocks = max(1, math.ceil(q_bytes / BLOCK_BYTES))

    queries = vectors.filter(is_query).dropDuplicates(["vec_id", "v"]).select(
        F.xxhash64("vec_id", "v").alias("qk"), "vec_id", "v", "dim",
        F.pmod(F.xxhash64("v", "vec_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("qb"))
    queries = stage(spark, queries, "topk-queries")
    # every item block meets every query block: items are sent once per query block and back
    items = (vectors.withColumn("ib", F.pmod(F.xxhash64("vec_id", "v"), F.lit(item_blocks)).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    grid = ["dim", "qb", "ib"]

    def meet(state: DataFrame, fn, schema: str) -> DataFrame:
        q = (queries.join(state, "qk").withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1)))))
        return items.groupBy(*grid).cogroup(q.groupBy(*grid)).applyInPandas(fn, schema)

    span = 2 * bound + 1  # length of the interval that holds the k-th value
    state = queries.select("qk", F.lit(-bound).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    while True:
        width = -(-span // SLICES)
        inside, step = span, width

        def count(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            width, found = step, []
            if len(x) and len(q):
                for part, s, _, counts in _tiles(q, x, exact):
                    above = s - part["low"].to_numpy(np.int64)[:, None]
                    b = np.where(counts & (above >= 0) & (above < inside), above // width, -1)
                    cut = np.partition(b, -k, axis=1)[:, -k] if b.shape[1] >= k else np.zeros(len(b), dtype=np.int64)
                    row, col = np.nonzero(b >= np.maximum(cut, 0)[:, None])
                    key, n = np.unique(row * SLICES + b[row, col], return_counts=True)
                    found.append(pd.DataFrame({"qk": part["qk"].to_numpy()[key // SLICES], "slice": key % SLICES, "n": n}))
            return pd.concat(found) if found else pd.DataFrame({"qk": [], "slice": [], "n": []}, dtype="int64")

        hist = meet(state, count, "qk long, slice long, n long").groupBy("qk", "slice").agg(F.sum("n").alias("n"))
        down = W.partitionBy("qk").orderBy(F.desc("slice"))
        hist = (hist.withColumn("above", F.coalesce(F.sum("n").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
                .join(state, "qk").filter((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need")))
                .select("qk", "slice", (F.col("need") - F.col("above")).alias("left")))
        # no such slice: fewer candidates than wanted, all of them are kept from the interval's low end
        state = stage(spark, state.join(hist, "qk", "left").select(
            "qk", (F.col("low") + F.coalesce("slice", F.lit(0)) * width).cast("long").alias("low"),
            F.coalesce("left", "need").cast("long").alias("need")), "topk-state")
        span = width
        if span == 1:
            break

    def keep(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(x) and len(q):
            for part, s, ids, counts in _tiles(q, x, exact):
                low = part["low"].to_numpy(np.int64)[:, None]
                order = np.argsort(ids, kind="stable")
                s, ids, counts = s[:, order], ids[order], counts[:, order]
                tie = counts & (s == low)
                keep = (counts & (s > low)) | (tie & (np.cumsum(tie, axis=1) <= k))
                row, col = np.nonzero(keep)
                found.append(pd.DataFrame({"qk": part["qk"].to_numpy()[row], "query_id": part["vec_id"].to_numpy()[row],
                                           "vec_id": ids[col], "score": s[row, col]}))
        return pd.concat(found) if found else pd.DataFrame({"qk": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    best = meet(state, keep, "qk long, query_id long, vec_id long, score long")
    order = W.partitionBy("qk").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(spark, read(spark, sf_dir, "embeddings"))


ORACLE = {"op4_exact_topk": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""}
QUERIES = {"op4_exact_topk": op4_exact_topk}
