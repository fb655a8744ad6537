"""Exact cosine top-k over a pivot index: cells that cannot hold a query's best items are skipped.

Building (:func:`build_index`): pivots are unit vectors fitted on a bounded sample of the items; every item
goes to its nearest pivot and, by its angle to it, to one of the pivot's rings.  A cell (pivot, ring)
keeps the least and greatest angle of its items, their number and the slot groups that any of them is
eligible for.  The cell table has at most ``pivots`` x ``rings`` rows, whatever the number of items.

Searching (:func:`pivot_top_k`): angles between directions obey the triangle inequality, so for a query
at angle t from a pivot no item of a cell with angles lo..hi is nearer than max(0, t - hi, lo - t), and
the cosine of that is a bound.  Round one scores each query against its most promising cells that
together hold k items, which gives a k-th value; round two scores the cells whose bound reaches it.
The cells left out hold no item of the answer, so the result equals the one of scoring all pairs.

Items without a direction (no vector, or zeros) have similarity 0 with every query and differ by uid only:
of each slot bit set its k smallest uids can matter.  A query without a direction needs k uids of each bit set.

Small cells that follow each other share a bin of ``tile_rows`` items: a query is copied once to a bin and its best
of the bin leave the task, not those of each cell.  Hot cells: items of a larger cell are dealt over blocks
of ``tile_rows`` rows and queries over query blocks; an item is copied only to the query blocks that need its bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pawgrid.operators import vectors as V
from pawgrid.session import run_path

PIVOTS = 64          # at most, and one for each PER_PIVOT rows of the sample
RINGS = 8            # per pivot
SAMPLE = 4096        # items (of smallest uid hash) that the pivots are fitted on
PER_PIVOT = 64
ROUNDS = 5           # of moving the pivots to the middle of their sample items
BLOCK_ROWS = 4096    # items of a cell, and queries, that are multiplied at once
SLACK = 1e-7         # of an angle: covers the rounding of arccos near 0
NO_VECTOR, ANY_ITEM = -1, -2  # cells of items without a direction, and for queries without one


@dataclass
class PivotIndex:
    """Pivots (a bounded matrix), the cell table (a row per cell) and the placed items (a stored table)."""

    pivots: np.ndarray
    cells: pd.DataFrame
    items: DataFrame

    @property
    def n_items(self) -> int:
        return int(self.cells["n"].sum())


@dataclass
class PivotSearch:
    """``result``: (qid, rank, uid, similarity); ``work``: one row (scored_pairs, all_pairs, share)."""

    result: DataFrame
    work: DataFrame


def fit_pivots(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``n`` unit vectors: the sample row farthest from those chosen so far each time, then
    ``rounds`` rounds of moving each to the mean direction of its rows."""
    rows = V._unit_rows(sample)
    rows = rows[np.linalg.norm(rows, axis=1) > 0]
    if not len(rows):
        return rows[:0]
    chosen, nearest = [0], rows @ rows[0]
    while len(chosen) < min(n, len(rows)):
        far = int(np.argmin(nearest))
        if nearest[far] > 1 - 1e-12:  # the other rows repeat the chosen ones
            break
        chosen.append(far)
        nearest = np.maximum(nearest, rows @ rows[far])
    pivots = rows[chosen]
    for _ in range(rounds):
        mine = np.argmax(rows @ pivots.T, axis=1)
        total = np.zeros_like(pivots)
        np.add.at(total, mine, rows)
        size = np.linalg.norm(total, axis=1)
        pivots = np.where(size[:, None] > 0, total / np.maximum(size, 1e-300)[:, None], pivots)
    return pivots


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def build_index(items: DataFrame, path: str | None = None, *, uid: str = "uid", i_vec: str = "embedding",
                i_mask: str | None = None, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE) -> PivotIndex:
    """Place every item; the placed table is written to ``path`` (default: a folder of this application).

    ``i_mask`` names the slot bit set.  An empty table, or one without any direction, has no pivots."""
    spark = items.sparkSession
    base = V._prep_items(items, uid, i_vec, i_mask)
    some = (base.where(F.col("ivec").isNotNull()).select("uid", "ivec").orderBy(F.xxhash64("uid"), "uid").limit(sample)
            .collect())  # at most ``sample`` vectors
    n = min(pivots, -(-len(some) // PER_PIVOT))
    fitted = fit_pivots(V._stack([r["ivec"] for r in some]), n) if some else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            unit = V._unit_rows(V._stack(pdf["ivec"], p.shape[1] or None))
            cell, angle = np.full(len(pdf), NO_VECTOR), np.zeros(len(pdf))
            solid = np.linalg.norm(unit, axis=1) > 0
            if len(p) and solid.any():
                theta = _angles(unit[solid], p)
                near = np.argmin(theta, axis=1)
                angle[solid] = theta[np.arange(len(near)), near]
                cell[solid] = near * rings + np.minimum((angle[solid] * rings / np.pi).astype(np.int64), rings - 1)
            yield pdf.assign(cell=cell.astype(np.int32), angle=angle)

    path = path or run_path(spark, "pivot-items")
    base.mapInPandas(place, "uid long, slot_mask long, ivec array<float>, cell int, angle double").write.mode("overwrite").parquet(path)
    placed = spark.read.parquet(path)
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"),
                                       F.bit_or("slot_mask").alias("groups"))
    rows = [tuple(r) for r in cells.orderBy("cell").collect()]  # at most pivots x rings + 1
    return PivotIndex(fitted, pd.DataFrame(rows, columns=["cell", "n", "lo", "hi", "groups"]), placed)


def cell_bounds(index_pivots: np.ndarray, cells: pd.DataFrame, unit: np.ndarray, rings: int) -> np.ndarray:
    """Queries x cells: no item of the cell is more similar than this."""
    lo, hi = cells["lo"].to_numpy(), cells["hi"].to_numpy()
    theta = _angles(unit, index_pivots)[:, cells["cell"].to_numpy() // rings]
    return np.cos(np.maximum(np.maximum(theta - hi, lo - theta) - SLACK, 0.0))


def _smallest(placed: DataFrame, k: int, cell: int) -> DataFrame:
    """The k smallest uids of every slot bit set, as items of ``cell``."""
    w = Window.partitionBy("slot_mask").orderBy("uid")
    return (placed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
            .select("uid", "slot_mask", "ivec", F.lit(cell).alias("cell")))


def cell_bins(sizes: list[tuple[int, int]], tile_rows: int) -> list[tuple[int, int, int]]:
    """(cell, bin, blocks) of every (cell, items): neighbouring cells share a bin of at most ``tile_rows`` items;
    a larger cell has a bin of its own, in several blocks."""
    out, number, held = [], -1, tile_rows
    for cell, n in sorted(sizes):
        if held + n > tile_rows:
            number, held = number + 1, 0
        held += n
        out.append((cell, number, max(1, -(-n // tile_rows))))
    return out


def _score(plan: DataFrame, items: DataFrame, bins: list[tuple[int, int, int]], k: int, query_blocks, block_rows: int) -> DataFrame:
    """Top-k per query and bin block of the cells each query of ``plan`` names: (qid, uid, similarity).

    A query is sent once to a bin, with the cells it names there, not once to each cell."""
    cells = F.broadcast(plan.sparkSession.createDataFrame(bins, "cell int, bin int, blocks int"))  # a row per cell
    low = min(c for c, _, _ in bins)
    places = dict((c, b) for c, b, _ in bins)
    bin_of = F.array(*[F.lit(places.get(c, -1)) for c in range(low, max(places) + 1)])
    blocks_of = F.array(*[F.lit(n) for _, n in sorted({(b, n) for _, b, n in bins})])
    place = lambda c: F.get(F.col("bin_of"), c - low)
    q = (plan.withColumn("bin_of", bin_of).withColumn("bin", F.explode(F.array_distinct(F.transform("cells", place))))
         .withColumn("cells", F.filter("cells", lambda c: place(c) == F.col("bin"))).drop("bin_of")
         .withColumn("qb", F.pmod(F.xxhash64("qid"), query_blocks)))
    q = q.withColumn("ib", F.explode(F.sequence(F.lit(0), F.get(blocks_of, F.col("bin")) - 1)))
    wanted = q.select("bin", "ib", F.col("qb").alias("to")).distinct()
    it = (items.join(cells, "cell").withColumn("ib", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).drop("blocks")
          .join(wanted, ["bin", "ib"]).withColumn("qb", F.col("to") + 0).drop("to"))

    def meet(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        dim = V.vector_size(qpdf["qvec"], ipdf["ivec"])
        qids, groups, qmat = qpdf["qid"].to_numpy(), qpdf["slot_group"].to_numpy(np.int64), V._stack(qpdf["qvec"], dim)
        uids, masks, imat = (ipdf["uid"].to_numpy(np.int64), ipdf["slot_mask"].to_numpy(np.int64),
                             V._stack(ipdf["ivec"], dim))
        number, owner = ipdf["cell"].to_numpy(), np.repeat(np.arange(len(qpdf)), qpdf["cells"].map(len))
        named = np.concatenate([np.zeros(0, np.int32), *qpdf["cells"]])
        found = []
        for c in np.unique(number):
            rows, mine = owner[named == c], number == c
            found.append(V.block_topk(rows, groups[rows], qmat[rows], uids[mine], masks[mine], imat[mine], k, block_rows))
        if not found:
            return pd.DataFrame({"qid": qids[:0], "uid": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        all_ = pd.concat(found, ignore_index=True)
        best = all_.iloc[V._first_k(all_["qid"].to_numpy(), all_["uid"].to_numpy(), all_["similarity"].to_numpy(), k)]
        return pd.DataFrame({"qid": qids[best["qid"].to_numpy()], "uid": best["uid"].to_numpy(),
                             "similarity": best["similarity"].to_numpy()})

    schema = f"qid {plan.schema['qid'].dataType.simpleString()}, uid long, similarity double"
    return q.groupBy("bin", "ib", "qb").cogroup(it.groupBy("bin", "ib", "qb")).applyInPandas(meet, schema)


def pivot_top_k(queries: DataFrame, index: PivotIndex, k: int = 10, *, qid: str = "qid", q_vec: str = "embedding",
                q_group: str | None = None, rings: int = RINGS, block_rows: int = BLOCK_ROWS,
                tile_rows: int = V.TILE_ROWS) -> PivotSearch:
    """The rows of ``vectors.top_k_similar`` through the index, and how many pairs were scored for them.

    ``rings`` is the number the index was built with.  No query: no row; fewer eligible items than k: all."""
    spark = queries.sparkSession
    base = V._prep_queries(queries, qid, q_vec, q_group)
    shared = spark.sparkContext.broadcast((index.pivots, index.cells[index.cells["cell"] >= 0].reset_index(drop=True)))
    has_zero = bool((index.cells["cell"] == NO_VECTOR).any())
    key = base.schema["qid"].dataType.simpleString()
    planned = f"qid {key}, slot_group long, qvec array<float>, cells array<int>"

    def choose(pdf: pd.DataFrame, floor: np.ndarray | None, seen: list) -> list[np.ndarray]:
        pivots, cells = shared.value
        number, n, groups = cells["cell"].to_numpy(np.int32), cells["n"].to_numpy(), cells["groups"].to_numpy(np.int64)
        unit = V._unit_rows(V._stack(pdf["qvec"], pivots.shape[1] or None))
        solid = np.linalg.norm(unit, axis=1) > 0
        bound = cell_bounds(pivots, cells, unit, rings) if len(number) else np.zeros((len(pdf), 0))
        open_ = ((groups[None, :] >> pdf["slot_group"].to_numpy(np.int64)[:, None]) & 1).astype(bool)
        out = []
        for r in range(len(pdf)):
            if not solid[r]:
                out.append(np.array([] if floor is not None else [ANY_ITEM], dtype=np.int32))
            elif floor is None:  # the best cells that together hold k items
                best = np.flatnonzero(open_[r])
                best = best[np.argsort(-bound[r, best], kind="stable")]
                out.append(number[best[:int(np.searchsorted(np.cumsum(n[best]), k)) + 1]])
            else:
                more = number[open_[r] & (bound[r] >= floor[r] - 2 * SLACK)]
                more = np.setdiff1d(more, np.asarray(seen[r], dtype=np.int32))
                out.append(np.append(more, NO_VECTOR).astype(np.int32) if has_zero and floor[r] <= 2 * SLACK else more)
        return out

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cells=choose(pdf, None, []))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            floor, seen = pdf.pop("floor").fillna(-2.0).to_numpy(), list(pdf.pop("cells"))
            yield pdf.assign(cells=choose(pdf, floor, seen))

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = run_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    n_q = F.greatest(F.lit(1).cast("long"), F.ceil(base.agg(F.count(F.lit(1)).alias("n")).scalar() / tile_rows))
    extra = [(NO_VECTOR, 1), (ANY_ITEM, 1)]  # a few rows per slot bit set
    sizes = [(int(c), int(n)) for c, n in zip(index.cells["cell"], index.cells["n"]) if c >= 0] + extra
    bins = cell_bins(sizes, tile_rows)
    items = (index.items.where(F.col("cell") >= 0).select("uid", "slot_mask", "ivec", "cell")
             .unionByName(_smallest(index.items.where(F.col("cell") == NO_VECTOR), k, NO_VECTOR))
             .unionByName(_smallest(index.items, k, ANY_ITEM)))
    plan = stored(base.mapInPandas(first, planned), "pivot-plan")
    one = stored(_score(plan, items, bins, k, n_q, block_rows), "pivot-first")
    kth = (V._final_topk(one, k).groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.min("similarity").alias("least"))
           .select("qid", F.when(F.col("found") >= k, F.col("least")).alias("floor")))
    rest = stored(plan.join(kth, "qid", "left").mapInPandas(second, planned).where(F.size("cells") > 0), "pivot-rest")
    two = _score(rest, items, bins, k, n_q, block_rows)
    pairs = (plan.unionByName(rest).select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("times"))
             .join(F.broadcast(items.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))), "cell").agg(F.coalesce(F.sum(F.col("times") * F.col("n")), F.lit(0)).alias("scored_pairs")))
    total = plan.agg((F.count(F.lit(1)) * index.n_items).alias("all_pairs")).scalar()
    work = pairs.withColumn("all_pairs", total).withColumn(
        "share", F.when(F.col("all_pairs") > 0, F.col("scored_pairs") / F.col("all_pairs")).otherwise(F.lit(0.0)))
    return PivotSearch(V._final_topk(one.unionByName(two), k), work)
