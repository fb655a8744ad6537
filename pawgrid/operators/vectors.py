"""Dense vectors: normalisation, cosine, exact top-k for many queries, batch embedding.

Exact cosine top-k (EMB4, EMB5, JN3–JN5, WIN1) is brute force by definition: every query meets
every eligible item.  One plan serves every size: queries and items are hashed into tiles (at most
``QUERY_TILES`` and ``ITEM_TILES`` times ``tile_rows`` rows) and travel as packs, a few dozen vectors in one binary value,
as each is copied to all tiles of the other side; in each (query tile, item tile) cell blocks of
``block_rows`` rows are multiplied inside ``cogroup().applyInArrow``, the cell emits its top-k per query, and a
window over those rows (with Spark's partial limit before the exchange) merges them.  Small blocks
bound a product, not a tile: they copy no more rows.  Tile counts are scalar subqueries of the plan:
nothing runs while the plan is built and no row passes through the driver.

Items without a direction (no vector, or zeros) have similarity 0 with every query and differ by uid
only: of each slot bit set its k smallest uids meet the queries (:func:`needed_items`).

Hard constraints (the size/age/sex slots) ride along as a small integer: each query carries a
``slot_group`` (0..35) and each item a ``slot_mask`` bit set of the groups it satisfies, so
eligibility is one bit test inside the kernel.  An item without a vector ranks with similarity 0.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BLOCK = 256           # queries per kernel matmul chunk
BLOCK_ROWS = 16384          # rows of a query or an item block
TIE_DIGITS = 9              # similarities equal to so many decimals tie, and the smaller uid comes first
TILE_ROWS = 16384           # unit of the rows of a side that meet in one task, in blocks
QUERY_TILES = 4             # at most so many times TILE_ROWS queries
ITEM_TILES = 16             # meet so many times TILE_ROWS items
ITEM_COPIES = 16            # a query has to find its first k items again in every cell, an item is only multiplied
PACK_BYTES = 8192           # of vectors in a row that is copied to tasks
ITEM_BLOCK = 4096           # items per kernel matmul chunk
PAIR_BLOCK = 1 << 16        # pairs scored at once
LEAST_ITEMS = 128           # items are not cut into smaller tiles than this to occupy more tasks
KNOWN_WORDS = 1 << 17       # words whose places a task's stand-in embedder remembers
EMBED_ROWS = 1000           # texts embedded before their vectors leave a task, in calls of a batch each


# ----------------------------------------------------------------------------------------------
# Column-level helpers (single literal query, or per-row use)
# ----------------------------------------------------------------------------------------------
def norm(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalise(v: Column | str) -> Column:
    """Unit vector in double; a zero vector stays zero (so its cosine is 0.0, as sklearn).

    Lambdas get no common-subexpression elimination, so stage the input (or use ``cosine``,
    which divides once) rather than nesting this inside another per-element lambda."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """EMB4 as a Column: cosine of two array columns, 0.0 when either is a zero vector.

    One dot product and two norms per row (O(dim)); nothing is re-evaluated per element."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    na, nb = norm(a), norm(b)
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


# ----------------------------------------------------------------------------------------------
# Kernel (pure numpy)
# ----------------------------------------------------------------------------------------------
def _unit_rows(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    return m / _lengths(m)[:, None]


def _lengths(m: np.ndarray) -> np.ndarray:
    """Of the rows; 1 for zeros."""
    n = np.linalg.norm(m, axis=1)
    n[n == 0] = 1.0
    return n


def _stack(vectors, dim: int | None = None) -> np.ndarray:
    """Rows of a matrix; a missing vector is a zero row."""
    vs = list(vectors)
    if dim is None:
        dim = next((len(v) for v in vs if v is not None), 0)
    out = np.zeros((len(vs), dim))
    for i, v in enumerate(vs):
        if v is not None:
            out[i] = v
    return out


def vector_size(*columns) -> int:
    """Length of the first vector that any of the columns has; 0 without one."""
    return next((len(v) for c in columns for v in c if v is not None), 0)


def _first_k(r: np.ndarray, order: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best by (similarity desc, ``order`` asc), row by row."""
    by = np.lexsort((order, -np.round(sims, TIE_DIGITS), r))
    rows = r[by]
    start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
    return by[rank < k]


def _best(q: np.ndarray, items: np.ndarray, sizes: np.ndarray, rough: np.ndarray, k: int, block_rows: int, first: int, held: tuple) -> tuple:
    """``held`` with the items (of lengths ``sizes``) numbered from ``first`` on: (query, item, similarity) of each query's k best so far,
    of equal ones those that come first, and its k-th similarity (-inf with fewer).

    Products in single precision (``rough``) find the pairs that can be among them: each query's k-th value so
    far, and in the first block the k-th largest of the maxima of column groups, are no more than its
    k-th value, and ``margin`` covers the rounding.  Only those pairs are scored in double precision and ranked."""
    r, c, sims, floor = held
    margin = 2e-6 + items.shape[1] * 4e-7
    q32 = q.astype(np.float32)
    for i in range(0, len(items), block_rows):
        near = q32 @ rough[i:i + block_rows].T
        limit, n = floor, near.shape[1]
        if n > k and np.isinf(floor).any():
            groups = min(n, max(64, 4 * k))
            tops = near[:, :n // groups * groups].reshape(len(q), -1, groups).max(axis=1)
            limit = np.maximum(floor, np.partition(tops, groups - k, axis=1)[:, groups - k])
        limit = (limit - margin).astype(np.float32)
        some = np.flatnonzero(near.max(axis=1) >= limit)  # most queries find nothing better in a later block
        if not len(some):
            continue
        if len(some) < len(q):
            near, limit = near[some], limit[some]
        new_r, new_c = np.divmod(np.flatnonzero(near >= limit[:, None]), n)
        new_r = some[new_r]
        new = np.empty(len(new_r))
        for j in range(0, len(new), PAIR_BLOCK):
            part = slice(j, j + PAIR_BLOCK)
            at = i + new_c[part]
            new[part] = np.einsum("ij,ij->i", q[new_r[part]], items[at].astype(np.float64) / sizes[at, None])
        changed = np.zeros(len(q), dtype=bool)
        changed[new_r] = True
        old = changed[r]
        all_r, all_c, all_sims = np.append(r[old], new_r), np.append(c[old], new_c + (first + i)), np.append(sims[old], new)
        best = _first_k(all_r, all_c, all_sims, k)
        all_r, all_c, all_sims = all_r[best], all_c[best], all_sims[best]
        last = np.flatnonzero(np.append(all_r[1:] != all_r[:-1], True))
        full = np.diff(np.append(-1, last)) == k
        floor[all_r[last[full]]] = all_sims[last[full]]
        r, c, sims = np.append(r[~old], all_r), np.append(c[~old], all_c), np.append(sims[~old], all_sims)
    return r, c, sims, floor


def block_topk(qids: np.ndarray, qgroups: np.ndarray, qmat: np.ndarray,
               uids: np.ndarray, masks: np.ndarray, imat: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> pd.DataFrame:
    """Top-k items per query by (similarity desc, uid asc), eligible items only, in products of at most
    ``block_rows`` queries and items.

    ``qmat`` and ``imat`` hold vectors of any length.
    Ties at the k-th value are resolved exactly.
    """
    qmat = _unit_rows(qmat)
    sizes = np.ones(len(imat))
    for s in range(0, len(imat), BLOCK_ROWS):
        sizes[s:s + BLOCK_ROWS] = _lengths(imat[s:s + BLOCK_ROWS].astype(np.float64))
    by_uid = np.argsort(uids, kind="stable")
    by_uid = by_uid[np.isfinite(imat).all(axis=1)[by_uid]]
    uids = uids.astype(np.int64)
    sound, solid = np.isfinite(qmat).all(axis=1), qmat.any(axis=1)
    found = [(qids[:0], uids[:0], np.zeros(0))]
    step, width = min(QUERY_BLOCK, block_rows), min(ITEM_BLOCK, block_rows)
    for g in np.unique(qgroups) if k > 0 else ():
        mine = by_uid[((masks[by_uid] >> g) & 1).astype(bool)]
        mine_q = sound & (qgroups == g)
        if not len(mine):
            continue
        flat = np.flatnonzero(mine_q & ~solid)  # similarity 0 with every item: the smallest uids
        n = min(k, len(mine))
        found.append((np.repeat(qids[flat], n), np.tile(uids[mine[:n]], len(flat)), np.zeros(len(flat) * n)))
        rows = np.flatnonzero(mine_q & solid)
        blocks = [rows[s:s + step] for s in range(0, len(rows), step)]
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(at), -np.inf)) for at in blocks]
        for s in range(0, len(mine) if blocks else 0, BLOCK_ROWS):
            at = mine[s:s + BLOCK_ROWS]
            items, long = imat[at], sizes[at]
            rough = (items / long[:, None]).astype(np.float32)
            for b, at in enumerate(blocks):
                held[b] = _best(qmat[at], items, long, rough, k, width, s, held[b])
        found.extend((qids[at[r]], uids[mine[c]], sims) for at, (r, c, sims, _) in zip(blocks, held))
    return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("qid", "uid", "similarity"), zip(*found))})


# ----------------------------------------------------------------------------------------------
# Distributed top-k
# ----------------------------------------------------------------------------------------------
def _prep_queries(queries: DataFrame, qid: str, vec: str, group: str | None) -> DataFrame:
    g = F.col(group).cast("long") if group else F.lit(0).cast("long")
    return queries.select(F.col(qid).alias("qid"), g.alias("slot_group"),
                          F.col(vec).alias("qvec"))


def _prep_items(items: DataFrame, uid: str, vec: str, mask: str | None) -> DataFrame:
    m = F.col(mask).cast("long") if mask else F.lit(1).cast("long")
    return items.select(F.col(uid).cast("long").alias("uid"), m.alias("slot_mask"), F.col(vec).alias("ivec"))


def _longs(column: pa.Array) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """The rows of a list column; a missing vector is a zero row, a missing component not a number."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dim = int(size.max(initial=0))
    if ((size > 0) & (size != dim)).any():
        raise ValueError("vectors differ in length")
    out = np.zeros((len(column), dim), dtype)
    out[size > 0] = column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim or 1)[:, :dim]
    return out


def _packs(side: DataFrame, key: str, tag: str, vec: str) -> DataFrame:
    """``(at, keys, tags, dim, vecs)``: rows of ``side`` (at, ``key``, ``tag``, ``vec``) with the same ``at``, packed
    by ``PACK_BYTES`` of vectors, so that copying and handing on a vector costs no more than its bytes."""
    dtype = np.float32 if isinstance(side.schema[vec].dataType.elementType, T.FloatType) else np.float64
    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("keys", T.ArrayType(side.schema[key].dataType)),
                           T.StructField("tags", T.ArrayType(T.LongType())), T.StructField("dim", T.IntegerType()),
                           T.StructField("vecs", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, vecs = _longs(batch.column(0)), _matrix(batch.column(3), dtype)
            order = np.argsort(at, kind="stable")
            at, vecs = at[order], vecs[order]
            rows = max(1, PACK_BYTES // max(1, vecs.itemsize * vecs.shape[1]))
            run = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            cut = np.concatenate([np.arange(a, b, rows) for a, b in zip(run, np.append(run[1:], len(at)))])
            ends = pa.array(np.append(cut, len(at)), pa.int32())
            keys, tags = (batch.column(i).take(pa.array(order)) for i in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[cut]), pa.ListArray.from_arrays(ends, keys), pa.ListArray.from_arrays(ends, tags),
                 pa.array(np.full(len(cut), vecs.shape[1], np.int32)),
                 pa.array([vecs[a:b].astype("<f8").tobytes() if dtype == np.float64 else vecs[a:b].astype("<f4").tobytes()
                           for a, b in zip(cut, np.append(cut[1:], len(at)))], pa.binary())], names=schema.names)

    return side.select("at", key, tag, vec).mapInArrow(pack, schema)


def _unpacked(packs: pa.Table, dim: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(keys, tags, vectors) of the rows in ``packs``; a pack without any vector has zero rows of ``dim``."""
    keys, tags = (packs[name].combine_chunks().flatten() for name in ("keys", "tags"))
    keys, tags = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (keys, tags))
    at, mat = 0, None
    for n, size, vecs in zip(packs["keys"].combine_chunks().value_lengths().to_pylist(), packs["dim"].to_pylist(), packs["vecs"]):
        if size not in (0, dim):
            raise ValueError("vectors differ in length")
        if size:
            raw = vecs.as_buffer()
            rows = np.frombuffer(raw, "<f4" if raw.size == 4 * n * dim else "<f8").reshape(n, dim)
            mat = np.zeros((len(keys), dim), rows.dtype) if mat is None else mat
            mat[at:at + n] = rows
        at += n
    return keys, _longs(tags), np.zeros((len(keys), dim)) if mat is None else mat


def _final_topk(partial: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("similarity", TIE_DIGITS)), F.asc("uid"))
    return (partial.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .select("qid", F.col("rank").cast("long").alias("rank"), "uid", "similarity"))


def needed_items(items: DataFrame, k: int) -> DataFrame:
    """The rows of ``items`` (uid, slot_mask, ivec) that any query's k best can hold: all with a direction and,
    of the others, those of the k smallest uids of each slot bit set (with a null vector)."""
    flat = F.coalesce(F.forall("ivec", lambda x: x == 0), F.col("ivec").isNull())
    w = Window.partitionBy("slot_mask").orderBy("uid")
    rest = (items.where(flat).select("uid", "slot_mask").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
            .select("uid", "slot_mask", F.lit(None).cast(items.schema["ivec"].dataType).alias("ivec")))
    return items.where(~flat).unionByName(rest)


def top_k_similar(queries: DataFrame, items: DataFrame, k: int = 10, *,
                  qid: str = "qid", q_vec: str = "embedding", q_group: str | None = None,
                  uid: str = "uid", i_vec: str = "embedding", i_mask: str | None = None,
                  block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS, sizes: tuple[DataFrame, DataFrame] | None = None,
                  read_twice: bool = True) -> DataFrame:
    """Exact cosine top-k per query: ``(qid, rank, uid, similarity)``; rank 1..min(k, eligible).

    ``q_group`` / ``i_mask`` name the slot group / eligibility bit-set columns (see
    ``pawgrid.operators.preferences``); without them every item is eligible.  ``sizes`` names frames
    with as many rows as queries and items with a vector where counting those would repeat an embedding job or a join.
    The items are read twice, to set those without a direction apart; with ``read_twice`` off (an embedding
    job) all meet the queries.
    Without queries, or without items, there are no rows; a query without a vector has similarity 0.
    """
    q = _prep_queries(queries, qid, q_vec, q_group)
    it = _prep_items(items, uid, i_vec, i_mask)
    if read_twice:
        it = needed_items(it, k)
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("long")
    n_q, n_i = (F.greatest(one, f.agg(F.count(F.lit(1)).alias("n")).scalar()) for f in sizes or (q, it))
    # as many cells as tasks, if that does not make them tiny; a copy of a query costs about ITEM_COPIES times one of an item
    tiles = F.greatest(F.ceil(n_q / (tile_rows * QUERY_TILES)),
                       F.least(F.ceil(F.sqrt(ITEM_COPIES * parts * n_q / n_i)), F.lit(parts).cast("long"), F.ceil(n_q / LEAST_ITEMS)))
    cells = F.greatest(F.ceil(n_i / (tile_rows * ITEM_TILES)), F.least(F.ceil(F.lit(parts) / tiles), F.ceil(n_i / LEAST_ITEMS)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    q = _packs(q.withColumn("at", F.pmod(F.xxhash64("qid"), tiles)), "qid", "slot_group", "qvec")
    q = q.withColumn("n", cells).withColumn("ib", every(F.col("n"))).drop("n").withColumnRenamed("at", "qb")
    it = _packs(it.withColumn("at", F.pmod(F.xxhash64("uid"), cells)), "uid", "slot_mask", "ivec")
    it = it.withColumn("n", tiles).withColumn("qb", every(F.col("n"))).drop("n").withColumnRenamed("at", "ib")
    schema = T.StructType([T.StructField("qid", queries.schema[qid].dataType), T.StructField("uid", T.LongType()),
                           T.StructField("similarity", T.DoubleType())])

    def cell(qt: pa.Table, it: pa.Table) -> pa.Table:
        dim = max([0, *qt["dim"].to_pylist(), *it["dim"].to_pylist()])
        qids, groups, qmat = _unpacked(qt, dim)
        uids, masks, imat = _unpacked(it, dim)
        best = block_topk(np.arange(len(qids)), groups, qmat, _longs(uids), masks, imat, k, block_rows)
        return pa.table([qids.take(pa.array(best["qid"], pa.int64())), pa.array(best["uid"], pa.int64()),
                         pa.array(best["similarity"], pa.float64())], names=schema.names)

    # a cell costs far more than its bytes say, so cells are not put together by size
    q, it = (side.repartition(parts, "qb", "ib").groupBy("qb", "ib") for side in (q, it))
    return _final_topk(q.cogroup(it).applyInArrow(cell, schema), k)


def top_k_for_vector(items: DataFrame, vector: list[float], k: int = 5, *, uid: str = "uid",
                     i_vec: str = "embedding", i_mask: str | None = None, group: int = 0) -> DataFrame:
    """SRT3: one literal query vector -> top-k rows ``(rank, uid, similarity)``.

    A single query needs no join: cosine against a literal, then ``orderBy().limit()``, which
    plans as TakeOrderedAndProject (per-partition top-k, then a k-row merge)."""
    qv = np.asarray(vector, dtype=np.float64)
    nrm = float(np.linalg.norm(qv))
    unit = (qv / nrm if nrm > 0 else qv).tolist()
    lit = F.array(*[F.lit(float(x)) for x in unit])
    n_i = norm(F.col(i_vec))
    sim = F.when(n_i > 0, dot(F.col(i_vec), lit) / n_i).otherwise(F.lit(0.0))
    base = items
    if i_mask:
        base = base.where(F.shiftright(F.col(i_mask), group).bitwiseAND(F.lit(1)) == 1)
    top = (base.select(F.col(uid).cast("long").alias("uid"), sim.alias("similarity"))
           .orderBy(F.desc("similarity"), F.asc("uid")).limit(k))
    w = Window.orderBy(F.desc("similarity"), F.asc("uid"))
    return top.select(F.row_number().over(w).cast("long").alias("rank"), "uid", "similarity")


# ----------------------------------------------------------------------------------------------
# Batch embedding (EMB1–EMB3, WIN5, AGG13)
# ----------------------------------------------------------------------------------------------
def hashing_embedder(dim: int = 64, fail_on: str | None = None) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in embedder: signed feature hashing of lower-cased words.

    Words are the non-empty pieces between single spaces; the first 8 hex digits of a word's md5
    choose its place, the ninth its sign.  Real deployments inject a model client; this one needs
    no network, no model files and only the standard library.  A batch that holds a text with
    ``fail_on`` fails, as a remote call may."""
    import hashlib

    class Places(dict):
        """Word -> its place, ``dim`` further on with a negative sign; 2 ``dim`` for the empty piece.  Holds ``KNOWN_WORDS``."""

        def __missing__(self, word: str) -> int:
            h = hashlib.md5(word.encode()).hexdigest()
            place = int(h[:8], 16) % dim + (0 if h[8] >= "8" else dim)
            if len(self) < KNOWN_WORDS:
                self[word] = place
            return place

    places = Places({"": 2 * dim})

    def embed(texts: list[str]) -> list[list[float]]:
        if fail_on and any(fail_on in (t or "") for t in texts):
            raise ValueError("text refused")
        out = []
        for t in texts:
            n = np.bincount(np.fromiter(map(places.__getitem__, (t or "").lower().split(" ")), np.int64), minlength=2 * dim + 1)
            out.append((n[:dim] - n[dim:2 * dim]).astype(np.float64).tolist())
        return out

    return embed


def embed_texts(texts: list[str], embedder: Callable[[list[str]], list[list[float]]], retries: int = 0, wait: float = 1.0,
                sleep: Callable[[float], None] = time.sleep) -> list:
    """The vectors of ``texts`` in one call where that works; None for a text that fails alone.

    A call that raises, or returns another number of vectors, is tried ``retries`` more times after
    ``wait``, 2 ``wait``, 4 ``wait``... seconds (a busy service), then its texts are halved: f bad texts
    among n cost about 2 f log2(n) calls, where a call per text would cost n."""
    if not texts:
        return []
    for attempt in range(retries + 1):
        if attempt:
            sleep(wait * 2 ** (attempt - 1))
        try:
            got = embedder(texts)
            if len(got) != len(texts):
                raise ValueError("embedder returned a different number of vectors")
            return list(got)
        except Exception:  # noqa: BLE001 — any failure of the injected function isolates the text at fault
            pass
    if len(texts) == 1:
        return [None]
    half = len(texts) // 2
    return [v for part in (texts[:half], texts[half:]) for v in embed_texts(part, embedder, retries, wait, sleep)]


def embed(df: DataFrame, text_col: str, embedder: Callable[[list[str]], list[list[float]]], dim: int,
          key: str = "uid", batch_size: int = 100, keep: tuple[str, ...] = (), retries: int = 0, wait: float = 1.0) -> DataFrame:
    """EMB1: ``(key, *keep, embedding ARRAY<FLOAT>, failed BOOLEAN)`` via ``mapInPandas``.

    Texts go to ``embedder`` in batches of ``batch_size`` that run on across the Arrow batches of a task
    (only a task's last call is smaller), ``EMBED_ROWS`` texts at a time; the texts at fault in a failing batch are found by halving
    (:func:`embed_texts`) and get a zero vector and ``failed = true`` (they then rank with similarity 0,
    as before).  ``keep`` columns ride along unchanged, so callers need no join back to the input."""
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType),
        *[T.StructField(c, df.schema[c].dataType) for c in keep],
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("failed", T.BooleanType()),
    ])
    zero = np.zeros(dim, dtype=np.float32)
    piece = max(1, EMBED_ROWS // batch_size) * batch_size

    def embedded(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf[text_col].fillna("").astype(str).tolist()
        vecs: list = []
        for s in range(0, len(texts), batch_size):
            vecs.extend(None if v is None else np.asarray(v, dtype=np.float32) for v in embed_texts(texts[s:s + batch_size], embedder, retries, wait))
        return pd.DataFrame({key: pdf[key].values, **{c: pdf[c].values for c in keep},
                             "embedding": [zero if v is None else v for v in vecs],
                             "failed": [v is None for v in vecs]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            for s in range(0, len(pdf), piece):
                rest = pd.concat([rest, pdf.iloc[s:s + piece]], ignore_index=True)
                full = len(rest) - len(rest) % batch_size
                if full:
                    yield embedded(rest.iloc[:full])
                    rest = rest.iloc[full:]
        if rest is not None and len(rest):
            yield embedded(rest)

    cols = [key, *keep] + ([] if text_col in keep else [text_col])
    return df.select(*cols).mapInPandas(run, schema)


def embed_summary(embedded: DataFrame) -> DataFrame:
    """AGG13: how many texts were embedded and how many fell back to a zero vector."""
    return embedded.agg(F.count_if(~F.col("failed")).alias("ok"), F.count_if(F.col("failed")).alias("failed"))
