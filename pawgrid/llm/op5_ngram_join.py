"""Operator 5: n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Exact: documents link when 100 * |intersection| >= 75 * |union| of their distinct 5-word shingles
(64-bit hashes).  The result is the component of every document under those links.

1. Documents with equal sets are one class; only classes are compared.
2. The columns (n-grams) are ordered from rare to common by a fixed-size table of counts over all
   documents (2^20 counters; a shared counter only costs speed).  By the size bounds, two linked sets of
   sizes x <= y share an n-gram among the first x - ceil(0.75 x) + 1 of each in this order, so the
   incidence matrix keeps those entries only: (n-gram, class, size, position).
3. The matrix is dealt out in blocks of columns.  Columns with one entry are dropped.  In a column,
   a pair can reach the needed overlap ceil(3/7 (x + y)) only if the sizes are within 3/4 of each other
   and enough n-grams follow the shared one in both orders; other pairs are discarded unseen.
   A set's common n-grams (counter well above the mean) close its order.  Two sets that share no
   rarer one overlap in common ones alone, so in a common column a pair also needs the overlap
   within the smaller number of common n-grams; pairs with a rarer one meet in its column.
4. First product: every entry against the hub of its column: the class in reach whose order has
   the fewest n-grams before the shared one, the most typical of a group of near copies.  The
   overlaps of the surviving pairs are counted on the whole sets; linked classes form components.
   A large group of near copies is joined here by as many pairs as it has members.
5. Second product: in columns whose classes are still in more than one component, all pairs across
   components that the bounds allow, and their exact overlaps.  No link between components is lost,
   and pairs inside a component, which cannot change it, are never formed.

A pair that repeats in many columns is checked once, by the sets' bitmaps (an upper bound of the
overlap) and, if it passes, by the whole sets.  Whole sets are made again from the texts, for the classes
in some pair only (a fixed-size Bloom filter picks their rows on the map side).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawgrid.llm.common import collect_blocks, read, split_count, stage, task_index, worker_state
from pawgrid.llm.components import connected_components
from pawgrid.llm.kernels import Hasher, chunks

PERCENT = 75
SHINGLE = 5
COUNTERS_LOG2 = 20
BLOOM_LOG2 = 24  # bits
BLOCKS = 64
BITMAP = 2048


def hasher() -> Hasher:
    return worker_state("word_hasher", Hasher)


def reach(x, y, percent: int):
    """Least overlap of linked sets of sizes x and y: 100 i >= percent (x + y - i)."""
    return -(-(percent * (x + y)) // (100 + percent))


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITMAP bits of a set, as longs."""
    bits = np.zeros(BITMAP, dtype=bool)
    bits[(hashes % np.uint64(BITMAP)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def class_key(hashes: np.ndarray) -> int:
    """64-bit key of a set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Documents per counter, over all documents; 2^COUNTERS_LOG2 numbers."""
    n = 1 << COUNTERS_LOG2

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, dtype=np.int64)
        for pdf in batches:
            for part in chunks(pdf["text"]):
                sets = list(hasher().shingles(part, SHINGLE))
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64), minlength=n)
        total = np.minimum(total, 0x7FFFFFFF).astype("<i4").reshape(BLOCKS, -1)
        yield pd.DataFrame({"block": range(BLOCKS), "part": task_index(), "data": [r.tobytes() for r in total]})

    texts = docs.select("text")
    return collect_blocks(texts.mapInPandas(count, "block int, part long, data binary"), split_count(texts),
                          "<i4", BLOCKS, n // BLOCKS).reshape(-1)


def incidence(spark: SparkSession, docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, row_key, n, common, cls, head): per document its set's size, number of common n-grams
    and class, and the first n-grams in order."""
    table = gram_counts(docs)
    counts = spark.sparkContext.broadcast(table)
    mean = float(table.mean())
    usual = mean + 8 * mean ** 0.5 + 16  # any value gives the same links

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for part in chunks(pdf["text"]):
                for h in hasher().shingles(part, SHINGLE):
                    n = len(h)
                    keep = n - -(-percent * n // 100) + 1 if n else 0
                    common = counts.value[(h >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)]
                    head = h[np.lexsort((h, common))[:keep]]
                    out.append((n, int((common > usual).sum()), class_key(h) if n else None, head.view(np.int64)))
            n, common, cls, head = zip(*out) if out else ((), (), (), ())
            # beside a text without words plain inference makes keys doubles, which lose their last digits
            frame = pd.DataFrame({"n": n, "common": common, "cls": pd.Series(cls, dtype="Int64"), "head": head})
            frame["doc_id"], frame["row_key"] = pdf["doc_id"], pdf["row_key"]
            yield frame

    # numbers as text: beside a null pandas makes them doubles too
    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "row_key", "text").mapInPandas(
        run, "doc_id string, row_key long, n int, common int, cls long, head array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))


def _columns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of whole columns out of batches sorted by gram."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = pdf["gram"].iloc[-1] if len(pdf) else None
        cut = int(np.searchsorted(pdf["gram"].to_numpy(), last)) if len(pdf) else 0
        if cut:
            yield pdf.iloc[:cut]
        rest = pdf.iloc[cut:]
    if rest is not None and len(rest):
        yield rest


def allowed(n, pos, common, i, j, percent: int):
    """Can entries i and j of a column (sizes n[i] <= n[j]) reach the overlap that links them?"""
    need = reach(n[i], n[j], percent)
    rare = pos[i] < n[i] - common[i]
    return ((100 * n[i] >= percent * n[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            & (rare | (np.minimum(common[i], common[j]) >= need)))


def reach_groups(gram, n, percent: int) -> Iterator[tuple[int, int]]:
    """Runs of a column's entries (sizes rising) whose sizes are within reach of the run's first."""
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, int)
    for lo, end in zip(first, np.append(first[1:], len(gram))):
        while lo < end:
            hi = lo + int(np.searchsorted(n[lo:end], 100 * n[lo] // percent, side="right"))
            yield lo, hi
            lo = hi


def hub_pairs(percent: int):
    """Kernel of the first product: columns of at least two entries, each entry with its hub (or none)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _columns(batches):
            gram, cls = pdf["gram"].to_numpy(), pdf["cls"].to_numpy()
            again = np.concatenate(([False], gram[1:] == gram[:-1]))
            keep = again | np.concatenate((again[1:], [False]))
            pdf, gram, cls = pdf[keep].reset_index(drop=True), gram[keep], cls[keep]
            n, pos, common = (pdf[c].to_numpy(np.int64) for c in ("n", "pos", "common"))
            hub = np.full(len(gram), -1, dtype=np.int64)
            for lo, hi in reach_groups(gram, n, percent):
                hub[lo:hi] = lo + int(np.argmin(pos[lo:hi]))
            i = np.arange(len(gram))
            hub[(hub == i) | ~allowed(n, pos, common, np.minimum(hub, i), np.maximum(hub, i), percent)] = -1
            pdf["hub"] = pd.Series(cls[np.maximum(hub, 0)]).astype("Int64").where(hub >= 0)
            if len(pdf):
                yield pdf
    return run


def cross_pairs(percent: int):
    """Kernel of the second product: pairs of a column in different components that the bounds allow."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _columns(batches):
            gram = pdf["gram"].to_numpy()
            cls, label = pdf["cls"].to_numpy(), pdf["label"].to_numpy()
            n, pos, common = (pdf[c].to_numpy(np.int64) for c in ("n", "pos", "common"))

            def fits(i, j):
                return (label[j] != label[i]) & allowed(n, pos, common, i, j, percent)

            first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            size = np.diff(np.append(first, len(gram)))
            two = first[size == 2]
            two = two[fits(two, two + 1)]
            left, right = [cls[two]], [cls[two + 1]]
            for lo, hi in zip(first[size > 2], (first + size)[size > 2]):
                for i in range(lo, hi - 1):
                    # sizes rise inside a column: partners end where the size bound does
                    end = lo + int(np.searchsorted(n[lo:hi], 100 * n[i] // percent, side="right"))
                    other = cls[i + 1:end][fits(i, slice(i + 1, end))]
                    left.append(np.full(len(other), cls[i]))
                    right.append(other)
            x, y = np.concatenate(left), np.concatenate(right)
            if len(x):
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()
    return run


def linked_pairs(spark: SparkSession, docs: DataFrame, keys: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose exact overlap links them.  ``keys``: (cls, row_key) of one row per class."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(keys, "cls").select("row_key")
    n_bytes = 1 << (BLOOM_LOG2 - 3)

    def places(keys: np.ndarray) -> np.ndarray:
        k = keys.astype(np.int64).view(np.uint64)
        return np.concatenate([(k * np.uint64(m)) >> np.uint64(64 - BLOOM_LOG2)
                               for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]).astype(np.int64)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(n_bytes * 8, dtype=bool)
        for pdf in batches:
            bits[places(pdf["row_key"].to_numpy())] = True
        data = np.packbits(bits).reshape(BLOCKS, -1)
        some = np.flatnonzero(data.any(axis=1))
        if len(some):
            yield pd.DataFrame({"block": some, "data": [data[k].tobytes() for k in some]})

    def either(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_bytes // BLOCKS, dtype=np.uint8)
        for pdf in pdfs:
            for blob in pdf["data"]:
                total |= np.frombuffer(blob, dtype=np.uint8)
        yield pd.DataFrame({"block": [key[0]], "data": [total.tobytes()]})

    bloom = np.zeros((BLOCKS, n_bytes // BLOCKS), dtype=np.uint8)
    for r in (wanted.mapInPandas(mark, "block int, data binary").groupBy("block")
              .applyInPandas(either, "block int, data binary").collect()):
        bloom[r["block"]] = np.frombuffer(r["data"], dtype=np.uint8)
    table = spark.sparkContext.broadcast(np.unpackbits(bloom.reshape(-1)).astype(bool))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = pdf["row_key"].to_numpy()
            hit = table.value[places(keys)].reshape(3, -1).all(axis=0)
            for part in chunks(pdf["text"][hit]):
                made = [h for h in hasher().shingles(part, SHINGLE) if len(h)]
                if made:
                    yield pd.DataFrame({"cls": [class_key(h) for h in made], "n": [len(h) for h in made],
                                        "grams": [h.tobytes() for h in made], "bits": [bitmap(h) for h in made]})

    whole = stage(spark, docs.select("row_key", "text").mapInPandas(sets, "cls long, n int, grams binary, bits array<long>"),
                  "sets")
    if not whole.groupBy("cls").count().filter("count > 1").isEmpty():  # repeated rows
        whole = whole.dropDuplicates(["cls"])
    # bitmaps first: each bit in which two sets differ stands for a gram that they do not share, so the
    # overlap is at most (x + y - differing bits) / 2; pairs that cannot reach the bound end here
    x, y = (whole.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0),
                         lambda t, n: t + n)
    most = (F.col("na") + F.col("nb") - differ) / 2
    pairs = (pairs.join(x, "a").join(y, "b").filter(most * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
             .select("a", "b"))

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            out.append(int((q[at] == p).sum()) >= reach(len(p), len(q), percent))
        return pd.Series(out, dtype=bool)

    a = whole.select(F.col("cls").alias("a"), F.col("grams").alias("ga"))
    b = whole.select(F.col("cls").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(a, "a").join(b, "b").filter(linked("ga", "gb")).select("a", "b")


def jaccard_components(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id per row; also ``component`` (one class of the component, null
    for texts without words) and ``row_key``, a hash of doc_id and text.

    Null texts and texts without words: no shingles, a component of their own (their doc_id).
    Equal texts, and equal shingle sets, are linked.  component_id is the smallest doc_id of the
    component; null doc_ids are rows like others but never the smallest, so a component of null
    ids alone has a null component_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("row_key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))))
    rows = stage(spark, incidence(spark, docs, percent), "incidence")
    filled = rows.filter(F.col("n") > 0)
    classes = filled.groupBy("cls").agg(F.first("n").alias("n"), F.first("common").alias("common"),
                                        F.first("head").alias("head"))
    keys = stage(spark, filled.groupBy("cls").agg(F.min("row_key").alias("row_key")), "class-keys")

    entries = classes.select(F.posexplode("head").alias("pos", "gram"), "cls", "n", "common")
    entries = entries.repartition("gram").sortWithinPartitions("gram", "n", "cls")
    entry = "gram long, cls long, n int, pos int, common int"
    shared = stage(spark, entries.select("gram", "cls", "n", "pos", "common").mapInPandas(hub_pairs(percent), f"{entry}, hub long"),
                   "columns")
    first = (shared.filter(F.col("hub").isNotNull())
             .select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b"))
             .distinct())
    first = stage(spark, first, "pairs")
    edges = stage(spark, linked_pairs(spark, docs, keys, first, percent), "links")
    label = connected_components(spark, edges)

    named = shared.join(label, F.col("cls") == F.col("node"), "left").select(
        "gram", "cls", "n", "pos", "common", F.coalesce("label", "cls").alias("label"))
    mixed = (named.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .filter(F.col("lo") != F.col("hi")).select("gram"))
    open_columns = named.join(mixed, "gram", "left_semi").repartition("gram").sortWithinPartitions("gram", "n", "cls")
    second = (open_columns.mapInPandas(cross_pairs(percent), "a long, b long").distinct()
              .join(first, ["a", "b"], "left_anti"))
    more = linked_pairs(spark, docs, keys, stage(spark, second, "pairs"), percent)
    label = connected_components(spark, edges.union(more))

    placed = (rows.drop("head", "common")
              .join(label, F.col("cls") == F.col("node"), "left")
              .select("doc_id", "row_key", F.col("n").cast("long").alias("n_shingles"),
                      F.coalesce("label", "cls").alias("component")))
    least = placed.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
        .alias("component_id"), "component", "row_key")


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component the row of the
    smallest doc_id stays (null ids last, then by a hash of the text).  Rows without words stay."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce("text", F.lit("")))
    found = stage(spark, jaccard_components(spark, docs, percent), "components")
    best = found.filter(F.col("component").isNotNull()).groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best"))
    times = found.groupBy("row_key").agg(F.count(F.lit(1)).alias("times"))
    keep = (best.select(F.col("best.row_key").alias("row_key")).join(times, "row_key")
            .union(found.filter(F.col("component").isNull()).select("row_key").distinct()
                   .withColumn("times", F.lit(1).cast("long"))))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.select(whole.alias("doc"), key.alias("row_key")).join(keep, "row_key")
    # equal rows (same doc_id and text) share a key: the first by the other columns stays
    first = W.partitionBy("row_key").orderBy(F.col("doc"))
    several = (kept.filter(F.col("times") > 1).withColumn("place", F.row_number().over(first))
               .filter(F.col("place") == 1).drop("place"))
    return kept.filter(F.col("times") == 1).union(several).select("doc.*")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read(spark, sf_dir, "documents")).drop("row_key", "component")


ORACLE = {}
QUERIES = {"op5_ngram_join": op5_ngram_join}
