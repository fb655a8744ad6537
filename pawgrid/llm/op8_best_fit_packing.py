"""Operator 8: best-fit-decreasing packing of tokenised documents into sequences.

Best-fit decreasing looks at nothing but lengths, and there are at most ``capacity`` of them.  So
the whole corpus is planned at once from the histogram of piece lengths (at most 4096 rows on the
driver, whatever the corpus): lengths in falling order; for each, a segment tree over remaining
capacities gives the tightest open bin, and all bins of that capacity are filled together, which is
what the one-by-one algorithm does since a bin that still fits the length stays the tightest.  The
plan is a list of moves ``(length, first rank, pieces, first bin, pieces per bin, offset)``.

On the executors each piece gets its rank among the pieces of its length and reads its bin and
offset off the move that holds the rank.  Ranks are made per (length, hash bucket) and shifted by
the counts of the buckets before, so a length that a third of all pieces share is not one task.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawgrid.llm.common import read, stage, worker_state
from pawgrid.llm.tokenizing import SEPARATORS, UnitCache, make_tokenizer, tokenizer_json

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
BUCKETS = 1024
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..n: is any bin open there?"""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, i: int, value: bool) -> None:
        i += self.size
        while i and self.open[i] != value:
            self.open[i] = value
            i >>= 1
            value = self.open[2 * i] or self.open[2 * i + 1] if i else value

    def first_from(self, low: int) -> int | None:
        """The smallest open capacity >= low."""
        i = low + self.size
        if self.open[i]:
            return low
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan_moves(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over a length histogram; rows (length, rank, pieces, bin, per bin, offset)."""
    tree, bins, moves, fresh = CapacityTree(capacity), [deque() for _ in range(capacity + 1)], [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.first_from(length)
            if room is None:
                room = capacity
                first, n = fresh, -(-left // (capacity // length))
                fresh += n
            else:
                first, n = bins[room].popleft()
            each = room // length
            whole = min(n, left // each)
            put = [(first, whole, each)] if whole else []
            if whole < n and left - whole * each > 0 and not whole:
                put, whole = [(first, 1, left)], 1
            for b, k, per in put:
                moves.append((length, rank, k * per, b, per, capacity - room))
                rank, left = rank + k * per, left - k * per
                rest = room - per * length
                if rest:
                    bins[rest].append((b, k))
                    tree.set(rest, True)
            if whole < n:
                bins[room].appendleft((first + whole, n - whole))
            tree.set(room, bool(bins[room]))
    return np.array(moves, dtype=np.int64).reshape(-1, 6)


def little_endian(ids: list[int]) -> bytes:
    """Unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def lower_latin(word: str) -> bool:
    """Letters that the vocabulary's normaliser (NFC, lower case) leaves as they are."""
    return word.isascii() and word.islower() or max(word) <= "ÿ" and word == word.lower()


def tokenised_pieces(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
                     end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of the whole text, then ``end_id``, cut at ``capacity``."""
    source = spark.sparkContext.broadcast(tokenizer_json(tokenizer))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_state(f"packing_{tokenizer}", lambda: UnitCache(
            make_tokenizer(source.value), little_endian, lower_latin))
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                text = text if isinstance(text, str) else ""
                if SEPARATORS.search(text):
                    blob = cache.encode([text])[0] + end
                else:
                    if "<|" not in text:
                        try:  # Latin-1 lower-cases alike here and in the library; other texts keep their case
                            text.encode("latin-1")
                            text = text.lower()
                        except UnicodeEncodeError:
                            pass
                    units = text.split()
                    cache.trim()
                    cache.learn(set(units))
                    blob = b"".join(map(cache.known.__getitem__, units)) + end
                for piece, at in enumerate(range(0, len(blob), 4 * capacity)):
                    part = blob[at:at + 4 * capacity]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, PIECE_SCHEMA)


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Adds sequence_id and offset to staged (doc_id, piece, start, length, ids_crc32) rows."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves = plan_moves(counts, capacity)  # at most one histogram row per length, so its size is bound by capacity
    moves = moves[np.lexsort((moves[:, 1], moves[:, 0]))]
    table = spark.sparkContext.broadcast(moves)

    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    tally = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    shift = tally.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (spread.withColumn("rank", F.row_number().over(inside) - 1).join(shift, ["length", "bucket"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("rank") + F.col("shift")).cast("long").alias("rank")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = table.value
        key = (m[:, 0] << 48) + m[:, 1]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf.pop("rank").to_numpy(np.int64)
            row = m[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            at = rank - row[:, 1]
            pdf["sequence_id"] = row[:, 3] + at // np.maximum(row[:, 4], 1)
            pdf["offset"] = row[:, 5] + at % np.maximum(row[:, 4], 1) * length
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf

    return ranked.mapInPandas(place, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def best_fit_packing(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY,
                     end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone.  Repeated rows (and null doc_ids) are
    packed as rows of their own.  An empty table gives no rows.
    """
    pieces = stage(spark, tokenised_pieces(spark, docs, tokenizer, capacity, end_id), "pieces")
    return pack(spark, pieces, capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark, read(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
