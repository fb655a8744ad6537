"""Operator 2: one-permutation MinHash fingerprints (DataFrame functions only).

A text is its set of 5-word shingles (words ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text; a text of
1 to 4 words is one shingle, a text without words none).  Every shingle is hashed once; the top 8
bits of the hash choose one of 256 bins, the smallest hash of a bin represents it.  The smallest
are found by sorting the hashes together with one sentinel per bin (the bin's largest value): the
first element of each run of equal top bits is the bin's minimum, or the sentinel of an empty bin.

Empty bins are filled by densification: bin i takes the value of the first non-empty bin in its own
random order of bins.  The order starts with ``PROBES`` hashed probes and goes on by the hash of
(i, j) over the non-empty bins, so it ends whatever the number of bins that are filled.

Stored are the low 4 bits of each bin, 16 to a long, written as 256 hex digits.  Two unrelated bins
agree with probability 1/16, which the likeness corrects: (agreeing / 256 - 1/16) / (1 - 1/16).
A text without words has the empty fingerprint, alike (1.0) only to another empty one.

The successor of a document needs no global sort: quantiles cut the ids into up to ``SLICES`` slices of
about as many rows each, equal widths cut a slice into blocks of about 256, the successor is looked up inside the block, and a block's last row takes the head of the next block,
found in the same way one level up (blocks of blocks).
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawgrid.llm.common import read

SHINGLE = 5
BINS = 256  # bins by the top 8 bits
BITS = 4  # kept of each bin
PER_LONG = 16
PROBES = 24
BLOCK_ROWS = 256
SLICES = 256
BLANKS = " \t\n\x0b\f\r"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


SENTINELS = [_signed(((b << 56) | ((1 << 56) - 1)) & ((1 << 64) - 1)) for b in range(-BINS // 2, BINS // 2)]


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array of 16 longs holding the 256 packed codes; null for a text without words.

    Each step is a column of its own, read several times by the next, so the optimizer keeps them
    as separate projections and nothing is evaluated twice.
    """
    trimmed = F.btrim(F.lower(F.col(text)), F.lit(BLANKS))
    df = df.withColumn("_t", trimmed)
    df = df.withColumn("_w", F.when(F.col("_t") != "", F.split("_t", r"[\x20\x09-\x0D]+")))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_t", "_w")
    at = lambda i, j: F.get("_h", i + j)
    shingles = F.when(F.size("_h") >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size("_h") - SHINGLE), lambda i: F.xxhash64(*[at(i, j) for j in range(SHINGLE)]))) \
        .otherwise(F.array(F.xxhash64("_h", F.size("_h"))))
    df = df.withColumn("_s", F.when(F.col("_h").isNotNull(), F.sort_array(
        F.concat(shingles, F.array(*[F.lit(s) for s in SENTINELS]))))).drop("_h")
    top = lambda x: F.shiftright(x, 56)
    mins = F.filter("_s", lambda x, i: (i == 0) | (top(x) != top(F.get("_s", i - 1))))
    df = df.withColumn("_m", mins).drop("_s")
    low = F.lit((1 << 56) - 1)
    df = df.withColumn("_m", F.transform("_m", lambda x: F.when(x.bitwiseAND(low) != low, x)))
    # the non-empty bins, for the rest of the order
    df = df.withColumn("_full", F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get("_m", j).isNotNull()))
    probe = lambda i, t: F.get("_m", F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int"))
    rest = lambda i: F.get("_m", F.array_min(F.transform(
        "_full", lambda j: F.struct(F.xxhash64(i, j, F.lit(PROBES)).alias("h"), j.alias("j"))))["j"])
    value = lambda i: F.coalesce(F.get("_m", i), *[probe(i, t) for t in range(PROBES)], rest(i))
    mask = F.lit((1 << BITS) - 1)
    df = df.withColumn("_d", F.when(F.col("_m").isNotNull(), F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: value(i).bitwiseAND(mask)))).drop("_m", "_full")
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda k: functools.reduce(
        lambda x, y: x.bitwiseOR(y),
        [F.shiftleft(F.get("_d", k * PER_LONG + t), BITS * t) for t in range(PER_LONG)]))
    return df.withColumn(out, F.when(F.col("_d").isNotNull(), packed)).drop("_d")


def as_text(packed: str) -> Column:
    """The packed codes as hex digits; the empty string for a text without words."""
    return F.coalesce(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Bias-corrected share of agreeing bins, 0 to 1."""
    def unlike(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        any_bit = functools.reduce(lambda v, k: v.bitwiseOR(F.shiftrightunsigned(z, k)), range(1, BITS), z)
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    differ = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda total, n: total + n)
    chance = 1.0 / (1 << BITS)
    share = (F.lit(1.0) - differ / F.lit(float(BINS)) - chance) / (1 - chance)
    return (F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(1.0))
            .when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), share)))


def _successors(keys: DataFrame, levels: int) -> DataFrame:
    """(b, next) for distinct longs b: the next larger one, the smallest after the largest."""
    if not levels:
        whole = W.partitionBy(F.lit(0))
        return keys.select("b", F.coalesce(F.lead("b").over(whole.orderBy("b")), F.min("b").over(whole)).alias("next"))
    up = keys.withColumn("u", F.floor(F.col("b") / BLOCK_ROWS).cast("long"))
    heads = up.groupBy("u").agg(F.min("b").alias("head"))
    above = _successors(heads.select(F.col("u").alias("b")), levels - 1)
    jump = above.join(heads, above["next"] == heads["u"]).select(F.col("b").alias("u"), "head")
    inside = up.withColumn("next", F.lead("b").over(W.partitionBy("u").orderBy("b")))
    return inside.join(jump, "u").select("b", F.coalesce("next", "head").alias("next"))


def id_blocks(docs: DataFrame, block_rows: int) -> Column:
    """Block number of the long ``doc_id``, rising with it; null for null.  The driver sees at most SLICES ids."""
    ids = docs.select(F.col("doc_id").cast("long").alias("i")).filter(F.col("i").isNotNull())
    low, high, n = ids.agg(F.min("i"), F.max("i"), F.count(F.lit(1))).first()
    if not n:
        return F.lit(None).cast("long")
    slices = max(1, min(SLICES, math.ceil(n / block_rows)))
    cuts = ids.agg(F.percentile_approx("i", [k / slices for k in range(1, slices)], 10_000)).first()[0] if slices > 1 else []
    lows = sorted({low, *cuts})
    inside = max(1, math.ceil(n / slices / block_rows))
    widths = [max(1.0, (float(b) - float(a)) / inside) for a, b in zip(lows, [*lows[1:], high + 1])]
    at = F.size(F.filter(F.array(*map(F.lit, lows)), lambda x: x <= F.col("doc_id")))
    pick = F.get(F.array(*[F.struct(F.lit(k * inside).cast("long").alias("base"), F.lit(float(a)).alias("low"), F.lit(w).alias("width"))
                           for k, (a, w) in enumerate(zip(lows, widths))]), at - 1)
    return F.when(F.col("doc_id").isNotNull(), pick["base"] + F.least(
        F.floor((F.col("doc_id").cast("double") - pick["low"]) / pick["width"]).cast("long"), F.lit(inside - 1).cast("long")))


def fingerprint_documents(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row.

    Null texts count as empty.  Order: null doc_ids first (by a hash of the text), then doc_id;
    rows of one doc_id by the text's hash, then the text.  A single row follows itself.  An empty
    table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    block = F.coalesce(id_blocks(docs, block_rows), -1 - F.pmod(F.xxhash64("text"), F.lit(4096)))
    rows = rows.withColumn("block", block).withColumn("key", F.xxhash64("text"))

    after = _successors(rows.select(F.col("block").alias("b")).distinct(), 2)
    order = W.partitionBy("block").orderBy("doc_id", "key", "text")
    # all but each task's first row of a block are left out before the heads are shuffled
    heads = (rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") == 1)
             .select(F.col("block").alias("hb"), F.col("text").alias("head_text")))
    heads = with_fingerprint(heads, "head_text", "head_fp")
    jump = after.join(heads, F.col("next") == F.col("hb")).select(F.col("b").alias("block"), "head_text", "head_fp")
    rows = with_fingerprint(rows, "text", "fp")
    rows = rows.withColumn("after", F.lead(F.struct("text", "fp")).over(order))
    rows = rows.join(jump, "block", "left")
    last = F.col("after").isNull()
    rows = rows.select("doc_id", "text", "fp", F.length("text").cast("long").alias("n_chars"),
                       F.when(last, F.col("head_text")).otherwise(F.col("after.text")).alias("next_text"),
                       F.when(last, F.col("head_fp")).otherwise(F.col("after.fp")).alias("next_fp"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    rows = rows.withColumn("edited", edited).drop("text", "next_text")
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"),
                       as_text("edited_fp").alias("edited_fingerprint"),
                       likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_fingerprints": op2_fingerprints}
