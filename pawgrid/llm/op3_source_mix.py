"""Operator 3: mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

1. Sizes: words per document.  Per source: words, documents, weight, target (water-filling with a
   ceiling of ``max_repeat`` times the source).
2. The corpus is thought of as blocks of ``block_words`` words.  ``round(total / block_words)``
   blocks are given to the sources by highest quotients target / (2k - 1).  Rounding target / block
   is the outcome at divisor ``block``; the few blocks it is over or short are settled by ranking
   the quotients next to that point only, so the work does not grow with the number of blocks.
3. The blocks of a source are given to its shards in the same way, with the shards' words as votes.
4. In a shard the documents lie in seeded order on a line cut into m blocks.  A quota q takes every
   block ``q div m`` times and ``q mod m`` blocks once more, evenly from a seeded start.  How many
   words of a document lie in chosen blocks has a closed form, so no block is ever materialised.

Shards hold about ``shard_docs`` documents each, so a source with a third of all rows is spread
over many windows.  Rows outside any window are (source) or (source, shard) totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawgrid.llm.common import WORD, read, stage

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 16
SHARD_DOCS = 256
SEED = 20


def _apportion(df: DataFrame, votes: str, seats: Column, divisor: Column, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``quota``: Sainte-Lague shares of ``seats`` among the rows of each ``by`` group.

    ``divisor`` is close to votes per seat.  Rounding at it misses the total by d seats; a row's
    final quota is within \\|d\\| of its rounded one, so only those quotients are ranked.
    """
    group = W.partitionBy(*by)
    near = F.floor(F.try_divide(votes, "_div") + 0.5).cast("long")
    df = (df.withColumn("_seats", seats).withColumn("_div", divisor)
          .withColumn("_near", F.coalesce(near, F.lit(0).cast("long")))
          .withColumn("_miss", F.abs(F.col("_seats") - F.sum("_near").over(group)))
          .withColumn("_low", F.greatest(F.lit(0).cast("long"), F.col("_near") - F.col("_miss")))
          .withColumn("_left", F.col("_seats") - F.sum("_low").over(group)))
    seat = df.filter((F.col("_miss") > 0) & (F.col(votes) > 0)).select(
        *by, *[c for c in order if c not in by], votes, "_left",
        F.explode(F.sequence(F.col("_low") + 1, F.col("_near") + F.col("_miss"))).alias("_k"))
    keys = [*by, *[c for c in order if c not in by]]
    rank = F.row_number().over(W.partitionBy(*by).orderBy(
        F.desc(F.col(votes) / (2 * F.col("_k") - 1)), *[F.col(c).asc_nulls_last() for c in order], "_k"))
    won = (seat.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_left"))
           .groupBy(*[F.col(c).alias(f"_w_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("_won")))
    out = df.join(won, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in keys], "left")
    quota = F.when(F.col("_miss") == 0, F.col("_near")).otherwise(F.col("_low") + F.coalesce("_won", F.lit(0)))
    return (out.withColumn("quota", quota.cast("long"))
            .drop("_seats", "_div", "_near", "_miss", "_low", "_left", "_won", *[f"_w_{c}" for c in keys]))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, n_docs, total, target) from ``(size, source)`` rows; one row per source.

    Sources in code-point order, null last, carry the weights in turn.  target = min(max_repeat *
    size, level * weight), with the level at which targets add up to all words: a source is at its
    ceiling exactly when filling everybody to its own ceiling/weight ratio stays within the total.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * max_repeat)
    s = s.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    whole = W.partitionBy(F.lit(1))
    below = whole.orderBy("_ratio").rangeBetween(W.unboundedPreceding, 0)
    s = (s.withColumn("total", F.sum("source_size").over(whole)).withColumn("_all", F.sum("weight").over(whole))
         .withColumn("_fill", F.sum("_cap").over(below)
                     + F.col("_ratio") * (F.col("_all") - F.sum("weight").over(below)))
         .withColumn("_full", F.col("_fill") <= F.col("total")))
    free_words = F.col("total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(F.lit(0))).over(whole)
    free_weight = F.sum(F.when(F.col("_full"), F.lit(0.0)).otherwise(F.col("weight"))).over(whole)
    s = s.withColumn("_level", F.try_divide(free_words, free_weight))
    target = F.when(F.col("_full") | F.col("_level").isNull(), F.col("_cap").cast("double")) \
        .otherwise(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight")))
    return s.withColumn("target", target).select("source", "source_size", "n_docs", "total", "target")


def mix_sources(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT,
                block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """Columns of ``docs`` (doc_id, text, source used) are reduced to: doc_id, size, source_size,
    target, taken, copies, row_key.

    ``taken`` counts the document's words in the mix, repeats included (0 to max_repeat * size).
    ``copies`` is the same decision in whole documents: it rounds the running sum of taken / size
    along the shard, so whole copies add up to the mix too.  Null text: size 0.  Null source: a
    source of its own, last.  Null doc_ids and repeated rows are ordinary rows.  Reruns agree.
    ``row_key`` = (doc_id, hash of the text), to join the decision back to the rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = stage(spark, docs.select(
        "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_key")), "mix-sizes")
    src = source_targets(sizes, weights, max_repeat).withColumn("_one", F.lit(1))
    src = _apportion(src, "target", F.floor(F.col("total") / block_words + 0.5).cast("long"),
                     F.lit(float(block_words)), ["_one"], ["source"])
    src = (src.withColumn("seats", F.col("quota"))
           .withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs).cast("long"))
           .select(F.col("source").alias("_src"), "source_size", "target", "seats", "n_shards"))
    src = stage(spark, src, "mix-sources")
    spot = F.xxhash64("doc_id", "text_key", F.lit(seed))
    rows = (sizes.join(src, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
            .withColumn("shard", F.pmod(spot, F.col("n_shards")))
            .withColumn("spot", F.xxhash64("doc_id", "text_key", F.lit(seed + 1))))
    shard = rows.groupBy("source", "shard").agg(
        F.sum("size").cast("long").alias("shard_size"), F.first("source_size").alias("source_size"),
        F.first("seats").alias("seats"))
    shard = _apportion(shard, "shard_size", F.col("seats"), F.try_divide("source_size", "seats"),
                       ["source"], ["shard"])
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("shard_size") / block_words).cast("long"))
    shard = (shard.withColumn("m", blocks)
             .withColumn("quota", F.least(F.col("quota"), F.col("m") * max_repeat))
             .select(F.col("source").alias("_src"), F.col("shard").alias("_shard"), "m", "quota"))
    rows = rows.join(shard, F.col("source").eqNullSafe(F.col("_src")) & (F.col("shard") == F.col("_shard")), "left")
    line = W.partitionBy("source", "shard").orderBy("spot", F.col("doc_id").asc_nulls_first(), "text_key") \
        .rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.sum("size").over(line)).withColumn("_start", F.col("_end") - F.col("size"))
    # whole rounds, extra blocks and the seeded start of the even pick
    m, b = F.col("m"), F.lit(block_words)
    rows = (rows.withColumn("_rounds", F.expr("quota div m")).withColumn("_extra", F.expr("quota % m"))
            .withColumn("_shift", F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), m)))
    pick = lambda x: F.floor((x * F.col("_extra") + F.col("_shift")) / m)  # noqa: E731  blocks before x that are picked

    def words_before(x: Column) -> Column:
        """Words on the line before position x that lie in picked blocks."""
        k = F.floor(x / b)
        return pick(k) * b + (pick(k + 1) - pick(k)) * (x - k * b)

    taken = F.col("_rounds") * F.col("size") + words_before(F.col("_end")) - words_before(F.col("_start"))
    rows = rows.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long"))
    own = F.coalesce(F.round(F.try_divide(F.col("taken") * (1 << 20), F.col("size"))), F.lit(0)).cast("long")
    share = F.sum(own).over(line)
    rows = rows.withColumn("_cum", share)
    start = F.pmod(F.xxhash64("source", "shard", F.lit(seed + 3)), F.lit(1 << 20))
    copies = F.floor((F.col("_cum") + start) / (1 << 20)) - F.floor((F.col("_cum") - own + start) / (1 << 20))
    return rows.select("doc_id", "size", "source_size", "target", "taken",
                       F.least(copies.cast("long"), F.lit(max_repeat).cast("long")).alias("copies"),
                       F.struct("doc_id", "text_key").alias("row_key"))


def mixed_documents(spark: SparkSession, docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes the whole document (0 to
    max_repeat times).  Equal rows share their copies evenly, rounded.  Texts without words add no
    words to a mix and are left out."""
    mix = mix_sources(spark, docs, **params)
    times = (mix.groupBy("row_key.doc_id", "row_key.text_key").agg(F.round(F.avg("copies")).cast("int").alias("times"))
             .filter(F.col("times") > 0).withColumnRenamed("text_key", "key"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"))
    rows = rows.join(times, (F.col("text_key") == F.col("key")) & F.col("doc.doc_id").eqNullSafe(times["doc_id"]))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, read(spark, sf_dir, "documents")).drop("row_key")


ORACLE: dict[str, str] = {}
QUERIES = {"op3_source_mix": op3_source_mix}
