"""Operator 12: prefix trie of conversations, totals rolled up in bands of depths.

A node is a distinct sequence of first turns.  Its key is (depth, 128 bits): the exclusive or of a
hash of (place, role, text) over its turns, so a key needs no walk along the conversation, a parent's
key is the node's without its last turn, and a conversation of any length is cut into blocks whose
parts are put together afterwards.  Two different sequences share a key with probability 2^-120.

Subtree totals come in depth bands of ``band`` levels.  A node explodes to its ancestors inside its
band only (at most ``band`` rows, however deep the trie is).  The band roots now hold the sums of
their bands; they form a trie of their own, ``band`` times shallower, which is summed the same way,
until one band holds all.  Then the completed totals of the band roots go down level by level: each
explodes to the ancestors in the band above it.  A trie of depth d takes 2 log_band(d) rounds.

Hot keys: turns are ordered by ranges (a conversation with many turns is spread over partitions, its
turns counted across them), nodes are counted with partial sums, ids that end at one node are hashed
as a stream of blocks of 4096 ids, and the few parents with a large share of all children are joined
by broadcast (at most 1000, as each has a thousandth of all nodes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pawgrid.llm.common import read, stage

BAND = 16
BLOCK = 512       # turns of a conversation hashed in one window
GROUP = 100       # conversations that share the first turns of one of them
HEADS = 6         # a conversation takes 0 to HEADS - 1 of those turns
ENDS_LOG2 = 12    # ids 4096 apart are in different blocks of an ends list
HOT_SHARE = 1000  # a parent with a thousandth of all nodes as children is joined by broadcast
KEY = ["depth", "x1", "x2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, gid (order of the turns: by turn, null first, ties by content), d1, d2, chars.

    ``gid`` numbers the rows of a sorted partition (partition << 33 + row)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    bits = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), bits(1).alias("d1"),
        bits(16).alias("d2"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("copy"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2"), F.col("copy")]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("conv_id", "d1", "d2", "chars", F.monotonically_increasing_id().alias("gid")))


def rebuilt_turns(spark: SparkSession, conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, pos (0: before any turn), k1, k2 (hash of place and turn), chars, n_turns.

    The first h turns are those of conversation c - c % group, h = crc32(c) % heads; c's own turns
    after its first h follow.  Every conversation has a row of place 0, also one without turns."""
    part, row = F.shiftright("gid", 33), F.col("gid").bitwiseAND(F.lit((1 << 33) - 1))
    rows = stage(spark, ordered_turns(conversations), "turns").withColumn("part", part).withColumn("row", row).drop("gid")
    whole = W.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(group))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    info = (rows.groupBy("conv_id", "part").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n"))
            .select("conv_id", "part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                    F.sum("n").over(whole).alias("n_own"), base.alias("base"), h.alias("h")))
    sizes = info.where((F.col("before") == 0) & (F.col("base") == F.col("conv_id"))).select("base", F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    info = stage(spark, info.join(sizes, "base", "left").select(
        "conv_id", "part", "low", "before", "base", "h", taken.alias("m"),
        (taken + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("n_turns")), "conversations")
    placed = (rows.join(info, ["conv_id", "part"])
              .withColumn("at", F.col("row") - F.col("low") + F.col("before")))
    own = placed.where(F.col("at") >= F.col("h")).select(
        "conv_id", (F.col("m") + F.col("at") - F.col("h") + 1).alias("pos"), "d1", "d2", "chars", "n_turns")
    lent = (placed.where((F.col("base") == F.col("conv_id")) & (F.col("at") < heads - 1))
            .select("base", "at", "d1", "d2", "chars"))
    convs = info.where(F.col("before") == 0)  # one row each
    borrowed = convs.join(lent, "base").where(F.col("at") < F.col("m")).select(
        "conv_id", (F.col("at") + 1).alias("pos"), "d1", "d2", "chars", "n_turns")
    turns = own.unionByName(borrowed).select(
        "conv_id", "pos", F.xxhash64("pos", "d1", "d2").alias("k1"), F.xxhash64("d2", "pos", "d1", F.lit(1)).alias("k2"),
        "chars", "n_turns")
    zero = F.lit(0).cast("long")
    start = convs.select("conv_id", zero.alias("pos"), zero.alias("k1"), zero.alias("k2"), zero.alias("chars"), "n_turns")
    return turns.unionByName(start)


def prefix_keys(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, x1, x2 (key), p1, p2 (the parent's), chars, ends: one row per place of a conversation."""
    cut = turns.withColumn("block", F.floor(F.col("pos") / block))
    inside = W.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (cut.where(F.col("n_turns") >= block).groupBy("conv_id", "block")
              .agg(F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"))
              .select("conv_id", "block", F.bit_xor("b1").over(earlier).alias("b1"), F.bit_xor("b2").over(earlier).alias("b2"))
              .where(F.col("block") > 0))
    running = (cut.withColumn("x1", F.bit_xor("k1").over(inside)).withColumn("x2", F.bit_xor("k2").over(inside))
               .join(blocks, ["conv_id", "block"], "left"))
    x1, x2 = (F.col(f"x{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2))
    return running.select("conv_id", F.col("pos").alias("depth"), x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("k1")).alias("p1"),
                          x2.bitwiseXOR(F.col("k2")).alias("p2"), "chars", (F.col("pos") == F.col("n_turns")).alias("ends"))


def _chains(paths: DataFrame, step: int, band: int) -> DataFrame:
    """conv_id, depth, up: the keys at the depths of its band (multiples of ``step``) down to its own."""
    inside = W.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (paths.where(F.col("depth") % step == 0).withColumn("band", F.floor(F.col("depth") / (step * band)))
            .select("conv_id", "depth", F.collect_list(F.struct("depth", "x1", "x2")).over(inside).alias("up")))


def _to_ancestors(part: DataFrame, chains: DataFrame, values: list[str]) -> DataFrame:
    """A row of ``values`` for each key in the chain of a row (conv_id, depth) of ``part``; conv_id stays on its own key."""
    return (part.join(chains, ["conv_id", "depth"])
            .select(F.explode("up").alias("a"), "depth", "conv_id", *values)
            .select("a.depth", "a.x1", "a.x2", *values, F.when(F.col("a.depth") == F.col("depth"), F.col("conv_id")).alias("conv_id")))


def subtree_totals(spark: SparkSession, nodes: DataFrame, paths: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """depth, x1, x2 and each of ``values`` summed over the node's subtree, in depth bands.

    ``nodes`` has a row per node with a member (conv_id), ``paths`` the keys along every member."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    total = lambda df: df.groupBy(*KEY).agg(*[F.sum(v).alias(v) for v in values], F.min("conv_id").alias("conv_id"))
    levels, step, part = [], 1, nodes.select("conv_id", *KEY, *values)
    while True:  # up: the sums of ever larger bands
        inside = total(_to_ancestors(part.drop("x1", "x2"), _chains(paths, step, band), values))
        if step * band > deepest:
            break
        inside = stage(spark, inside, "bands")
        levels.append((step, inside))
        step *= band
        part = inside.where(F.col("depth") % step == 0)
    done = inside
    for step, inside in reversed(levels):  # down: completed totals of band roots to the band above
        done = stage(spark, done, "totals")
        roots = done.where(F.col("depth") > 0).select("conv_id", (F.col("depth") - step).alias("depth"), *values)
        above = _to_ancestors(roots, _chains(paths, step, band), values)
        done = total(inside.unionByName(above.withColumn("conv_id", F.lit(None).cast("long"))))
    return done.drop("conv_id")


def ends_hashes(paths: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256: the conversations that end at a node, by number, as one stream of blocks."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = (paths.where("ends").groupBy(*KEY, F.shiftright("conv_id", ENDS_LOG2).alias("block")).agg(ids.alias("ids"))
              .repartition(*KEY).sortWithinPartitions(*KEY, "block"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for pdf in batches:
            out = []
            for *at, ids in zip(pdf["depth"], pdf["x1"], pdf["x2"], pdf["ids"]):
                if at == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = at, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=[*KEY, "ends_sha256"])

    return blocks.mapInPandas(digest, "depth long, x1 long, x2 long, ends_sha256 string")


def conversation_trie(spark: SparkSession, conversations: DataFrame, group: int = GROUP, heads: int = HEADS,
                      band: int = BAND, block: int = BLOCK) -> DataFrame:
    """One row per trie node of the rebuilt conversations: conv_id (smallest member; the node's turns are
    its first ``depth`` ones), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the node's key (x1, x2).

    Null roles and texts are empty; rows without a conv_id are left out; turns of equal number
    (repeated rows too) follow each other by content; other columns are ignored.  An empty table has
    no node, not even the root.  Conversations without a turn left count at the root.
    """
    paths = stage(spark, prefix_keys(rebuilt_turns(spark, conversations, group, heads), block), "paths")
    ended = F.sum(F.col("ends").cast("long"))
    n = F.count(F.lit(1))
    nodes = stage(spark, paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), n.alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        (n == ended).cast("long").alias("n_leaves"), ((n - 1) * F.min("chars")).alias("saved_tokens")), "nodes")
    n_nodes = nodes.count()
    kids = (nodes.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
            .agg(F.count(F.lit(1)).alias("n_children")))
    full = stage(spark, nodes.drop("n_leaves", "saved_tokens").join(kids, KEY, "left")
                 .join(subtree_totals(spark, nodes, paths, ["n_leaves", "saved_tokens"], band), KEY)
                 .join(ends_hashes(paths), KEY, "left"), "trie")
    parents = full.where(F.col("n_children") > 0).select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), "conv_id", "n_children")
    # sum of n_children < n_nodes: at most HOT_SHARE parents pass this test
    hot = F.broadcast(parents.where(F.col("n_children") * HOT_SHARE >= n_nodes)
                      .select("depth", "p1", "p2", F.col("conv_id").alias("hot_parent")))
    near = full.join(hot, ["depth", "p1", "p2"], "left")
    found = F.col("hot_parent").isNotNull() | (F.col("depth") == 0)
    own = lambda a, b: F.when(found, F.col(b)).otherwise(F.col(a))  # noqa: E731 - found rows spread by their own key
    near = near.withColumn("at", F.when(found, F.lit(-1).cast("long")).otherwise(F.col("depth"))).withColumn("q1", own("p1", "x1")) \
        .withColumn("q2", own("p2", "x2"))
    cold = parents.select(F.col("depth").alias("at"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    empty = hashlib.sha256().hexdigest()
    return near.join(cold, ["at", "q1", "q2"], "left").select(
        "conv_id", "depth", F.coalesce("hot_parent", "parent").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "x1", "x2")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark, read(spark, sf_dir, "conversations")).drop("x1", "x2")


ORACLE: dict[str, str] = {}
QUERIES = {"op12_conversation_trie": op12_conversation_trie}
