"""Joins: left join with overlap suffixes (JN1–JN2), the 3-way enrichment.

All joins are equi-joins on the key; the physical strategy (broadcast when a side is small at
runtime, else sort-merge) is left to AQE.  Nothing is broadcast on a guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_suffixed(left: DataFrame, right: DataFrame, key: str,
                       suffixes: tuple[str, str] = ("_x", "_y"), salts: int = 0,
                       hot_fraction: float = 1e-4, split: bool = True) -> DataFrame:
    """JN1 + JN2: left join on ``key``; non-key names present on both sides get ``_x`` (left)
    and ``_y`` (right), as a dataframe merge does.  1:N fan-out is kept.

    By default the join runs as ``split_left_join`` (AQE can split a hot key on either side);
    ``salts > 1`` switches to ``salted_left_join`` (no reliance on AQE); ``split=False`` is the
    plain left join."""
    overlap = [c for c in right.columns if c in left.columns and c != key]
    lx = left.withColumnsRenamed({c: c + suffixes[0] for c in overlap}) if overlap else left
    ry = right.withColumnsRenamed({c: c + suffixes[1] for c in overlap}) if overlap else right
    if salts > 1:
        return salted_left_join(lx, ry, key, salts, hot_fraction)
    if split:
        return split_left_join(lx, ry, key)
    return lx.join(ry, on=key, how="left")


def split_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join written as (inner join) + (left rows without a match), same answer.

    AQE's skew-join handling splits an oversized partition only on a side whose rows may be
    replicated safely: for a left join that is the left side alone, so a key holding a third
    of the *right* rows (the 1:N side) would stay in one task.  An inner join may be split on
    either side, and the unmatched rows come from an anti join against the right's distinct
    keys, which partial aggregation collapses to one row per key per task before the shuffle.
    """
    matched = left.join(right, on=key, how="inner")
    unmatched = left.join(right.select(key).distinct(), on=key, how="left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def salt_hot_rows(right: DataFrame, hot: DataFrame, key: str, salts: int) -> DataFrame:
    """Adds ``__salt``: rows of hot keys are dealt over ``salts`` buckets by their position in the scan
    (equal rows too), others get 0.  ``right`` is a scan or a projection of one, whose row order is
    the same whenever a task is run again."""
    place = F.monotonically_increasing_id()
    return (right.withColumn("__place", place).join(hot, key, "left")
            .withColumn("__salt", F.when(F.col("__hot"), F.pmod("__place", F.lit(salts))).otherwise(F.lit(0)).cast("long"))
            .drop("__hot", "__place"))


def heavy_keys(df: DataFrame, key: str, fraction: float = 1e-4, groups: int = 256) -> DataFrame:
    """``(key, n)``: the keys that hold more than about ``fraction`` of the rows, with their counts.

    Counted with mergeable frequent-item sketches in one pass and without a shuffle of the keys: a task sends one
    sketch, ``groups`` tasks merge them, one merges the rest.  A sketch tracks ``8 / fraction`` keys (a million at
    most, the function's limit) and errs by less than half of ``fraction``, so a key of half as many rows may be listed
    and one of more than ``1.5 * fraction`` is.  At most ``1 / fraction`` keys are returned.  Null keys
    are left out; an empty table gives no rows."""
    tracked, most = min(int(8 / fraction) + 1, 1_000_000), min(max(1, int(1 / fraction)), 100_000)
    seen = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    parts = (seen.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g"))
             .agg(F.call_function("approx_top_k_accumulate", F.col("k"), F.lit(tracked)).alias("s"), F.count(F.lit(1)).alias("n")))
    whole = (parts.groupBy(F.lit(0).alias("g")).agg(F.call_function("approx_top_k_combine", F.col("s"), F.lit(tracked)).alias("s"),
                                                    F.sum("n").alias("rows")))
    top = whole.select("rows", F.explode(F.call_function("approx_top_k_estimate", F.col("s"), F.lit(most))).alias("t"))
    often = F.col("t.count") > F.greatest(F.lit(1).cast("long"), F.floor(F.col("rows") * fraction))
    return top.where(often).select(F.col("t.item").alias(key), F.col("t.count").alias("n"))


def salted_left_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16,
                     hot_fraction: float = 1e-4) -> DataFrame:
    """Left join that stays balanced when one key holds a large share of the right side.

    AQE can split a skewed partition only on the preserved (left) side of a left join, so a
    hot key on the right would land in one task.  Keys holding more than ``hot_fraction`` of
    the right rows are found first by :func:`heavy_keys` (at most ``1 / hot_fraction`` of them, so
    broadcasting that list has a proven bound; no action runs here); their right rows are spread over
    ``salts`` buckets and their left rows are replicated once per bucket.  The salted inner join plus
    the left rows without any match (anti join against the distinct right keys, which partial aggregation
    shrinks before the shuffle) equals the plain left join, whatever keys the sketch lists.
    """
    hot = F.broadcast(heavy_keys(right, key, hot_fraction).select(key, F.lit(True).alias("__hot")))
    r = salt_hot_rows(right, hot, key, salts)
    l = (left.join(hot, key, "left")
         .withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                         .otherwise(F.array(F.lit(0))).cast("array<long>")))
         .drop("__hot"))
    matched = l.join(r, [key, "__salt"], "inner").drop("__salt")
    unmatched = left.join(right.select(key).distinct(), key, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def enrich(base: DataFrame, subs: list[DataFrame], key: str = "uid", salts: int = 0,
           hot_fraction: float = 1e-4, unique: list[bool] | None = None) -> DataFrame:
    """Chain of suffixed left joins; a later table is compared with the already-suffixed names.

    ``unique[i]`` declares that sub table ``i`` holds at most one row per key (e.g. it was
    aggregated by the key): no key can be hot there, so it joins with a plain left join and the
    chain so far is read once.  Other subs use the hot-key-safe strategy (split or salted)."""
    out = base
    for i, s in enumerate(subs):
        one_per_key = bool(unique and unique[i])
        out = left_join_suffixed(out, s, key, salts=0 if one_per_key else salts, hot_fraction=hot_fraction,
                                 split=not one_per_key)
    return out
