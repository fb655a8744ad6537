"""Aggregations (AGG1–AGG14): value counts, shares, facets, length stats, null profile, summary.

Every facet is a ``groupBy`` with map-side partial aggregation, so a hot value costs one
partial row per task, never a hot task.  Top-n uses ``orderBy().limit()``
(TakeOrderedAndProject).  Outputs are tidy ``(facet, key, n)`` frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions.classes import age_bucket, size_class_c


def value_counts(df: DataFrame, col: str | Column, name: str = "key") -> DataFrame:
    """AGG1: counts of non-null values, most frequent first (ties by key)."""
    c = F.col(col) if isinstance(col, str) else col
    return (df.select(c.alias(name)).where(F.col(name).isNotNull())
            .groupBy(name).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(name)))


def share(df: DataFrame, col: str) -> DataFrame:
    """AGG2: per value count and percentage of all rows (nulls form their own key).

    The total is a scalar subquery of the plan (a column-pruned count), so nothing runs before the
    caller's action and the grouped counts stay distributed whatever their number."""
    counts = df.groupBy(F.col(col).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    return counts.select("key", "n", F.round(F.col("n") * 100.0 / total, 6).alias("pct"))


def state_share(df: DataFrame, state_col: str = "state") -> DataFrame:
    """AGG2: per state count and share of all listings (the open ratio is the open row)."""
    return share(df, state_col)


def result_facets(df: DataFrame, top_regions: int = 10) -> DataFrame:
    """AGG3–AGG6: total, sex, age bucket, weight bucket, care type, top-10 region counts.

    Output ``(facet, key, n)``; the total is facet ``total`` with key ``all`` (and n = 0 for an
    empty input).  One scan: every row emits one ``(facet, key)`` pair per facet and a single
    ``groupBy`` counts them (partial aggregation before the shuffle, so a hot value costs one
    row per task); the region facet keeps its top ``top_regions`` with a window over the
    per-facet counts, which are bounded by the number of distinct values."""
    def pair(facet: str, key: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), key.cast("string").alias("key"))

    pairs = F.array(
        pair("total", F.lit("all")),
        pair("gender", F.col("gender")),
        pair("age", age_bucket("age")),
        pair("weight", size_class_c("weight")),
        pair("care_type", F.col("care_type")),
        pair("region", F.col("rescue_location")),
    )
    rows = (df.select(F.explode(pairs).alias("p")).select("p.facet", "p.key").where(F.col("key").isNotNull())
            .withColumn("w", F.lit(1)))
    # one zero-weight total row, so an empty input still reports total = 0
    zero = df.sparkSession.range(1).select(F.lit("total").alias("facet"), F.lit("all").alias("key"),
                                           F.lit(0).alias("w"))
    counted = rows.unionByName(zero).groupBy("facet", "key").agg(F.sum("w").cast("long").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.asc("key")))
    return (counted.withColumn("__rn", rank)
            .where((F.col("facet") != "region") | (F.col("__rn") <= top_regions))
            .select("facet", "key", "n"))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """AGG6: the ``n`` most frequent values."""
    return value_counts(df, col).limit(n)


def length_stats(df: DataFrame, text_col: str) -> DataFrame:
    """AGG7: mean, max, min characters of a text column."""
    ln = F.char_length(text_col)
    return df.agg(F.round(F.avg(ln), 6).alias("avg_chars"), F.max(ln).cast("long").alias("max_chars"),
                  F.min(ln).cast("long").alias("min_chars"), F.count(F.lit(1)).alias("n_rows"))


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """AGG8: nulls per column in one scan, tidy ``(column, nulls)``."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column, nulls)")


def weight_scans(raw: DataFrame, col: str = "addinfo07", cleaned: Column | None = None,
                 outlier: float = 100.0) -> DataFrame:
    """FLT20 + FLT21: count of cleaned weights above ``outlier`` and of raw texts containing '-'."""
    from pawgrid.functions.classes import clean_positive_number
    w = cleaned if cleaned is not None else clean_positive_number(col)
    return raw.agg(F.count_if(w > outlier).alias("over_limit"),
                   F.count_if(F.col(col).cast("string").contains("-")).alias("with_dash"),
                   F.count(F.lit(1)).alias("n_rows"))


def summary(df: DataFrame, open_value: str = K.OPEN_STATE) -> DataFrame:
    """AGG9: total, open, mean age, mean weight (rounded to 6 places) in one scan."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == F.lit(open_value)).alias("available"),
        F.round(F.avg("age"), 6).alias("average_age"),
        F.round(F.avg("weight"), 6).alias("average_weight"),
    )


def full_summary(df: DataFrame, open_value: str = K.OPEN_STATE, top: int = 10) -> DataFrame:
    """AGG9 + PIPE8: ``summary`` with the sex, care-type and region distributions and the ``top`` most
    frequent regions and care types, tidy ``(facet, key, n)``."""
    one = summary(df, open_value)
    names = ["total", "available", "average_age", "average_weight"]
    totals = one.select(F.explode(F.array(*[F.struct(F.lit("all").alias("facet"), F.lit(c).alias("key"),
                                                     F.col(c).cast("double").alias("n")) for c in names])).alias("p")).select("p.*")
    sides = {"sex": "gender", "care_type": "care_type", "region": "rescue_location"}
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("key")) for f, c in sides.items()])
    counts = (df.select(F.explode(pairs).alias("p")).select("p.facet", "p.key").where(F.col("key").isNotNull())
              .groupBy("facet", "key").agg(F.count(F.lit(1)).cast("double").alias("n")))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.asc("key")))
    leaders = (counts.where(F.col("facet").isin("region", "care_type")).withColumn("__rn", rank)
               .where(F.col("__rn") <= top).select(F.concat(F.lit("top_"), "facet").alias("facet"), "key", "n"))
    return totals.unionByName(counts).unionByName(leaders)


def distinct_tags(df: DataFrame, tags: str = "hashtags") -> DataFrame:
    """AGG10: every distinct tag (flattened), with its listing count."""
    return (df.select(F.explode(tags).alias("tag")).where(F.col("tag").isNotNull())
            .groupBy("tag").agg(F.count(F.lit(1)).alias("n")))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """AGG10: distinct non-null values of a column (regions)."""
    return df.select(F.col(col).alias("value")).where(F.col("value").isNotNull()).distinct()


def crawl_summary(items: DataFrame, group_col: str, name_col: str = K.PAGE_ITEM_NAME,
                  order_col: str | None = None, missing: str = K.CRAWL_NO_NAMES) -> DataFrame:
    """AGG11 / SNK2 rows: per crawl batch (``group_col``, e.g. the list page) the item count and
    the ', '-joined names ('N/A' for a missing/empty name), in ``order_col`` order.

    The name list is built per batch — a list page holds a bounded number of items — never for
    the whole table in one group."""
    name = F.when(F.col(name_col).isNull() | (F.col(name_col) == ""), F.lit(missing)).otherwise(F.col(name_col))
    order = F.col(order_col) if order_col else name
    return (items.groupBy(group_col)
            .agg(F.count(F.lit(1)).alias("collected_count"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), name.alias("v")))),
                                          lambda x: x["v"]), ", ").alias("animal_names")))
