"""Registered queries of the pivot index, of records with open labels and of profile tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.operators import pages as PG
from pawgrid.operators import pivots as PV
from pawgrid.operators import preferences as PR
from pawgrid.plans import adapters as A
from pawgrid.plans import sqltext as X
from pawgrid.plans.catalog import _LABELS, _SCAN_HTML, ORACLE, SITE, _items, _topk_sql, composed_list_pages, register
from pawgrid.plans.crawl import open_crawl_table, scan_list_pages_in_ranges
from pawgrid.session import run_path


def pivot_search(spark: SparkSession, d: str, k: int = 10, filtered: bool = False) -> PV.PivotSearch:
    """Every stored vector against the open listings, as in ``catalog.recommend``, through the index."""
    queries = A.vector_queries(spark, d)
    if filtered:
        queries = queries.withColumn("slot_group", PR.slot_group())
    index = PV.build_index(_items(spark, d, with_mask=filtered), i_mask="slot_mask" if filtered else None)
    return PV.pivot_top_k(queries, index, k, q_group="slot_group" if filtered else None)


@register("recommend_topk_pivots", _topk_sql(False))
def q_recommend_topk_pivots(spark: SparkSession, d: str) -> DataFrame:
    """EMB4 + WIN1: the rows of recommend_topk without scoring every pair."""
    return pivot_search(spark, d).result.withColumn("similarity", F.round("similarity", 6))


@register("recommend_topk_pivots_filtered", _topk_sql(True))
def q_recommend_topk_pivots_filtered(spark: SparkSession, d: str) -> DataFrame:
    """JN5 on the index: cells without an eligible item for the query's slots are skipped too."""
    return pivot_search(spark, d, filtered=True).result.withColumn("similarity", F.round("similarity", 6))


@register("pivot_work", "SELECT (SELECT count(*) FROM embeddings) * (SELECT count(*) FROM part WHERE p_partkey % 4 <> 3) "
          "AS all_pairs, true AS no_pair_twice")
def q_pivot_work(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of queries and items, and that the index scored none twice (a table of a few cells may need all)."""
    return pivot_search(spark, d).work.select("all_pairs", (F.col("scored_pairs") <= F.col("all_pairs")).alias("no_pair_twice"))


# ================================================================================================
# Records whose labels nobody listed (SRC8, PG12, PIPE9)
# ================================================================================================
_MORE = {**_LABELS,
         "참고용정보_색상": ("p_partkey % 3 = 0", "p_brand"),
         "참고용정보_비고1": ("p_partkey % 5 = 2 AND p_partkey % 2 = 1", "p_type"),
         "참고용정보_비고0": ("p_partkey % 5 = 2 AND p_partkey % 2 = 0", "p_type")}
_ASKED = ["종류", "크기"]


def extended_pages(spark: SparkSession, d: str) -> DataFrame:
    """The composed detail pages with further labels on some: a colour, and a remark whose label varies."""
    k = F.col("p_partkey")
    item = lambda label, value: F.concat(
        F.lit('<li><p class="t_bef">'), label, F.lit('</p><p class="a">'), value, F.lit("</p></li>"))
    more = F.concat(F.when(k % 3 == 0, item(F.lit("색상"), F.col("p_brand"))).otherwise(F.lit("")),
                    F.when(k % 5 == 2, item(F.concat(F.lit("비고"), (k % 2).cast("string")), F.col("p_type"))).otherwise(F.lit("")))
    part = A.table(spark, d, "part").select(k.alias("page_id"), more.alias("more"))
    pages = A.detail_pages(spark, d).join(part, "page_id")
    return pages.select(F.concat(F.lit(f"{SITE}/d/"), F.col("page_id").cast("string")).alias("page_id"),
                        F.replace("html", F.lit("</ul>"), F.concat("more", F.lit("</ul>"))).alias("html"))


def _value_sql(label: str) -> str:
    has, value = _MORE[label]
    return f"CASE WHEN {has} THEN {value} END"


_REST_SQL = ", ".join(f"CASE WHEN {has} THEN {X.q(label)} || '=' || coalesce({value}, '-') END" for label, (has, value) in _MORE.items()
                      if label not in (*_ASKED, K.PAGE_ITEM_NAME, K.PAGE_KEY_NOTICE))


@register("crawl_table_open",
          "SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS page_id, "
          "CAST(row_number() OVER (PARTITION BY floor(p_partkey / 10) ORDER BY p_partkey) - 1 AS BIGINT) AS pos, "
          f"'{SITE}/d/' || CAST(p_partkey AS VARCHAR) AS \"{K.PAGE_ITEM_LINK}\", "
          + ", ".join(f"{_value_sql(c)} AS \"{c}\"" for c in (K.PAGE_ITEM_NAME, K.PAGE_KEY_NOTICE, *_ASKED))
          + f", array_to_string(list_sort(list_filter([{_REST_SQL}], lambda x: x IS NOT NULL)), '; ') AS others FROM part")
def q_crawl_table_open(spark: SparkSession, d: str) -> DataFrame:
    """PG12 + SRC8: two labels asked for, all others (three of them listed nowhere) kept in the map."""
    out = open_crawl_table(composed_list_pages(spark, d), extended_pages(spark, d), SITE, _ASKED)
    text = F.transform(F.map_entries("other_labels"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))
    return out.withColumn("others", F.array_join(F.array_sort(text), "; ")).drop("other_labels")


@register("label_inventory", " UNION ALL ".join(
    f"SELECT {X.q(label)} AS key, count(*) AS n_pages, count({value}) AS n_values FROM part WHERE {has}"
    for label, (has, value) in _MORE.items()))
def q_label_inventory(spark: SparkSession, d: str) -> DataFrame:
    """SRC8: which labels the pages have, counted in one pass."""
    return PG.label_inventory(PG.detail_maps(extended_pages(spark, d)))


# ================================================================================================
# A table of profiles (SCR1, SCR2, SRT2)
# ================================================================================================
def supplier_profiles(spark: SparkSession, d: str) -> DataFrame:
    """One preference profile per supplier; some leave the region or the size open, some want no trait."""
    k = F.col("s_suppkey")
    num = lambda c: c.cast("double")
    brand = lambda c: F.concat(F.lit("Brand#"), (c % 25 + 1).cast("string"))
    band = lambda a, b, c, e: F.struct(
        F.struct(num(a).alias("min"), num(b).alias("max")).alias("preferred"), F.struct(num(c).alias("min"), num(e).alias("max")).alias("acceptable"))
    words = F.array(F.element_at(F.array(*map(F.lit, ("red", "ring", "bolt", "blue"))), (k % 4 + 1).cast("int")),
                    F.element_at(F.array(F.lit("gear"), F.lit("hot")), (k % 2 + 1).cast("int")))
    wish = lambda ideal, *good: F.struct(num(ideal).alias("ideal"), F.array(*map(num, good)).alias("acceptable"))
    return A.table(spark, d, "supplier").select(
        k.alias("profile_id"),
        F.when(k % 11 != 0, F.array(brand(k), brand(k * 7))).alias("region"),
        band(k % 5, k % 5 + 3, F.greatest(k % 5 - 1, F.lit(0)), k % 5 + 6).alias("age_preference"),
        F.when(k % 13 != 0, band(F.lit(3), k % 7 + 10, F.lit(0), F.lit(50))).alias("size_preference"),
        F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(words).alias("personality_traits"),
        F.create_map(F.lit("affection"), wish(k % 5 + 1, k % 5, k % 5 + 1, k % 5 + 2),
                     F.lit("barking"), wish(k % 3 + 1, k % 3 + 1)).alias("behavior_preferences"),
        F.create_map(F.lit("region"), F.lit(1.0), F.lit("age"), F.lit(1.5), F.lit("size"), F.lit(1.2),
                     F.lit("personality"), num(k % 3) + 1.0, F.lit("behavior"), F.lit(1.3)).alias("weights"))


def _wish_sql(v: str, ideal: str, good: str) -> str:
    return (f"CASE WHEN {v} = {ideal} THEN 1.0 WHEN {v} IN ({good}) THEN 0.7 "
            f"ELSE greatest(0.0, 1.0 - abs({v} - {ideal}) / 4.0) END")


_HAS = "len(list_filter(hashtags, lambda h: contains({w}, h) OR contains(h, {w}))) > 0"
_MANY_SQL = (
    ", wishes AS (SELECT s_suppkey AS k, ['red', 'ring', 'bolt', 'blue'][s_suppkey % 4 + 1] AS w1, "
    "['gear', 'hot'][s_suppkey % 2 + 1] AS w2 FROM supplier), parts AS (SELECT k, uid, "
    "CASE WHEN (NOT care_null AND care_region = '전국') OR rescue_location IN ('Brand#' || CAST(k % 25 + 1 AS VARCHAR), "
    "'Brand#' || CAST(k * 7 % 25 + 1 AS VARCHAR)) THEN 1.0 ELSE 0.0 END AS s1, "
    "CASE WHEN age IS NULL THEN 0.5 WHEN age BETWEEN k % 5 AND k % 5 + 3 THEN 1.0 "
    "WHEN age BETWEEN greatest(k % 5 - 1, 0) AND k % 5 + 6 THEN 0.7 ELSE 0.0 END AS s2, "
    "CASE WHEN weight IS NULL THEN 0.5 WHEN weight BETWEEN 3 AND k % 7 + 10 THEN 1.0 WHEN weight BETWEEN 0 AND 50 THEN 0.7 "
    "ELSE 0.0 END AS s3, "
    "CASE WHEN k % 9 = 0 OR hashtags IS NULL OR len(hashtags) = 0 THEN 0.5 ELSE (CASE WHEN " + _HAS.format(w="w1")
    + " THEN 1 ELSE 0 END + CASE WHEN " + _HAS.format(w="w2") + " THEN 1 ELSE 0 END) / 2.0 END AS s4, "
    "CASE WHEN traits_null THEN 0.5 ELSE (" + _wish_sql("affection", "(k % 5 + 1)", "k % 5, k % 5 + 1, k % 5 + 2")
    + " + CASE WHEN barking IS NULL THEN 0.0 ELSE " + _wish_sql("barking", "(k % 3 + 1)", "k % 3 + 1")
    + " END) / (1 + CASE WHEN barking IS NULL THEN 0 ELSE 1 END) END AS s5 "
    "FROM wishes, listings WHERE status = '임보가능'), scored AS (SELECT k, uid, "
    "(CASE WHEN k % 11 <> 0 THEN CAST(s1 AS DOUBLE) ELSE 0 END + CAST(s2 AS DOUBLE) * CAST(1.5 AS DOUBLE) "
    "+ CASE WHEN k % 13 <> 0 THEN CAST(s3 AS DOUBLE) * CAST(1.2 AS DOUBLE) ELSE 0 END + CAST(s4 AS DOUBLE) * (k % 3 + 1) "
    "+ CAST(s5 AS DOUBLE) * CAST(1.3 AS DOUBLE)) / CAST(CASE WHEN k % 11 <> 0 THEN 1.0 ELSE 0 END + 1.5 "
    "+ CASE WHEN k % 13 <> 0 THEN 1.2 ELSE 0 END + (k % 3 + 1) + 1.3 AS DOUBLE) AS s FROM parts) "
    "SELECT profile_id, rank, uid, round(s + 1e-9, 6) AS match_score FROM (SELECT k AS profile_id, uid, s, row_number() OVER "
    "(PARTITION BY k ORDER BY round(s, 9) DESC, uid) AS rank FROM scored WHERE s >= 0.3) t WHERE rank <= 10")


@register("soft_filter_many", f"WITH listings AS ({A.LISTINGS_SQL})" + _MANY_SQL)
def q_soft_filter_many(spark: SparkSession, d: str) -> DataFrame:
    """SCR1 + SCR2 + SRT2 for every supplier's profile: its ten best open listings.

    Scores have few decimals, some end in a 5 at the seventh: a billionth settles those on both sides."""
    from pawgrid.operators.profiles import soft_filter_many
    out = soft_filter_many(A.structured_listings(spark, d), supplier_profiles(spark, d), 10)
    return out.withColumn("match_score", F.round(F.col("match_score") + 1e-9, 6))


@register("scan_list_pages_ranges", ORACLE["scan_list_pages"])
def q_scan_list_pages_ranges(spark: SparkSession, d: str) -> DataFrame:
    """SRC7 in rising ranges of 50, 100, ... page numbers: the range of the 90th page is the last one parsed."""
    pages = A.table(spark, d, "pages", wide=True, key="page_id")
    numbered = pages.select((F.col("page_id") + 1).alias("page_no"), "url", F.expr(_SCAN_HTML).alias("html"))
    return scan_list_pages_in_ranges(numbered, PG.site_root(F.col("url")), run_path(spark, "list-ranges"), container="nav", first=50)
