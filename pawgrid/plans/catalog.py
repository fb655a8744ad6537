"""The registered queries: one Spark plan per operator family, each with its DuckDB oracle.

Every query reads the whole test tables (through ``adapters``) and returns a DataFrame whose
column names match its oracle.  Continuous scores are rounded to 6 places on both sides;
counts are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions import classes as C
from pawgrid.functions import describe as D
from pawgrid.functions import text as T
from pawgrid.operators import joins as J
from pawgrid.operators import pages as PG
from pawgrid.operators import predicates as P
from pawgrid.operators import preferences as PR
from pawgrid.operators import rerank as R
from pawgrid.operators import scoring as S
from pawgrid.operators import shaping as SH
from pawgrid.operators import stats as ST
from pawgrid.operators import vectors as V
from pawgrid.plans import adapters as A
from pawgrid.plans import sqltext as X
from pawgrid.sources import readers as RD

AS_OF = "2026-12-01"
LINK_PREFIX = "https://site.example/listing/"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def with_listings(body: str) -> str:
    return f"WITH listings AS ({A.LISTINGS_SQL})\n{body}"


def with_raw(body: str, extra: str = "") -> str:
    return f"WITH raw AS ({A.RAW_SQL}){extra}\n{body}"


# ================================================================================================
# Hard filters (FLT1–FLT14, AGG12, PIPE6)
# ================================================================================================
OPEN = "status = '임보가능'"

FILTERS = {
    "filter_region": ({"region": ["Brand#1", "Brand#2"]},
                      "(rescue_location IN ('Brand#1', 'Brand#2') OR (NOT care_null AND care_region = '전국'))"),
    "filter_gender_care": ({"gender": "male", "care_type": ["SMALL", "ECONOMY"]},
                           "gender = 'male' AND care_type IN ('SMALL', 'ECONOMY')"),
    "filter_ranges": ({"age_range": {"min": 1, "max": 10}, "weight_range": {"min": 0, "max": 20}},
                      "age BETWEEN 1 AND 10 AND weight BETWEEN 0 AND 20"),
    "filter_neutered": ({"neutered": False, "gender": None}, "neutered = false"),
    "filter_tags": ({"hashtags": ["red", "ring"]},
                    "coalesce(len(list_filter(hashtags, lambda h: contains(h, 'red') OR contains('red', h) "
                    "OR contains(h, 'ring') OR contains('ring', h))) > 0, false)"),
    "filter_homes": ({"suitable_homes": ["PROMO", "Brand#1"]},
                     "NOT care_null AND coalesce(len(list_filter(homes, lambda h: contains(h, 'PROMO') OR "
                     "contains('PROMO', h) OR contains(h, 'Brand#1') OR contains('Brand#1', h))) > 0, false)"),
    "filter_traits": ({"behavior_traits": {"affection": {"min": 2, "max": 4}, "barking": {"exact": 3}}},
                      "NOT traits_null AND coalesce(affection >= 2, true) AND coalesce(affection <= 4, true) "
                      "AND coalesce(barking = 3, true)"),
    "filter_health": ({"health_requirements": {"min_vaccinations": 2, "exclude_conditions": ["red"]}},
                      "NOT health_null AND NOT coalesce(len(vaccination) > 0 AND len(vaccination) < 2, false) "
                      "AND NOT coalesce(medical_history <> '' AND contains(lower(medical_history), 'red'), false)"),
    "filter_no_history": ({"health_requirements": {"no_medical_history": True}},
                          "NOT health_null AND coalesce(medical_history, '') = ''"),
    "filter_care": ({"care_preferences": {"max_duration": 8, "pickup_method": "delivery",
                                          "exclude_conditions": ["promo"]}},
                    "NOT care_null AND NOT coalesce(care_duration <> 0 AND care_duration > 8, false) "
                    "AND NOT coalesce(len(pickup) > 0 AND NOT list_contains(pickup, 'delivery'), false) "
                    "AND NOT coalesce(extra <> '' AND contains(lower(extra), 'promo'), false)"),
}
COMBINED = {"region": ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5"], "age_range": {"min": 0, "max": 12},
            "neutered": True, "hashtags": ["blue", "steel"]}
COMBINED_SQL = [
    ("status", OPEN),
    ("region", "(rescue_location IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5') "
               "OR (NOT care_null AND care_region = '전국'))"),
    ("age_range", "coalesce(age BETWEEN 0 AND 12, false)"),
    ("neutered", "neutered = true"),
    ("hashtags", "coalesce(len(list_filter(hashtags, lambda h: contains(h, 'blue') OR contains('blue', h) "
                 "OR contains(h, 'steel') OR contains('steel', h))) > 0, false)"),
]


def _filter_query(criteria: dict):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return P.apply_filters(A.structured_listings(spark, d), criteria).select("uid", "name")
    return run


for _name, (_crit, _cond) in FILTERS.items():
    register(_name, with_listings(f"SELECT uid, name FROM listings WHERE {OPEN} AND {_cond}"))(_filter_query(_crit))

register("filter_combined", with_listings(
    "SELECT uid, name FROM listings WHERE " + " AND ".join(c for _, c in COMBINED_SQL)))(_filter_query(COMBINED))


def _funnel_sql() -> str:
    parts = ["SELECT CAST(0 AS BIGINT) AS step_no, 'all' AS step, count(*) AS n FROM listings"]
    acc = []
    for i, (name, cond) in enumerate(COMBINED_SQL, 1):
        acc.append(f"({cond})")
        parts.append(f"SELECT CAST({i} AS BIGINT), '{name}', count_if({' AND '.join(acc)}) FROM listings")
    return with_listings("\nUNION ALL\n".join(parts))


@register("filter_funnel", _funnel_sql())
def q_filter_funnel(spark: SparkSession, d: str) -> DataFrame:
    return P.funnel(A.structured_listings(spark, d), COMBINED)


# ================================================================================================
# Soft scoring (SCR1–SCR8, FLT15, SRT1–SRT2, AGG14, PIPE7)
# ================================================================================================
PROFILE = S.default_profile(traits=["red", "ring"])
PROFILE = {**PROFILE, "region": ["Brand#3", "Brand#7"], "weights": {**PROFILE["weights"], "region": 1.0}}

_SC = {
    "region_score": "CASE WHEN (NOT care_null AND care_region = '전국') OR rescue_location IN ('Brand#3', 'Brand#7') "
                    "THEN 1.0 ELSE 0.0 END",
    "age_score": "CASE WHEN age IS NULL THEN 0.5 WHEN age BETWEEN 2 AND 5 THEN 1.0 WHEN age BETWEEN 1 AND 8 THEN 0.7 "
                 "ELSE 0.0 END",
    "size_score": "CASE WHEN weight IS NULL THEN 0.5 WHEN weight BETWEEN 3.0 AND 10.0 THEN 1.0 "
                  "WHEN weight BETWEEN 0 AND 50 THEN 0.7 ELSE 0.0 END",
    "personality_score": "CASE WHEN hashtags IS NULL OR len(hashtags) = 0 THEN 0.5 ELSE "
                         "((CASE WHEN len(list_filter(hashtags, lambda h: contains('red', h) OR contains(h, 'red'))) > 0 "
                         "THEN 1 ELSE 0 END) + (CASE WHEN len(list_filter(hashtags, lambda h: contains('ring', h) "
                         "OR contains(h, 'ring'))) > 0 THEN 1 ELSE 0 END)) / 2.0 END",
    "behavior_score": "CASE WHEN traits_null THEN 0.5 ELSE "
                      "((CASE WHEN affection = 4 THEN 1.0 WHEN affection IN (3, 4, 5) THEN 0.7 "
                      "ELSE greatest(0.0, 1.0 - abs(affection - 4.0) / 4.0) END) "
                      "+ coalesce(CASE WHEN barking = 2 THEN 1.0 WHEN barking IN (1, 2, 3) THEN 0.7 "
                      "ELSE greatest(0.0, 1.0 - abs(barking - 2.0) / 4.0) END, 0.0)) "
                      "/ (1 + CASE WHEN barking IS NULL THEN 0 ELSE 1 END) END",
}
_MATCH = ("((((0.0 + ({region_score}) * 1.0) + ({age_score}) * 1.5) + ({size_score}) * 1.2) "
          "+ ({personality_score}) * 1.8 + ({behavior_score}) * 1.3) / 6.8")


def _scored_sql() -> str:
    cols = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _SC.items())
    return f"scored AS (SELECT *, {cols} FROM listings)"


def _match_sql() -> str:
    return _MATCH.format(**{k: k for k in _SC})


@register("score_components", with_listings(
    f", {_scored_sql()} SELECT uid, " + ", ".join(f"round({k}, 6) AS {k}" for k in _SC)
    + f", round({_match_sql()}, 6) AS match_score FROM scored").replace("\n,", ",", 1))
def q_score_components(spark: SparkSession, d: str) -> DataFrame:
    df = A.structured_listings(spark, d)
    return df.select(
        "uid",
        F.round(S.region_score(PROFILE["region"]), 6).alias("region_score"),
        F.round(S.band_score("age", PROFILE["age_preference"]), 6).alias("age_score"),
        F.round(S.band_score("weight", PROFILE["size_preference"]), 6).alias("size_score"),
        F.round(S.personality_score(PROFILE["personality_traits"]), 6).alias("personality_score"),
        F.round(S.behavior_score(PROFILE["behavior_preferences"]), 6).alias("behavior_score"),
        F.round(S.match_score(PROFILE), 6).alias("match_score"),
    )


@register("soft_filter", with_listings(
    f", {_scored_sql()} SELECT uid, name, round({_match_sql()}, 6) AS match_score FROM scored "
    f"WHERE {OPEN} AND {_match_sql()} >= 0.3"))
def q_soft_filter(spark: SparkSession, d: str) -> DataFrame:
    out = S.soft_filter(A.structured_listings(spark, d), PROFILE)
    return out.select("uid", "name", F.round("match_score", 6).alias("match_score"))


@register("top_matches", with_listings(
    f", {_scored_sql()}, m AS (SELECT uid, {_match_sql()} AS s FROM scored WHERE {OPEN}) "
    "SELECT uid, round(s, 6) AS match_score FROM m WHERE s >= 0.3 ORDER BY s DESC, uid LIMIT 10"))
def q_top_matches(spark: SparkSession, d: str) -> DataFrame:
    out = S.top_matches(A.structured_listings(spark, d), PROFILE, n=10)
    return out.select("uid", F.round("match_score", 6).alias("match_score"))


@register("export_flat", with_listings(
    f", {_scored_sql()}, m AS (SELECT *, {_match_sql()} AS s FROM scored WHERE {OPEN}) "
    "SELECT uid AS id, name, gender, age, weight, care_type, rescue_location, "
    "coalesce(array_to_string(hashtags, '|'), '') AS hashtags, round(s, 6) AS match_score, "
    "coalesce(detail_link, '') AS detail_link FROM m WHERE s >= 0.3"))
def q_export_flat(spark: SparkSession, d: str) -> DataFrame:
    from pawgrid.sources.sinks import export_flat
    out = export_flat(S.soft_filter(A.structured_listings(spark, d), PROFILE))
    return out.withColumn("match_score", F.round("match_score", 6))


# ================================================================================================
# Vector matching (EMB4–EMB5, JN3–JN5, WIN1, SRT3, PRJ11, FLT16–FLT19)
# ================================================================================================
def _items(spark: SparkSession, d: str, with_mask: bool = False) -> DataFrame:
    """Open listings with their vectors on uid (JN3); a listing without a vector stays (similarity 0)."""
    raw = A.raw_listings(spark, d, long_text=False)
    open_ = RD.open_listings(raw)
    cols = [F.col("uid"), F.col("embedding")]
    if with_mask:
        cols.append(PR.slot_mask().alias("slot_mask"))
    return open_.join(A.vectors(spark, d).select("uid", "embedding"), "uid", "left").select(*cols)


def recommend(spark: SparkSession, d: str, k: int = 10, filtered: bool = False, **kw) -> DataFrame:
    queries = A.vector_queries(spark, d)
    if filtered:
        queries = queries.withColumn("slot_group", PR.slot_group())
    items = _items(spark, d, with_mask=filtered)
    # uids are unique in both tables, so no more items than stored vectors have one
    return V.top_k_similar(queries, items, k, q_group="slot_group" if filtered else None,
                           i_mask="slot_mask" if filtered else None, sizes=(A.table(spark, d, "embeddings"),) * 2, **kw)


_ITEMS_SQL = (", items AS (SELECT r.uid, CAST(e.embedding AS DOUBLE[]) AS v, r.addinfo03, r.addinfo05, "
              f"{X.strict_double('r.addinfo07')} AS w FROM raw r LEFT JOIN embeddings e ON e.vec_id = r.uid "
              "WHERE r.state = '임보가능')"
              f", qs AS (SELECT qid, CAST(embedding AS DOUBLE[]) AS v, size, age, gender FROM ({A.VQUERIES_SQL}))")
_COS = ("CASE WHEN i.v IS NULL OR list_dot_product(q.v, q.v) = 0 OR list_dot_product(i.v, i.v) = 0 THEN 0.0 ELSE "
        "list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))) END")
_SLOT_OK = ("(q.size IS NULL OR (q.size = '소형' AND i.w < 7) OR (q.size = '중형' AND i.w >= 7 AND i.w < 20) "
            "OR (q.size = '대형' AND i.w >= 20)) "
            "AND (q.age IS NULL OR (q.age = '어린' AND coalesce(regexp_matches(i.addinfo05, '2024|2023'), false)) "
            "OR (q.age = '고령' AND coalesce(regexp_matches(i.addinfo05, '2013|2014|2015|2016'), false))) "
            "AND (q.gender IS NULL OR i.addinfo03 = q.gender)")


def _topk_sql(filtered: bool, k: int = 10) -> str:
    cond = _SLOT_OK if filtered else "true"
    return with_raw(
        f"SELECT qid, rank, uid, round(sim, 6) AS similarity FROM ("
        f"SELECT q.qid, i.uid, {_COS} AS sim, row_number() OVER (PARTITION BY q.qid ORDER BY {_COS} DESC, i.uid) "
        f"AS rank FROM qs q JOIN items i ON {cond}) t WHERE rank <= {k}", _ITEMS_SQL)


@register("recommend_topk", _topk_sql(False))
def q_recommend_topk(spark: SparkSession, d: str) -> DataFrame:
    return recommend(spark, d).withColumn("similarity", F.round("similarity", 6))


@register("recommend_topk_grid", _topk_sql(False))
def q_recommend_topk_grid(spark: SparkSession, d: str) -> DataFrame:
    """Same answer with small blocks (several query and item blocks at any size, met inside a task's tiles)."""
    return recommend(spark, d, block_rows=128).withColumn("similarity", F.round("similarity", 6))


@register("recommend_topk_filtered", _topk_sql(True))
def q_recommend_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return recommend(spark, d, filtered=True).withColumn("similarity", F.round("similarity", 6))


_ZERO_ITEMS = (", items AS (SELECT r.uid, CASE WHEN e.label = 9 THEN list_transform(CAST(e.embedding AS DOUBLE[]), "
               "lambda x: 0.0) ELSE CAST(e.embedding AS DOUBLE[]) END AS v FROM raw r LEFT JOIN embeddings e "
               "ON e.vec_id = r.uid WHERE r.state = '임보가능')"
               f", qs AS (SELECT qid, CASE WHEN label = 8 THEN list_transform(CAST(embedding AS DOUBLE[]), "
               f"lambda x: 0.0) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM ({A.VQUERIES_SQL}))")


@register("recommend_zero_vector", with_raw(
    f"SELECT qid, rank, uid, round(sim, 6) AS similarity FROM (SELECT q.qid, i.uid, {_COS} AS sim, "
    f"row_number() OVER (PARTITION BY q.qid ORDER BY {_COS} DESC, i.uid) AS rank FROM qs q JOIN items i ON true) t "
    "WHERE rank <= 10", _ZERO_ITEMS))
def q_recommend_zero_vector(spark: SparkSession, d: str) -> DataFrame:
    """Failed embeddings are zero vectors (label 9 items, label 8 queries): similarity 0.0, ties by uid."""
    def zero_if(cond):
        return F.when(cond, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    queries = A.vector_queries(spark, d).withColumn("embedding", zero_if(F.col("label") == 8))
    vec = A.vectors(spark, d).withColumn("embedding", zero_if(F.col("label") == 9))
    items = RD.open_listings(A.raw_listings(spark, d, long_text=False)).join(vec.select("uid", "embedding"), "uid", "left")
    top = V.top_k_similar(queries, items, 10, sizes=(A.table(spark, d, "embeddings"),) * 2)
    return top.withColumn("similarity", F.round("similarity", 6))


PREPARED_CTE = (
    "prepared AS (SELECT uid, " + ", ".join(
        f"coalesce({c}, {X.q(v)}) AS {c}" for c, v in K.RAW_DEFAULTS.items())
    + f", CASE WHEN sd > 0 THEN sd END AS addinfo07, addinfo19 FROM (SELECT *, {X.strict_double('addinfo07')} AS sd "
    "FROM raw))")


def _cand_desc_sql(alias: str = "r") -> str:
    r = alias
    return ("concat_ws(' | ', '성별: ' || coalesce({r}.addinfo03, 'nan') || ', 몸무게: ' "
            "|| coalesce(CAST({r}.addinfo07 AS VARCHAR), 'nan') "
            "|| 'kg', CASE WHEN coalesce({r}.addinfo08, '') <> '' THEN '성격: ' || {r}.addinfo08 END, "
            "CASE WHEN coalesce({r}.addinfo10, '') <> '' THEN '상세설명: ' || ({t10}) END, "
            "CASE WHEN coalesce({r}.addinfo16, '') <> '' THEN '특별요구: ' || {r}.addinfo16 END, "
            "CASE WHEN coalesce({r}.addinfo09, '') <> '' THEN '구조배경: ' || ({t09}) END)").format(
        r=r, t10=f"{r}.addinfo10", t09=f"{r}.addinfo09")


_CANDS_SQL = (
    f"top AS (SELECT qid, rank, uid, sim FROM (SELECT q.qid, i.uid, {_COS} AS sim, row_number() OVER "
    f"(PARTITION BY q.qid ORDER BY {_COS} DESC, i.uid) AS rank FROM qs q JOIN items i ON true) t WHERE rank <= 10), "
    "cands AS (SELECT t.qid, t.rank, t.uid, t.sim, r.addinfo01 AS name, r.addinfo03 AS gender, "
    "CAST(r.addinfo07 AS VARCHAR) AS weight, "
    "coalesce(r.addinfo05, '나이미정') AS age, coalesce(r.addinfo04, '중성화미정') AS neuter, "
    "coalesce(r.kind, '임보종류미정') AS kind, r.state, "
    f"'{LINK_PREFIX}' || CAST(t.uid AS VARCHAR) AS link, {_cand_desc_sql('r')} AS description "
    "FROM top t LEFT JOIN prepared r ON r.uid = t.uid)")


def prepared(spark: SparkSession, d: str) -> DataFrame:
    """PIPE1 prefix: weight cleaned (PRJ5), null defaults filled (PRJ4)."""
    return SH.fill_defaults(SH.clean_weight(A.raw_listings(spark, d)))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.with_candidate_text(R.candidate_rows(recommend(spark, d), prepared(spark, d), LINK_PREFIX))


@register("recommend_candidates", with_raw(
    "SELECT qid, rank, uid, round(sim, 6) AS similarity, name, gender, weight, age, neuter, kind, state, link, "
    "description FROM cands", _ITEMS_SQL + ", " + PREPARED_CTE + ", " + _CANDS_SQL))
def q_recommend_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = candidates(spark, d)
    return c.select("qid", "rank", "uid", F.round("similarity", 6).alias("similarity"), "name", "gender", "weight",
                    "age", "neuter", "kind", "state", "link", "description")


@register("recommend_single", with_raw(
    f", qv AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) "
    "SELECT rank, uid, round(sim, 6) AS similarity FROM (SELECT i.uid, "
    f"{_COS} AS sim, row_number() OVER (ORDER BY {_COS} DESC, i.uid) AS rank FROM items i, qv q) t WHERE rank <= 5",
    _ITEMS_SQL))
def q_recommend_single(spark: SparkSession, d: str) -> DataFrame:
    """PIPE5 / SRT3: one query vector (the first stored vector, read from the table), top 5."""
    first = A.vectors(spark, d).where(F.col("uid") == 0).select("embedding").head(1)
    vec = [float(x) for x in first[0]["embedding"]] if first else []
    return V.top_k_for_vector(_items(spark, d), vec, k=5).withColumn("similarity", F.round("similarity", 6))


def _slot_case_sql(slot: str, text: str = "text") -> str:
    return ("CASE " + " ".join(f"WHEN {X.contains_any(text, w)} THEN {X.q(v)}" for v, w in A.TEXT_SLOT_RULES[slot])
            + " END")


@register("eligible_counts", with_raw(
    ", qs AS (SELECT qid, " + ", ".join(f"{_slot_case_sql(s)} AS {s}" for s in ("size", "age", "gender"))
    + f" FROM ({A.USER_QUERIES_SQL})), "
    f"items AS (SELECT uid, addinfo03, addinfo05, {X.strict_double('addinfo07')} AS w FROM raw "
    "WHERE state = '임보가능') "
    f"SELECT q.qid, count(i.uid) AS eligible FROM qs q LEFT JOIN items i ON {_SLOT_OK} GROUP BY q.qid"))
def q_eligible_counts(spark: SparkSession, d: str) -> DataFrame:
    """JN5 / AGG12 for many queries: slots from user text, eligible open listings per query."""
    queries = PR.extract_slots(A.user_queries(spark, d), "text", rules=A.TEXT_SLOT_RULES)
    return PR.eligible_counts(queries, A.raw_listings(spark, d, long_text=False))


@register("extract_slots", "SELECT qid, " + ", ".join(f"{_slot_case_sql(s)} AS {s}" for s in ("size", "age", "gender"))
          + f", text AS personality_query FROM ({A.USER_QUERIES_SQL})")
def q_extract_slots(spark: SparkSession, d: str) -> DataFrame:
    return PR.extract_slots(A.user_queries(spark, d), "text", rules=A.TEXT_SLOT_RULES).drop("text")


# ================================================================================================
# Text (SC1–SC16, PRJ4–PRJ6, PRJ12, AGG7, PIPE1)
# ================================================================================================
@register("clean_text", "SELECT doc_id, " + X.clean_text(
    "'#' || lang || '#' || source || ' &apos;' || text") + " AS cleaned FROM documents")
def q_clean_text(spark: SparkSession, d: str) -> DataFrame:
    """SC1 + SC2 over every whole document (tags and an entity injected in front)."""
    docs = A.table(spark, d, "documents", wide=True, key="doc_id")
    src = F.concat(F.lit("#"), F.col("lang"), F.lit("#"), F.col("source"), F.lit(" &apos;"), F.col("text"))
    return docs.select("doc_id", T.clean_text(src).alias("cleaned"))


@register("clean_query", f"SELECT qid, {X.clean_query('text')} AS cleaned FROM ({A.USER_QUERIES_SQL})")
def q_clean_query(spark: SparkSession, d: str) -> DataFrame:
    """SC4 over every user turn."""
    return A.user_queries(spark, d).select("qid", T.clean_query("text").alias("cleaned"))


@register("tag_text", with_raw(f"SELECT uid, {X.tag_text('addinfo08')} AS tag_text FROM raw"))
def q_tag_text(spark: SparkSession, d: str) -> DataFrame:
    """SC3 (reference mode: '#a#b' -> 'ab')."""
    return A.raw_listings(spark, d, long_text=False).select("uid", T.tag_text("addinfo08").alias("tag_text"))


_W = X.strict_double("addinfo07")


@register("size_classes", with_raw(
    f"SELECT uid, CASE WHEN w IS NULL THEN '몸무게 정보 없음' WHEN w < 7 THEN '소형 (7kg 미만)' "
    "WHEN w < 20 THEN '중형 (7-20kg)' ELSE '대형 (20kg 이상)' END AS size_a, "
    "CASE WHEN w IS NULL OR w = 0 THEN '크기미정' WHEN w < 10 THEN '소형' WHEN w < 25 THEN '중형' ELSE '대형' END AS size_b, "
    "CASE WHEN w IS NULL THEN '몸무게 불명' WHEN w < 5 THEN '소형견' WHEN w <= 15 THEN '중형견' ELSE '대형견' END AS size_c "
    f"FROM (SELECT uid, {_W} AS w FROM raw)"))
def q_size_classes(spark: SparkSession, d: str) -> DataFrame:
    """SC6, SC7, SC8 (three cut sets) over the parsed weight."""
    w = C.strict_double("addinfo07")
    return A.raw_listings(spark, d, long_text=False).select("uid", C.size_class_a(w).alias("size_a"), C.size_class_b(w).alias("size_b"),
                                           C.size_class_c(w).alias("size_c"))


def _age_phrase_sql(x: str) -> str:
    rules = " ".join(f"WHEN {X.contains_any(f'lower({x})', ys)} THEN {X.q(lbl)}" for ys, lbl in K.AGE_PHRASE_RULES)
    return (f"CASE WHEN {x} IS NULL OR {x} = '{K.AGE_UNKNOWN_TEXT}' THEN '{K.AGE_PHRASE_NULL}' {rules} "
            f"ELSE '{K.AGE_PHRASE_OTHER_PREFIX}' || {x} END")


@register("age_phrase", with_raw(f"SELECT uid, {_age_phrase_sql('addinfo05')} AS age_phrase FROM raw"))
def q_age_phrase(spark: SparkSession, d: str) -> DataFrame:
    """SC9."""
    return A.raw_listings(spark, d, long_text=False).select("uid", C.age_phrase("addinfo05").alias("age_phrase"))


@register("age_months", with_raw(
    f"SELECT uid, addinfo05 AS birth, {X.age_months_text('addinfo05', AS_OF)} AS age_months FROM raw"))
def q_age_months(spark: SparkSession, d: str) -> DataFrame:
    """SC10 with a fixed reference date."""
    return A.raw_listings(spark, d, long_text=False).select("uid", F.col("addinfo05").alias("birth"),
                                           C.age_months_text("addinfo05", AS_OF).alias("age_months"))


@register("prepared_listings", with_raw(
    "SELECT uid, state, kind, addinfo01, addinfo02, addinfo03, addinfo04, addinfo05, addinfo07, addinfo08, addinfo09, "
    "addinfo10, addinfo11, addinfo16, addinfo19, addinfo20 FROM prepared", ", " + PREPARED_CTE.replace(
        "addinfo19 FROM", "addinfo19 FROM")))
def q_prepared_listings(spark: SparkSession, d: str) -> DataFrame:
    """PRJ5 + PRJ4 (+ PRJ6): the cleaned, default-filled listing table."""
    return prepared(spark, d).select("uid", "state", "kind", "addinfo01", "addinfo02", "addinfo03", "addinfo04",
                                     "addinfo05", "addinfo07", "addinfo08", "addinfo09", "addinfo10", "addinfo11",
                                     "addinfo16", "addinfo19", "addinfo20")


def _describe_sql() -> str:
    dft = K.RAW_DEFAULTS
    size = ("CASE WHEN addinfo07 IS NULL THEN '몸무게 정보 없음' WHEN addinfo07 < 7 THEN '소형 (7kg 미만)' "
            "WHEN addinfo07 < 20 THEN '중형 (7-20kg)' ELSE '대형 (20kg 이상)' END")
    age = _age_phrase_sql("addinfo05")
    intro = (f"addinfo01 || '는 ' || addinfo03 || '이며, ' || ({size}) || '에 해당합니다.' || "
             f"(CASE WHEN ({age}) <> '{K.AGE_PHRASE_NULL}' THEN ' ' || ({age}) || '이고' ELSE '' END) || "
             f"(CASE WHEN addinfo04 IS NOT NULL AND addinfo04 <> '' AND addinfo04 <> '{dft['addinfo04']}' "
             "THEN ' ' || addinfo04 || ' 상태입니다.' ELSE '입니다.' END)")
    status = (f"CASE WHEN state <> '{dft['state']}' OR kind <> '{dft['kind']}' THEN "
              "'현재 ' || state || ' 상태이며 ' || kind || '로 분류됩니다.' END")
    parts = [intro, status, f"CASE WHEN {X.clean_text('addinfo08')} <> '' THEN {X.clean_text('addinfo08')} END"]
    for col, label in K.DESCRIBE_LABELS.items():
        c = X.clean_text(col)
        parts.append(f"CASE WHEN {c} <> '' THEN '{label}' || {c} END")
    return "concat_ws(' ', " + ", ".join(parts) + ")"


@register("describe_listing", with_raw(f"SELECT uid, {_describe_sql()} AS description FROM prepared",
                                       ", " + PREPARED_CTE))
def q_describe_listing(spark: SparkSession, d: str) -> DataFrame:
    """PIPE1: clean weight -> fill defaults -> SC11 description for every listing (whole texts)."""
    return D.with_description(prepared(spark, d)).select("uid", "description")


@register("text_length_stats", with_raw(
    "SELECT round(avg(length(description)), 6) AS avg_chars, CAST(max(length(description)) AS BIGINT) AS max_chars, "
    "CAST(min(length(description)) AS BIGINT) AS min_chars, count(*) AS n_rows FROM "
    f"(SELECT {_describe_sql()} AS description FROM prepared)", ", " + PREPARED_CTE))
def q_text_length_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG7 over the SC11 descriptions."""
    return ST.length_stats(D.with_description(prepared(spark, d)).select("description"), "description")


@register("preview", with_raw(
    "SELECT addinfo01 AS name, substr(description, 1, 300) AS head, CAST(length(description) AS BIGINT) AS n_chars "
    f"FROM (SELECT uid, addinfo01, {_describe_sql()} AS description FROM prepared) ORDER BY uid LIMIT 3",
    ", " + PREPARED_CTE))
def q_preview(spark: SparkSession, d: str) -> DataFrame:
    """PRJ12: first 3 listings (by uid): name, first 300 characters, length."""
    # the rows are chosen on the key before the free text is joined
    first = A.raw_listings(spark, d, long_text=False).select("uid").orderBy("uid").limit(3)
    first = prepared(spark, d).join(first, "uid", "left_semi")
    return SH.preview(D.with_description(first).select("uid", "addinfo01", "description").orderBy("uid"), "description")


def _embedding_text_sql() -> str:
    dft = K.EMBED_DEFAULTS
    wn = X.strict_double("addinfo07")
    size = f"CASE WHEN ({wn}) IS NULL OR ({wn}) = 0 THEN '크기미정' WHEN ({wn}) < 10 THEN '소형' WHEN ({wn}) < 25 THEN '중형' ELSE '대형' END"
    basic = (f"coalesce(addinfo01, '{dft['addinfo01']}') || '는 ' || coalesce(addinfo03, '{dft['addinfo03']}') || "
             f"'이고 몸무게 ' || coalesce(addinfo07, '{dft['addinfo07']}') || 'kg인 ' || ({size}) || ' 동물입니다.'")
    status = ("CASE WHEN coalesce(state, '') <> '' AND coalesce(kind, '') <> '' THEN "
              "'현재 ' || state || ' 상태이며 ' || kind || '로 분류됩니다.' END")
    tt = X.tag_text("addinfo08")
    tags = f"CASE WHEN ({tt}) <> '' THEN '성격 특징은 ' || ({tt}) || ' 입니다.' END"
    parts = [basic, status, tags]
    for col, label in K.EMBED_LABELS.items():
        parts.append(f"CASE WHEN NOT {X.is_blank(col)} THEN '{label}' || {X.strip(col)} END")
    arr = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    return f"array_to_string({arr}, ' ')"


@register("embedding_text", with_raw(f"SELECT uid, {_embedding_text_sql()} AS embedding_text FROM raw"))
def q_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """SC12 over every listing, whole texts."""
    return D.with_embedding_text(A.raw_listings(spark, d)).select("uid", "embedding_text")


# ================================================================================================
# Statistics (AGG1–AGG10, FLT20–FLT21, PIPE8)
# ================================================================================================
@register("state_share", with_raw(
    "SELECT state AS key, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 6) AS pct "
    "FROM raw GROUP BY state"))
def q_state_share(spark: SparkSession, d: str) -> DataFrame:
    """AGG1 + AGG2: per state count and share."""
    return ST.state_share(A.raw_listings(spark, d, long_text=False))


_AGE_BUCKET_SQL = ("CASE WHEN age IS NULL THEN '나이 불명' WHEN age <= 1 THEN '1세 이하' WHEN age <= 3 THEN '1-3세' "
                   "WHEN age <= 7 THEN '4-7세' ELSE '8세 이상' END")
_W_BUCKET_SQL = ("CASE WHEN weight IS NULL THEN '몸무게 불명' WHEN weight < 5 THEN '소형견' WHEN weight <= 15 THEN '중형견' "
                 "ELSE '대형견' END")


@register("result_facets", with_listings(
    ", r AS (SELECT * FROM listings WHERE status = '임보가능' AND age BETWEEN 0 AND 10) "
    "SELECT 'total' AS facet, 'all' AS key, count(*) AS n FROM r "
    "UNION ALL SELECT 'gender', gender, count(*) FROM r WHERE gender IS NOT NULL GROUP BY gender "
    f"UNION ALL SELECT 'age', {_AGE_BUCKET_SQL}, count(*) FROM r GROUP BY 2 "
    f"UNION ALL SELECT 'weight', {_W_BUCKET_SQL}, count(*) FROM r GROUP BY 2 "
    "UNION ALL SELECT 'care_type', care_type, count(*) FROM r GROUP BY care_type "
    "UNION ALL SELECT 'region', key, n FROM (SELECT rescue_location AS key, count(*) AS n, row_number() OVER "
    "(ORDER BY count(*) DESC, rescue_location) AS rn FROM r GROUP BY rescue_location) WHERE rn <= 10"))
def q_result_facets(spark: SparkSession, d: str) -> DataFrame:
    """AGG3–AGG6 over a filter result (open, age 0..10)."""
    res = P.apply_filters(A.structured_listings(spark, d), {"age_range": {"min": 0, "max": 10}})
    return ST.result_facets(res)


@register("top_regions", with_listings(
    "SELECT rescue_location AS key, count(*) AS n FROM listings WHERE status = '임보가능' "
    "GROUP BY rescue_location ORDER BY n DESC, key LIMIT 10"))
def q_top_regions(spark: SparkSession, d: str) -> DataFrame:
    """AGG6: the 10 most frequent regions among open listings."""
    return ST.top_values(A.structured_listings(spark, d).where(P.open_state()), "rescue_location", 10)


_FACETS_SQL = ("SELECT 'sex' AS facet, gender AS key, count(*) AS n FROM listings WHERE gender IS NOT NULL GROUP BY gender "
               "UNION ALL SELECT 'care_type', care_type, count(*) FROM listings WHERE care_type IS NOT NULL GROUP BY care_type "
               "UNION ALL SELECT 'region', rescue_location, count(*) FROM listings WHERE rescue_location IS NOT NULL "
               "GROUP BY rescue_location")


@register("summary", with_listings(
    "SELECT 'all' AS facet, 'total' AS key, CAST(count(*) AS DOUBLE) AS n FROM listings "
    "UNION ALL SELECT 'all', 'available', CAST(count_if(status = '임보가능') AS DOUBLE) FROM listings "
    "UNION ALL SELECT 'all', 'average_age', round(avg(age), 6) FROM listings "
    "UNION ALL SELECT 'all', 'average_weight', round(avg(weight), 6) FROM listings "
    f"UNION ALL SELECT facet, key, CAST(n AS DOUBLE) FROM ({_FACETS_SQL}) "
    "UNION ALL SELECT 'top_region', key, CAST(n AS DOUBLE) FROM (SELECT rescue_location AS key, count(*) AS n FROM listings "
    "WHERE rescue_location IS NOT NULL GROUP BY 1 ORDER BY n DESC, key LIMIT 10) "
    "UNION ALL SELECT 'top_care_type', key, CAST(n AS DOUBLE) FROM (SELECT care_type AS key, count(*) AS n FROM listings "
    "WHERE care_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, key LIMIT 10)"))
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG9 + PIPE8: totals and means, the sex, care-type and region distributions, and the ten most
    frequent regions and care types, as tidy (facet, key, n)."""
    return ST.full_summary(A.structured_listings(spark, d))


@register("system_stats", with_raw(
    "SELECT 'state' AS facet, state AS key, count(*) AS n FROM raw WHERE state IS NOT NULL GROUP BY state "
    "UNION ALL SELECT 'sex', addinfo03, count(*) FROM raw WHERE addinfo03 IS NOT NULL GROUP BY addinfo03"))
def q_system_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG1: state and sex counts."""
    from pawgrid.plans.recommend import system_stats
    return system_stats(A.raw_listings(spark, d, long_text=False))


@register("distinct_tags", with_listings(
    "SELECT tag, count(*) AS n FROM (SELECT unnest(hashtags) AS tag FROM listings) WHERE tag IS NOT NULL GROUP BY tag"))
def q_distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    """AGG10: flattened distinct tags with counts."""
    return ST.distinct_tags(A.structured_listings(spark, d))


@register("distinct_regions", with_listings("SELECT DISTINCT rescue_location AS value FROM listings "
                                            "WHERE rescue_location IS NOT NULL"))
def q_distinct_regions(spark: SparkSession, d: str) -> DataFrame:
    """AGG10: distinct regions."""
    return ST.distinct_values(A.structured_listings(spark, d), "rescue_location")


_RAW_COLS = ["uid", "state", "kind", "addinfo01", "addinfo02", "addinfo03", "addinfo04", "addinfo05", "addinfo07",
             "addinfo08", "addinfo09", "addinfo10", "addinfo11", "addinfo16", "addinfo19", "addinfo20"]


@register("null_profile", with_raw(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS nulls FROM raw" for c in _RAW_COLS)))
def q_null_profile(spark: SparkSession, d: str) -> DataFrame:
    """AGG8: nulls per column, one scan."""
    return ST.null_profile(A.raw_listings(spark, d), _RAW_COLS)


@register("weight_scans",
          "SELECT count_if(w > 100) AS over_limit, count_if(contains(t, '-')) AS with_dash, count(*) AS n_rows FROM "
          f"(SELECT t, CASE WHEN sd > 0 THEN sd END AS w FROM (SELECT t, {X.strict_double('t')} AS sd FROM "
          "(SELECT CAST(value * 10 - 100 AS VARCHAR) AS t FROM events)))")
def q_weight_scans(spark: SparkSession, d: str) -> DataFrame:
    """FLT20 + FLT21 over a weight-like text derived from every event value."""
    ev = A.table(spark, d, "events").select((F.col("value") * 10 - 100).cast("string").alias("addinfo07"))
    return ST.weight_scans(ev)


# ================================================================================================
# Enrichment: 3-way left join with suffixes, drop/rename, period merge, age months (PIPE2)
# ================================================================================================
def enrich_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Base = orders (open = status 'O'), sub01 = every line item, sub04 = per-order line summary."""
    # the subs grow with the data, so they join by key (sort-merge) rather than by broadcast; every
    # exchange below a join is the join's own, which AQE may split where a key is hot
    o = A.table(spark, d, "orders")
    base = o.select(
        F.col("o_orderkey").alias("uid"),
        F.when(F.col("o_orderstatus") == "O", F.lit(K.OPEN_STATE)).otherwise(F.lit("임보완료")).alias("state"),
        F.col("o_orderpriority").alias("kind"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("addinfo01"),
        F.col("o_orderpriority").alias("addinfo03"),
        F.concat(F.date_format("o_orderdate", "yyyyMM"),
                 F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.lit("추정")).otherwise(F.lit(""))).alias("addinfo05"),
        F.col("o_totalprice").alias("addinfo07"),
        F.col("o_orderstatus").alias("addinfo13"),
        F.col("o_orderdate").alias("d_regis"),
        F.col("o_custkey").alias("puid"),
    )
    li = A.table(spark, d, "lineitem")
    sub01 = li.select(
        F.col("l_orderkey").alias("uid"), F.col("l_returnflag").alias("addinfo01"),
        F.col("l_linestatus").alias("addinfo03"),
        F.when(F.pmod("l_linenumber", F.lit(2)) == 1, F.col("l_linenumber").cast("string")).alias("addinfo13sub01"),
        F.col("l_partkey").alias("puid"),
        F.concat(F.lit("#"), F.col("l_returnflag"), F.lit("#"), F.col("l_linestatus")).alias("addinfo08"),
    )
    sub04 = li.groupBy(F.col("l_orderkey").alias("uid")).agg(
        F.count(F.lit(1)).cast("string").alias("addinfo02"),
        F.when(F.max("l_linenumber") > 3, F.lit("long")).alias("addinfo13sub02"),
        F.sum("l_quantity").cast("bigint").cast("string").alias("addinfo17"),
    )
    return base, sub01.hint("merge"), sub04.hint("merge")


def enrich_full(spark: SparkSession, d: str, as_of: str | None = AS_OF, salts: int = 0,
                hot_fraction: float = 1e-4) -> DataFrame:
    base, sub01, sub04 = enrich_inputs(spark, d)
    # sub04 is aggregated by uid (one row per key); sub01 is the 1:N side that may hold hot keys
    merged = J.enrich(RD.open_listings(base), [sub01, sub04], key="uid", salts=salts, hot_fraction=hot_fraction,
                      unique=[False, True])
    out = SH.drop_if_present(merged, K.ENRICH_DROP)
    out = SH.rename_if_present(out, K.ENRICH_RENAME)
    out = SH.merge_text_columns(out, K.PERIOD_PARTS, K.PERIOD_MERGED)
    out = SH.with_age_months(out, K.BIRTH_COL, K.AGE_MONTHS_COL, as_of)
    return SH.key_first(out, K.KEY_COL)


_ENRICH_SQL = (
    "WITH base AS (SELECT o_orderkey AS uid, CASE WHEN o_orderstatus = 'O' THEN '임보가능' ELSE '임보완료' END AS state, "
    "o_orderpriority AS addinfo03_x, 'c' || CAST(o_custkey AS VARCHAR) AS addinfo01_x, "
    "strftime(o_orderdate, '%Y%m') || CASE WHEN o_custkey % 3 = 0 THEN '추정' ELSE '' END AS addinfo05, "
    "o_totalprice AS addinfo07, o_orderstatus AS addinfo13 FROM orders), "
    "sub01 AS (SELECT l_orderkey AS uid, l_linestatus AS addinfo03_y, "
    "CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_linenumber AS VARCHAR) END AS addinfo13sub01, "
    "'#' || l_returnflag || '#' || l_linestatus AS addinfo08 FROM lineitem), "
    "sub04 AS (SELECT l_orderkey AS uid, CASE WHEN max(l_linenumber) > 3 THEN 'long' END AS addinfo13sub02, "
    "CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS addinfo17 FROM lineitem GROUP BY l_orderkey), "
    "j AS (SELECT b.*, s1.addinfo03_y, s1.addinfo13sub01, s1.addinfo08, s4.addinfo13sub02, s4.addinfo17 "
    "FROM base b LEFT JOIN sub01 s1 ON s1.uid = b.uid LEFT JOIN sub04 s4 ON s4.uid = b.uid WHERE b.state = '임보가능'), "
    "m AS (SELECT *, " + X.strip("concat_ws(' ', coalesce(addinfo13, ''), coalesce(addinfo13sub01, ''), "
                                  "coalesce(addinfo13sub02, ''))") + " AS merged FROM j) "
    "SELECT uid AS \"Pk\", state AS \"상태\", addinfo01_x AS \"이름\", addinfo07 AS \"몸무게\", addinfo03_x AS \"성별\", "
    "addinfo05 AS \"출생\", addinfo08 AS \"해시태그\", addinfo17 AS \"접종현황\", addinfo03_y AS \"유의사항\", "
    "CASE WHEN merged <> '' THEN merged END AS \"임보가능_기간_통합\", "
    + X.age_months_text("addinfo05", AS_OF) + " AS \"나이_개월수\" FROM m")


@register("enrich_three_way", _ENRICH_SQL)
def q_enrich_three_way(spark: SparkSession, d: str) -> DataFrame:
    """JN1–JN2, PRJ1–PRJ3, PRJ7, SC10, SRC3: the whole enrichment plan (1:N fan-out kept)."""
    return enrich_full(spark, d)


@register("enrich_three_way_salted", _ENRICH_SQL)
def q_enrich_three_way_salted(spark: SparkSession, d: str) -> DataFrame:
    """The same plan with the skew-safe salted left joins (orders with the most line items are
    the hot keys here); the answer must not change."""
    return enrich_full(spark, d, salts=8, hot_fraction=1e-4)


# ================================================================================================
# Re-rank flow (RR1–RR5, SRT4, SNK5, WIN2, WIN4, FLT22, PIPE4)
# ================================================================================================
def _prompt_item_sql() -> str:
    return ("chr(10) || CAST(rank AS VARCHAR) || '. 이름: ' || name || chr(10) || '   설명: ' || description || chr(10) "
            "|| '   유사도 점수: ' || printf('%.3f', sim) || chr(10)")


_PROMPT_HEAD_SQL = "'사용자 쿼리:' || chr(10) || '\"' || text || '\"' || chr(10) || chr(10) || '아래는 추천 후보 동물 리스트입니다:'"
_PROMPT_TAIL_SQL = " || ".join("chr(10)" if part == "\n" else X.q(part)
                               for part in K.PROMPT_TAIL.replace("\n", "\x00\n\x00").split("\x00") if part != "")


@register("rerank_prompts", with_raw(
    "SELECT c.qid, " + _PROMPT_HEAD_SQL + " || string_agg(" + _prompt_item_sql() + ", '' ORDER BY c.rank) || "
    + _PROMPT_TAIL_SQL + " AS prompt FROM cands c JOIN (" + A.VQUERIES_SQL + ") qt ON qt.qid = c.qid "
    "GROUP BY c.qid, qt.text", _ITEMS_SQL + ", " + PREPARED_CTE + ", " + _CANDS_SQL))
def q_rerank_prompts(spark: SparkSession, d: str) -> DataFrame:
    """RR1 + RR2 for every query in one job (shuffle only to group each query's k candidates)."""
    return R.prompts(candidates(spark, d), A.vector_queries(spark, d))


def composed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Reply texts composed from every part row, covering every parsing rule."""
    p = A.table(spark, d, "part", wide=True, key="p_partkey")
    k = "p_partkey"
    lines = [
        F.lit("추천 리스트:"),
        F.concat(F.lit("1. 이름: "), F.col("p_name")),
        F.concat(F.lit("   이유: "), F.col("p_type")),
        F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("2. "), F.col("p_brand")))
        .otherwise(F.concat(F.lit("2. 이름: "), F.col("p_brand"))),
        F.when(F.pmod(k, F.lit(4)) != 1, F.lit("   이유: brand reason")),
        F.when(F.pmod(k, F.lit(11)) == 0, F.lit("4. 이름:")),
        F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.lit("3. 이름:"), F.col("p_name"))).otherwise(F.lit("3. 이름: a 이름: b")),
        F.when(F.pmod(k, F.lit(5)) == 0, F.lit("6. 이름: six")),
        F.concat(F.lit("   이유: size "), F.col("p_size").cast("string")),
        F.lit("10. 이름: ten"),
        F.lit("이유: 이유: double "),
    ]
    return p.select(F.col(k).alias("qid"), F.concat_ws("\n", *lines).alias("reply"), F.col("p_name").alias("text"))


_REPLIES_SQL = (
    "replies AS (SELECT p_partkey AS qid, p_name AS text, concat_ws(chr(10), '추천 리스트:', '1. 이름: ' || p_name, "
    "'   이유: ' || p_type, CASE WHEN p_partkey % 3 = 0 THEN '2. ' || p_brand ELSE '2. 이름: ' || p_brand END, "
    "CASE WHEN p_partkey % 4 <> 1 THEN '   이유: brand reason' END, CASE WHEN p_partkey % 11 = 0 THEN '4. 이름:' END, CASE WHEN p_partkey % 2 = 0 THEN '3. 이름:' || p_name ELSE '3. 이름: a 이름: b' END, "
    "CASE WHEN p_partkey % 5 = 0 THEN '6. 이름: six' END, '   이유: size ' || CAST(p_size AS VARCHAR), "
    "'10. 이름: ten', '이유: 이유: double ') AS reply FROM part)")


def _parse_sql(replies: str = "replies") -> str:
    starts = " OR ".join(f"starts_with(line, '{p}')" for p in [f"{i}." for i in range(1, K.FALLBACK_PICKS + 1)])
    return (
        f"lines AS (SELECT qid, unnest(string_split(reply, chr(10))) AS raw, "
        f"unnest(range(len(string_split(reply, chr(10))))) AS pos FROM {replies}), "
        f"l2 AS (SELECT qid, pos, {X.strip('raw')} AS line FROM lines), "
        f"l3 AS (SELECT *, ({starts}) AS is_start, starts_with(line, '이유:') AS is_reason FROM l2), "
        "l4 AS (SELECT *, sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY pos "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seq FROM l3), "
        "its AS (SELECT qid, seq, max(CASE WHEN is_start AND contains(line, '이름:') THEN 1 END) AS named, "
        f"max(CASE WHEN is_start AND contains(line, '이름:') THEN {X.strip("(string_split(line, '이름:')[-1])")} END) AS name, "
        f"arg_max(CASE WHEN NOT is_start AND is_reason THEN {X.strip("replace(line, '이유:', '')")} END, "
        "CASE WHEN NOT is_start AND is_reason THEN pos END) AS reason FROM l4 WHERE seq > 0 GROUP BY qid, seq), "
        "picks AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY seq) AS item, name, reason "
        "FROM its WHERE named = 1)")


@register("parse_replies", f"WITH {_REPLIES_SQL}, {_parse_sql()} SELECT qid, item, name, reason FROM picks")
def q_parse_replies(spark: SparkSession, d: str) -> DataFrame:
    """RR3 + WIN2 + WIN4 over one composed reply per part row."""
    return R.parse_replies(composed_replies(spark, d))


@register("shown_picks", f"WITH {_REPLIES_SQL}, {_parse_sql()} SELECT qid, item, name, reason FROM picks "
          "WHERE name IS NOT NULL AND reason IS NOT NULL")
def q_shown_picks(spark: SparkSession, d: str) -> DataFrame:
    """RR4: picks with both a name and a reason."""
    return R.shown_picks(R.parse_replies(composed_replies(spark, d)))


def _sat_text(c_user: str = "user_id", c_type: str = "event_type"):
    return (F.when(F.col(c_type) == "view", F.pmod(c_user, F.lit(9)).cast("string"))
            .when(F.col(c_type) == "click", F.concat(F.lit(" "), F.pmod(c_user, F.lit(7)).cast("string"), F.lit(" ")))
            .when(F.col(c_type) == "error", F.concat(F.lit("x"), F.pmod(c_user, F.lit(5)).cast("string")))
            .when(F.col(c_type) == "purchase", F.concat(F.lit("0"), F.pmod(c_user, F.lit(6)).cast("string")))
            .otherwise(F.lit("")))


_SAT_TEXT_SQL = ("CASE event_type WHEN 'view' THEN CAST(user_id % 9 AS VARCHAR) WHEN 'click' THEN ' ' || "
                 "CAST(user_id % 7 AS VARCHAR) || ' ' WHEN 'error' THEN 'x' || CAST(user_id % 5 AS VARCHAR) "
                 "WHEN 'purchase' THEN '0' || CAST(user_id % 6 AS VARCHAR) ELSE '' END")


def _sat_valid_sql(t: str) -> str:
    s = X.strip(t)
    return (f"CASE WHEN regexp_full_match({s}, '[0-9]+') AND TRY_CAST({s} AS BIGINT) BETWEEN 1 AND 5 "
            f"THEN CAST({s} AS INTEGER) END")


@register("satisfaction_valid", f"SELECT event_id, t AS text, {_sat_valid_sql('t')} AS satisfaction FROM "
          f"(SELECT event_id, {_SAT_TEXT_SQL} AS t FROM events)")
def q_satisfaction_valid(spark: SparkSession, d: str) -> DataFrame:
    """FLT22 over a rating text derived from every event."""
    ev = A.table(spark, d, "events").select("event_id", _sat_text().alias("text"))
    return ev.select("event_id", "text", P.satisfaction_valid("text").alias("satisfaction"))


@register("pick_log",
          f"WITH {_REPLIES_SQL}, {_parse_sql()} SELECT '2026-12-01 00:00:00' AS timestamp, r.text AS user_query, "
          "p.item AS rank, coalesce(p.name, '이름없음') AS animal_name, coalesce(p.reason, '이유없음') AS reason, "
          + _sat_valid_sql("CAST(r.qid % 7 AS VARCHAR)") + " AS satisfaction FROM picks p JOIN replies r ON r.qid = p.qid")
def q_pick_log(spark: SparkSession, d: str) -> DataFrame:
    """SNK5 rows (RR5 defaults, WIN2 ranks) with a fixed timestamp."""
    rep = composed_replies(spark, d)
    picks = R.parse_replies(rep)
    sat = P.satisfaction_valid(F.pmod("qid", F.lit(7)).cast("string"))
    return R.pick_log(picks, rep.select("qid", "text"), satisfaction=sat,
                                ts=F.lit("2026-12-01 00:00:00"))


def rerank_replies(spark: SparkSession, d: str, cands: DataFrame) -> DataFrame:
    """Replies that pick candidates 3, 1, 5 (in that order); label-0 queries get an empty reply."""
    order = F.when(F.col("rank") == 3, 1).when(F.col("rank") == 1, 2).when(F.col("rank") == 5, 3)
    lines = (cands.where(order.isNotNull())
             .select("qid", order.alias("o"),
                     F.concat(order.cast("string"), F.lit(". 이름: "), F.col("name"), F.lit("\n   이유: rank "),
                              F.col("rank").cast("string")).alias("line")))
    body = lines.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))),
                                                             lambda x: x["line"]), "\n").alias("body"))
    q = A.vector_queries(spark, d).select("qid", "label")
    return (q.join(body, "qid", "left")
            .select("qid", F.when(F.col("label") == 0, F.lit("추천 리스트:"))
                    .otherwise(F.concat(F.lit("추천 리스트:\n"), F.col("body"))).alias("reply")))


@register("rerank_final", with_raw(
    "SELECT qid, pick_rank, name, uid, sim_rank, source FROM ("
    "SELECT p.qid, p.item AS pick_rank, p.name, c.uid, c.sim_rank, 'rerank' AS source FROM picks p LEFT JOIN "
    "(SELECT qid, name, arg_min(uid, rank) AS uid, min(rank) AS sim_rank FROM cands GROUP BY qid, name) c "
    "ON c.qid = p.qid AND c.name = p.name "
    "UNION ALL SELECT c.qid, c.rank, c.name, c.uid, c.rank, 'similarity' FROM cands c "
    "WHERE c.rank <= 5 AND c.qid NOT IN (SELECT DISTINCT qid FROM picks))",
    _ITEMS_SQL + ", " + PREPARED_CTE + ", " + _CANDS_SQL + ", "
    "body AS (SELECT qid, string_agg(CAST(o AS VARCHAR) || '. 이름: ' || name || chr(10) || '   이유: rank ' "
    "|| CAST(rank AS VARCHAR), chr(10) ORDER BY o) AS body FROM (SELECT *, CASE rank WHEN 3 THEN 1 WHEN 1 THEN 2 "
    "WHEN 5 THEN 3 END AS o FROM cands) WHERE o IS NOT NULL GROUP BY qid), "
    f"replies AS (SELECT q.qid, CASE WHEN q.label = 0 THEN '추천 리스트:' ELSE '추천 리스트:' || chr(10) || b.body END "
    f"AS reply FROM ({A.VQUERIES_SQL}) q LEFT JOIN body b ON b.qid = q.qid), " + _parse_sql()))
def q_rerank_final(spark: SparkSession, d: str) -> DataFrame:
    """PIPE4: candidates -> replies -> parsed picks -> picks joined back to candidates, with the
    similarity fallback (top 5) for queries whose reply names nothing (SRT4)."""
    # the candidate table is read three times (replies, join-back, fallback): it is written once under
    # the shared folder instead of re-running the free-text join and the top-k for every use
    from pawgrid.session import run_path
    from pawgrid.sources.sinks import materialise
    cands = materialise(spark, run_path(spark, "candidates"), lambda: candidates(spark, d))
    picks = R.parse_replies(rerank_replies(spark, d, cands))
    return R.final_picks(picks, cands)


# ================================================================================================
# Pages (PG1–PG12, JN6–JN7, WIN3, SET1, SRC7–SRC8, AGG11, SNK2)
# ================================================================================================
def _li_sql(container: str = "<nav") -> str:
    top = X.first("li", r'(?s)class="top"[^>]*>(.*?)</(?:p|div|span|strong)>')
    bottom = X.first("li", r'(?s)class="bottom"[^>]*>(.*?)</(?:p|div)>')
    parts = f"list_transform(regexp_split_to_array({bottom}, '<[^>]*>'), lambda s: {X.strip(X.decode('s'))})"
    nums = (f"list_transform(list_filter({parts}, lambda s: contains(s, '{K.PAGE_LIST_NOTICE_LABEL}')), "
            f"lambda s: {X.strip("(replace(s, " + X.q(K.PAGE_LIST_NOTICE_LABEL) + ", ''))")})")
    from pawgrid.functions.text import WS_CLASS
    name = f"nullif(string_split_regex({X.node_text(top)}, {X.q(WS_CLASS + '+')})[1], '')"
    return (
        f"pg AS (SELECT page_id, url, {X.first('html', '(?s)' + container + r'[^>]*>(.*?)</ul>')} AS seg FROM pages), "
        "lis AS (SELECT page_id, url, regexp_extract_all(seg, '(?s)<li[^>]*>(.*?)</li>', 1) AS arr FROM pg "
        "WHERE seg IS NOT NULL), "
        "li AS (SELECT page_id, url, unnest(arr) AS li, unnest(range(len(arr))) AS pos FROM lis), "
        f"items AS (SELECT page_id, pos, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || "
        f"{X.first('li', r'(?s)<a\s[^>]*?href=\"([^\"]*)\"')} AS \"{K.PAGE_ITEM_LINK}\", {name} AS \"{K.PAGE_ITEM_NAME}\", "
        f"{nums}[-1] AS \"{K.PAGE_KEY_NOTICE}\", {X.first('li', r'(?s)<a\s[^>]*?href=\"([^\"]*)\"')} AS href FROM li)")


def page_items(spark: SparkSession, d: str) -> DataFrame:
    pages = A.table(spark, d, "pages", wide=True, key="page_id")
    return PG.list_items(pages, PG.site_root(F.col("url")), container="nav")


@register("page_list_items", "WITH " + _li_sql() + f" SELECT page_id, pos, \"{K.PAGE_ITEM_LINK}\", "
          f"\"{K.PAGE_ITEM_NAME}\", \"{K.PAGE_KEY_NOTICE}\" FROM items WHERE href IS NOT NULL")
def q_page_list_items(spark: SparkSession, d: str) -> DataFrame:
    """PG1 over every stored page (navigation list as the item container)."""
    return page_items(spark, d)


_RUN_PAGES = 100  # list pages of one crawl run


@register("crawl_summary", "WITH " + _li_sql() + f" SELECT CAST(page_id // {_RUN_PAGES} AS BIGINT) AS run, "
          "count(*) AS collected_count, "
          f"string_agg(coalesce(nullif(\"{K.PAGE_ITEM_NAME}\", ''), '{K.CRAWL_NO_NAMES}'), ', ' ORDER BY page_id, pos) "
          "AS animal_names FROM items WHERE href IS NOT NULL GROUP BY 1")
def q_crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG11 / SNK2 rows: per crawl run (at most 100 list pages) the item count and the joined names."""
    items = page_items(spark, d).withColumn("run", F.floor(F.col("page_id") / _RUN_PAGES).cast("long"))
    return ST.crawl_summary(items.withColumn("place", F.struct("page_id", "pos")), "run", order_col="place")


@register("page_texts",
          "SELECT page_id, CASE WHEN wrap IS NOT NULL THEN array_to_string(ps, ', ') END AS texts, "
          "CASE WHEN wrap IS NOT NULL THEN CAST(len(ps) AS BIGINT) END AS n_paragraphs FROM (SELECT page_id, wrap, "
          f"list_transform(string_split(wrap, '<p>')[2:], lambda x: {X.node_text("split_part(x, '</p>', 1)")}) AS ps "
          f"FROM (SELECT page_id, {X.first('html', '(?s)<article[^>]*>(.*?)</article>')} AS wrap FROM pages))")
def q_page_texts(spark: SparkSession, d: str) -> DataFrame:
    """PG4 generalised: paragraph texts of each page's article, whole pages."""
    return PG.page_texts(A.table(spark, d, "pages", wide=True, key="page_id"))


# ================================================================================================
# Incremental read, streaming twin, stage materialisation (SRC2, STR1, SNK7, SRC5)
# ================================================================================================
MARK = "2024-01-15 00:00:00"
_INCR_SQL = f"SELECT event_id, user_id, event_type, value FROM events WHERE ts > TIMESTAMP '{MARK}'"


@register("incremental_read", _INCR_SQL)
def q_incremental_read(spark: SparkSession, d: str) -> DataFrame:
    """SRC2: rows strictly after the high-water mark (pushed into the parquet scan)."""
    ev = A.table(spark, d, "events")
    return RD.read_incremental(ev, "ts", MARK).select("event_id", "user_id", "event_type", "value")


@register("incremental_mark", f"SELECT epoch_us(max(ts)) AS mark_us, count(*) AS n_new FROM events "
          f"WHERE ts > TIMESTAMP '{MARK}'")
def q_incremental_mark(spark: SparkSession, d: str) -> DataFrame:
    """SRC2: the next mark (max timestamp of the increment, as epoch microseconds) and its size."""
    inc = RD.read_incremental(A.table(spark, d, "events"), "ts", MARK)
    return inc.agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("mark_us"), F.count(F.lit(1)).alias("n_new"))


@register("incremental_stream", _INCR_SQL)
def q_incremental_stream(spark: SparkSession, d: str) -> DataFrame:
    """STR1: the same increment through Structured Streaming (file source, availableNow trigger,
    checkpointed foreachBatch into a table under the shared checkpoint folder)."""
    from pawgrid.session import run_path
    from pawgrid.streaming.incremental import drain_to_table, stream_files
    src = f"{d}/events.parquet"
    schema = spark.read.parquet(src).schema
    src = src[:-1] + "[t]"  # a file source watches a folder or a glob; the glob names exactly this file
    out = run_path(spark, "incremental")
    stream = stream_files(spark, src, schema)
    drain_to_table(stream, out, run_path(spark, "incremental-checkpoint"),
                   transform=lambda b, _e: RD.read_incremental(b, "ts", MARK)
                   .select("event_id", "user_id", "event_type", "value"))
    return spark.read.parquet(out).drop("batch_id")


@register("materialised_prepared", with_raw(
    "SELECT uid, state, kind, addinfo01, addinfo03, addinfo05, addinfo07 FROM prepared", ", " + PREPARED_CTE))
def q_materialised_prepared(spark: SparkSession, d: str) -> DataFrame:
    """SNK7 + SRC5: the prepared stage written once under the shared checkpoint folder and read
    back (the write also cuts lineage for later stages)."""
    from pawgrid.session import run_path
    from pawgrid.sources.sinks import materialise
    t = materialise(spark, run_path(spark, "prepared"), lambda: prepared(spark, d))
    return t.select("uid", "state", "kind", "addinfo01", "addinfo03", "addinfo05", "addinfo07")


# ================================================================================================
# Embedding job and text-to-listing matching (EMB1–EMB3, EMB5, WIN5, AGG13, PIPE4/5)
# ================================================================================================
DIM = 64
LISTING_FAIL, QUERY_FAIL = "password", " wh "  # texts that the stand-in embedder refuses


def _hash_vectors_sql(name: str, source: str, key: str, fail: str) -> str:
    """CTEs: ``name`` (key, v) with the hashed vector of every text of ``source`` that is not refused."""
    return (f"{name}_w AS (SELECT {key}, unnest(string_split(lower(coalesce(text, '')), ' ')) AS w FROM {source} "
            f"WHERE NOT contains(coalesce(text, ''), {X.q(fail)})), "
            f"{name}_b AS (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIM} AS b, "
            f"sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS s FROM {name}_w "
            "WHERE w <> '' GROUP BY 1, 2), "
            f"{name}_m AS (SELECT {key}, map(list(b), list(s)) AS m FROM {name}_b GROUP BY 1), "
            f"{name} AS (SELECT t.{key}, CASE WHEN contains(coalesce(t.text, ''), {X.q(fail)}) THEN NULL ELSE "
            f"[coalesce(m.m[i], 0.0) for i in range({DIM})] END AS v FROM {source} t LEFT JOIN {name}_m m USING ({key}))")


_DOC_VECTORS = ("WITH docs AS (SELECT doc_id, text FROM documents), "
                + _hash_vectors_sql("vec", "docs", "doc_id", LISTING_FAIL))


@register("embed_batch", _DOC_VECTORS + f" SELECT doc_id, v IS NULL AS failed, CAST({DIM} AS BIGINT) AS dim, "
          "round(coalesce(sqrt(list_dot_product(v, v)), 0.0), 6) AS norm FROM vec")
def q_embed_batch(spark: SparkSession, d: str) -> DataFrame:
    """EMB1 over every whole document: batched, per-text fallback, zero vector + flag on failure."""
    docs = A.table(spark, d, "documents", wide=True, key="doc_id")
    emb = V.embed(docs, "text", V.hashing_embedder(DIM, LISTING_FAIL), DIM, key="doc_id")
    return emb.select("doc_id", "failed", F.size("embedding").cast("long").alias("dim"),
                      F.round(V.norm("embedding"), 6).alias("norm"))


@register("embed_summary", _DOC_VECTORS + " SELECT count(v) AS ok, count(*) - count(v) AS failed FROM vec")
def q_embed_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG13 over the batch embedding of every document; the embedder refuses some."""
    docs = A.table(spark, d, "documents", wide=True, key="doc_id")
    return V.embed_summary(V.embed(docs, "text", V.hashing_embedder(DIM, LISTING_FAIL), DIM, key="doc_id"))


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """SC5 + EMB3 for every user turn: slot group from the text, vector of the cleaned text; a turn
    whose embedding failed has no result."""
    q = PR.extract_slots(A.user_queries(spark, d), "text", rules=A.TEXT_SLOT_RULES)
    q = q.select("qid", "text", PR.slot_group().alias("slot_group"), T.clean_query("text").alias("clean"))
    qv = V.embed(q, "clean", V.hashing_embedder(DIM, QUERY_FAIL), DIM, key="qid", keep=("slot_group", "text"))
    return qv.where(~F.col("failed")).drop("failed")


def recommend_by_text(spark: SparkSession, d: str, queries: DataFrame, sizes: DataFrame, k: int = 10) -> DataFrame:
    """EMB2 + EMB5: listings embedded from their SC12 text (a failed one ranks with similarity 0),
    exact cosine top-k among those that meet the query's hard slots."""
    listings = RD.open_listings(A.raw_listings(spark, d))
    texts = D.with_embedding_text(listings, "etext").select("uid", "etext", PR.slot_mask().alias("slot_mask"))
    items = V.embed(texts, "etext", V.hashing_embedder(DIM, LISTING_FAIL), DIM, key="uid", keep=("slot_mask",))
    return V.top_k_similar(queries, items, k, q_group="slot_group", i_mask="slot_mask", read_twice=False,
                           sizes=(sizes, RD.open_listings(A.raw_listings(spark, d, long_text=False))))


_TEXT_TOP_SQL = (
    f", lt AS (SELECT uid, {_embedding_text_sql()} AS text FROM raw WHERE state = '임보가능'), "
    + _hash_vectors_sql("lv", "lt", "uid", LISTING_FAIL)
    + f", uq AS (SELECT qid, text AS raw_text, {X.clean_query('text')} AS text, "
    + ", ".join(f"{_slot_case_sql(s)} AS {s}" for s in ("size", "age", "gender")) + f" FROM ({A.USER_QUERIES_SQL})), "
    + _hash_vectors_sql("qv", "uq", "qid", QUERY_FAIL)
    + ", items AS (SELECT r.uid, l.v, r.addinfo03, r.addinfo05, " + X.strict_double("r.addinfo07")
    + " AS w FROM raw r JOIN lv l ON l.uid = r.uid), "
    "qs AS (SELECT u.qid, u.raw_text, u.size, u.age, u.gender, q.v FROM uq u JOIN qv q USING (qid) WHERE q.v IS NOT NULL{only}), "
    f"top AS (SELECT qid, rank, uid, sim FROM (SELECT q.qid, i.uid, {_COS} AS sim, row_number() OVER (PARTITION BY q.qid "
    f"ORDER BY round({_COS}, 9) DESC, i.uid) AS rank FROM qs q JOIN items i ON {_SLOT_OK}) t WHERE rank <= 10)")


@register("recommend_text", with_raw("SELECT qid, rank, uid, round(sim, 6) AS similarity FROM top",
                                     _TEXT_TOP_SQL.replace("{only}", "")))
def q_recommend_text(spark: SparkSession, d: str) -> DataFrame:
    """EMB5 end to end for every user turn."""
    top = recommend_by_text(spark, d, text_queries(spark, d), A.user_queries(spark, d))
    return top.withColumn("similarity", F.round("similarity", 6))


_LAST_TURN_SQL = " AND q.qid = (SELECT max(qid) FROM qv WHERE v IS NOT NULL)"


@register("single_query_chain", with_raw(
    "SELECT t.qid, " + _PROMPT_HEAD_SQL.replace("text", "max(q.raw_text)") + " || string_agg(chr(10) || CAST(t.rank AS VARCHAR) || "
    "'. 이름: ' || r.addinfo01 || chr(10) || '   설명: ' || " + _cand_desc_sql("r") + " || chr(10) || '   유사도 점수: ' "
    "|| printf('%.3f', t.sim) || chr(10), '' ORDER BY t.rank) || " + _PROMPT_TAIL_SQL + " AS prompt, "
    "list(r.addinfo01 ORDER BY t.rank)[1:3] AS picks FROM top t JOIN prepared r ON r.uid = t.uid JOIN qs q ON q.qid = t.qid "
    "GROUP BY t.qid", _TEXT_TOP_SQL.replace("{only}", _LAST_TURN_SQL) + ", " + PREPARED_CTE))
def q_single_query_chain(spark: SparkSession, d: str) -> DataFrame:
    """PIPE5: one user turn through the whole chain: text -> slots -> hard filter and top-k ->
    prompt -> reply (the stand-in model names the first three candidates) -> parsed picks."""
    from pawgrid.session import run_path
    from pawgrid.sources.sinks import materialise
    # one row, used twice: the turns are embedded once
    turn = materialise(spark, run_path(spark, "turn"), lambda: text_queries(spark, d).orderBy(F.desc("qid")).limit(1))
    top = recommend_by_text(spark, d, turn, A.user_queries(spark, d).limit(1))
    cands = R.with_candidate_text(R.candidate_rows(top, prepared(spark, d), LINK_PREFIX))
    asked = R.prompts(cands, turn.select("qid", "text"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". 이름: "), F.col("name"))
    replies = cands.where(F.col("rank") <= 3).groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n")
        .alias("reply"))
    picks = R.parse_replies(replies).groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("item", "name"))), lambda x: x["name"]).alias("picks"))
    return asked.join(picks, "qid")


# ================================================================================================
# Crawl table: list pages + detail pages -> one wide row per item (PIPE9, PG12, JN6, SRC8)
# ================================================================================================
SITE = "https://site.example"


def composed_list_pages(spark: SparkSession, d: str) -> DataFrame:
    """List pages of 10 items each (page = part key div 10), in the site's list markup."""
    p = A.table(spark, d, "part")
    li = F.concat(F.lit('<li><a href="/d/'), F.col("p_partkey").cast("string"), F.lit('"><p class="top">'),
                  F.col("p_name"), F.lit('</p><p class="bottom"><span>지역</span><span>공고번호 '),
                  F.col("p_partkey").cast("string"), F.lit("</span></p></a></li>"))
    pages = (p.groupBy(F.floor(F.col("p_partkey") / 10).cast("long").alias("page_id"))
             .agg(F.array_sort(F.collect_list(F.struct("p_partkey", li.alias("li")))).alias("items")))
    return pages.select("page_id", F.concat(F.lit('<div class="lst_wrap"><ul>'),
                                            F.array_join(F.transform("items", lambda x: x["li"]), ""),
                                            F.lit("</ul></div>")).alias("html"))


def _labels_sql() -> dict[str, tuple[str, str]]:
    """Label -> (when the composed detail page has it, its value), from the source columns."""
    k = "p_partkey"
    return {
        K.PAGE_KEY_NOTICE: ("true", f"CASE WHEN {k} % 7 <> 0 THEN CAST({k} AS VARCHAR) END"),
        # without as many descriptions as terms only the text line with a colon counts, and it is empty
        K.PAGE_ITEM_NAME: ("true", f"CASE WHEN {k} % 5 = 0 THEN '' ELSE p_name END"),
        "브랜드 ": (f"{k} % 5 <> 0", "p_brand"),
        K.PAGE_KEY_TAGS: ("true", f"CASE WHEN {k} % 3 <> 0 THEN array_to_string(list_transform(string_split(p_name, ' '), "
                                  "lambda w: '#' || w), ', ') END"),
        "종류": ("true", "p_type"),
        "크기": ("true", "CAST(p_size AS VARCHAR) || 'kg'"),
        "임보조건_기간": ("true", f"CAST({k} % 12 + 1 AS VARCHAR) || '개월'"),
        K.PAGE_KEY_HOMES: ("true", f"CASE WHEN {k} % 2 = 0 THEN '아파트, 주택' ELSE '아파트' END"),
        "건강정보_접종": (f"{k} % 4 <> 0", f"CASE WHEN {k} % 2 = 0 THEN '완료' ELSE '미완료' END"),
        "건강정보_종류": (f"{k} % 4 <> 0", "p_type"),
        "참고용정보_가격": ("true", "CAST(p_retailprice AS VARCHAR)"),
        "참고용정보_브랜드": ("true", "p_brand"),
        K.PAGE_KEY_TERMS: (f"{k} % 5 <> 1", "'사료, & 용품'"),
    }


_LABELS = {k: v for k, v in _labels_sql().items()}
CRAWL_LABELS = list(_LABELS)


@register("page_detail_records", " UNION ALL ".join(
    f"SELECT p_partkey AS page_id, {X.q(label)} AS key, {value} AS value FROM part WHERE {has}"
    for label, (has, value) in _LABELS.items()))
def q_page_detail_records(spark: SparkSession, d: str) -> DataFrame:
    """PG2–PG11 + SRC8: label/value records of one composed detail page per part row."""
    return PG.detail_records(A.detail_pages(spark, d))


@register("crawl_table",
          f"SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS page_id, "
          "CAST(row_number() OVER (PARTITION BY floor(p_partkey / 10) ORDER BY p_partkey) - 1 AS BIGINT) AS pos, "
          f"'{SITE}/d/' || CAST(p_partkey AS VARCHAR) AS \"상세링크\", "
          + ", ".join(f"CASE WHEN {has} THEN {value} END AS \"{label}\"" for label, (has, value) in _LABELS.items())
          + " FROM part")
def q_crawl_table(spark: SparkSession, d: str) -> DataFrame:
    """PG1 + PG11 + PG12 + JN6 + SRC8: list items merged with all labels of their detail pages; a
    label of the detail page wins, even when null or empty."""
    from pawgrid.plans.crawl import crawl_table
    details = A.detail_pages(spark, d).select(
        F.concat(F.lit(f"{SITE}/d/"), F.col("page_id").cast("string")).alias("page_id"), "html")
    return crawl_table(composed_list_pages(spark, d), details, SITE, CRAWL_LABELS)


_SCAN_HTML = "CASE WHEN page_id % 90 = 89 THEN '<nav><ul></ul></nav>' WHEN page_id % 7 = 3 THEN NULL ELSE html END"


@register("scan_list_pages",
          f"WITH stored AS (SELECT page_id, url, {_SCAN_HTML} AS html FROM pages), "
          + _li_sql().replace("FROM pages)", "FROM stored)", 1) + ", "
          "cnt AS (SELECT p.page_id, count(i.href) AS n FROM stored p LEFT JOIN items i "
          "ON i.page_id = p.page_id AND i.href IS NOT NULL WHERE p.html IS NOT NULL GROUP BY p.page_id), "
          "stop AS (SELECT min(page_id + 1) AS s FROM cnt WHERE n = 0) "
          f"SELECT page_id + 1 AS page_no, pos, \"{K.PAGE_ITEM_LINK}\", \"{K.PAGE_ITEM_NAME}\", \"{K.PAGE_KEY_NOTICE}\" "
          "FROM items, stop WHERE href IS NOT NULL AND (stop.s IS NULL OR page_id + 1 < stop.s)")
def q_scan_list_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC7 (page number = page_id + 1): every seventh page failed to load and is skipped, the scan
    ends at the first page without items (the 90th)."""
    from pawgrid.plans.crawl import scan_list_pages
    pages = A.table(spark, d, "pages", wide=True, key="page_id")
    numbered = pages.select((F.col("page_id") + 1).alias("page_no"), "url", F.expr(_SCAN_HTML).alias("html"))
    return scan_list_pages(numbered, PG.site_root(F.col("url")), container="nav")


_HARD_CASES = [("소형", "고령", "남"), ("중형", "어린", None), (None, None, "여"), ("대형", None, None)]


def _hard_sql(size, age, gender) -> str:
    conds = ["state = '임보가능'"]
    if size:
        conds.append({"소형": "w < 7", "중형": "w >= 7 AND w < 20", "대형": "w >= 20"}[size])
    if age:
        conds.append(f"coalesce(regexp_matches(addinfo05, {X.q(K.HARD_AGE_PATTERNS[age])}), false)")
    if gender:
        conds.append(f"addinfo03 = {X.q(gender)}")
    return " AND ".join(conds)


@register("hard_filter_slots", with_raw(
    " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS case_no, uid FROM (SELECT *, {X.strict_double('addinfo07')} AS w "
                       f"FROM raw) WHERE {_hard_sql(*c)}" for i, c in enumerate(_HARD_CASES))))
def q_hard_filter_slots(spark: SparkSession, d: str) -> DataFrame:
    """FLT16–FLT19 for literal slot sets, all cases in one scan of the open listings: each
    listing emits the numbers of the cases it satisfies."""
    raw = RD.open_listings(A.raw_listings(spark, d, long_text=False))
    hits = F.filter(F.array(*[F.when(PR.hard_filter(*c), F.lit(i).cast("long")) for i, c in enumerate(_HARD_CASES)]),
                    lambda x: x.isNotNull())
    return raw.select(F.explode(hits).alias("case_no"), "uid")
