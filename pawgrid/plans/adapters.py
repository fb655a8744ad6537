"""Adapters: derive listing-shaped tables from the driver's TPC-H-style test tables.

The library operates on listings, vectors, queries, replies and pages; the test data holds
``part``, ``embeddings``, ``documents``, ``conversations``, ``pages``, ``orders``, ``lineitem``
and ``events``.  Each adapter is a pure projection (plus one left join for long free text) of
the WHOLE table — no row subset — and has a DuckDB SQL twin of identical meaning used by the
oracle queries.  Modulo expressions below only derive attribute values; they never filter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False, key: str | None = None) -> DataFrame:
    """The whole test table; ``wide=True`` spreads a few-split scan over the cores before
    CPU-heavy per-row work (a no-op when the scan already has enough splits).

    Each table is registered once per session as a temp view, so later reads reuse its listed
    file index and footer schema instead of listing and reading them again."""
    view = "pawgrid_" + hashlib.sha1(f"{sf_dir.rstrip('/')}/{name}".encode()).hexdigest()[:12]
    if not spark.catalog.tableExists(view):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)
    df = spark.table(view)
    if not wide:
        return df
    return spread(df, key) if key else spread(df)


def _m(c: str, n: int):
    return F.pmod(F.col(c), F.lit(n))


# ----------------------------------------------------------------------------------------------
# structured listing (filter / score model)
# ----------------------------------------------------------------------------------------------
def structured_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = "p_partkey"
    traits = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("affection").alias("key"), (_m(k, 5) + 1).cast("double").alias("value")),
        F.struct(F.lit("barking").alias("key"),
                 F.when(_m(k, 10) != 9, (F.pmod(F.floor(F.col(k) / 5.0), F.lit(5)) + 1).cast("double"))
                 .alias("value")),
    ), lambda e: e["value"].isNotNull()))
    care = F.struct(
        F.when(_m(k, 9) == 0, F.lit(K.NATIONWIDE)).otherwise(F.col("p_brand")).alias("region"),
        F.when(_m(k, 5) != 4, (_m(k, 12) + 1).cast("double")).alias("duration"),
        F.when(_m(k, 6) != 0, F.split(F.when(_m(k, 2) == 0, F.lit("visit")).otherwise(F.lit("visit delivery")), " "))
        .alias("pickup"),
        F.when(_m(k, 8) != 0, F.split(F.concat_ws(" ", "p_type", "p_brand"), " ")).alias("suitable_homes"),
        F.when(_m(k, 5) == 0, F.concat(F.lit("No "), F.col("p_type"))).alias("additional_conditions"),
    )
    health = F.struct(
        F.when(_m(k, 4) == 1, F.array(F.lit("v1"))).when(_m(k, 4) >= 2, F.array(F.lit("v1"), F.lit("v2"), F.lit("v3")))
        .alias("vaccination"),
        F.when(_m(k, 3) == 0, F.col("p_name")).alias("medical_history"),
    )
    return p.select(
        F.col(k).alias("uid"),
        F.col("p_name").alias("name"),
        F.when(_m(k, 4) == 3, F.lit("임보완료")).otherwise(F.lit(K.OPEN_STATE)).alias("status"),
        F.when(_m(k, 3) == 0, F.lit("male")).when(_m(k, 3) == 1, F.lit("female")).alias("gender"),
        F.when(_m(k, 11) != 0, F.pmod(F.col("p_size"), F.lit(17)).cast("double")).alias("age"),
        F.when(_m(k, 13) != 0, (F.col("p_retailprice") - 900.0) / 2.0).alias("weight"),
        (_m(k, 2) == 0).alias("neutered"),
        F.col("p_type").alias("care_type"),
        F.col("p_brand").alias("rescue_location"),
        F.when(_m(k, 7) != 0, F.split("p_name", " ")).alias("hashtags"),
        F.concat(F.lit("/d/"), F.col(k).cast("string")).alias("detail_link"),
        F.when(_m(k, 17) != 0, care).alias("care_conditions"),
        F.when(_m(k, 19) != 0, traits).alias("behavior_traits"),
        F.when(_m(k, 23) != 0, health).alias("health_info"),
    )


LISTINGS_SQL = """
SELECT p_partkey AS uid, p_name AS name,
  CASE WHEN p_partkey % 4 = 3 THEN '임보완료' ELSE '임보가능' END AS status,
  CASE p_partkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender,
  CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size % 17 AS DOUBLE) END AS age,
  CASE WHEN p_partkey % 13 <> 0 THEN (p_retailprice - 900.0) / 2.0 END AS weight,
  p_partkey % 2 = 0 AS neutered, p_type AS care_type, p_brand AS rescue_location,
  CASE WHEN p_partkey % 7 <> 0 THEN string_split(p_name, ' ') END AS hashtags,
  '/d/' || CAST(p_partkey AS VARCHAR) AS detail_link,
  p_partkey % 17 = 0 AS care_null,
  CASE WHEN p_partkey % 9 = 0 THEN '전국' ELSE p_brand END AS care_region,
  CASE WHEN p_partkey % 5 <> 4 THEN CAST(p_partkey % 12 + 1 AS DOUBLE) END AS care_duration,
  CASE WHEN p_partkey % 6 <> 0 THEN string_split(CASE WHEN p_partkey % 2 = 0 THEN 'visit' ELSE 'visit delivery' END, ' ') END AS pickup,
  CASE WHEN p_partkey % 8 <> 0 THEN string_split(p_type || ' ' || p_brand, ' ') END AS homes,
  CASE WHEN p_partkey % 5 = 0 THEN 'No ' || p_type END AS extra,
  p_partkey % 19 = 0 AS traits_null,
  CAST(p_partkey % 5 + 1 AS DOUBLE) AS affection,
  CASE WHEN p_partkey % 10 <> 9 THEN CAST(CAST(FLOOR(p_partkey / 5.0) AS BIGINT) % 5 + 1 AS DOUBLE) END AS barking,
  p_partkey % 23 = 0 AS health_null,
  CASE WHEN p_partkey % 4 = 1 THEN ['v1'] WHEN p_partkey % 4 >= 2 THEN ['v1', 'v2', 'v3'] END AS vaccination,
  CASE WHEN p_partkey % 3 = 0 THEN p_name END AS medical_history
FROM part
"""


# ----------------------------------------------------------------------------------------------
# raw listing (addinfo columns: text builders, hard filters, vector matching)
# ----------------------------------------------------------------------------------------------
def raw_listings(spark: SparkSession, sf_dir: str, long_text: bool = True) -> DataFrame:
    """``long_text=False`` leaves ``addinfo10`` null and skips the documents join (for plans that
    never read the free text, e.g. the vector side of a match)."""
    k = "p_partkey"
    p = table(spark, sf_dir, "part")
    if long_text:
        d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(k), F.col("text").alias("doc_text"))
        # the free-text side grows with the data and has no size bound: join by key (sort-merge),
        # never by a broadcast chosen from a file-size estimate
        j = p.join(d.hint("merge"), k, "left")
    else:
        j = p.withColumn("doc_text", F.lit(None).cast("string"))
    return j.select(
        F.col(k).alias("uid"),
        F.when(_m(k, 4) == 3, F.lit("임보완료")).otherwise(F.lit(K.OPEN_STATE)).alias("state"),
        F.when(_m(k, 31) != 0, F.col("p_type")).alias("kind"),
        F.when(_m(k, 29) != 0, F.col("p_name")).alias("addinfo01"),
        F.col("p_brand").alias("addinfo02"),
        F.when(_m(k, 3) == 0, F.lit("남")).when(_m(k, 3) == 1, F.lit("여")).alias("addinfo03"),
        F.when(_m(k, 10) != 5, F.when(_m(k, 2) == 0, F.lit("Y")).otherwise(F.lit("N"))).alias("addinfo04"),
        F.when(_m(k, 6) == 0, F.lit("2023")).when(_m(k, 6) == 1, F.lit("202305추정"))
        .when(_m(k, 6) == 2, F.lit("2018추정")).when(_m(k, 6) == 3, F.lit("2015년 추정"))
        .when(_m(k, 6) == 4, F.lit("2021")).alias("addinfo05"),
        F.when(_m(k, 13) == 0, F.lit(None).cast("string")).when(_m(k, 17) == 0, F.lit("unknown"))
        .otherwise(F.col("p_size").cast("string")).alias("addinfo07"),
        F.when(_m(k, 7) != 0, F.concat(F.lit("#"), F.replace(F.col("p_name"), F.lit(" "), F.lit("#")))).alias("addinfo08"),
        F.when(_m(k, 3) == 1, F.concat(F.lit("found near "), F.col("p_brand"), F.lit("\nsafe now"))).alias("addinfo09"),
        F.col("doc_text").alias("addinfo10"),
        F.when(_m(k, 4) == 0, F.lit("other &apos;info&apos;")).alias("addinfo11"),
        F.when(_m(k, 6) == 1, F.lit("needs #care daily")).alias("addinfo16"),
        F.when(_m(k, 5) == 2, F.lit("healthy\r\nvaccinated")).alias("addinfo19"),
        F.when(_m(k, 7) == 3, F.lit("  walk   twice  ")).alias("addinfo20"),
    )


RAW_SQL = """
SELECT p.p_partkey AS uid,
  CASE WHEN p.p_partkey % 4 = 3 THEN '임보완료' ELSE '임보가능' END AS state,
  CASE WHEN p.p_partkey % 31 <> 0 THEN p.p_type END AS kind,
  CASE WHEN p.p_partkey % 29 <> 0 THEN p.p_name END AS addinfo01,
  p.p_brand AS addinfo02,
  CASE p.p_partkey % 3 WHEN 0 THEN '남' WHEN 1 THEN '여' END AS addinfo03,
  CASE WHEN p.p_partkey % 10 <> 5 THEN CASE WHEN p.p_partkey % 2 = 0 THEN 'Y' ELSE 'N' END END AS addinfo04,
  CASE p.p_partkey % 6 WHEN 0 THEN '2023' WHEN 1 THEN '202305추정' WHEN 2 THEN '2018추정'
       WHEN 3 THEN '2015년 추정' WHEN 4 THEN '2021' END AS addinfo05,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL WHEN p.p_partkey % 17 = 0 THEN 'unknown'
       ELSE CAST(p.p_size AS VARCHAR) END AS addinfo07,
  CASE WHEN p.p_partkey % 7 <> 0 THEN '#' || replace(p.p_name, ' ', '#') END AS addinfo08,
  CASE WHEN p.p_partkey % 3 = 1 THEN 'found near ' || p.p_brand || chr(10) || 'safe now' END AS addinfo09,
  d.text AS addinfo10,
  CASE WHEN p.p_partkey % 4 = 0 THEN 'other &apos;info&apos;' END AS addinfo11,
  CASE WHEN p.p_partkey % 6 = 1 THEN 'needs #care daily' END AS addinfo16,
  CASE WHEN p.p_partkey % 5 = 2 THEN 'healthy' || chr(13) || chr(10) || 'vaccinated' END AS addinfo19,
  CASE WHEN p.p_partkey % 7 = 3 THEN '  walk   twice  ' END AS addinfo20
FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey
"""


# ----------------------------------------------------------------------------------------------
# vectors and vector queries
# ----------------------------------------------------------------------------------------------
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(uid, embedding, label)`` — the embeddings table keyed like the listings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uid"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector also acts as a query: ``(qid, embedding, label, text, size, age, gender)``.

    Slots are derived from the label: size from label 1/2/3, age from 4/5, sex from 6/7."""
    sizes = [v for v, _ in K.SLOT_RULES["size"]]
    ages = [v for v, _ in K.SLOT_RULES["age"]]
    genders = [v for v, _ in K.SLOT_RULES["gender"]]
    lab = F.col("label")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qid"), "embedding", "label",
        F.concat(F.lit("vector "), F.col("vec_id").cast("string"), F.lit(" label "), lab.cast("string")).alias("text"),
        F.when(lab == 1, F.lit(sizes[0])).when(lab == 2, F.lit(sizes[1])).when(lab == 3, F.lit(sizes[2])).alias("size"),
        F.when(lab == 4, F.lit(ages[0])).when(lab == 5, F.lit(ages[1])).alias("age"),
        F.when(lab == 6, F.lit(genders[0])).when(lab == 7, F.lit(genders[1])).alias("gender"),
    )


VQUERIES_SQL = """
SELECT vec_id AS qid, embedding, label,
  'vector ' || CAST(vec_id AS VARCHAR) || ' label ' || CAST(label AS VARCHAR) AS text,
  CASE label WHEN 1 THEN '소형' WHEN 2 THEN '중형' WHEN 3 THEN '대형' END AS size,
  CASE label WHEN 4 THEN '어린' WHEN 5 THEN '고령' END AS age,
  CASE label WHEN 6 THEN '남' WHEN 7 THEN '여' END AS gender
FROM embeddings
"""

# English keyword rules for the multilingual conversation texts (same shape as the defaults)
TEXT_SLOT_RULES = {
    "size": [("소형", ["ou"]), ("중형", ["en"]), ("대형", ["th"])],
    "age": [("어린", ["ü"]), ("고령", ["é"])],
    "gender": [("남", ["ing"]), ("여", ["ch"])],
}


def user_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations as queries ``(qid, text)``; qid = conversation and turn, as text."""
    c = table(spark, sf_dir, "conversations", wide=True)  # not by conversation: one may be huge
    return c.where(F.col("role") == "user").select(F.concat_ws("-", "conv_id", "turn").alias("qid"), "text")


USER_QUERIES_SQL = """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS qid, text FROM conversations WHERE role = 'user'
"""


# ----------------------------------------------------------------------------------------------
# composed detail pages (the real pages table carries no detail markup)
# ----------------------------------------------------------------------------------------------
def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detail page per part row in the site's markup (``page_id`` = part key)."""
    p = table(spark, sf_dir, "part", wide=True, key="p_partkey")
    k = "p_partkey"
    words = F.split("p_name", " ")
    tags = F.array_join(F.transform(words, lambda w: F.concat(F.lit("<p>#"), w, F.lit("</p>"))), "")
    info = (F.when(_m(k, 5) == 0, F.concat(F.lit("<dl><dt>이름:</dt><dd>"), F.col("p_name"),
                                            F.lit("</dd><dt>브랜드</dt></dl>")))
            .otherwise(F.concat(F.lit("<dl><dt>이름:</dt><dd>"), F.col("p_name"), F.lit("</dd><dt>브랜드 :</dt><dd> "),
                                F.col("p_brand"), F.lit(" </dd></dl>"))))
    html = F.concat(
        F.lit("<html><body>"),
        F.when(_m(k, 7) != 0, F.concat(F.lit('<p class="num">공고 번호 : '), F.col(k).cast("string"), F.lit("</p>")))
        .otherwise(F.lit("")),
        F.lit('<div class="info_box">'), info, F.lit("</div>"),
        F.when(_m(k, 3) != 0, F.concat(F.lit('<div class="tag_wrap">'), tags, F.lit("</div>"))).otherwise(F.lit("")),
        F.lit('<div class="tb_wrap"><table><tr><th>종류:</th><td>'), F.col("p_type"),
        F.lit("</td></tr><tr><th>크기</th><td><b>"), F.col("p_size").cast("string"), F.lit("</b> kg</td></tr></table></div>"),
        F.lit('<div class="box pt40"><div class="check_i a">아파트</div>'),
        F.when(_m(k, 2) == 0, F.lit('<div class="check_i a">주택</div>')).otherwise(F.lit('<div class="check_i a"> </div>')),
        F.lit("</div>"),
        F.lit('<div class="view_main">'),
        F.lit('<div class="line"><p class="tit">임보 조건</p><div class="tb_wrap"><table><tr><th>기간</th><td>'),
        (_m(k, 12) + 1).cast("string"), F.lit("개월</td></tr></table></div></div>"),
        F.when(_m(k, 4) != 0, F.concat(
            F.lit('<div class="line"><p class="tit">건강 정보</p><div class="tb_wrap"><table><tr><th>접종</th><td>'),
            F.when(_m(k, 2) == 0, F.lit("완료")).otherwise(F.lit("미완료")),
            F.lit("</td></tr><tr><th>종류</th><td>"), F.col("p_type"), F.lit("</td></tr></table></div></div>")))
        .otherwise(F.lit("")),
        F.lit('<div class="line"><p class="tit">참고용 정보</p><div class="box"><ul><li><p class="t_bef">가격</p><p class="a">'),
        F.col("p_retailprice").cast("string"), F.lit('</p></li><li><p class="t_bef">브랜드</p><p class="a">'),
        F.col("p_brand"), F.lit("</p></li></ul></div></div>"),
        F.when(_m(k, 5) != 1, F.concat(
            F.lit('<div class="line"><p class="tit">책임자 제공 사항</p><div class="box pt40">'
                  '<div class="check_i a">사료</div><div class="check_i a">&amp; 용품</div></div></div>')))
        .otherwise(F.lit("")),
        F.lit("</div></body></html>"),
    )
    return p.select(F.col(k).alias("page_id"), html.alias("html"))


DETAIL_PAGES_SQL = """
SELECT p_partkey AS page_id, '<html><body>'
  || CASE WHEN p_partkey % 7 <> 0 THEN '<p class="num">공고 번호 : ' || CAST(p_partkey AS VARCHAR) || '</p>' ELSE '' END
  || '<div class="info_box">'
  || CASE WHEN p_partkey % 5 = 0 THEN '<dl><dt>이름:</dt><dd>' || p_name || '</dd><dt>브랜드</dt></dl>'
          ELSE '<dl><dt>이름:</dt><dd>' || p_name || '</dd><dt>브랜드 :</dt><dd> ' || p_brand || ' </dd></dl>' END
  || '</div>'
  || CASE WHEN p_partkey % 3 <> 0 THEN '<div class="tag_wrap">'
          || array_to_string(list_transform(string_split(p_name, ' '), lambda w: '<p>#' || w || '</p>'), '')
          || '</div>' ELSE '' END
  || '<div class="tb_wrap"><table><tr><th>종류:</th><td>' || p_type
  || '</td></tr><tr><th>크기</th><td><b>' || CAST(p_size AS VARCHAR) || '</b> kg</td></tr></table></div>'
  || '<div class="box pt40"><div class="check_i a">아파트</div>'
  || CASE WHEN p_partkey % 2 = 0 THEN '<div class="check_i a">주택</div>' ELSE '<div class="check_i a"> </div>' END
  || '</div>' || '<div class="view_main">'
  || '<div class="line"><p class="tit">임보 조건</p><div class="tb_wrap"><table><tr><th>기간</th><td>'
  || CAST(p_partkey % 12 + 1 AS VARCHAR) || '개월</td></tr></table></div></div>'
  || CASE WHEN p_partkey % 4 <> 0 THEN '<div class="line"><p class="tit">건강 정보</p><div class="tb_wrap"><table><tr><th>접종</th><td>'
          || CASE WHEN p_partkey % 2 = 0 THEN '완료' ELSE '미완료' END
          || '</td></tr><tr><th>종류</th><td>' || p_type || '</td></tr></table></div></div>' ELSE '' END
  || '<div class="line"><p class="tit">참고용 정보</p><div class="box"><ul><li><p class="t_bef">가격</p><p class="a">'
  || CAST(p_retailprice AS VARCHAR) || '</p></li><li><p class="t_bef">브랜드</p><p class="a">'
  || p_brand || '</p></li></ul></div></div>'
  || CASE WHEN p_partkey % 5 <> 1 THEN '<div class="line"><p class="tit">책임자 제공 사항</p><div class="box pt40">'
          || '<div class="check_i a">사료</div><div class="check_i a">&amp; 용품</div></div></div>' ELSE '' END
  || '</div></body></html>' AS html
FROM part
"""
