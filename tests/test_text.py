"""G5 and the text builders (SC1–SC4, SC9–SC14)."""

from pyspark.sql import functions as F

from pawgrid.functions import age_months_text, age_phrase, clean_positive_number, clean_query, clean_text, tag_text, truncate
from pawgrid.functions.classes import age_bucket, size_class_a, size_class_b, size_class_c, strict_double


def col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_clean_text_golden(spark):
    assert col(spark, ["#애교쟁이#사람좋아\r\n착해요&apos;  ok ", None, ""], clean_text) == \
        ["애교쟁이사람좋아 착해요' ok", "", ""]


def test_clean_text_unicode_whitespace(spark):
    assert col(spark, [" a　　b "], clean_text) == ["a b"]


def test_clean_query_golden(spark):
    assert col(spark, ["활발하고~ 귀여운!! 아이♥ ", "  a_b-c?  "], clean_query) == ["활발하고 귀여운!! 아이", "a_b c?"]


def test_tag_text_modes(spark):
    assert col(spark, ["#애교쟁이#사람좋아", "", None, "#!a#b"], tag_text) == ["애교쟁이사람좋아", "", "", "!ab"]
    assert col(spark, ["#a#b"], lambda c: tag_text(c, mode="split")) == ["a, b"]


def test_truncate(spark):
    assert col(spark, ["abcdef", "abc"], lambda c: truncate(c, 3)) == ["abc...", "abc"]


def test_size_classes_boundaries(spark):
    assert col(spark, [6.99, 7.0, 19.99, 20.0, None], size_class_a, "double") == \
        ["소형 (7kg 미만)", "중형 (7-20kg)", "중형 (7-20kg)", "대형 (20kg 이상)", "몸무게 정보 없음"]
    assert col(spark, [9.99, 10.0, 25.0, 0.0, None], size_class_b, "double") == \
        ["소형", "중형", "대형", "크기미정", "크기미정"]
    assert col(spark, [4.99, 5.0, 15.0, 15.01, None], size_class_c, "double") == \
        ["소형견", "중형견", "중형견", "대형견", "몸무게 불명"]


def test_size_b_bad_text(spark):
    assert col(spark, ["abc"], lambda c: size_class_b(strict_double(c))) == ["크기미정"]


def test_age_bucket(spark):
    assert col(spark, [1.0, 1.5, 3.0, 3.5, 7.0, 7.5, None], age_bucket, "double") == \
        ["1세 이하", "1-3세", "1-3세", "4-7세", "4-7세", "8세 이상", "나이 불명"]


def test_weight_clean(spark):
    assert col(spark, ["8.5", "0", "-3", "abc", "8kg", None, "150"], clean_positive_number) == \
        [8.5, None, None, None, None, None, 150.0]


def test_age_phrase(spark):
    out = col(spark, ["2024년", "2019, 2023", "2021", "2018", "2013", "2012", None], age_phrase)
    assert out == ["어린 동물 (1-2세 추정)", "어린 동물 (1-2세 추정)", "젊은 성체 (3-5세 추정)", "중년 동물 (6-8세 추정)",
                   "고령 동물 (9세 이상 추정)", "나이 관련 정보: 2012", "나이 정보 없음"]


def test_age_months_golden(spark):
    cases = {"2023": "47개월", "202305": "43개월", "202305추정": "43개월(추정)", "2023추정": "47개월(추정)",
             "2027": "-1개월", "202313": None, "2023년 5월": None, "2023.5": None, "2023.0": None,
             "20235": "47개월", "2023 5": "43개월", "20230115": "47개월", "2023(추정)": None, "추정": None}
    keys = list(cases)
    out = col(spark, keys + [None], lambda c: age_months_text(c, "2026-12-01"))
    assert out == [cases[k] for k in keys] + [None]
