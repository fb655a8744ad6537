"""G1 soft filter and G3 score boundaries (SCR1–SCR8)."""

from pyspark.sql import functions as F

from pawgrid.operators import scoring as S
from tests.test_filters import SCHEMA


def test_g1_soft_filter(spark):
    row = ("1", "테스트독", "임보가능", "male", 3.0, 8.5, None, "일반임보", "서울", ["애교쟁이", "사람좋아"],
           ("전국", 3.0, None, None, None), {"affection": 4.0, "human_friendly": 5.0}, None)
    df = spark.createDataFrame([row], SCHEMA)
    prefs = {"age_preference": {"preferred": {"min": 2, "max": 4}, "acceptable": {"min": 1, "max": 6}},
             "personality_traits": ["애교쟁이", "사람좋아"], "weights": {"age": 1.5, "personality": 1.0}}
    out = S.soft_filter(df, prefs).collect()
    assert len(out) == 1 and abs(out[0]["match_score"] - 1.0) < 1e-12


def test_age_score_boundaries(spark):
    df = spark.createDataFrame([(x,) for x in [2.0, 4.0, 1.0, 6.0, 7.0, None]], "age double")
    pref = {"preferred": {"min": 2, "max": 4}, "acceptable": {"min": 1, "max": 6}}
    assert [r[0] for r in df.select(S.band_score("age", pref)).collect()] == [1.0, 1.0, 0.7, 0.7, 0.0, 0.5]


def test_behavior_score(spark):
    df = spark.createDataFrame([({"a": 4.0},), ({"a": 3.0},), ({"a": 1.0},), ({"z": 1.0},), (None,)],
                               "behavior_traits map<string,double>")
    prefs = {"a": {"ideal": 4, "acceptable": [3, 5]}, "missing": {"ideal": 2}}
    assert [r[0] for r in df.select(S.behavior_score(prefs)).collect()] == [1.0, 0.7, 0.25, 0.5, 0.5]


def test_personality_share(spark):
    df = spark.createDataFrame([(["red ring"],), (["blue"],), ([],), (None,)], "hashtags array<string>")
    out = [r[0] for r in df.select(S.personality_score(["red", "ring", "x"])).collect()]
    assert out == [2 / 3, 0.0, 0.5, 0.5]


def test_weights_and_empty_profile(spark):
    df = spark.createDataFrame([(None, None)], "age double, weight double")
    assert df.select(S.match_score({})).first()[0] == 0.0
    prof = {"age_preference": {}, "size_preference": {}, "weights": {"age": 3, "size": 1}}
    assert df.select(S.match_score(prof)).first()[0] == 0.5
