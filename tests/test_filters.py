"""G1, G6: hard filters and the funnel (FLT1–FLT14, AGG12)."""

import pytest
from pyspark.sql import functions as F

from pawgrid.operators import predicates as P

SCHEMA = ("uid string, name string, status string, gender string, age double, weight double, neutered boolean, "
          "care_type string, rescue_location string, hashtags array<string>, "
          "care_conditions struct<region:string,duration:double,pickup:array<string>,suitable_homes:array<string>,"
          "additional_conditions:string>, behavior_traits map<string,double>, "
          "health_info struct<vaccination:array<string>,medical_history:string>")


@pytest.fixture(scope="module")
def sample(spark):
    rows = [
        ("1", "테스트독", "임보가능", "male", 3.0, 8.5, None, "일반임보", "서울", ["애교쟁이", "사람좋아"],
         ("전국", 3.0, None, None, None), {"affection": 4.0, "human_friendly": 5.0}, None),
        ("2", "b", "임보가능", "female", None, 12.0, True, "x", "부산", None,
         ("부산", 10.0, ["visit"], ["아파트"], "No cats"), None, ([], "skin")),
        ("3", "c", "임보완료", "male", 2.0, 4.0, False, "x", "서울", ["애교"], None, {"affection": 1.0},
         (["v1"], None)),
        ("4", "d", "임보가능", "male", 5.0, 30.0, False, "y", "대구", ["순둥"],
         ("대구", None, ["delivery"], ["주택"], None), {"barking": 2.0}, (["v1"], "")),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return sorted(r["uid"] for r in df.select("uid").collect())


def test_g1_hard_filter(sample):
    assert ids(P.apply_filters(sample, {"age_range": {"min": 1, "max": 5}, "weight_range": {"min": 5, "max": 15}})) == ["1"]


def test_open_state_only(sample):
    assert ids(P.apply_filters(sample, {})) == ["1", "2", "4"]


def test_region_nationwide(sample):
    assert ids(P.apply_filters(sample, {"region": "대구"})) == ["1", "4"]


def test_tags_two_way(sample):
    # '애교' is contained in '애교쟁이'; the reverse direction also matches
    assert ids(P.apply_filters(sample, {"hashtags": ["애교"]}, available_only=False)) == ["1", "3"]
    assert ids(P.apply_filters(sample, {"hashtags": ["애교쟁이와"]}, available_only=False)) == ["1", "3"]


def test_traits_missing_trait_passes_null_map_fails(sample):
    crit = {"behavior_traits": {"barking": {"max": 3}, "affection": {"min": 3}}}
    assert ids(P.apply_filters(sample, crit, available_only=False)) == ["1", "4"]


def test_health_vaccination_minimum(sample):
    # empty list -> minimum ignored; one vaccination with min 2 -> fails; null dict fails
    assert ids(P.apply_filters(sample, {"health_requirements": {"min_vaccinations": 2}}, available_only=False)) == ["2"]


def test_health_history(sample):
    crit = {"health_requirements": {"no_medical_history": True}}
    assert ids(P.apply_filters(sample, crit, available_only=False)) == ["3", "4"]
    crit = {"health_requirements": {"exclude_conditions": ["SKIN"]}}
    assert ids(P.apply_filters(sample, crit, available_only=False)) == ["3", "4"]


def test_care_preferences(sample):
    crit = {"care_preferences": {"max_duration": 5, "pickup_method": "delivery"}}
    assert ids(P.apply_filters(sample, crit, available_only=False)) == ["1", "4"]
    crit = {"care_preferences": {"exclude_conditions": ["cats"]}}
    assert ids(P.apply_filters(sample, crit, available_only=False)) == ["1", "4"]


def test_neutered_false_is_applied_none_is_skipped(sample):
    assert ids(P.apply_filters(sample, {"neutered": False})) == ["4"]
    assert ids(P.apply_filters(sample, {"neutered": None})) == ["1", "2", "4"]


def test_funnel_counts(sample):
    rows = P.funnel(sample, {"gender": "male", "age_range": {"min": 0, "max": 4}}).orderBy("step_no").collect()
    assert [(r.step, r.n) for r in rows] == [("all", 4), ("status", 3), ("gender", 2), ("age_range", 1)]


def test_satisfaction(spark):
    df = spark.createDataFrame([(x,) for x in ["3", " 5 ", "0", "6", "a", "", "03", None]], "t string")
    assert [r[0] for r in df.select(P.satisfaction_valid("t")).collect()] == [3, 5, None, None, None, None, 3, None]


def test_a_bound_of_none_is_no_bound(spark):
    from pyspark.sql import functions as F

    from pawgrid.operators import predicates as P
    df = spark.createDataFrame([(5.0,), (150.0,), (None,)], "age double")
    count = lambda rng: df.where(P.in_range("age", rng)).agg(F.count(F.lit(1))).first()[0]
    assert (count({"min": 1}), count({"min": 1, "max": None}), count({"min": None, "max": None})) == (1, 2, 2)
