"""A table of profiles gives each profile the rows it has alone."""

from collections import namedtuple

import numpy as np
import pandas as pd
import pytest

from pawgrid.operators import profiles as PF
from pawgrid.operators import scoring as S
from pawgrid.plans import adapters as A

SF = "/root/testdata/sf0.001"
PROFILES = {
    1: S.default_profile(traits=["red", "ring"]),
    2: {**S.default_profile(traits=[]), "region": ["Brand#3", "Brand#7"]},
    3: {"region": []},
    4: {},
    5: {"age_preference": {"preferred": {"min": 3, "max": None}, "acceptable": {"min": None, "max": 9}}, "weights": {"age": 2}},
    6: {"behavior_preferences": {"affection": {"acceptable": [1, 2]}, "barking": {"ideal": 3}, "unknown": {"ideal": 1}},
        "personality_traits": ["blue bolt", "b", "b"]},
    7: {"behavior_preferences": {"affection": {}}, "size_preference": {"acceptable": {"max": 20}}},
}


@pytest.mark.parametrize("block_rows, n", [(2, 3), (8192, 10), (8192, 1000)])
def test_each_profile_has_its_own_rows(spark, block_rows, n):
    listings = A.structured_listings(spark, SF)
    got = {}
    for r in PF.soft_filter_many(listings, PF.profile_table(spark, PROFILES), n, block_rows=block_rows if n < 100 else 8192).collect():
        got.setdefault(r["profile_id"], []).append((r["rank"], r["uid"], r["match_score"]))
    for pid, profile in PROFILES.items():
        want = [(i, r["uid"], r["match_score"]) for i, r in enumerate(S.top_matches(listings, profile, n).collect(), 1)]
        assert sorted(got.get(pid, [])) == want, pid


def test_empty_sides_and_null_columns(spark):
    listings = A.structured_listings(spark, SF)
    table = PF.profile_table(spark, PROFILES)
    assert PF.soft_filter_many(listings.limit(0), table).collect() == []
    assert PF.soft_filter_many(listings, table.limit(0)).collect() == []
    bare = listings.selectExpr("uid", "status", "cast(null as double) age", "cast(null as double) weight", "care_conditions",
                               "cast(null as string) rescue_location", "cast(null as array<string>) hashtags",
                               "cast(null as map<string,double>) behavior_traits")
    out = PF.soft_filter_many(bare, PF.profile_table(spark, {1: PROFILES[1]}), 3).collect()
    assert [r["match_score"] for r in out] == [0.5] * 3


def test_all_listings_are_reached(spark):
    listings = A.structured_listings(spark, SF)
    out = PF.soft_filter_many(listings, PF.profile_table(spark, {9: {"age_preference": {"acceptable": {"min": None, "max": None}}}}),
                              10 ** 6, threshold=-1.0, available_only=False)
    assert out.count() == listings.count()


def test_few_listings_are_scored_and_none_is_lost(monkeypatch):
    """The search in a cell gives the rows of scoring every listing, and opens few of its runs."""
    rng = np.random.default_rng(3)
    n = 20_000
    pick = lambda xs, size=n: rng.choice(np.array(xs, dtype=object), size)
    pdf = pd.DataFrame({
        "uid": rng.integers(0, 10 ** 9, n), "age": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 17, n)),
        "weight": np.where(rng.random(n) < 0.1, np.nan, rng.random(n) * 60), "care_region": pick([None, "A", PF.K.NATIONWIDE]),
        "rescue_location": pick([None, *"ABCDEFGHIJKL"]),
        "hashtags": pick([None, "[]", "[null]", *(f'["{a}","{b}"]' for a in ("red", "blue", "old") for b in ("ring", "bolt", "reddish"))]),
        "behavior_traits": pick([None, "{}", '{"affection":null}', *(f'{{"affection":{i}.0,"barking":{j}.0}}' for i in range(1, 6) for j in range(1, 6))])})
    block, scored = PF.Listings(pdf), []
    band = PF.Amount.band
    monkeypatch.setattr(PF.Amount, "band", lambda self, pref, rows: (scored.append(len(rows)), band(self, pref, rows))[1])
    wish = lambda ideal: (float(ideal), [float(ideal), float(ideal + 1)])
    row = namedtuple("row", ["profile_id", *PF.SLOTS, "weights"])
    few = [0, 0]
    for i in range(60):
        a, b = float(i % 9), float(5 + i % 11)
        age, size = ((a, a + 3), (None, a + 6)), ((3.0, b), (0.0, 50.0))
        p = row(i, ["A", "ZZ", "CDE"[i % 3]] if i % 7 else None, age, size if i % 5 else None, ["red", "ring"] if i % 4 else [],
                {"affection": wish(i % 5 + 1), "barking": wish(i % 3 + 1), "other": wish(1)}, {"age": 1.5, "region": -1.0 if i == 59 else 1.0})
        scored.clear()
        uid, score = block.best(p, 10, 0.3)
        few[0], few[1] = few[0] + sum(scored), few[1] + n * (1 + (p.size_preference is not None))
        num, den, every = np.zeros(n), 0.0, np.arange(n)
        for w, _, part in block.slots(p):
            num, den = num + part(every) * w, den + w
        full = num / den
        by = np.lexsort((block.uid, -np.round(full, PF.TIE_DIGITS)))
        by = by[full[by] >= 0.3][:10]
        assert uid.tolist() == block.uid[by].tolist() and score.tolist() == full[by].tolist(), i
    assert few[0] < 0.35 * few[1], few
