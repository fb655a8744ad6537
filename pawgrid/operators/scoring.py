"""Weighted soft scoring of listings against one preference profile (SCR1–SCR8, FLT15, SRT1–2).

The profile is a Python dict, so the whole score is one Column expression: no join, no UDF,
no shuffle until the final sort (which becomes ``TakeOrderedAndProject`` under a limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions.text import two_way_contains
from pawgrid.operators.predicates import open_state


def region_score(regions: list, location: str = "rescue_location", care: str = "care_conditions",
                 nationwide: str = K.NATIONWIDE) -> Column:
    """SCR3: nationwide care region or a preferred location -> 1, else 0."""
    nation = F.coalesce(F.col(care).getField("region") == F.lit(nationwide), F.lit(False))
    listed = F.coalesce(F.col(location).isin(list(regions)), F.lit(False)) if regions else F.lit(False)
    return F.when(nation | listed, F.lit(1.0)).otherwise(F.lit(0.0))


def band_score(column: str, pref: dict) -> Column:
    """SCR4 / SCR5: null .5; preferred band 1; acceptable band .7; else 0 (bands inclusive).  A bound
    left out is 0 or 100, as the source has it; a bound given as None is no bound."""
    v = F.col(column)

    def inside(band: dict) -> Column:
        lo, hi = band.get("min", 0), band.get("max", 100)
        out = F.lit(True)
        if lo is not None:
            out = out & (v >= F.lit(lo))
        return out if hi is None else out & (v <= F.lit(hi))

    p = pref.get("preferred", {})
    a = pref.get("acceptable", {})
    return (
        F.when(v.isNull() | F.isnan(v), F.lit(0.5))
        .when(inside(p), F.lit(1.0))
        .when(inside(a), F.lit(0.7))
        .otherwise(F.lit(0.0))
    )


def personality_score(traits: list, tags: str = "hashtags") -> Column:
    """SCR6 / AGG14: share of wanted traits matched two ways by some tag; no tags .5."""
    t = F.col(tags)
    no_tags = t.isNull() | (F.size(t) == 0)
    if not traits:
        return F.lit(0.5)
    def hit(word: str) -> Column:
        return F.when(F.exists(t, lambda h: two_way_contains(F.lit(word), h)), F.lit(1)).otherwise(F.lit(0))

    hits = [hit(w) for w in traits]
    matched = hits[0]
    for h in hits[1:]:
        matched = matched + h
    return F.when(no_tags, F.lit(0.5)).otherwise(matched.cast("double") / F.lit(float(len(traits))))


def behavior_score(prefs: dict, traits: str = "behavior_traits") -> Column:
    """SCR7: mean over known traits of (ideal 1 | acceptable .7 | max(0, 1-|v-ideal|/4)); none known .5."""
    m = F.col(traits)
    total = F.lit(0.0)
    known = F.lit(0)
    for name, pref in prefs.items():
        v = m.getItem(name)
        ideal = pref.get("ideal")
        acceptable = list(pref.get("acceptable", []))
        if ideal is None:
            s = F.when(v.isin(acceptable), F.lit(0.7)).otherwise(F.lit(1.0)) if acceptable else F.lit(1.0)
        else:
            dist = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(v - F.lit(float(ideal))) / F.lit(4.0))
            s = F.when(v == F.lit(ideal), F.lit(1.0))
            if acceptable:
                s = s.when(v.isin(acceptable), F.lit(0.7))
            s = s.otherwise(dist)
        present = v.isNotNull() & ~F.isnan(v)
        total = total + F.when(present, s).otherwise(F.lit(0.0))
        known = known + F.when(present, F.lit(1)).otherwise(F.lit(0))
    return F.when(m.isNull() | (known == 0), F.lit(0.5)).otherwise(total / known.cast("double"))


def match_score(profile: dict) -> Column:
    """SCR2: sum(score * weight) / sum(weight) over the slots present in the profile; none -> 0."""
    weights = profile.get("weights", {})
    builders = {
        "region": lambda v: region_score(v),
        "age_preference": lambda v: band_score("age", v),
        "size_preference": lambda v: band_score("weight", v),
        "personality_traits": lambda v: personality_score(v),
        "behavior_preferences": lambda v: behavior_score(v),
    }
    num = F.lit(0.0)
    den = 0.0
    for key, build in builders.items():
        if key not in profile:
            continue
        w = float(weights.get(K.SLOT_WEIGHT_KEYS[key], 1))
        num = num + build(profile[key]) * F.lit(w)
        den += w
    return num / F.lit(den) if den > 0 else F.lit(0.0)


def soft_filter(df: DataFrame, profile: dict, threshold: float = K.SCORE_THRESHOLD,
                available_only: bool = True, score_col: str = "match_score", key: str = "uid") -> DataFrame:
    """SCR1: open listings with their score, kept when score >= threshold, best first.

    Ties are broken by ``key`` (the source leaves them unordered)."""
    base = df.where(open_state()) if available_only else df
    scored = base.withColumn(score_col, match_score(profile))
    return scored.where(F.col(score_col) >= F.lit(threshold)).orderBy(F.desc(score_col), F.asc(key))


def top_matches(df: DataFrame, profile: dict, n: int = 10, threshold: float = K.SCORE_THRESHOLD,
                key: str = "uid") -> DataFrame:
    """SRT2: the first ``n`` of ``soft_filter`` (plans as TakeOrderedAndProject)."""
    return soft_filter(df, profile, threshold, key=key).limit(n)


def default_profile(pref_age=(2, 5), accept_age=(1, 8), pref_weight=(3.0, 10.0), traits=(),
                    affection: int = 4, friendly: int = 5, barking: int = 2) -> dict:
    """SCR8: the interactive tab's profile: acceptable trait levels = ideal +- 1 clamped to 1..5,
    size acceptable 0..50, weights age 1.5 / size 1.2 / personality 1.8 / behaviour 1.3."""
    def acc(v):
        return [max(1, v - 1), v, min(5, v + 1)]

    return {
        "age_preference": {"preferred": {"min": pref_age[0], "max": pref_age[1]},
                           "acceptable": {"min": accept_age[0], "max": accept_age[1]}},
        "size_preference": {"preferred": {"min": pref_weight[0], "max": pref_weight[1]},
                            "acceptable": dict(K.PROFILE_SIZE_ACCEPTABLE)},
        "personality_traits": list(traits),
        "behavior_preferences": {
            "affection": {"ideal": affection, "acceptable": acc(affection)},
            "human_friendly": {"ideal": friendly, "acceptable": acc(friendly)},
            "barking": {"ideal": barking, "acceptable": acc(barking)},
        },
        "weights": dict(K.PROFILE_WEIGHTS),
    }
