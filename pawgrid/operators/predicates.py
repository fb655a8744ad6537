"""Hard filters over the structured listing (FLT1–FLT15, FLT22, AGG12).

Every predicate is a plain Column, null-safe (a missing value gives a definite True/False), so
the whole criteria dict folds into ONE ``where`` that Catalyst pushes into the scan where it
can (flat columns) and evaluates inside whole-stage codegen otherwise.

Structured listing columns: ``status, gender, care_type, rescue_location, age, weight,
neutered, hashtags ARRAY<STRING>, care_conditions STRUCT<region, duration, pickup ARRAY,
suitable_homes ARRAY, additional_conditions>, behavior_traits MAP<STRING,DOUBLE>,
health_info STRUCT<vaccination ARRAY, medical_history>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions.text import any_two_way, contains_any


def _false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _true_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(True))


def as_list(v) -> list:
    """FLT14: a scalar argument means a one-element list."""
    if v is None:
        return []
    return [v] if isinstance(v, (str, int, float, bool)) else list(v)


def open_state(status: str = "status", open_value: str = K.OPEN_STATE) -> Column:
    """FLT2."""
    return _false_if_null(F.col(status) == F.lit(open_value))


def region_in(regions, location: str = "rescue_location", care: str = "care_conditions",
              nationwide: str = K.NATIONWIDE) -> Column:
    """FLT3: listed location, or a care region of 'nationwide'."""
    regions = as_list(regions)
    hit = F.col(location).isin(regions) if regions else F.lit(False)
    return _false_if_null(hit) | _false_if_null(F.col(care).getField("region") == F.lit(nationwide))


def value_in(column: str, values) -> Column:
    """FLT4 / FLT5."""
    return _false_if_null(F.col(column).isin(as_list(values)))


def in_range(column: str, rng: dict, lo_default: float = 0, hi_default: float = 100) -> Column:
    """FLT6 / FLT7: inclusive, null excluded.  A bound left out is 0 or 100, as the source has it (the
    ``*_default`` arguments); a bound given as None is no bound."""
    c = F.col(column)
    lo, hi = rng.get("min", lo_default), rng.get("max", hi_default)
    inside = c.isNotNull() & ~F.isnan(c)
    if lo is not None:
        inside = inside & (c >= F.lit(lo))
    if hi is not None:
        inside = inside & (c <= F.lit(hi))
    return _false_if_null(inside)


def equals(column: str, value) -> Column:
    """FLT8."""
    return _false_if_null(F.col(column) == F.lit(value))


def tags_match(wanted, tags: str | Column = "hashtags") -> Column:
    """FLT9: any wanted word and any own tag match two ways; no tags -> False."""
    t = F.col(tags) if isinstance(tags, str) else tags
    return any_two_way(t, as_list(wanted))


def homes_match(wanted, care: str = "care_conditions") -> Column:
    """FLT10: as FLT9 on ``care_conditions.suitable_homes``."""
    return any_two_way(F.col(care).getField("suitable_homes"), as_list(wanted))


def traits_ok(requirements: dict, traits: str = "behavior_traits") -> Column:
    """FLT11: per trait min / max / exact; a trait missing from the map passes, a null map fails."""
    m = F.col(traits)
    conds = [m.isNotNull()]
    for name, req in requirements.items():
        v = m.getItem(name)
        if "min" in req:
            conds.append(_true_if_null(v >= F.lit(req["min"])))
        if "max" in req:
            conds.append(_true_if_null(v <= F.lit(req["max"])))
        if "exact" in req:
            conds.append(_true_if_null(v == F.lit(req["exact"])))
    return reduce(lambda a, b: a & b, conds)


def health_ok(reqs: dict, health: str = "health_info") -> Column:
    """FLT12: vaccination minimum (only when some are recorded), no history, excluded words."""
    h = F.col(health)
    vac = h.getField("vaccination")
    hist = h.getField("medical_history")
    has_hist = hist.isNotNull() & (hist != "")
    conds = [h.isNotNull()]
    if "min_vaccinations" in reqs:
        conds.append(_true_if_null(~((F.size(vac) > 0) & (F.size(vac) < F.lit(reqs["min_vaccinations"])))))
    if reqs.get("no_medical_history", False):
        conds.append(~_false_if_null(has_hist))
    if "exclude_conditions" in reqs:
        conds.append(~_false_if_null(has_hist & contains_any(hist, list(reqs["exclude_conditions"]), lower=True)))
    return reduce(lambda a, b: a & b, conds)


def care_ok(prefs: dict, care: str = "care_conditions") -> Column:
    """FLT13: duration <= max when known; pickup method offered when pickup known; no excluded words."""
    c = F.col(care)
    dur = c.getField("duration")
    pickup = c.getField("pickup")
    extra = c.getField("additional_conditions")
    conds = [c.isNotNull()]
    if "max_duration" in prefs:
        known = dur.isNotNull() & (dur != 0) & ~F.isnan(dur)
        conds.append(~_false_if_null(known & (dur > F.lit(prefs["max_duration"]))))
    if "pickup_method" in prefs:
        known = pickup.isNotNull() & (F.size(pickup) > 0)
        conds.append(~_false_if_null(known & ~F.array_contains(pickup, F.lit(prefs["pickup_method"]))))
    if "exclude_conditions" in prefs:
        known = extra.isNotNull() & (extra != "")
        conds.append(~_false_if_null(known & contains_any(extra, list(prefs["exclude_conditions"]), lower=True)))
    return reduce(lambda a, b: a & b, conds)


# criteria key -> predicate builder; order is the application order
_CRITERIA = [
    ("region", lambda v: region_in(v)),
    ("gender", lambda v: value_in("gender", v)),
    ("care_type", lambda v: value_in("care_type", v)),
    ("age_range", lambda v: in_range("age", v)),
    ("weight_range", lambda v: in_range("weight", v)),
    ("neutered", lambda v: equals("neutered", v)),
    ("hashtags", lambda v: tags_match(v)),
    ("suitable_homes", lambda v: homes_match(v)),
    ("behavior_traits", lambda v: traits_ok(v)),
    ("health_requirements", lambda v: health_ok(v)),
    ("care_preferences", lambda v: care_ok(v)),
]


def criteria_predicates(criteria: dict, available_only: bool = True,
                        open_value: str = K.OPEN_STATE) -> list[tuple[str, Column]]:
    """Named predicates in application order; absent/falsy criteria are skipped
    (``neutered`` only when None)."""
    preds: list[tuple[str, Column]] = []
    if available_only:
        preds.append(("status", open_state(open_value=open_value)))
    for key, build in _CRITERIA:
        if key not in criteria:
            continue
        v = criteria[key]
        if key == "neutered":
            if v is None:
                continue
        elif not v:
            continue
        preds.append((key, build(v)))
    return preds


def build_filter(criteria: dict, available_only: bool = True, open_value: str = K.OPEN_STATE) -> Column:
    """FLT1: AND of all active predicates as one Column."""
    preds = [p for _, p in criteria_predicates(criteria, available_only, open_value)]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def apply_filters(df: DataFrame, criteria: dict, available_only: bool = True,
                  open_value: str = K.OPEN_STATE) -> DataFrame:
    """FLT1: open listings matching every active criterion."""
    clean = {k: v for k, v in criteria.items() if v is not None or k == "neutered"}
    return df.where(build_filter(clean, available_only, open_value))


def funnel(df: DataFrame, criteria: dict, available_only: bool = True,
           open_value: str = K.OPEN_STATE) -> DataFrame:
    """AGG12: one scan; row ``step`` = count after applying predicates 1..step (``all`` first).

    Output: ``(step_no BIGINT, step STRING, n BIGINT)``.
    """
    preds = criteria_predicates(criteria, available_only, open_value)
    aggs = [F.count(F.lit(1)).alias("s0")]
    acc = F.lit(True)
    for i, (_, p) in enumerate(preds, 1):
        acc = acc & p
        aggs.append(F.count_if(acc).alias(f"s{i}"))
    names = ["all"] + [n for n, _ in preds]
    wide = df.agg(*aggs)
    stack = ", ".join(f"{i}L, '{n}', s{i}" for i, n in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {stack}) as (step_no, step, n)")


def satisfaction_valid(text: str | Column) -> Column:
    """FLT22: digits only (after strip) and 1..5; else null."""
    from pawgrid.functions.text import pystrip
    t = pystrip(F.col(text) if isinstance(text, str) else text)
    n = F.when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))
    return F.when(n.between(1, 5), n.cast("int"))
