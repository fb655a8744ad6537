"""Preference slots from query text (SC5) and the hard filter they imply (FLT16–FLT19, JN5).

Slots: ``size`` (small/medium/large), ``age`` (young/senior), ``gender`` (male/female); each
null when no keyword fires.  The hard filter per (query, listing) pair is expressed without a
theta join: a query's slot combination is encoded as ``slot_group`` (0..35) and each listing
carries ``slot_mask``, the bit set of every combination it satisfies.  A pair is eligible iff
``(slot_mask >> slot_group) & 1 == 1`` — one integer test inside the vector kernel, and an
equi-join key when counting eligible listings per query.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions.classes import strict_double
from pawgrid.functions.text import contains_any


def slot_value(text: Column | str, rules: list[tuple[str, list[str]]]) -> Column:
    """First rule whose keywords occur in the text wins (substring test, as specified)."""
    t = F.col(text) if isinstance(text, str) else text
    expr = None
    for value, words in rules:
        cond = contains_any(t, words)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr if expr is not None else F.lit(None).cast("string")


def extract_slots(df: DataFrame, text_col: str, rules: dict = K.SLOT_RULES) -> DataFrame:
    """SC5: adds ``size``, ``age``, ``gender`` and ``personality_query`` (the whole text)."""
    return df.withColumns({
        "size": slot_value(text_col, rules["size"]),
        "age": slot_value(text_col, rules["age"]),
        "gender": slot_value(text_col, rules["gender"]),
        "personality_query": F.col(text_col),
    })


SIZE_VALUES = [None] + [v for v, _ in K.SLOT_RULES["size"]]      # index 0 = no constraint
AGE_VALUES = [None] + [v for v, _ in K.SLOT_RULES["age"]]
GENDER_VALUES = [None] + [v for v, _ in K.SLOT_RULES["gender"]]


def _index(c: Column, values: list) -> Column:
    expr = F.when(c.isNull(), F.lit(0))
    for i, v in enumerate(values[1:], 1):
        expr = expr.when(c == F.lit(v), F.lit(i))
    return expr


def slot_group(size: str = "size", age: str = "age", gender: str = "gender") -> Column:
    """A query's slot combination as one small integer (size + 4*age + 12*gender)."""
    return (_index(F.col(size), SIZE_VALUES) + F.lit(len(SIZE_VALUES)) * _index(F.col(age), AGE_VALUES)
            + F.lit(len(SIZE_VALUES) * len(AGE_VALUES)) * _index(F.col(gender), GENDER_VALUES))


def size_ok(slot: str | None, weight: Column, cuts=K.HARD_SIZE_CUTS) -> Column:
    """FLT16: small < 7 <= medium < 20 <= large on the numeric weight; null weight fails."""
    if slot is None:
        return F.lit(True)
    lo, hi = cuts
    names = [v for v, _ in K.SLOT_RULES["size"]]
    cond = {names[0]: weight < lo, names[1]: (weight >= lo) & (weight < hi), names[2]: weight >= hi}[slot]
    return F.coalesce(cond, F.lit(False))


def age_ok(slot: str | None, birth_text: Column, patterns=K.HARD_AGE_PATTERNS) -> Column:
    """FLT18: year pattern found in the birth text; null text fails."""
    if slot is None:
        return F.lit(True)
    return F.coalesce(birth_text.cast("string").rlike(patterns[slot]), F.lit(False))


def gender_ok(slot: str | None, gender: Column) -> Column:
    """FLT17: equality with the slot value."""
    if slot is None:
        return F.lit(True)
    return F.coalesce(gender == F.lit(slot), F.lit(False))


def hard_filter(size: str | None = None, age: str | None = None, gender: str | None = None,
                weight_col: str = "addinfo07", gender_col: str = "addinfo03",
                birth_col: str = "addinfo05") -> Column:
    """FLT19 for one literal slot set: unset slots are True."""
    w = strict_double(weight_col)
    return size_ok(size, w) & age_ok(age, F.col(birth_col)) & gender_ok(gender, F.col(gender_col))


def slot_mask(weight_col: str = "addinfo07", gender_col: str = "addinfo03",
              birth_col: str = "addinfo05") -> Column:
    """Bit set over all 36 slot combinations that a listing satisfies."""
    w = strict_double(weight_col)
    b = F.col(birth_col)
    g = F.col(gender_col)
    size_bits = [size_ok(v, w) for v in SIZE_VALUES]
    age_bits = [age_ok(v, b) for v in AGE_VALUES]
    gender_bits = [gender_ok(v, g) for v in GENDER_VALUES]
    mask = F.lit(0).cast("long")
    ns, na = len(SIZE_VALUES), len(AGE_VALUES)
    for (si, s), (ai, a), (gi, gg) in product(enumerate(size_bits), enumerate(age_bits), enumerate(gender_bits)):
        bit = si + ns * ai + ns * na * gi
        mask = mask + F.when(s & a & gg, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


def eligible_counts(queries: DataFrame, listings: DataFrame, qid: str = "qid",
                    available_only: bool = True, state_col: str = "state",
                    open_value: str = K.OPEN_STATE) -> DataFrame:
    """JN5 funnel for many queries at once: ``(qid, eligible BIGINT)``.

    Listings are pre-aggregated by their slot mask (at most a few dozen distinct masks), the
    mask table is expanded to one row per satisfied slot group, and queries join it on the
    group — an equi-join against a table whose size is bounded by 36 rows, whatever the data.
    """
    base = listings.where(F.col(state_col) == F.lit(open_value)) if available_only else listings
    per_mask = base.groupBy(slot_mask().alias("m")).agg(F.count(F.lit(1)).alias("n"))
    per_group = (per_mask
                 .withColumn("slot_group", F.explode(F.sequence(F.lit(0), F.lit(35))))
                 .where(F.expr("shiftright(m, slot_group) & 1") == 1)
                 .groupBy("slot_group").agg(F.sum("n").alias("eligible")))
    q = queries.withColumn("slot_group", slot_group())
    return (q.join(F.broadcast(per_group), "slot_group", "left")
            .select(F.col(qid), F.coalesce(F.col("eligible"), F.lit(0)).cast("long").alias("eligible")))
