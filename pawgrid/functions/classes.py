"""Classification columns: size classes, age buckets, age phrases, age in months, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions.text import col_, contains_any

# A number the way Python's float()/int() would accept it (ASCII form, no '_' groups).
NUMBER_PATTERN = r"^[ \t\n\r\f\x0B]*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?[ \t\n\r\f\x0B]*$"
INT_PATTERN = r"^[ \t\n\r\f\x0B]*[-+]?[0-9]+[ \t\n\r\f\x0B]*$"


def strict_double(c: Column | str) -> Column:
    """PRJ6: ``pd.to_numeric(errors='coerce')`` — text that is not a plain number -> null."""
    s = col_(c).cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))


def clean_positive_number(c: Column | str) -> Column:
    """PRJ5: unparsable, zero or negative -> null; large values are kept."""
    x = strict_double(c)
    return F.when(x > 0, x)


def size_class_lt(weight: Column | str, cuts: list[tuple[float, str]], else_label: str, null_label: str,
                  zero_is_null: bool = False) -> Column:
    """Size label with ``weight < cut`` bounds (SC6 with cut set A, SC7 with cut set B)."""
    w = col_(weight)
    missing = w.isNull() | F.isnan(w)
    if zero_is_null:
        missing = missing | (w == 0)
    expr = F.when(missing, F.lit(null_label))
    for cut, label in cuts:
        expr = expr.when(w < cut, F.lit(label))
    return expr.otherwise(F.lit(else_label))


def size_class_a(weight: Column | str) -> Column:
    return size_class_lt(weight, K.SIZE_A, K.SIZE_A_ELSE, K.SIZE_A_NULL)


def size_class_b(weight: Column | str) -> Column:
    return size_class_lt(weight, K.SIZE_B, K.SIZE_B_ELSE, K.SIZE_B_NULL, zero_is_null=True)


def size_class_c(weight: Column | str) -> Column:
    """SC8 / AGG5: ``< 5`` small, ``<= 15`` medium, else large; null -> unknown."""
    w = col_(weight)
    return (
        F.when(w.isNull() | F.isnan(w), F.lit(K.SIZE_C_NULL))
        .when(w < K.SIZE_C_SMALL[0], F.lit(K.SIZE_C_SMALL[1]))
        .when(w <= K.SIZE_C_MEDIUM[0], F.lit(K.SIZE_C_MEDIUM[1]))
        .otherwise(F.lit(K.SIZE_C_ELSE))
    )


def age_bucket(age: Column | str) -> Column:
    """AGG4: ``<= 1``, ``<= 3``, ``<= 7``, else 8+; null -> unknown."""
    a = col_(age)
    expr = F.when(a.isNull() | F.isnan(a), F.lit(K.AGE_BUCKET_NULL))
    for cut, label in K.AGE_BUCKETS:
        expr = expr.when(a <= cut, F.lit(label))
    return expr.otherwise(F.lit(K.AGE_BUCKET_ELSE))


def age_phrase(age_text: Column | str, rules=K.AGE_PHRASE_RULES) -> Column:
    """SC9: first year rule found in the lower-cased text wins, else echo the text."""
    t = col_(age_text).cast("string")
    low = F.lower(t)
    expr = F.when(t.isNull() | (t == K.AGE_UNKNOWN_TEXT), F.lit(K.AGE_PHRASE_NULL))
    for years, label in rules:
        expr = expr.when(contains_any(low, years), F.lit(label))
    return expr.otherwise(F.concat(F.lit(K.AGE_PHRASE_OTHER_PREFIX), t))


def _py_int(s: Column) -> Column:
    return F.when(s.rlike(INT_PATTERN), F.trim(s, F.lit(" \t\n\r\f\u000b")).try_cast("int"))


def birth_parts(birth: Column | str) -> tuple[Column, Column, Column]:
    """(year, month, estimated) of a birth text ``YYYY[MM]`` with an optional estimate mark.

    Year is the first 4 characters, month the next 2 when the cleaned text has at least 6
    characters (else January).  Anything not an integer, a month outside 1..12 or a year
    outside 1..9999 gives a null year/month.
    """
    b = col_(birth).cast("string")
    est = b.contains(K.ESTIMATE_MARK)
    clean = F.replace(b, F.lit(K.ESTIMATE_MARK), F.lit(""))
    year = _py_int(F.substring(clean, 1, 4))
    month = F.when(F.char_length(clean) >= 6, _py_int(F.substring(clean, 5, 2))).otherwise(F.lit(1))
    ok = year.between(1, 9999) & month.between(1, 12)
    return F.when(ok, year), F.when(ok, month), est


def age_in_months(birth: Column | str, as_of: Column | str | None = None) -> Column:
    """SC10 numeric part: months from the birth month to ``as_of`` (default: today)."""
    ref = F.current_date() if as_of is None else (F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of)
    year, month, _ = birth_parts(birth)
    return (F.year(ref) - year) * 12 + (F.month(ref) - month)


def age_months_text(birth: Column | str, as_of: Column | str | None = None) -> Column:
    """SC10: ``{n}개월`` plus ``(추정)`` when the text carries the estimate mark; bad text -> null."""
    _, _, est = birth_parts(birth)
    n = age_in_months(birth, as_of)
    suffix = F.when(est, F.lit(K.ESTIMATE_SUFFIX)).otherwise(F.lit(""))
    return F.when(n.isNotNull(), F.concat(n.cast("string"), F.lit(K.MONTHS_SUFFIX), suffix))
