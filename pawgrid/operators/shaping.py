"""Column shaping (PRJ1–PRJ12): drop/rename if present, key first, defaults, merges, preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions.classes import age_months_text, clean_positive_number
from pawgrid.functions.text import pystrip


def drop_if_present(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ1: absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def rename_if_present(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ2: absent names are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns and k != v})


def key_first(df: DataFrame, key: str) -> DataFrame:
    """PRJ3: the key column moves to the front."""
    if key not in df.columns:
        return df
    return df.select(key, *[c for c in df.columns if c != key])


def fill_defaults(df: DataFrame, defaults: dict[str, str] = K.RAW_DEFAULTS) -> DataFrame:
    """PRJ4: per-column null defaults for the columns that exist (weight stays null)."""
    present = {k: v for k, v in defaults.items() if k in df.columns}
    return df.fillna(present) if present else df


def with_default_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """PRJ8: add absent columns as literals."""
    missing = {k: F.lit(v) for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def clean_weight(df: DataFrame, col: str = "addinfo07") -> DataFrame:
    """PRJ5: text weight -> positive double or null."""
    return df.withColumn(col, clean_positive_number(col))


def merge_text_columns(df: DataFrame, parts: list[str], out: str, drop: bool = True) -> DataFrame:
    """PRJ7: join the present parts with a space (null -> ''), strip, '' -> null; drop the parts.

    Inner blanks stay: ('a', null, 'c') -> 'a  c'."""
    present = [c for c in parts if c in df.columns]
    if not present:
        return df
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in present])
    stripped = pystrip(joined)
    df = df.withColumn(out, F.when(stripped != "", stripped))
    return df.drop(*present) if drop else df


def with_age_months(df: DataFrame, birth: str = K.BIRTH_COL, out: str = K.AGE_MONTHS_COL,
                    as_of: str | None = None) -> DataFrame:
    """SC10 as a column step (only when the birth column exists)."""
    if birth not in df.columns:
        return df
    return df.withColumn(out, age_months_text(birth, as_of))


def preview(df: DataFrame, text_col: str, name_col: str = "addinfo01", n: int = 3, chars: int = 300) -> DataFrame:
    """PRJ12: first ``n`` rows: name, first ``chars`` characters, full length."""
    return df.select(F.col(name_col).alias("name"), F.substring(text_col, 1, chars).alias("head"),
                     F.char_length(text_col).cast("long").alias("n_chars")).limit(n)


def flat_export_columns(score_col: str = "match_score") -> list[Column]:
    """PRJ10 / SNK6: the 10 flat export columns of a structured listing."""
    return [
        F.col("uid").alias("id"), "name", "gender", "age", "weight", "care_type", "rescue_location",
        F.coalesce(F.array_join("hashtags", "|"), F.lit("")).alias("hashtags"),
        F.coalesce(F.col(score_col), F.lit(0.0)).alias("match_score") if score_col else F.lit(0.0).alias("match_score"),
        F.coalesce(F.col("detail_link"), F.lit("")).alias("detail_link"),
    ]
