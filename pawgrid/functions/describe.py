"""Natural-language text builders over listing rows (SC11, SC12, SC13), as Column expressions.

Each builder reads the raw listing columns (``addinfo01`` name, ``03`` sex, ``04`` neutered,
``05`` birth text, ``07`` weight, ``08`` hashtags, ``09`` rescue story, ``10`` personality,
``11`` other, ``16`` special needs, ``19`` health, ``20`` daily care, ``state``, ``kind``).
A column missing from the frame is replaced by its default literal (PRJ8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions.classes import age_phrase, size_class_a, size_class_b, strict_double
from pawgrid.functions.text import clean_text, is_blank, pystrip, tag_text, truncate


def get_or(df: DataFrame, name: str, default) -> Column:
    """``row.get(name, default)``: the column when present, else the literal."""
    return F.col(name) if name in df.columns else F.lit(default)


def _part(cond: Column, text: Column) -> Column:
    return F.when(cond, text)


DESCRIBE_TEXT_COLS = ["addinfo08", "addinfo10", "addinfo09", "addinfo19", "addinfo16", "addinfo20", "addinfo11"]
EMBED_TEXT_COLS = ["addinfo10", "addinfo09", "addinfo16", "addinfo20"]


def with_description(df: DataFrame, out: str = "description") -> DataFrame:
    """SC11 as a frame step: the cleaned free-text fields are projected once, then the
    description is built from them (each long text is scanned by the regexes once)."""
    staged = df.withColumns({f"__clean_{c}": clean_text(get_or(df, c, "")) for c in DESCRIBE_TEXT_COLS})
    return staged.withColumn(out, describe_listing(staged, _staged=True)).drop(
        *[f"__clean_{c}" for c in DESCRIBE_TEXT_COLS])


def with_embedding_text(df: DataFrame, out: str = "embedding_text", max_length: int | None = None,
                        tag_mode: str = "reference") -> DataFrame:
    """SC12 as a frame step: stripped free-text fields projected once."""
    staged = df.withColumns({f"__strip_{c}": pystrip(get_or(df, c, "").cast("string")) for c in EMBED_TEXT_COLS})
    return staged.withColumn(out, embedding_text(staged, max_length, tag_mode, _staged=True)).drop(
        *[f"__strip_{c}" for c in EMBED_TEXT_COLS])


def describe_listing(df: DataFrame, _staged: bool = False) -> Column:
    """SC11: intro sentence + up to 8 optional parts, joined by a space.

    Expects the frame after ``fill_defaults`` (nulls already replaced); remaining nulls are
    treated as the defaults.  Prefer ``with_description`` on long texts.
    """
    d = K.RAW_DEFAULTS
    name = F.coalesce(get_or(df, "addinfo01", d["addinfo01"]), F.lit(d["addinfo01"]))
    gender = F.coalesce(get_or(df, "addinfo03", d["addinfo03"]), F.lit(d["addinfo03"]))
    weight = get_or(df, "addinfo07", None).cast("double")
    age_info = get_or(df, "addinfo05", d["addinfo05"])
    neuter = get_or(df, "addinfo04", d["addinfo04"]).cast("string")
    state = F.coalesce(get_or(df, "state", d["state"]), F.lit(d["state"]))
    kind = F.coalesce(get_or(df, "kind", d["kind"]), F.lit(d["kind"]))

    size_desc = size_class_a(weight)
    age_desc = age_phrase(age_info)
    intro = F.concat(name, F.lit("는 "), gender, F.lit("이며, "), size_desc, F.lit("에 해당합니다."))
    intro = F.concat(intro, F.when(age_desc != K.AGE_PHRASE_NULL, F.concat(F.lit(" "), age_desc, F.lit("이고")))
                     .otherwise(F.lit("")))
    neuter_known = neuter.isNotNull() & (neuter != "") & (neuter != d["addinfo04"])
    intro = F.concat(intro, F.when(neuter_known, F.concat(F.lit(" "), neuter, F.lit(" 상태입니다.")))
                     .otherwise(F.lit("입니다.")))

    status = _part((state != d["state"]) | (kind != d["kind"]),
                   F.concat(F.lit("현재 "), state, F.lit(" 상태이며 "), kind, F.lit("로 분류됩니다.")))

    def cleaned(col_name: str) -> Column:
        return F.col(f"__clean_{col_name}") if _staged else clean_text(get_or(df, col_name, ""))

    tags = cleaned("addinfo08")
    parts = [intro, status, _part(tags != "", tags)]
    for col_name, label in K.DESCRIBE_LABELS.items():
        t = cleaned(col_name)
        parts.append(_part(t != "", F.concat(F.lit(label), t)))
    return F.array_join(F.array_compact(F.array(*parts)), " ")


def embedding_text(df: DataFrame, max_length: int | None = None, tag_mode: str = "reference",
                   _staged: bool = False) -> Column:
    """SC12: basic sentence + status + tags + 4 labelled free-text parts, joined by a space.

    Whole texts by default.  With ``max_length``, a longer text keeps its first 4 parts only, cut
    with ``...`` if still too long.
    A missing weight gives ``몸무게미정`` / ``크기미정`` (where the source printed ``nan``).
    """
    d = K.EMBED_DEFAULTS
    name = F.coalesce(get_or(df, "addinfo01", d["addinfo01"]).cast("string"), F.lit(d["addinfo01"]))
    gender = F.coalesce(get_or(df, "addinfo03", d["addinfo03"]).cast("string"), F.lit(d["addinfo03"]))
    weight_raw = get_or(df, "addinfo07", d["addinfo07"])
    weight_txt = F.coalesce(weight_raw.cast("string"), F.lit(d["addinfo07"]))
    weight_num = strict_double(weight_raw)
    size = size_class_b(weight_num)
    state = get_or(df, "state", d["state"]).cast("string")
    kind = get_or(df, "kind", d["kind"]).cast("string")

    basic = F.concat(name, F.lit("는 "), gender, F.lit("이고 몸무게 "), weight_txt, F.lit("kg인 "), size,
                     F.lit(" 동물입니다."))
    status = _part(~is_blank_empty(state) & ~is_blank_empty(kind),
                   F.concat(F.lit("현재 "), state, F.lit(" 상태이며 "), kind, F.lit("로 분류됩니다.")))
    ptext = tag_text(get_or(df, "addinfo08", ""), mode=tag_mode)
    tags = _part(ptext != "", F.concat(F.lit("성격 특징은 "), ptext, F.lit(" 입니다.")))

    def labelled(col_name: str, label: str) -> Column:
        if _staged:
            v = F.col(f"__strip_{col_name}")
            return _part(v.isNotNull() & (v != ""), F.concat(F.lit(label), v))
        v = get_or(df, col_name, "").cast("string")
        return _part(~is_blank(v), F.concat(F.lit(label), pystrip(v)))

    parts = [
        basic, status, tags,
        *[labelled(c, label) for c, label in K.EMBED_LABELS.items()],
    ]
    arr = F.array_compact(F.array(*parts))
    full = F.array_join(arr, " ")
    if max_length is None:
        return full
    essential = F.array_join(F.slice(arr, 1, 4), " ")
    cut = F.when(F.char_length(essential) <= max_length, essential).otherwise(
        F.concat(F.substring(essential, 1, max_length), F.lit("...")))
    return F.when(F.char_length(full) > max_length, cut).otherwise(full)


def is_blank_empty(c: Column) -> Column:
    """Python falsiness of a string: null or ''."""
    return c.isNull() | (c == "")


def candidate_text(gender: Column, weight: Column, tags: Column, personality: Column,
                   special_needs: Column, rescue_story: Column, personality_length: int | None = None,
                   story_length: int | None = None) -> Column:
    """SC13: up to 5 parts joined by `` | ``; the personality and the story are cut where a length is given."""
    def cut(c: Column, n: int | None) -> Column:
        return c if n is None else truncate(c, n)

    parts = [
        F.concat(F.lit("성별: "), F.coalesce(gender.cast("string"), F.lit("nan")), F.lit(", 몸무게: "),
                 F.coalesce(weight.cast("string"), F.lit("nan")), F.lit("kg")),
        _part(~is_blank_empty(tags), F.concat(F.lit("성격: "), tags)),
        _part(~is_blank_empty(personality), F.concat(F.lit("상세설명: "), cut(personality, personality_length))),
        _part(~is_blank_empty(special_needs), F.concat(F.lit("특별요구: "), special_needs)),
        _part(~is_blank_empty(rescue_story), F.concat(F.lit("구조배경: "), cut(rescue_story, story_length))),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), " | ")
