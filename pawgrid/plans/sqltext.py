"""DuckDB SQL twins of the text expressions, used only to write oracle queries.

They mirror ``pawgrid.functions.text`` one-for-one so that oracle SQL reads like the Spark code.
"""

from __future__ import annotations

from pawgrid.functions.text import HASHTAG_PATTERN, QUERY_DROP_PATTERN, WS_CHARS, WS_CLASS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _chars_sql(chars: str) -> str:
    return " || ".join(f"chr({ord(ch)})" for ch in chars)


def strip(x: str) -> str:
    return f"trim({x}, {_chars_sql(WS_CHARS)})"


def clean_text(x: str) -> str:
    y = f"coalesce(CAST({x} AS VARCHAR), '')"
    y = f"regexp_replace({y}, {q(HASHTAG_PATTERN)}, '\\1', 'g')"
    y = f"replace({y}, '&apos;', '''')"
    y = f"replace({y}, chr(13) || chr(10), ' ')"
    y = f"replace({y}, chr(10), ' ')"
    y = f"regexp_replace({y}, {q(WS_CLASS + '+')}, ' ', 'g')"
    return strip(y)


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def tag_text(x: str) -> str:
    base = f"regexp_replace(coalesce({x}, ''), {q(HASHTAG_PATTERN)}, '\\1', 'g')"
    pieces = f"list_filter(string_split({base}, '#'), lambda t: {strip('t')} <> '')"
    return f"CASE WHEN {is_blank(x)} THEN '' ELSE array_to_string({pieces}, ', ') END"


def clean_query(x: str) -> str:
    y = strip(f"CAST({x} AS VARCHAR)")
    y = f"regexp_replace({y}, {q(QUERY_DROP_PATTERN)}, ' ', 'g')"
    y = f"regexp_replace({y}, {q(WS_CLASS + '+')}, ' ', 'g')"
    return strip(y)


def truncate(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
            ("&middot;", "·"), ("&copy;", "©"),
            ("&amp;", "&")]


def decode(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def node_text(x: str) -> str:
    pieces = f"list_transform(regexp_split_to_array({x}, '<[^>]*>'), lambda ntx: {strip(decode('ntx'))})"
    return f"array_to_string(list_filter({pieces}, lambda ntx: ntx <> ''), '')"


def first(x: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {q(pattern)}) THEN regexp_extract({x}, {q(pattern)}, 1) END"


def strict_double(x: str) -> str:
    pat = r"^[ \t\n\r\f\x{0B}]*[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?[ \t\n\r\f\x{0B}]*$"
    return f"CASE WHEN regexp_matches(CAST({x} AS VARCHAR), {q(pat)}) THEN TRY_CAST(trim(CAST({x} AS VARCHAR)) AS DOUBLE) END"


def py_int(x: str) -> str:
    pat = r"^[ \t\n\r\f\x{0B}]*[-+]?[0-9]+[ \t\n\r\f\x{0B}]*$"
    return f"CASE WHEN regexp_matches({x}, {q(pat)}) THEN TRY_CAST(trim({x}) AS INTEGER) END"


def age_months_text(b: str, as_of: str) -> str:
    clean = f"replace({b}, '추정', '')"
    year = py_int(f"substr({clean}, 1, 4)")
    month = f"CASE WHEN length({clean}) >= 6 THEN {py_int(f'substr({clean}, 5, 2)')} ELSE 1 END"
    ok = f"(({year}) BETWEEN 1 AND 9999 AND ({month}) BETWEEN 1 AND 12)"
    n = (f"((year(DATE {q(as_of)}) - ({year})) * 12 + (month(DATE {q(as_of)}) - ({month})))")
    est = f"CASE WHEN contains({b}, '추정') THEN '(추정)' ELSE '' END"
    return f"CASE WHEN {ok} THEN CAST({n} AS VARCHAR) || '개월' || {est} END"
