"""Scalar text functions as native Column expressions (no Python UDFs).

Python's ``str.strip`` and ``\\s`` cover Unicode whitespace while Java's ``\\s`` and
``trim`` cover ASCII only, so whitespace classes are spelled out here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pawgrid import constants as K

# Unicode whitespace as Python's str.isspace() sees it (Java and RE2 syntax alike).
WS_CLASS = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# the same set as plain characters, for btrim (no regex)
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
HASHTAG_PATTERN = "#([가-힣a-zA-Z0-9]+)"
# characters kept by the query cleaner: Unicode letters/digits, '_', whitespace, . , ! ?
QUERY_DROP_PATTERN = r"[^\p{L}\p{N}_" + WS_CLASS[1:-1] + r".,!?]"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c: Column | str) -> Column:
    """``str.strip()`` with Python's whitespace set (a character-set trim, no regex)."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def is_blank(c: Column | str) -> Column:
    """True when null or only whitespace (``not s or not s.strip()``)."""
    c = col_(c)
    return c.isNull() | (pystrip(c) == "")


def strip_hashtags(c: Column | str) -> Column:
    """``#tag`` -> ``tag`` (SC1)."""
    return F.regexp_replace(col_(c), HASHTAG_PATTERN, "$1")


def clean_text(c: Column | str) -> Column:
    """SC2: null/'' -> ''; unhash tags; &apos; -> '; line breaks and runs of blanks -> one space; strip."""
    x = F.coalesce(col_(c).cast("string"), F.lit(""))
    x = strip_hashtags(x)
    x = F.replace(x, F.lit("&apos;"), F.lit("'"))
    # line breaks are whitespace: the run collapse turns CRLF / LF into one space as well, and
    # after it the only whitespace left is single spaces, so a plain space trim is a full strip
    x = F.regexp_replace(x, f"{WS_CLASS}+", " ")
    return F.trim(x)


def tag_text(c: Column | str, mode: str = "reference") -> Column:
    """SC3: hashtag string -> ', '-joined tag text.

    ``reference``: tags are unhashed *before* the split, so ``#a#b`` becomes ``ab`` (the
    observed behaviour).  ``split``: split on ``#`` first, giving ``a, b``.
    """
    raw = col_(c)
    base = strip_hashtags(raw) if mode == "reference" else raw
    pieces = F.filter(F.split(F.coalesce(base, F.lit("")), "#"), lambda t: pystrip(t) != "")
    if mode != "reference":
        pieces = F.transform(pieces, lambda t: pystrip(t))
    return F.when(is_blank(raw), F.lit("")).otherwise(F.array_join(pieces, ", "))


def clean_query(c: Column | str) -> Column:
    """SC4: strip; characters outside letters/digits/_/space/.,!? -> space; collapse; strip."""
    x = pystrip(col_(c).cast("string"))
    x = F.regexp_replace(x, QUERY_DROP_PATTERN, " ")
    x = F.regexp_replace(x, f"{WS_CLASS}+", " ")
    return pystrip(x)


def truncate(c: Column | str, n: int, ellipsis: str = "...") -> Column:
    """SC14: cut to ``n`` characters and add ``...`` only when longer."""
    c = col_(c)
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def contains_any(c: Column | str, words: list[str], lower: bool = False) -> Column:
    """SC16: any of ``words`` occurs in ``c`` (optionally both lower-cased)."""
    c = col_(c)
    if lower:
        c = F.lower(c)
        words = [w.lower() for w in words]
    if not words:
        return F.lit(False)
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def two_way_contains(a: Column, b: Column) -> Column:
    """SC23: ``a in b or b in a``."""
    return a.contains(b) | b.contains(a)


def any_two_way(tags: Column, wanted: list[str]) -> Column:
    """Any listed tag and any wanted word match two ways; null/empty list -> False."""
    if not wanted:
        return F.lit(False)
    wanted_arr = F.array(*[F.lit(w) for w in wanted])
    hit = F.exists(tags, lambda h: F.exists(wanted_arr, lambda t: two_way_contains(h, t)))
    return F.coalesce(hit & (F.size(tags) > 0), F.lit(False))


def format_fixed(c: Column | str, decimals: int = 3) -> Column:
    """SC20: ``f"{x:.3f}"``; a tie goes to the even digit."""
    return F.format_string(f"%.{decimals}f", F.bround(col_(c), decimals))


def py_str(c: Column | str) -> Column:
    """``str(x)`` for strings and doubles (``8.0`` stays ``8.0``)."""
    return col_(c).cast("string")
