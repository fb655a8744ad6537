"""Operator 7: secret scan: fixed patterns, and a randomness battery with false-discovery control.

Pattern spans (kinds assign, access, hex) are leftmost non-overlapping matches, code points, end
exclusive; a match that is too short is dropped after matching.

The battery looks at every token ``[A-Za-z0-9+/_=-]{20,}``, also those of letters or digits alone.  The encoding
(digits, letters of one case, letters, hex, base32, base62, base64) is inferred from the characters and maps them to
numbers.  Three
tests ask whether the numbers look drawn at random: chi-squared uniformity over equal slices of the
alphabet (slices grow with the length, five expected a slice), the runs test around its middle, the
lag-one serial correlation; Fisher's rule combines their p-values.

Runs of consecutive words of the documents (of letters alone or digits alone), joined to the length
of a class, ended by a digit where the encoding has both (its candidates have one) and read in the encoding of the
candidates, serve as decoys: they show, for each length class and encoding, how often written text passes for
random.  A run begins at every word of every document, so a text counts by its length, for
each class that has candidates; running sums over a chunk of texts give the statistics of all its runs.  A class with less
than 1 / ``fdr`` decoys takes those of the next shorter ones as well: the shorter a text, the more
random it looks, so they can only raise the rate.  Over all documents, histograms of the combined
p-value of candidates and decoys give per class the widest acceptance region whose estimated
false-discovery rate (decoy rate x candidates / accepted) is within ``fdr``.  A class where
written text looks as random as keys accepts nothing (as that of 40 letters of one case beside texts of short
words: their letters fall evenly enough into the slices); so does a p-value that rejects randomness
itself at 0.001 (one key in a thousand).  Accepted candidates are spans of kind
``random``, unless they overlap a pattern span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import read
from pawgrid.llm.kernels import chunks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as a run of [0-9a-f]+ of 24 characters or more
KEYWORDS = ("passw", "secret", "token", "api")  # one of them is in every assign match
MIN_VALUE, MIN_ACCESS, MIN_TOKEN = 6, 20, 20
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: tokens of digits or letters alone first: those that mix them fit none of the first four
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
             "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
             "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
#: a word of letters alone or digits alone that is not a part of a longer token
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])(?:[A-Za-z]+|[0-9]+)(?![A-Za-z0-9+/_=-])")
LEVEL = 30  # bins of the p-values above 0.001
ENOUGH = 12.0  # half of Fisher's statistic at which p is below 0.001, in bins that are not told apart
TABLE = 1 << 22  # keys looked up in a table; more are sorted
BINS = 200  # of the combined p-value: ten a decade, 0 the most random
FDR = 0.05
MARK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern spans."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def numbers(token: str) -> tuple[list[int], int] | None:
    """The token as numbers of its inferred encoding and the alphabet's size; None for no encoding."""
    body = token.rstrip("=")
    chars = set(body)
    for alphabet in ALPHABETS:
        if chars <= set(alphabet):
            return [alphabet.index(c) for c in body], len(alphabet)
    return None


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * df)
    return _tail(((x / df) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def _slices(n: int, size: int) -> tuple[int, list[float]]:
    """Number of slices of the alphabet for n values and the expected values in each."""
    slices = max(2, min(size, n // 5))
    edges = [-(-k * size // slices) for k in range(slices + 1)]
    return slices, [n * (edges[k + 1] - edges[k]) / size for k in range(slices)]


def _combined(n: int, slices: int, chi: float, n1: int, runs: int, r: float | None) -> float:
    """Combined p-value: chi-squared of the slices, ``runs`` with n1 values in the upper half, lag-one correlation r."""
    p1 = _chi2_tail(chi, slices - 1)
    n2 = n - n1
    if n1 and n2:
        mean = 1 + 2 * n1 * n2 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p2 = 2 * _tail(abs(runs - mean) / math.sqrt(var))
    else:
        p2 = 2.0 ** (1 - n)
    p3 = 2.0 ** (1 - n) if r is None else 2 * _tail(abs(r + 1 / n) * math.sqrt(n))
    x = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))  # half of Fisher's statistic, 6 degrees
    return math.exp(-x) * (1 + x + x * x / 2)


def battery(values: list[int], size: int) -> float:
    """Combined p-value of the three tests that the values are uniform and independent."""
    n = len(values)
    slices, expected = _slices(n, size)
    seen = [0] * slices
    for v in values:
        seen[v * slices // size] += 1
    chi = sum((c - e) ** 2 / e for c, e in zip(seen, expected))
    high = [2 * v >= size for v in values]
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    centre = sum(values) / n
    spread = sum((v - centre) ** 2 for v in values)
    r = sum((a - centre) * (b - centre) for a, b in zip(values, values[1:])) / spread if spread else None
    return _combined(n, slices, chi, sum(high), runs, r)


def _tails(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.array([*map(math.erfc, (z / math.sqrt(2)).tolist())])


def _each(keys: np.ndarray, top: int, value) -> np.ndarray:
    """``value`` (of an array) of every key from 0 to ``top``, worked out once for each that occurs."""
    if top >= TABLE:
        some, place = np.unique(keys, return_inverse=True)
        return value(some)[place]
    occurs = np.zeros(top + 1, dtype=bool)
    occurs[keys] = True
    some = np.flatnonzero(occurs)
    table = np.empty(top + 1)
    table[some] = value(some)
    return table[keys]


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... values.  They may wrap: a difference is right as long as it fits itself."""
    out = np.zeros(len(x) + 1, dtype=np.int32)
    np.cumsum(x, dtype=np.int32, out=out[1:])
    return out


class Sums:
    """Running sums over the numbers of an encoding that the runs of every length share."""

    def __init__(self, values: np.ndarray, size: int) -> None:
        self.values, self.size = values, size
        v = values.astype(np.int32)
        self.high = 2 * v >= size
        self.first, self.squares, self.highs = running(v), running(v * v), running(self.high)
        self.products, self.turns = running(v[:-1] * v[1:]), running(self.high[:-1] != self.high[1:])


def run_batteries(sums: Sums, first: np.ndarray, n: int, last: np.ndarray | None, enough: float = math.inf) -> np.ndarray:
    """:func:`battery` of the runs of n values from ``first`` on, whose last one is replaced by ``last`` if given.

    A run whose first two tests have a log sum of ``-enough`` or less is left at their p-value.  Every statistic is a difference of running sums, so a run costs the same whatever its length."""
    values, size = sums.values, sums.size
    end = first + (n if last is None else n - 1)  # of the values of the run as they stand

    def total(run: np.ndarray, cut: int = 0) -> np.ndarray:
        return (run[end - cut] - run[first]).astype(np.int64)

    s1, s2, n1 = total(sums.first), total(sums.squares), total(sums.highs)
    product, turns = total(sums.products, 1), total(sums.turns, 1)  # of neighbours: one less than the values
    head, tail = values[first].astype(np.int64), values[end - 1].astype(np.int64)
    if last is not None:
        z = last.astype(np.int64)
        top = 2 * z >= size
        s1, s2, n1, product, turns, tail = (s1 + z, s2 + z * z, n1 + top, product + tail * z, turns + (top != sums.high[end - 1]), z)
    slices, _ = _slices(n, size)
    edges = [-(-k * size // slices) for k in range(slices + 1)]
    # a slice is ``thin`` or thin + 1 symbols wide; the sum of squares over widths, as a whole number
    thin = size // slices
    key = np.zeros(len(first), dtype=np.int64)
    for lo, hi in zip(edges, edges[1:]):
        seen = total(running((values >= lo) & (values < hi)))
        if last is not None:
            seen += (z >= lo) & (z < hi)
        key += seen * seen * (thin + 1 if hi - lo == thin else thin)

    def chi_log(keys: np.ndarray) -> np.ndarray:
        chi = keys * (size / (n * thin * (thin + 1))) - n
        w = 2 / (9 * (slices - 1))
        p = _tails((np.cbrt(np.maximum(chi, 0.0) / (slices - 1)) - (1 - w)) / math.sqrt(w))
        return np.log(np.maximum(np.where(chi <= 1e-9, 1.0, p), 1e-300))

    def runs_log(keys: np.ndarray) -> np.ndarray:
        ones, runs = np.divmod(keys, n + 1)
        mean = 1 + 2 * ones * (n - ones) / n
        var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p = np.where((ones > 0) & (ones < n), 2 * _tails(np.abs(runs - mean) / np.sqrt(var)), 2.0 ** (1 - n))
        return np.log(np.maximum(p, 1e-300))

    spread = n * s2 - s1 * s1  # n times
    lag = n * n * product - n * s1 * (2 * s1 - head - tail) + (n - 1) * s1 * s1  # n * n times
    r = lag / (n * np.maximum(spread, 1))
    x = -(_each(key, n * n * (thin + 1), chi_log) + _each(n1 * (n + 1) + turns + 1, (n + 1) ** 2, runs_log))
    open_ = np.flatnonzero(x < enough)  # the third test can only lower the others' combined p-value
    p3 = np.where(spread[open_] > 0, 2 * _tails(np.abs(r[open_] + 1 / n) * math.sqrt(n)), 2.0 ** (1 - n))
    x[open_] -= np.log(np.maximum(p3, 1e-300))
    return np.exp(-x) * (1 + x + x * x / 2)


def batteries(rows: np.ndarray, size: int) -> np.ndarray:
    """:func:`battery` of every row of an array."""
    m, n = rows.shape
    return run_batteries(Sums(rows.reshape(-1), size), np.arange(m) * n, n, None)


def p_bin(p: float) -> int:
    return min(BINS - 1, int(-10 * math.log10(max(p, 1e-300))))


def p_bins(p: np.ndarray) -> np.ndarray:
    """:func:`p_bin` of an array."""
    return np.minimum(BINS - 1, (-10 * np.log10(np.maximum(p, 1e-300))).astype(np.int64))


def length_class(n: int) -> int:
    return int(2 * math.log2(n))


def least_length(size_class: int) -> int:
    """Smallest length of a class that the battery looks at."""
    n = MIN_TOKEN
    while length_class(n) < size_class:
        n = max(n + 1, math.floor(2 ** (size_class / 2)))
    return n


def _codes() -> dict[int, np.ndarray]:
    """Alphabet size -> number of every byte in that encoding (-1: none); one-case encodings take both cases."""
    out = {}
    for alphabet in ALPHABETS:
        code = np.full(256, -1, dtype=np.int8)
        for k, c in enumerate(alphabet):
            code[ord(c)] = k
            if len(alphabet) <= 32:
                code[ord(c.swapcase())] = k
        out[len(alphabet)] = code
    return out


CODES = _codes()


def tokens(text: str) -> Iterator[tuple[int, int, tuple[int, int], int]]:
    """(start, end, (length class, alphabet size), bin) of every token that the battery looks at."""
    for m in CANDIDATE.finditer(text):
        coded = numbers(m.group())
        if coded and len(coded[0]) >= MIN_TOKEN:
            yield m.start(), m.end(), (length_class(len(coded[0])), coded[1]), p_bin(battery(*coded))


def decoys(texts: list[str], classes: dict[int, list[int]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """((length class, alphabet size), bins) of the runs from every word of some texts on; no run leaves its text.
    Bins from ``LEVEL`` on are not told apart.
    ``classes``: alphabet size -> length classes."""
    words, counts = [], []
    for t in texts:
        some = WORD.findall(t)
        words += some
        counts.append(len(some))
    joined = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    if not len(joined):
        return
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    owner, bounds = np.repeat(np.arange(len(texts)), counts), np.append(0, np.cumsum(counts))
    head, final = bounds[owner], bounds[owner + 1] - 1  # first and last word of a word's text
    start = np.cumsum(lengths) - lengths
    for size, wanted in classes.items():
        code = CODES[size][joined]
        has = code >= 0
        values = code[has]
        before = np.append(0, np.cumsum(has))
        at, end = before[start], before[start + lengths]
        # one start for the words that begin at the same value: those before it have none in the encoding
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])))
        tail = end[final]
        begin, inside, tail = at[new], (at - at[head])[new], tail[new]
        digits = size > 10 and CODES[size][50] >= 0
        sums = Sums(values, size)
        for c in wanted:
            n = least_length(c)
            fits = begin + n <= tail
            if fits.any():
                # 2 to 7: digits of every encoding that has some
                last = CODES[size][50 + inside[fits] % 6] if digits else None
                yield (c, size), p_bins(run_batteries(sums, begin[fits], n, last, ENOUGH))


def histograms(docs: DataFrame, look) -> dict[tuple[int, int], np.ndarray]:
    """(length class, alphabet size) -> counts per bin, over all documents, of what ``look`` finds in a list of texts."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            for texts in chunks(pdf["text"]):
                for kind, bins in look(texts):
                    seen[kind] = seen.get(kind, 0) + np.bincount(bins, minlength=BINS)
        if seen:
            yield pd.DataFrame([(*kind, b, n[b]) for kind, n in seen.items() for b in np.flatnonzero(n)],
                               columns=["length", "size", "bin", "n"])

    rows = (docs.select("text").mapInPandas(count, "length int, size int, bin int, n long")
            .groupBy("length", "size", "bin").agg(F.sum("n").alias("n")).collect())
    out: dict = {}
    for r in rows:
        out.setdefault((r["length"], r["size"]), np.zeros(BINS))[r["bin"]] += r["n"]
    return out


def thresholds(docs: DataFrame, fdr: float = FDR) -> dict[tuple[int, int], int]:
    """(length class, alphabet size) -> largest accepted bin, from histograms over all documents (a few thousand rows)."""
    seen = histograms(docs, lambda texts: ((kind, [b]) for text in texts for _, _, kind, b in tokens(text)))
    if not seen:
        return {}
    def written_in(kinds: set) -> dict[tuple[int, int], np.ndarray]:
        classes = {size: sorted(c for c, s in kinds if s == size) for size in {s for _, s in kinds}}
        return histograms(docs, lambda texts: decoys(texts, classes))

    shortest = length_class(MIN_TOKEN)
    written = written_in(set(seen))
    few = [k for k in seen if written.get(k, np.zeros(1)).sum() < 1 / fdr]
    shorter = {(c, size) for top, size in few for c in range(shortest, top)} - set(seen)
    if shorter:
        written |= written_in(shorter)
    out = {}
    for (c, size), hist in seen.items():
        null, k = written.get((c, size), np.zeros(BINS)), c
        while null.sum() < 1 / fdr and k > shortest:
            k -= 1
            null = null + written.get((k, size), 0)
        found, passed = np.cumsum(hist), np.cumsum(null)
        rate = (passed + 1) / (passed[-1] + 1) * found[-1] / np.maximum(found, 1)
        good = np.flatnonzero((rate <= fdr)[:LEVEL] & (found > 0)[:LEVEL])
        if len(good):
            out[c, size] = int(good[-1])
    return out


def all_spans(text: str, accept: dict[tuple[int, int], int]) -> tuple[list, list]:
    """(pattern spans, pattern and random spans), each (start, kind number, end) in order."""
    base = base_spans(text)
    extra = [(s, 3, e) for s, e, kind, b in tokens(text) if b <= accept.get(kind, -1)
             and not any(s < be and bs < e for bs, _, be in base)]
    return base, sorted(base + extra)


def as_text(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random per row.

    Null and empty texts have no spans (base_sha256 of the empty string); repeated rows and null
    doc_ids keep a row each; an empty table gives no rows.
    """
    accept = thresholds(docs, fdr)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                base, spans = all_spans(text, accept) if isinstance(text, str) else ([], [])
                n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
                out.append((*n, hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans)))
            frame = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])
            frame["doc_id"] = pdf["doc_id"].astype("Int64")
            yield frame

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact(text: str, spans: list) -> str:
    """The text with every span replaced by MARK; overlapping spans make one mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], MARK]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """The rows and columns of ``docs`` with the secrets of ``text`` replaced and n_chars (where it
    is a column) set to the new length.  No row is dropped; null texts stay null."""
    accept = thresholds(docs, fdr)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, all_spans(t, accept)[1]) if isinstance(t, str) else t)

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(n, F.col("n_chars")))
    return out


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op7_secret_scan": op7_secret_scan}
