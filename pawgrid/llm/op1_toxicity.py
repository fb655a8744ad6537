"""Operator 1: toxicity by noisy-channel deobfuscation.

1. A character trigram model over the letters of all documents (counted per task with numpy, added
   up in a tree).
2. Every distinct token is restored.  A token of plain letters stands for itself.  One with a double
   letter, and any other token, is a lattice too: leet characters may be letters, runs may be one or two
   letters, marks may vanish or part words.  A token with leet marks at its edges (``a$$``) is read without
   and with them as letters, a token without a letter (``455``) as letters if each of its characters may be
   one (``2024`` is a number).  Letters typed one by one (``i d i o t``, any white space between) are one lattice
   over the whole run.  Viterbi finds the reading of highest channel plus trigram log-probability.  Fragments
   (``st upid``) are also read as one word where the trigrams across a gap say clearly more for a join than
   for two words (by ``JOIN_MARGIN``).
3. A logistic model over whole restored words and their first 3 to 8 letters scores the document.
   It is fitted on a bounded sample of the labelled training rows (``SAMPLE`` rows with the smallest
   hash of doc_id): features are the ``FEATURES`` most telling of the sample (beyond ``MIN_Z`` standard
   deviations), their values the log of one plus the number of distinct tokens that have them.

Tokens are restored once while a worker's cache holds them (``CACHE_BYTES``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import collect_blocks, held_out, read, split_count, stage, task_index
from pawgrid.llm.kernels import chunks

FOLDS = 3
THRESHOLD = 0.7
SAMPLE = 6000
FEATURES = 2048
MIN_DOCS = 3  # toxic sample rows that a feature needs
MIN_Z = 5.0  # standard deviations by which its share among them has to exceed its share among the others
PREFIXES = range(3, 9)
CACHE_BYTES = 32 << 20  # of a worker
JOIN_MARGIN = 2.0  # log-likelihood by which a join has to beat two words
HEAD = 6  # letters of a word's beginning that decide whether it is looked at
LONGEST = 32  # letters of a word that training joins from fragments; scoring joins up to its longest known word
SYMBOLS = 62  # 0 word edge, 1-26 a-z, 27-59 Latin-1 letters, 61 any other letter
#: what a character may stand for
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "#": "h", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
#: channel log-probabilities
SAME, DOUBLED, LONG_RUN, LEET_COST, VANISH, PART, LEET_LOST, DIGIT_LOST = 0.0, -2.0, -1.0, -1.5, -1.5, -2.0, -3.0, -6.0
_LEET_CLASS = re.escape("".join(c for c in LEET if not c.isalnum()))
EDGE_MARKS = re.compile(r"^[\W_]+|[\W_]+$")
_LEET_MARKS = re.escape("".join(c for c in LEET if not c.isalnum()))
EDGE_OTHER = re.compile(rf"^(?:(?![{_LEET_MARKS}])[\W_])+|(?:(?![{_LEET_MARKS}])[\W_])+$")  # leet marks stay
DOUBLE = re.compile(r"(.)\1")
PLAIN_MARKS = ".,;:?\"'()"  # marks that stand for no letter
SPELLED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")


def _symbol_table() -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[97:123] = np.arange(1, 27)
    table[0xDF:0x100] = np.arange(27, 60)
    table[0xF7] = 0
    return table


def symbol(ch: str) -> int:
    cp = ord(ch)
    if cp < 256:
        return int(_TABLE[cp])
    return 61 if ch.isalpha() else 0


_TABLE = _symbol_table()
_READ_AS = _TABLE.copy()  # leet characters as the first letter they may stand for
for _ch, _letters in LEET.items():
    if ord(_ch) < 256:
        _READ_AS[ord(_ch)] = _TABLE[ord(_letters[0])]


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of (two before, one before, symbol); the context of a word's first letter is (0, 0)."""
    cp = np.frombuffer((" " + " ".join(texts).lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = np.where(cp < 256, _TABLE[np.minimum(cp, 255)], np.where(cp < 0x2000, 61, 0))
    one, now = s[:-1], s[1:]
    two = np.concatenate(([0], s[:-2]))
    two = np.where(one == 0, 0, two)
    keep = (now > 0) | (one > 0)
    code = (two * SYMBOLS + one) * SYMBOLS + now
    return np.bincount(code[keep], minlength=SYMBOLS ** 3)


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | two before), SYMBOLS^3, over all documents; interpolated with the shorter contexts."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS ** 3, dtype=np.int64)
        for pdf in batches:
            for part in chunks(pdf["text"]):
                total += trigram_counts(part)
        total = total.reshape(SYMBOLS, -1)
        yield pd.DataFrame({"block": range(SYMBOLS), "part": task_index(), "data": [r.tobytes() for r in total]})

    texts = docs.select("text")
    c3 = collect_blocks(texts.mapInPandas(count, "block int, part long, data binary"), split_count(texts),
                        "int64", SYMBOLS, SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    c1 = c3.sum(axis=(0, 1)) + 0.5
    p1 = c1 / c1.sum()
    c2 = c3.sum(axis=0)
    p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
    return np.log((c3 + 5 * p2) / (c3.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def lattice(text: str, letters_only: bool = False) -> list[list[tuple[str, float]]]:
    """Per run of equal characters the readings (letters, channel log-probability); a space reads as a word edge.

    ``letters_only``: leet characters have to be letters, one or two as typed, one or two for a longer run."""
    out, i = [], 0
    while i < len(text):
        ch, j = text[i], i
        while j < len(text) and text[j] == ch:
            j += 1
        n, i = j - i, j
        if ch.isalpha():
            out.append([(ch, SAME)] if n == 1 else [(ch * 2, SAME), (ch, DOUBLED)] if n == 2
                       else [(ch, LONG_RUN), (ch * 2, LONG_RUN - 0.5)])
        elif ch in LEET:
            reads = [(letter * k, LEET_COST - (k == 2) * 0.5) for letter in LEET[ch] for k in ((1,) if n == 1 else (1, 2))]
            if letters_only:
                out.append([(letter * k, LEET_COST) for letter in LEET[ch] for k in ((n,) if n < 3 else (1, 2))])
            elif ch.isdigit():
                out.append([*reads, (" ", DIGIT_LOST)])
            else:
                out.append([*reads, ("", LEET_LOST), (" ", PART)])
        elif ch.isdigit():
            out.append([(" ", SAME)])
        else:
            out.append([("", VANISH), (" ", PART)])
    return out


def viterbi(stages: list[list[tuple[str, float]]], lm) -> str:
    """The reading of highest channel plus trigram log-probability; states are the last two symbols.  ``lm`` is
    the model as an array or, quicker here, as nested lists."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in stages:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (x, y), (value, path) in states.items():
            for read_as, cost in options:
                a, b, v = x, y, value + cost
                for ch in read_as:
                    s = symbol(ch)
                    if s or b:
                        v += float(lm[a][b][s])
                    a, b = (b, s) if s else (0, 0)
                if (a, b) not in new or v > new[a, b][0]:
                    new[a, b] = (v, (path, read_as))
        states = new
    best = max(states.items(), key=lambda kv: (kv[1][0] + (float(lm[kv[0][0]][kv[0][1]][0]) if kv[0][1] else 0.0), kv[0]))
    out, path = [], best[1][1]
    while path:
        out.append(path[1])
        path = path[0]
    return "".join(reversed(out))


def plain(token: str) -> bool:
    """Letters that nothing disguises."""
    return token.isalpha() and not DOUBLE.search(token)


def restore(token: str, lm: np.ndarray) -> list[str]:
    """The words that a lower-case token (no white space) may stand for, as typed first."""
    core, whole = (token, token) if token.isalpha() else (EDGE_MARKS.sub("", token), EDGE_OTHER.sub("", token))
    out = []
    if core.isalpha():
        out = [core]
    if any(c.isalpha() for c in core):
        if not plain(core):
            out += [w for w in viterbi(lattice(core), lm).split() if w not in out]
        readable = whole != core
    else:
        readable = all(c in LEET for c in whole)
    if readable:
        out += [w for w in viterbi(lattice(whole, True), lm).split() if w not in out]
    return out


def spelled_out(text: str, lm: np.ndarray) -> list[str]:
    """Words typed letter by letter; every gap may join or part."""
    out = []
    for m in SPELLED.finditer(text):
        stages: list = []
        for i, ch in enumerate(m.group().lower().split()):
            if i:
                stages.append([("", SAME), (" ", PART)])
            stages += lattice(ch)
        out += viterbi(stages, lm).split()
    return out


def open_gaps(tokens: list[str], lm: np.ndarray) -> np.ndarray:
    """Numbers of the tokens whose gap to the next is clearly more likely inside a word than between two."""
    cp = np.frombuffer((" " + " ".join(tokens) + "  ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = np.where(cp < 256, _READ_AS[np.minimum(cp, 255)], np.where(cp < 0x2000, 61, 0))
    gap = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)[:-1]
    x, y, a, b = s[gap - 2], s[gap - 1], s[gap + 1], s[gap + 2]
    joined = lm[x, y, a] + lm[y, a, b]
    parted = lm[x, y, 0] + lm[0, 0, a] + lm[0, a, b]
    return np.flatnonzero((y > 0) & (a > 0) & (joined > parted + JOIN_MARGIN))


def fragments(text: str, lm: np.ndarray) -> list[tuple[str, ...]]:
    """Distinct runs of tokens with open gaps between them."""
    tokens = text.lower().split()
    if len(tokens) < 2:
        return []
    gaps = open_gaps(tokens, lm)
    if not len(gaps):
        return []
    cut = np.flatnonzero(np.diff(gaps) > 1) + 1
    first, last = gaps[np.append(0, cut)], gaps[np.append(cut - 1, len(gaps) - 1)]
    return list({tuple(tokens[i:j + 2]) for i, j in zip(first.tolist(), last.tolist())})


def first_letters(token: str) -> set[str]:
    """The ``HEAD`` letters that any reading of a token of letters begins with (a run may be read as a shorter one)."""
    begin, short, i = {""}, HEAD, 0
    while i < len(token) and short > 0:
        j = i + 1
        while j < len(token) and token[j] == token[i]:
            j += 1
        if j == i + 1:
            begin = {w + token[i] for w in begin}
        else:
            begin = {w + token[i] * k for w in begin for k in range(1, min(j - i, HEAD) + 1)}
        i, short = j, short - 1  # letters that the shortest beginning lacks
    return {w[:HEAD] for w in begin}


def begins(word: str, starts: set[str]) -> bool:
    """Does the word begin with one of ``starts`` (up to ``HEAD`` letters each)?"""
    for k in range(HEAD, 0, -1):
        if word[:k] in starts:
            return True
    return False


def may_start(parts: list[str], i: int, starts: set[str]) -> bool:
    """Can a word joined from part i on begin with one of ``starts``?"""
    begin = {parts[i]}
    for q in parts[i + 1:]:
        if all(len(w) >= HEAD for w in begin):
            break
        begin = {w + r for w in begin for r in ((q, q[1:]) if w[-1] == q[0] and len(q) > 1 else (q,))}
    return any(begins(w, starts) for w in begin)


def joined_words(parts: list[str], longest: int = LONGEST, starts: set[str] | None = None) -> set[str]:
    """The words that neighbouring parts make together; a letter typed on both sides of a gap counts once or twice.

    With ``starts`` only words that begin with one of them (up to ``HEAD`` letters) are wanted."""
    out = set()
    for i in range(len(parts) - 1):
        if starts is not None and not may_start(parts, i, starts):
            continue
        words = {parts[i]}
        for p in parts[i + 1:]:
            words = {w + q for w in words for q in ((p, p[1:]) if w[-1] == p[0] and len(p) > 1 else (p,))
                     if len(w) + len(q) <= longest}
            if not words:
                break
            out.update(words)
    return out


def word_features(word: str) -> list[str]:
    return ["=" + word, *[word[:k] for k in PREFIXES if k <= len(word)]]


class Features:
    """The features of words by number; calling it gives the numbers of the known features that words have."""

    def __init__(self, number: dict[str, int]) -> None:
        self.whole = {f[1:]: n for f, n in number.items() if f[0] == "="}
        self.prefix = {f: n for f, n in number.items() if f[0] != "="}
        self.alive = {f[:k] for f in self.prefix for k in PREFIXES}  # a longer prefix can follow only these

    def __call__(self, words: list[str]) -> tuple[int, ...]:
        out = []
        for w in words:
            if w in self.whole:
                out.append(self.whole[w])
            for k in PREFIXES:
                p = w[:k]
                if len(p) < k or p not in self.alive:
                    break
                if p in self.prefix:
                    out.append(self.prefix[p])
        return tuple(out)


class Reader:
    """Distinct tokens of a text as restored words, through ``value`` (words -> what to keep).

    ``starts`` (with one of which, up to ``HEAD`` letters, every word that has a value begins) and ``longest`` (letters of the longest)
    bound the joins that are tried."""

    def __init__(self, lm: np.ndarray, value, longest: int = LONGEST, starts: set[str] | None = None) -> None:
        self.lm, self.value, self.longest, self.starts = lm, value, longest, starts
        self.table = lm.tolist()  # of fixed size
        self.known, self.words, self.size = {}, {}, 0
        if starts is not None:
            self.threes, self.partial = {s[:3] for s in starts}, {s[:k] for s in starts for k in range(HEAD)}

    def may_begin(self, word: str, open_end: bool = False) -> bool:
        """Can a reading of a word of letters (``open_end``: and of more letters after it) begin with one of ``starts``?"""
        if self.starts is None:
            return True
        head = word[:HEAD]
        for w in first_letters(word) if DOUBLE.search(head) else (head,):
            if w[:3] in self.threes and begins(w, self.starts) or open_end and len(w) < HEAD and w in self.partial:
                return True
        return False

    def may_join(self, run: tuple[str, ...]) -> bool:
        """Can a word joined from neighbouring tokens of the run begin with one of ``starts``?"""
        cores = [t.strip(PLAIN_MARKS) for t in run]
        if self.starts is None or not "".join(cores).isalpha():
            return True
        return any(self.may_begin("".join(cores[i:])) for i in range(len(cores) - 1))

    def restored(self, token: str) -> list[str]:
        """The words of a lower-case token."""
        core = token.strip(PLAIN_MARKS)
        if plain(core):
            return [core]
        if token not in self.words:
            self.words[token] = out = restore(token, self.table)
            self.size += 250 + 2 * len(token) + sum(60 + len(w) for w in out)
        return self.words[token]

    def worth(self, token: str):
        """The value of a lower-case token; one whose readings can begin with none of ``starts`` has none."""
        core = token.strip(PLAIN_MARKS)
        if core.isalpha():
            if not self.may_begin(core):
                return ()
            return self.value(self.restored(token) if DOUBLE.search(core) else [core])
        core, whole = EDGE_MARKS.sub("", token), EDGE_OTHER.sub("", token)
        # letters, or letters with leet marks behind: every reading is one word that begins as the letters do
        if core.isalpha() and whole.startswith(core) and not self.may_begin(core, whole != core):
            return ()
        return self.value(self.restored(token))

    def read(self, text: str) -> list:
        if self.size > CACHE_BYTES:
            self.known, self.words, self.size = {}, {}, 0
        known, distinct = self.known, set(text.split())
        for t in distinct.difference(known):
            known[t] = v = self.worth(t.lower())
            self.size += 160 + 2 * len(t) + 40 * len(v)
        out = [v for v in map(known.__getitem__, distinct) if v]
        joined: set[str] = set()
        if list(map(len, distinct)).count(1) > 1:
            joined.update(spelled_out(text, self.table))
        for run in filter(self.may_join, fragments(text, self.lm)):
            parts = [self.restored(t) for t in run]
            for k in range(max(map(len, parts))):  # a disguised fragment has two readings
                joined |= joined_words([p[min(k, len(p) - 1)] for p in parts if p], self.longest, self.starts)
        return out + [v for w in joined if (v := self.value([w]))]


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1, l2: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch gradient steps with moment estimates; one class alone gives the base rate."""
    base = (y.sum() + 0.5) / (len(y) + 1)
    w, b = np.zeros(x.shape[1]), float(np.log(base / (1 - base)))
    if not 0 < y.sum() < len(y):
        return w, b
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for i in range(1, steps + 1):
        gap = (1 / (1 + np.exp(-(x @ w.astype(x.dtype) + b))) - y) * np.where(y > 0, 3.0, 1.0)
        g = np.append(gap.astype(x.dtype) @ x / len(y) + l2 * w, gap.mean())  # in x's precision: no copy of x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.99 ** i)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, lm, folds: int, sample: int,
          n_features: int) -> tuple[dict[str, int], np.ndarray, float]:
    """(feature numbers, weights, offset) from the labelled documents outside the held-out fold."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(F.col("toxic").isNotNull() & F.col("l_id").isNotNull() & ~held_out(F.col("l_id"), folds))
             .groupBy("l_id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("l_id"), "l_id").limit(sample))
    marks = stage(spark, marks, "toxic-labels")  # at most ``sample`` rows of two numbers

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(lm.value, lambda ws: ws)
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "words": [
                [w for ws in reader.read(t if isinstance(t, str) else "") for w in ws] for t in pdf["text"]]})

    # one row per doc_id, so that its rows are at most ``sample`` too
    texts = (docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("l_id"))
             .groupBy("l_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("least")))
    rows = stage(spark, texts.select("toxic", F.col("least.text").alias("text")).mapInPandas(words, "toxic int, words array<string>"), "toxic-sample")

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in batches:
            for toxic, ws in zip(pdf["toxic"], pdf["words"]):
                seen[int(toxic > 0)].update({f for w in set(ws) for f in word_features(w)})
        keys = list(seen[0].keys() | seen[1].keys())
        if keys:
            yield pd.DataFrame({"feature": keys, "n0": [seen[0][k] for k in keys], "n1": [seen[1][k] for k in keys]})

    sizes = {int(r["toxic"] > 0): r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = sizes.get(1, 0), sizes.get(0, 0)
    chosen: list[str] = []
    if a and b:
        spread = (a * b / (a + b)) ** 0.5
        share = (F.col("n0") + F.col("n1")) / float(a + b)
        lift = F.col("n1") / float(a) - F.col("n0") / float(b)
        telling = lift / F.sqrt(share * (1 - share) + 1e-9)
        chosen = [r["feature"] for r in rows.mapInPandas(tally, "feature string, n0 long, n1 long").groupBy("feature")
                  .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter((F.col("n1") >= MIN_DOCS) & (telling * spread >= MIN_Z)).orderBy(F.desc(telling), "feature").limit(n_features).collect()]
    number = {f: i for i, f in enumerate(chosen)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = [Counter(number[f] for w in ws for f in word_features(w) if f in number) for ws in pdf["words"]]
            yield pd.DataFrame({"toxic": pdf["toxic"], "f": [list(c) for c in counts], "n": [list(c.values()) for c in counts]})

    held = rows.mapInPandas(encode, "toxic int, f array<int>, n array<int>").collect()  # at most ``sample`` rows
    x, y = np.zeros((len(held), len(chosen)), dtype=np.float32), np.zeros(len(held))
    for i, r in enumerate(held):
        x[i, r["f"]], y[i] = np.log1p(r["n"]), r["toxic"] > 0
    return number, *fit(x, y)


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE,
                    n_features: int = FEATURES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with all their columns in ``doc`` (a struct), score and predicted.

    Only text is an input of the score; null and empty texts get the score of a text without words.
    Labels of a doc_id that occur twice count by their largest; null labels and null doc_ids do not
    train.  Of the rows of one doc_id the one with the smallest hash of its text trains.
    Repeated rows keep a row each.  Without labels every score is 0.5 or the base rate.
    """
    lm = spark.sparkContext.broadcast(language_model(docs))
    number, w, b = train(spark, docs, labels, lm, folds, sample, n_features)
    starts = {f.lstrip("=")[:HEAD] for f in number}
    longest = max(map(len, number), default=0) + 1  # a longer word has the features of its first letters
    model = spark.sparkContext.broadcast((number, w, b))

    def make_scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number, w, b = model.value
        reader = Reader(lm.value, Features(number), longest, starts)
        for texts in batches:
            out = []
            for t in texts:
                hits = Counter(f for fs in reader.read(t if isinstance(t, str) else "") for f in fs)
                z = b + sum(w[f] * np.log1p(n) for f, n in hits.items())
                out.append(1 / (1 + np.exp(-min(max(z, -40.0), 40.0))))
            yield pd.Series(out, dtype="float64")

    score = F.pandas_udf(make_scorer, "double")
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score_documents(spark, docs, read(spark, sf_dir, "labels"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), held_out(F.col("doc.doc_id"), FOLDS).alias("held_out"),
                      "score", "predicted")


ORACLE: dict[str, str] = {}
QUERIES = {"op1_toxicity": op1_toxicity}
