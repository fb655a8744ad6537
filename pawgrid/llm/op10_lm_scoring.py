"""Operator 10: hashed maximum-entropy language model with class-factored softmax.

P(word | context) = P(class | context) * P(member | class, context) * P(word | member).

* Classes: the end, the most frequent words (one class each), and 17 classes of the other words by
  their first two bytes (known for any word, seen in training or not).
* P(class | context) is a softmax over the sum of weight rows of hashed features: the word before,
  the two words before, and two skips (the word two and three back); the offset is the classes' log
  frequency.
* P(member | class, context) is a second softmax of the same kind inside each class of other words.  Its
  members are the class's most frequent words (one member each) and ``GROUPS`` groups of its rarer words by hash; the
  features are the word before and the word two back, hashed together with the class; the offset is the members' log frequency.
* P(word | member) is 1 for a word that is a member; in a group it is (c + 0.5) / (sum over the group of (c + 0.5) + 0.5);
  the last 0.5 is an unseen word.  So the probabilities of all words and the unseen ones add up to one in every context.
* Training makes one pass over all training documents in ``ROUNDS`` parts, both softmaxes at once.  In a
  part each task runs mini-batch gradient steps from the common weights; the changes are averaged
  row by row, weighted by how often a task updated the row, in a tree of bounded fan-in.

Counts are over all training tokens: each task counts its own words, Spark adds the counts up.  Word
identities are 64-bit hashes.  The ``TABLE_WORDS`` most frequent counts are broadcast (a fixed size);
the other words of a document are joined to the staged counts, pre-aggregated per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import collect_blocks, held_out, read, split_count, stage, task_index, worker_state
from pawgrid.llm.kernels import Hasher, chunks, mix

FOLDS = 5
TABLE_WORDS = 1 << 18
OWN_CLASS = 14  # frequent words with a class of their own
SPELLING = 17  # classes of the other words
CLASSES = 1 + OWN_CLASS + SPELLING
GROUPS = 8  # members of a spelling class that hold its rarer words; a power of two
MEMBERS = CLASSES  # as wide as the classes, so that both softmaxes have rows of one table
OWN_MEMBER = MEMBERS - GROUPS  # words of a spelling class that are members themselves
ROWS_LOG2 = 14  # rows of either softmax
BLOCK_ROWS = 256
ROUNDS = 3
BATCH = 8192
RATE = 0.3
ONES = np.ones(MEMBERS, dtype=np.float32)
END, START = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def hasher() -> Hasher:
    return worker_state("word_hasher", Hasher)


def token_stream(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, text number, spelling class) of all words with one end after each text."""
    h, doc, first, a, start = hasher().words(texts)
    at = np.arange(len(h)) + doc
    n = len(h) + len(texts)
    tok, owner, spell = np.full(n, END), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    tok[at], owner[at] = h, doc
    owner[first[1:] + np.arange(len(texts))] = np.arange(len(texts))
    spell[at] = 1 + OWN_CLASS + (a[start].astype(np.int64) * 257 + a[start + 1]) * 40503 % 65536 % SPELLING
    return tok, owner, spell


def words_before(tok: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """The word before each token, two and three back; before a text's first word there is a start."""
    place = np.arange(len(tok)) - np.searchsorted(owner, owner)
    back = []
    for k in (1, 2, 3):
        p = np.full(len(tok), START)
        p[k:] = tok[:-k]
        p[place < k] = START
        back.append(p)
    return back


def hashed_rows(keys: list[np.ndarray]) -> np.ndarray:
    return np.stack([(mix(k) >> np.uint64(64 - ROWS_LOG2)).astype(np.uint16) for k in keys])


def features(back: list[np.ndarray]) -> np.ndarray:
    """Row numbers of the four context features of the class, 4 x tokens."""
    p1, p2, p3 = back
    return hashed_rows([p1 * _SALT[0], p1 * _SALT[1] + mix(p2 * _SALT[2]), p2 * _SALT[3], p3 * _SALT[4]])


def member_features(back: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Row numbers of the two context features inside class ``y``, 2 x tokens; they follow the rows of the classes."""
    inside = mix(y.astype(np.uint64) * _SALT[5])
    return hashed_rows([back[0] * _SALT[2] + inside, back[1] * _SALT[1] + inside]) + np.uint16(1 << ROWS_LOG2)


class Words:
    """Class and member of every word: ``top`` are the frequent words as (hash, spelling class), most frequent first."""

    def __init__(self, top: Iterator[tuple[int, int]]) -> None:
        place, full = {}, {}
        for h, spell in top:
            if h == int(END):
                continue
            if len(place) < OWN_CLASS:
                place[h] = (1 + len(place), 0)
            elif full.get(spell, 0) < OWN_MEMBER:
                place[h] = (spell, full.get(spell, 0))
                full[spell] = full.get(spell, 0) + 1
        self.own = np.array(sorted(place), dtype=np.uint64)
        self.cls, self.member = (np.array([place[h][i] for h in sorted(place)], dtype=np.int64) for i in (0, 1))
        self.place = place

    def find(self, tok: np.ndarray, spell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, member) per token; the end and words with a class of their own have member 0."""
        y, m = spell.copy(), OWN_MEMBER + (tok % np.uint64(GROUPS)).astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, tok), len(self.own) - 1)
            hit = self.own[at] == tok
            y[hit], m[hit] = self.cls[at[hit]], self.member[at[hit]]
        end = tok == END
        y[end] = m[end] = 0
        return y, m


def masses(words: Words, count_of: dict[int, int], sums: dict[tuple[int, int], tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(mass per class, mass per class and member) from the members' counts and (spelling class, group): (tokens, words)."""
    inner = np.zeros((CLASSES, MEMBERS))
    for k in range(1 + OWN_CLASS, CLASSES):
        for g in range(GROUPS):
            n, v = sums.get((k, g), (0, 0))
            inner[k, OWN_MEMBER + g] = n + 0.5 * v + 0.5
    outer = np.full(CLASSES, 0.5)  # classes without a word
    outer[0] = count_of.get(int(END), 0) + 1.0
    for h, (y, m) in words.place.items():
        if y <= OWN_CLASS:
            outer[y] = count_of[h] + 0.5
        else:
            inner[y, m] = count_of[h] + 0.5
    outer[1 + OWN_CLASS:] = inner[1 + OWN_CLASS:].sum(axis=1)
    return outer, inner


def offsets(outer: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log frequencies of the classes, and of the members inside each (none: minus infinity)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log(outer / outer.sum()).astype(np.float32), np.log(inner / inner.sum(axis=1, keepdims=True)).astype(np.float32)


def activations(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Sums of the features' weights and the offset; the largest of each token is 0."""
    z = weights.take(f[0], axis=0)
    for rows in f[1:]:
        z += weights.take(rows, axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def log_softmax(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = activations(weights, bias, f)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def outcome_log_p(weights: np.ndarray, bias: np.ndarray, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``log_softmax`` of the outcomes alone."""
    z = activations(weights, bias, f)
    own = z[np.arange(len(y)), y]
    return own - np.log(np.exp(z, out=z) @ ONES)


def group_sums(g: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of rows (first row and number of each run); most runs are short and are added a row at a time."""
    out = g.take(first, axis=0)
    short = np.flatnonzero((n > 1) & (n <= 8))
    k = 1
    while len(short):
        out[short] += g.take(first[short] + k, axis=0)
        k += 1
        short = short[n[short] > k]
    for i in np.flatnonzero(n > 8):
        out[i] = g[first[i]:first[i] + n[i]].sum(axis=0)
    return out


def batches_of(tok: np.ndarray, owner: np.ndarray, y: np.ndarray, m: np.ndarray, bias: np.ndarray, inner: np.ndarray) -> Iterator[tuple]:
    """(tokens, rows, offsets, outcome) of runs of ``BATCH`` tokens: of all for their classes, then of the words of
    spelling classes for their members."""
    back = words_before(tok, owner)
    f = features(back)
    for i in range(0, len(y), BATCH):
        s = slice(i, i + BATCH)
        yield s, f[:, s], bias, y[s]
    plain = np.flatnonzero(y > OWN_CLASS)
    f = member_features([p[plain] for p in back[:2]], y[plain])
    for i in range(0, len(plain), BATCH):
        s = plain[i:i + BATCH]
        yield s, f[:, i:i + BATCH], inner[y[s]], m[s]


class Trainer:
    """Mini-batch gradient steps with per-row step sizes, from common weights."""

    def __init__(self, weights: np.ndarray) -> None:
        self.w = weights.copy()
        self.squares = np.full(len(weights), 1.0, dtype=np.float32)
        self.updates = np.zeros(len(weights), dtype=np.float32)

    def step(self, f: np.ndarray, bias: np.ndarray, y: np.ndarray) -> None:
        g = activations(self.w, bias, f)
        np.exp(g, out=g)
        g /= (g @ ONES)[:, None]
        g[np.arange(len(y)), y] -= 1
        rows = f.reshape(-1)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        n = np.diff(np.append(first, len(order)))
        total = group_sums(g.take(order % len(y), axis=0), first, n)
        rows = rows[first]
        self.squares[rows] += (total * total).mean(axis=1)
        self.w[rows] -= RATE * total / np.sqrt(self.squares[rows])[:, None]
        self.updates[rows] += n


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, spell, c): every distinct word of the texts, and the end, with its count."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def merged() -> tuple:
            h, s, c = (np.concatenate(x) for x in zip(*held))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, s[first], np.bincount(inverse, weights=c).astype(np.int64)

        for pdf in batches:
            for part in chunks(pdf["text"]):
                tok, _, spell = token_stream(part)
                u, first, c = np.unique(tok, return_index=True, return_counts=True)
                held.append((u, spell[first], c))
                if len(held) >= 32:
                    held = [merged()]
        if held:
            h, s, c = merged()
            for i in range(0, len(h), 100_000):
                yield pd.DataFrame({"h": h[i:i + 100_000].view(np.int64), "spell": s[i:i + 100_000], "c": c[i:i + 100_000]})

    return (docs.select("text").mapInPandas(count, "h long, spell int, c long")
            .groupBy("h").agg(F.first("spell").alias("spell"), F.sum("c").alias("c")))


def train_weights(spark: SparkSession, docs: DataFrame, bias: np.ndarray, inner: np.ndarray, words: Words, rounds: int) -> np.ndarray:
    """Weights (2^ROWS_LOG2 rows of the classes, as many of the members) after one pass over ``docs`` (doc_id,
    text) in ``rounds`` parts."""
    rows = 2 << ROWS_LOG2
    weights = np.zeros((rows, CLASSES), dtype=np.float32)
    part_of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for r in range(rounds):
        common = spark.sparkContext.broadcast(weights)

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = Trainer(common.value)
            for pdf in batches:
                for part in chunks(pdf["text"]):
                    tok, owner, spell = token_stream(part)
                    for _, f, offset, y in batches_of(tok, owner, *words.find(tok, spell), bias, inner):
                        model.step(f, offset, y)
            n = model.updates[:, None]
            data = np.concatenate([(model.w - common.value) * n, n], axis=1).astype("<f4")
            blocks = range(0, rows, BLOCK_ROWS)
            yield pd.DataFrame({"block": [b // BLOCK_ROWS for b in blocks], "part": task_index(),
                                "data": [data[b:b + BLOCK_ROWS].tobytes() for b in blocks]})

        share = docs.filter(part_of == r).select("text")
        total = collect_blocks(share.mapInPandas(learn, "block int, part long, data binary"), split_count(share),
                               "<f4", rows // BLOCK_ROWS, BLOCK_ROWS * (CLASSES + 1)).reshape(rows, CLASSES + 1)
        weights = weights + total[:, :-1] / np.maximum(total[:, -1:], 1)
        common.unpersist()
    return weights


def lm_scores(spark: SparkSession, docs: DataFrame, folds: int = FOLDS, table_words: int = TABLE_WORDS,
              rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row.

    Null and empty texts consist of the end alone.  Rows with a null doc_id are in the training
    part.  Repeated rows keep a row each.  Without training rows every count is 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), folds))
    learn_from = rows.filter(~F.col("held_out")).drop("held_out")
    counts = stage(spark, word_counts(learn_from), "lm-counts")

    top = counts.orderBy(F.desc("c"), "h").limit(table_words).toArrow()  # at most table_words rows
    h = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    c = top["c"].to_numpy().astype(np.int64)
    words = Words(zip(h.tolist(), top["spell"].to_pylist()))
    count_of = dict(zip(h.tolist(), c.tolist()))
    members = F.col("h").isin(words.own.view(np.int64).tolist())  # a fixed number of words
    sums = {(r["spell"], r["g"], r["own"]): (r["n"], r["v"]) for r in counts.groupBy(
        "spell", F.pmod("h", F.lit(GROUPS)).cast("int").alias("g"), members.alias("own")).agg(
            F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # a few rows per class
    n_all, v_all = sum(n for n, _ in sums.values()), sum(v for _, v in sums.values())
    outer, mass = masses(words, count_of, {(k, g): x for (k, g, own), x in sums.items() if not own})
    bias, inner = offsets(outer, mass)
    weights = train_weights(spark, learn_from, bias, inner, words, rounds)

    by_hash = np.argsort(h)
    log_mass = np.log10(np.where(mass > 0, mass, 1.0))
    model = spark.sparkContext.broadcast((weights, bias, inner, words, h[by_hash], c[by_hash], log_mass))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias, inner, placed, known, known_c, log_mass = model.value
        row = task_index() << 40
        log_c = np.log10(known_c + 0.5)
        end_c = float(known_c[known == END].sum())
        for pdf in batches:
            out: list[tuple] = []
            for part in chunks(pdf["text"]):
                tok, owner, spell = token_stream(part)
                y, m = placed.find(tok, spell)
                log_p = np.zeros(len(y))
                for s, f, offset, of in batches_of(tok, owner, y, m, bias, inner):
                    log_p[s] += outcome_log_p(weights, offset, f, of)
                log_p /= np.log(10)
                at = np.minimum(np.searchsorted(known, tok), max(len(known) - 1, 0))
                hit = known[at] == tok if len(known) else np.zeros(len(tok), dtype=bool)
                is_end = tok == END
                base = np.where(hit, log_c[at] if len(known) else 0.0, 0.0)
                base[is_end] = np.log10(end_c + 0.5)
                grouped = (y > OWN_CLASS) & (m >= OWN_MEMBER)
                log_p += np.where(grouped, np.where(hit, base, 0.0) - log_mass[y, m], 0.0)
                seen = hit | (is_end & (end_c > 0))
                d = len(part)
                n = np.bincount(owner, minlength=d)
                sums = [np.bincount(owner, weights=x, minlength=d) for x in (seen, base, log_p)]
                rare = ~hit & ~is_end
                rare_tok, rare_doc = tok[rare], owner[rare]
                order = np.lexsort((rare_tok, rare_doc))
                rare_tok, rare_doc = rare_tok[order], rare_doc[order]
                new = np.flatnonzero(np.concatenate(([True], (rare_tok[1:] != rare_tok[:-1])
                                                     | (rare_doc[1:] != rare_doc[:-1])))) if len(rare_tok) else np.zeros(0, int)
                times = np.diff(np.append(new, len(rare_tok)))
                cut = np.searchsorted(rare_doc[new], np.arange(d + 1))
                words = rare_tok[new].view(np.int64)
                for i in range(d):
                    s = slice(cut[i], cut[i + 1])
                    out.append((int(n[i]), int(sums[0][i]), sums[1][i], sums[2][i], words[s], times[s]))
            frame = pd.DataFrame(out, columns=["n_tokens", "n_top", "base_top", "model_top", "rare_h", "rare_n"])
            frame["doc_id"], frame["held_out"] = pdf["doc_id"].astype("Int64"), pdf["held_out"]
            frame["row"] = row + np.arange(len(frame))
            row += len(frame)
            yield frame

    per_doc = stage(spark, rows.select("doc_id", "held_out", "text").mapInPandas(
        score, "row long, doc_id long, held_out boolean, n_tokens long, n_top long, base_top double, "
               "model_top double, rare_h array<long>, rare_n array<long>"), "lm-documents")
    rare = (per_doc.select("row", F.explode(F.arrays_zip("rare_h", "rare_n")).alias("r"))
            .select("row", F.col("r.rare_h").alias("h"), F.col("r.rare_n").alias("n")))
    found = rare.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    found = found.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_log"),
                                     F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    out = per_doc.drop("rare_h", "rare_n").join(found, "row", "left")
    extra = F.coalesce("rare_log", F.lit(0.0))
    below = float(np.log10(n_all + 0.5 * (v_all + 1)))
    return out.select("doc_id", "held_out", "n_tokens",
                      (F.col("n_top") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
                      F.lit(n_all).cast("long").alias("train_tokens"),
                      (F.col("base_top") + extra - F.col("n_tokens") * below).alias("base_score"),
                      (F.col("model_top") + extra).alias("score"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark, read(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op10_lm_scoring": op10_lm_scoring}
