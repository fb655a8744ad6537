"""Operator 9: language identification by mixture inference.

Training counts hashed byte trigrams of letter words per language over all training documents.  A
word's likelihood under a language is the product of its trigrams' smoothed probabilities.  A
document is a mixture: expectation-maximisation estimates its language proportions from the words'
likelihoods, until the likelihood stops rising.  The language set is chosen by penalised likelihood:
sets of the 1, 2, ... leading languages, up to all that were learned, are refitted as long as they can
still improve it, and each language costs half the log of the number of words.  The
prediction is the leading language of the chosen set, the score its proportion.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import collect_blocks, held_out, read, split_count, task_index
from pawgrid.llm.kernels import chunks

FOLDS = 3
BUCKETS = 1 << 15
SMOOTHING = 0.5
TOLERANCE = 1e-3  # of a document's log-likelihood; a language costs half the log of the number of words
LETTER = re.compile(r"[^\W\d_]")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket per byte position, first and last position per word, text number per word).

    Words are runs of letters (ASCII letters and all non-ASCII bytes) of the lower-cased text; a
    word's trigrams include the blank before and after it."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    a = np.frombuffer(b"  " + b" ".join(raw) + b"  ", dtype=np.uint8).copy()
    a[(a < 97) | ((a > 122) & (a < 128))] = 32
    solid = a != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    wide = a.astype(np.uint32)
    code = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)
    bounds = 2 + np.cumsum([len(r) + 1 for r in raw])
    return bucket, start - 1, end - 1, np.searchsorted(bounds, start, side="right")


def train(docs: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability table buckets x languages) from (text, lang) rows; null langs are left out."""
    docs = docs.filter(F.col("lang").isNotNull()).select("text", "lang")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    place = {name: k for k, name in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                total = seen.setdefault(place[lang], np.zeros(buckets, dtype=np.int64))
                for part in chunks(texts):
                    bucket, first, last, _ = trigrams(part)
                    inside = np.zeros(len(bucket) + 1, dtype=np.int32)
                    inside[first] += 1
                    inside[last] -= 1
                    total += np.bincount(bucket[np.cumsum(inside[:-1]) > 0], minlength=buckets)
        if seen:
            yield pd.DataFrame({"block": list(seen), "part": task_index(), "data": [v.tobytes() for v in seen.values()]})

    if not langs:
        return [], np.zeros((buckets, 0), dtype=np.float32)
    counts = collect_blocks(docs.mapInPandas(count, "block int, part long, data binary"), split_count(docs),
                            "int64", len(langs), buckets)
    p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * buckets)
    return langs, np.ascontiguousarray(np.log(p).T.astype(np.float32))


def _fit(like: np.ndarray, n: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) per document; ``like`` holds the words document by document, ``n`` of each.

    A document takes steps until one raises its log-likelihood by TOLERANCE or less."""
    pi, value = pi.copy(), np.full(len(n), -np.inf)
    live = np.arange(len(n))
    while len(live):
        first, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        share = pi[live][doc] * like
        total = np.maximum(share.sum(axis=1), 1e-300)
        fit = np.add.reduceat(np.log(total), first)
        rises = fit - value[live] > TOLERANCE
        value[live] = np.maximum(fit, value[live])
        step = np.add.reduceat(share / total[:, None], first, axis=0) / n[:, None]
        pi[live[rises]] = step[rises]
        if not rises.all():
            like, n, live = like[rises[doc]], n[rises], live[rises]
    return pi, value


def mixtures(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Proportions per text (zero outside the chosen set; all zero for a text without words)."""
    k = table.shape[1]
    out = np.zeros((len(texts), k))
    bucket, start, end, doc = trigrams(texts)
    if not len(start) or not k:
        return out
    run = np.zeros((len(bucket) + 1, k))
    np.cumsum(table[bucket], axis=0, out=run[1:])
    log_like = run[end] - run[start]
    del run
    top = log_like.max(axis=1, keepdims=True)
    like = np.exp(log_like - top)
    ids, first = np.unique(doc, return_index=True)
    n = np.diff(np.append(first, len(doc)))
    pi, most = _fit(like, n, np.full((len(ids), k), 1 / k))
    order = np.argsort(-pi, axis=1, kind="stable")
    best, score = np.zeros_like(pi), np.full(len(ids), -np.inf)
    for size in range(1, k + 1):
        # no set fits better than all languages together: documents that cannot gain any more are done
        some = np.flatnonzero(most + TOLERANCE * 10 - 0.5 * size * np.log(n + 1) > score) if size > 1 else np.arange(len(ids))
        if not len(some):
            break
        mask = np.zeros((len(some), k))
        np.put_along_axis(mask, order[some, :size], 1.0, axis=1)
        own = np.maximum(pi[some], 1e-6) * mask
        of_some = np.repeat(np.isin(np.arange(len(ids)), some), n)
        own, fit = _fit(like[of_some], n[some], own / own.sum(axis=1, keepdims=True))
        value = fit - 0.5 * size * np.log(n[some] + 1)
        better = value > score[some]
        best[some[better]], score[some[better]] = own[better], value[better]
    out[ids] = best
    return out


def language_id(spark: SparkSession, docs: DataFrame, folds: int = FOLDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_languages per row.

    ``und`` with score 0 for null texts, texts without a letter, and when nothing could be learned.
    Rows with a null doc_id train (they are in no held-out fold).  Null langs do not train.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), folds))
    langs, table = train(rows.filter(~F.col("held_out")), buckets)
    model = spark.sparkContext.broadcast(table)  # buckets x languages floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array([*langs, "und"], dtype=object)
        for pdf in batches:
            pi = np.concatenate([mixtures(part, model.value) for part in chunks(pdf["text"])]
                                or [np.zeros((0, len(langs)))])
            some = np.array([isinstance(t, str) and bool(LETTER.search(t)) for t in pdf["text"]], dtype=bool)
            some = some & (pi.sum(axis=1) > 0)
            score = np.where(some, pi.max(axis=1, initial=0.0), 0.0)
            lead = pi.argmax(axis=1) if len(langs) else np.zeros(len(pdf), dtype=int)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"],
                                "lang_pred": names[np.where(some, lead, len(langs))],
                                "score": np.clip(score, 0.0, 1.0), "n_languages": (pi > 0.01).sum(axis=1)})

    return rows.select("doc_id", "text", "held_out").mapInPandas(
        run, "doc_id long, held_out boolean, lang_pred string, score double, n_languages int")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark, read(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op9_language_id": op9_language_id}
