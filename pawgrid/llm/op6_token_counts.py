"""Operator 6: token counts by a two-tier lookup on the map side.

Tier one is a compact table of the lengths (in tokens) of the corpus' frequent units, a unit being
a run of characters between single spaces together with its leading space (no pre-token crosses
from a non-space to a space).  Each task counts its units and hands over its ``PER_TASK`` most
frequent; the ``TABLE_UNITS`` largest sums are encoded once and broadcast (a fixed size).  Tier two
encodes what the table misses through the worker's cache.  Units are never shuffled: what the first
pass moves is a bounded list per task, and the table decides only how fast a unit is counted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import read, worker_state
from pawgrid.llm.tokenizing import SEPARATORS, UnitCache, make_tokenizer, tokenizer_json

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
PER_TASK = 4096
TABLE_UNITS = 32_768
COUNTED_UNITS = 200_000  # distinct units a task counts at a time; rarer ones are let go
SPACES = re.compile(r" \s|\s |^\s|\s$")  # white space that is not one space between two units


def any_word(word: str) -> bool:
    """The vocabulary has no normaliser."""
    return True


def plain_units(text: str) -> list[str] | None:
    """The units of a text whose spaces all stand alone; None for others (and for special strings)."""
    if "<|" in text or SPACES.search(text) or SEPARATORS.search(text):
        return None
    parts = text.split(" ")
    return parts


def frequent_units(docs: DataFrame, per_task: int, table_units: int) -> list[str]:
    """The most frequent units over all documents, by the tasks' own leaders."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                if isinstance(text, str) and (units := plain_units(text)):
                    seen.update(units[1:])
                    if len(seen) > COUNTED_UNITS:
                        seen = Counter(dict(seen.most_common(COUNTED_UNITS // 4)))
        top = seen.most_common(per_task)
        if top:
            yield pd.DataFrame({"unit": [u for u, _ in top], "n": [n for _, n in top]})

    rows = (docs.select("text").mapInPandas(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "unit").limit(table_units).collect())
    return [r["unit"] for r in rows]


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT,
                 per_task: int = PER_TASK, table_units: int = TABLE_UNITS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row.  Null and empty texts have 0 tokens; repeated
    rows and null doc_ids keep a row each."""
    text = tokenizer_json(tokenizer)
    lengths = UnitCache(make_tokenizer(text), len, any_word)
    units = [f" {u}" for u in frequent_units(docs, per_task, table_units)]
    table = spark.sparkContext.broadcast({u[1:]: n for u, n in zip(units, lengths.encode(units))})
    source = spark.sparkContext.broadcast(text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_state(f"counts_{tokenizer}", lambda: UnitCache(make_tokenizer(source.value), len, any_word))
        frequent = table.value
        for pdf in batches:
            sizes, n_tokens = [], []
            for text in pdf["text"]:
                text = text if isinstance(text, str) else ""
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                units = plain_units(text) if text else []
                if units is None:
                    n_tokens.append(cache.encode([text])[0])
                    continue
                total, rare = 0, []
                for u in units[1:]:
                    n = frequent.get(u)
                    if n is None:
                        rare.append(" " + u)
                    else:
                        total += n
                if units:
                    rare.append(units[0])
                cache.trim()
                cache.learn(set(rare))
                n_tokens.append(total + sum(map(cache.known.__getitem__, rare)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": sizes, "n_tokens": n_tokens})

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, read(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op6_token_counts": op6_token_counts}
