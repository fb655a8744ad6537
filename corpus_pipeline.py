"""The corpus pipeline: documents to packed training sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; :func:`run` writes it as Parquet under
the shared folder and reads it back as the docs of the next.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import read, stage
from pawgrid.llm.op1_toxicity import score_documents
from pawgrid.llm.op3_source_mix import mixed_documents
from pawgrid.llm.op5_ngram_join import keep_one
from pawgrid.llm.op7_secret_scan import redact_secrets
from pawgrid.llm.op8_best_fit_packing import best_fit_packing


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    scored = score_documents(spark, docs, read(spark, sf_dir, "labels"))
    return scored.filter(F.col("predicted") == 0).select("doc.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id stays."""
    return keep_one(spark, docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark (n_chars follows); every document stays."""
    return redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it (0 to 3 times)."""
    return mixed_documents(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence of at most 4096 tokens."""
    return best_fit_packing(spark, docs)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", ngram_jaccard_join), ("secret_scan", secret_scan),
          ("source_mix", source_mix), ("best_fit_packing", packing)]

#: learned scores, corpus-wide hashing and a tokenizer: not expressible in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(spark, step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
