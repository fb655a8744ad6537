"""The end-to-end matching run as stages (PIPE1, PIPE3, PIPE4, PIPE5, E1).

Each stage is a DataFrame function; ``run`` chains them and materialises the two expensive
stages (prepared listings, listing vectors) under the shared checkpoint folder, rebuilding a
stage only when its table is missing (``skip_existing``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.functions.describe import with_description, with_embedding_text
from pawgrid.functions.text import clean_query
from pawgrid.operators import preferences as PR
from pawgrid.operators import rerank as R
from pawgrid.operators import shaping as SH
from pawgrid.operators import vectors as V
from pawgrid.session import shared_path
from pawgrid.sources.readers import open_listings
from pawgrid.sources.sinks import materialise

Embedder = Callable[[list[str]], list[list[float]]]


def prepare(raw: DataFrame) -> DataFrame:
    """PIPE1: weight cleaned, defaults filled, natural-language description added."""
    return with_description(SH.fill_defaults(SH.clean_weight(raw)), "gpt_description")


def listing_vectors(prepared: DataFrame, embedder: Embedder, dim: int, batch_size: int = 100) -> DataFrame:
    """EMB2: SC12 text per listing, embedded in batches: ``(uid, embedding, failed, embedding_text)``."""
    texts = with_embedding_text(prepared, "embedding_text").select("uid", "embedding_text")
    return V.embed(texts, "embedding_text", embedder, dim, key="uid", batch_size=batch_size,
                   keep=("embedding_text",))


def query_vectors(queries: DataFrame, embedder: Embedder, dim: int, rules: dict = K.SLOT_RULES) -> DataFrame:
    """SC5 + EMB3: slots and the slot group from the raw text, vector from the cleaned text."""
    slots = PR.extract_slots(queries, "text", rules).withColumn("slot_group", PR.slot_group())
    cleaned = slots.select(*slots.columns, clean_query("text").alias("clean"))
    vecs = V.embed(cleaned, "clean", embedder, dim, key="qid", keep=tuple(c for c in slots.columns if c != "qid"))
    return vecs.where(~F.col("failed")).drop("failed")  # failed query: no result


def candidates(prepared: DataFrame, vectors: DataFrame, queries: DataFrame, link_prefix: str, k: int = 10,
               available_only: bool = True) -> DataFrame:
    """EMB5 for every query at once: hard slots, exact cosine top-k, candidate projection."""
    base = open_listings(prepared) if available_only else prepared
    items = base.select("uid", PR.slot_mask().alias("slot_mask")).join(vectors.select("uid", "embedding"), "uid", "left")
    top = V.top_k_similar(queries, items, k, q_group="slot_group", i_mask="slot_mask")
    return R.with_candidate_text(R.candidate_rows(top, prepared, link_prefix))


def system_stats(prepared: DataFrame) -> DataFrame:
    """AGG1: state and sex counts, tidy ``(facet, key, n)``."""
    pairs = F.array(F.struct(F.lit("state").alias("facet"), F.col("state").cast("string").alias("key")),
                    F.struct(F.lit("sex").alias("facet"), F.col("addinfo03").cast("string").alias("key")))
    return (prepared.select(F.explode(pairs).alias("p")).select("p.facet", "p.key").where(F.col("key").isNotNull())
            .groupBy("facet", "key").agg(F.count(F.lit(1)).alias("n")))   # both facets in one scan


def run(spark: SparkSession, raw: DataFrame, queries: DataFrame, embedder: Embedder, dim: int,
        link_prefix: str, name: str = "default", k: int = 10, skip_existing: bool = True) -> dict[str, DataFrame]:
    """PIPE3 + PIPE4: stages materialised under ``spark.checkpoint.dir``; returns the stage
    frames (``prepared``, ``vectors``, ``stats``, ``candidates``, ``prompts``).  A stage is taken from an earlier
    run only when its input's files and schema (and the dimension) are the same."""
    prepared = materialise(spark, shared_path(spark, f"stages/{name}/prepared"), lambda: prepare(raw), skip_existing, inputs=[raw])
    vectors = materialise(spark, shared_path(spark, f"stages/{name}/vectors"),
                          lambda: listing_vectors(prepared, embedder, dim), skip_existing, inputs=[prepared], params={"dim": dim})
    # read several times below: each is computed once and cut off from the jobs before it
    qv = materialise(spark, shared_path(spark, f"stages/{name}/query-vectors"),
                     lambda: query_vectors(queries, embedder, dim), skip_existing=False)
    cands = materialise(spark, shared_path(spark, f"stages/{name}/candidates"),
                        lambda: candidates(prepared, vectors, qv, link_prefix, k), skip_existing=False)
    return {"prepared": prepared, "vectors": vectors, "stats": system_stats(prepared), "candidates": cands,
            "prompts": R.prompts(cands, queries)}
