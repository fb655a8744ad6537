"""Operator 5, second part: exact number of links of every document, by accumulated overlap counts.

:func:`pawgrid.llm.op5_ngram_join.jaccard_components` finds the components; a link cannot leave one.
Inside the components of two classes (distinct shingle sets) or more, the product of the document by
n-gram incidence is taken in blocks:

1. Size bands: linked sets differ by less than one band, so a band meets itself and the next only.
2. The classes of a band are dealt into blocks by a hash of their key; a block holds about
   ``block_entries`` entries and ``block_sets`` sets, however large the component is.
3. A cell is two blocks that meet.  The overlaps of a set with all sets of the other block add up over
   its n-grams; pairs under the bound that their sizes give are discarded there.  A cell returns
   numbers of links, never the pairs.

Equal sets are one class with a number of rows: a class' links are the rows of the classes linked with
it and its own other rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import stage
from pawgrid.llm.kernels import chunks
from pawgrid.llm.op5_ngram_join import PERCENT, SHINGLE, class_key, hasher, jaccard_components, reach

BLOCK_ENTRIES = 1 << 20
BLOCK_SETS = 1024


def _sets(with_grams: bool):
    """Kernel: (row_key, cls, n) and, if asked, the n-grams of every row; cls is null without words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            for part in chunks(pdf["text"]):
                made = list(hasher().shingles(part, SHINGLE))
                out = pd.DataFrame({"row_key": pdf["row_key"].to_numpy()[at:at + len(part)],
                                    "cls": pd.Series([class_key(h) if len(h) else None for h in made], dtype="Int64"),
                                    "n": [len(h) for h in made]})
                if with_grams:
                    out["grams"] = [h.tobytes() for h in made]
                at += len(part)
                yield out
    return run


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For every set its overlap with each of ``others``."""
    gram = np.concatenate(others)
    owner = np.repeat(np.arange(len(others)), [len(h) for h in others])
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    for h in sets:
        lo = np.searchsorted(gram, h, side="left")
        times = np.searchsorted(gram, h, side="right") - lo
        ends = np.cumsum(times)
        entry = np.repeat(lo - ends + times, times) + np.arange(ends[-1])
        yield np.bincount(owner[entry], minlength=len(others))


def cell_links(percent: int):
    """Kernel of a cell: (cls, links) of its classes."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, band, block, next_band, next_block = key
        same = (band, block) == (next_band, next_block)
        left = pdf[(pdf["band"] == band) & (pdf["block"] == block)]
        right = left if same else pdf[(pdf["band"] == next_band) & (pdf["block"] == next_block)]
        if not len(left) or not len(right):
            return pd.DataFrame({"cls": [], "links": []}).astype("int64")
        a, b = ([np.frombuffer(g, dtype=np.uint64) for g in side["grams"]] for side in (left, right))
        n, rows = right["n"].to_numpy(np.int64), right["times"].to_numpy(np.int64)
        here, there = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        for i, (overlap, times) in enumerate(zip(overlaps(a, b), left["times"].to_numpy(np.int64))):
            linked = overlap >= reach(len(a[i]), n, percent)
            if same:
                linked[i] = False
            else:
                there[linked] += times
            here[i] = rows[linked].sum()
        out = pd.DataFrame({"cls": left["cls"], "links": here})
        if not same:
            out = pd.concat([out, pd.DataFrame({"cls": right["cls"], "links": there})])
        return out[out["links"] > 0]
    return run


def jaccard_links(spark: SparkSession, docs: DataFrame, percent: int = PERCENT, block_entries: int = BLOCK_ENTRIES,
                  block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links per row; n_links counts the other rows linked with the row.

    Null texts and texts without words have no links.  Repeated rows and null doc_ids are rows like
    others and count as links of their equals.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stage(spark, jaccard_components(spark, docs, percent), "components")
    docs = docs.withColumn("row_key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit(""))))
    texts = docs.select("row_key", "text")
    of_row = texts.mapInPandas(_sets(False), "row_key long, cls long, n int").filter("cls IS NOT NULL")
    of_row = of_row.groupBy("row_key").agg(F.first("cls").alias("cls"), F.count(F.lit(1)).alias("times"))
    component = found.groupBy("row_key").agg(F.first("component").alias("component"),
                                             F.first("n_shingles").alias("n"))
    of_row = stage(spark, of_row.join(component, "row_key"), "rows")
    classes = of_row.groupBy("cls").agg(F.first("component").alias("component"), F.first("n").alias("n"),
                                        F.sum("times").alias("times"), F.min("row_key").alias("row_key"))
    step = math.log(1.001 * 100 / percent)  # a little wider than the sizes of linked sets can differ
    classes = stage(spark, classes.withColumn("band", F.floor(F.log("n") / step).cast("int")), "classes")

    several = classes.groupBy("component").count().filter("count > 1").select("component")
    bands = (classes.join(several, "component", "left_semi").groupBy("component", "band")
             .agg(F.greatest(F.ceil(F.sum("n") / block_entries), F.ceil(F.count(F.lit(1)) / block_sets))
                  .cast("int").alias("blocks")))
    bands = stage(spark, bands, "bands")
    above = bands.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = bands.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    dealt = (classes.join(bands, ["component", "band"]).join(above, ["component", "band"], "left")
             .join(below, ["component", "band"], "left")
             .withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")))

    def cells(count, make):
        return F.when(F.col(count).isNotNull(), F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array())

    def cell(band, block, next_band, next_block):
        return F.struct(band.alias("band1"), block.alias("block1"), next_band.alias("band2"), next_block.alias("block2"))

    band, block = F.col("band"), F.col("block")
    meets = F.concat(cells("blocks", lambda y: cell(band, F.least(block, y), band, F.greatest(block, y))),
                     cells("above", lambda y: cell(band, block, band + 1, y)),
                     cells("below", lambda y: cell(band - 1, y, band, block)))
    whole = texts.join(dealt.select("row_key"), "row_key", "left_semi")
    grams = (whole.mapInPandas(_sets(True), "row_key long, cls long, n int, grams binary").dropDuplicates(["row_key"])
             .select("row_key", "grams"))
    placed = stage(spark, dealt.select("row_key", "component", "cls", "n", "times", "band", "block", meets.alias("meets"))
                   .join(grams, "row_key").drop("row_key"), "placed")
    key = ["component", "band1", "block1", "band2", "block2"]
    links = (placed.withColumn("cell", F.explode("meets")).drop("meets").select("*", "cell.*").drop("cell")
             .groupBy(*key).applyInPandas(cell_links(percent), "cls long, links long")
             .groupBy("cls").agg(F.sum("links").alias("links")))
    per_class = classes.select("cls", "times").join(links, "cls", "left").select(
        "cls", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    per_row = of_row.select("row_key", "cls").join(per_class, "cls").select("row_key", "n_links")
    return found.join(per_row, "row_key", "left").select(
        "doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
