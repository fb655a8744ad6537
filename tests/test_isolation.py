"""Failing batches are halved, batches run across Arrow batches, and a long page list is read up to its stop page."""

import math

import pytest
from pyspark.sql import functions as F

from pawgrid.operators import pages as PG
from pawgrid.operators import vectors as V
from pawgrid.plans.crawl import scan_list_pages, scan_list_pages_in_ranges
from pawgrid.session import run_path


@pytest.mark.parametrize("bad", [set(), {3}, {0, 99}, {10, 11, 12, 57}])
def test_calls_for_bad_texts_of_a_batch(bad):
    calls = []

    def embedder(texts):
        calls.append(len(texts))
        if any(int(t) in bad for t in texts):
            raise ValueError("refused")
        return [[float(t)] for t in texts]

    got = V.embed_texts([str(i) for i in range(100)], embedder)
    assert [v is None for v in got] == [i in bad for i in range(100)]
    assert all(v == [float(i)] for i, v in enumerate(got) if i not in bad)
    assert len(calls) <= 2 * len(bad) * math.ceil(math.log2(100)) + 1


def test_back_off_before_halving():
    waits, left = [], [2]

    def busy(texts):
        if left[0]:
            left[0] -= 1
            raise TimeoutError
        return [[1.0]] * len(texts)

    assert V.embed_texts(["a", "b"], busy, retries=3, wait=0.5, sleep=waits.append) == [[1.0], [1.0]]
    assert waits == [0.5, 1.0]
    assert V.embed_texts(["a"], lambda t: [], retries=1, wait=1, sleep=waits.append) == [None]
    assert V.embed_texts([], busy) == []


def test_batches_run_across_arrow_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 45, 1, 1).select(F.col("id").alias("uid"), F.col("id").cast("string").alias("t"))
        out = V.embed(df, "t", lambda texts: [[float(len(texts)), float(t)] for t in texts], 2, batch_size=20).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r["uid"]: list(r["embedding"]) for r in out} == {i: [20.0 if i < 40 else 5.0, float(i)] for i in range(45)}


def page(n, items):
    lis = "".join(f'<li><a href="/{n}-{i}"><p class="top">x</p></a></li>' for i in range(items))
    return f'<div class="lst_wrap"><ul>{lis}</ul></div>'


@pytest.mark.parametrize("stop, first", [(7, 2), (1, 3), (None, 2), (5, 100)])
def test_ranges_end_at_the_stop_page(spark, stop, first):
    rows = [(n, None if n in (3, 9) else page(n, 0 if n == stop else 2)) for n in range(1, 30)] + [(None, page(0, 1))]
    pages = spark.createDataFrame(rows, "page_no long, html string").repartition(3)
    path = run_path(spark, "ranges")
    got = sorted(map(tuple, scan_list_pages_in_ranges(pages, "b", path, first=first).collect()), key=str)
    want = sorted(map(tuple, scan_list_pages(pages.where("page_no is not null"), "b").collect()), key=str)
    assert got == want
    parsed = spark.read.parquet(path).agg(F.max("page_no")).first()[0]  # marks and items of all pages parsed
    if stop == 7:
        assert parsed <= 14  # ranges 1-2, 3-6, 7-14
    assert scan_list_pages_in_ranges(pages, "b", run_path(spark, "r"), max_pages=2, first=1).count() == (0 if stop == 1 else 4)


def test_a_list_without_pages(spark):
    none = spark.createDataFrame([], "page_no long, html string")
    assert scan_list_pages_in_ranges(none, "b", run_path(spark, "r")).collect() == []
    assert PG.list_items(none, "b", key="page_no", mark_empty=True).collect() == []
