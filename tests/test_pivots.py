"""The pivot index gives the rows of the full search; empty and vectorless sides have a defined result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pawgrid.operators import pivots as PV
from pawgrid.operators import vectors as V

ITEM, QUERY = "uid long, embedding array<float>, mask long", "qid long, embedding array<float>, grp long"


def clustered(rng, n, centres, dim, spread=0.15):
    c = rng.normal(size=(centres, dim))
    return (c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def rows(df):
    return sorted((r["qid"], r["rank"], r["uid"], round(r["similarity"], 8)) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    vec = clustered(rng, 1500, 20, 16)
    items = [(i, vec[i].tolist(), int(rng.integers(1, 8))) for i in range(1500)]
    items += [(2000 + i, items[7][1], 7) for i in range(40)]            # repeated vectors: ties
    items += [(3000 + i, None if i % 2 else [0.0] * 16, 1 + i % 7) for i in range(30)]
    q = clustered(np.random.default_rng(3), 1500, 20, 16)[::10]
    queries = [(i, q[i].tolist(), i % 3) for i in range(len(q))]
    queries += [(900, None, 0), (901, [0.0] * 16, 2), (902, (-vec[0]).tolist(), 1), (903, items[7][1], 0)]
    return (spark.createDataFrame(queries, QUERY).repartition(3), spark.createDataFrame(items, ITEM).repartition(4))


@pytest.mark.parametrize("k", [1, 10, 60])
@pytest.mark.parametrize("filtered", [False, True])
def test_same_rows_as_the_full_search(tables, k, filtered):
    queries, items = tables
    mask, group = ("mask", "grp") if filtered else (None, None)
    want = rows(V.top_k_similar(queries, items, k, q_group=group, i_mask=mask))
    index = PV.build_index(items, i_mask=mask, pivots=24, rings=8)
    assert index.n_items == items.count()
    found = PV.pivot_top_k(queries, index, k, q_group=group, rings=8, block_rows=50)
    assert rows(found.result) == want


def test_under_half_of_the_pairs_on_clustered_vectors(tables):
    queries, items = tables
    work = PV.pivot_top_k(queries, PV.build_index(items), 10).work.first()
    assert work["all_pairs"] == queries.count() * items.count()
    assert 0 < work["share"] < 0.5


def test_spread_vectors_are_still_exact(spark):
    rng = np.random.default_rng(8)
    items = spark.createDataFrame([(i, rng.normal(size=6).astype(np.float32).tolist(), 1) for i in range(400)], ITEM)
    queries = spark.createDataFrame([(i, rng.normal(size=6).astype(np.float32).tolist(), 0) for i in range(40)], QUERY)
    assert rows(PV.pivot_top_k(queries, PV.build_index(items), 7).result) == rows(V.top_k_similar(queries, items, 7))


def test_empty_sides(spark, tables):
    queries, items = tables
    none_q, none_i = spark.createDataFrame([], QUERY), spark.createDataFrame([], ITEM)
    for search in (lambda q, i: V.top_k_similar(q, i, 3), lambda q, i: PV.pivot_top_k(q, PV.build_index(i), 3).result):
        assert search(none_q, items).collect() == []
        assert search(queries, none_i).collect() == []
        assert search(none_q, none_i).collect() == []


def test_sides_without_any_vector(spark, tables):
    queries, items = tables
    blank_q = queries.withColumn("embedding", F.lit(None).cast("array<float>"))
    blank_i = items.withColumn("embedding", F.lit(None).cast("array<float>"))
    first = [0, 1, 2]
    for search in (lambda q, i: V.top_k_similar(q, i, 3), lambda q, i: PV.pivot_top_k(q, PV.build_index(i), 3).result):
        for q, i in ((blank_q, items), (queries, blank_i), (blank_q, blank_i)):
            got = rows(search(q, i))
            assert len(got) == 3 * queries.count()
            assert [u for _, _, u, _ in got[:3]] == first and all(s == 0 for *_, s in got)


def test_pivots_of_repeated_rows():
    assert len(PV.fit_pivots(np.ones((9, 3)), 5)) == 1
    assert len(PV.fit_pivots(np.zeros((4, 3)), 5)) == 0


@pytest.mark.parametrize("tile_rows", [5, 40, 16384])
def test_bins_of_cells_give_the_same_rows(spark, tile_rows):
    """Cells that share a bin, cells of several blocks, queries without a direction and slot groups."""
    rng = np.random.default_rng(12)
    items = spark.createDataFrame([(i, v.tolist() if i % 9 else None, 1 + i % 3) for i, v in enumerate(rng.normal(size=(300, 5)))],
                                  "uid long, embedding array<float>, m int")
    queries = spark.createDataFrame([(i, v.tolist() if i % 7 else None, i % 2) for i, v in enumerate(rng.normal(size=(40, 5)))],
                                    "qid long, embedding array<float>, g int")
    found = PV.pivot_top_k(queries, PV.build_index(items, i_mask="m"), 6, q_group="g", tile_rows=tile_rows, block_rows=16).result
    want = V.top_k_similar(queries, items, 6, q_group="g", i_mask="m")
    key = lambda df: sorted((r["qid"], r["rank"], r["uid"], round(r["similarity"], 6) + 0.0) for r in df.collect())
    assert key(found) == key(want)


def test_neighbouring_cells_share_a_bin():
    assert PV.cell_bins([(3, 10), (1, 5), (-1, 1), (2, 100), (7, 30)], 40) == [(-1, 0, 1), (1, 0, 1), (2, 1, 3), (3, 2, 1), (7, 2, 1)]
