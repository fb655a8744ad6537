"""G7 and the exact top-k at several block sizes (EMB1, EMB4, WIN1, JN5)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pawgrid.operators import preferences as PR
from pawgrid.operators import vectors as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    items = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(60)]
    items.append((60, [0.0] * 8))                       # zero vector
    items.append((61, list(items[5][1])))                # exact duplicate of item 5 -> tie
    queries = [(100 + j, rng.normal(size=8).astype(np.float32).tolist()) for j in range(25)]
    queries.append((200, list(items[5][1])))
    queries.append((201, [0.0] * 8))
    it = spark.createDataFrame(items, "uid long, embedding array<float>")
    qs = spark.createDataFrame(queries, "qid long, embedding array<float>")
    return it, qs, items, queries


def brute(items, queries, k):
    out = {}
    for qid, qv in queries:
        q = np.asarray(qv, float)
        sims = []
        for uid, v in items:
            v = np.asarray(v, float)
            d = np.linalg.norm(q) * np.linalg.norm(v)
            sims.append((-(q @ v / d) if d else -0.0, uid))
        out[qid] = [u for _, u in sorted(sims)[:k]]
    return out


@pytest.mark.parametrize("block_rows", [7, 16384])
def test_topk_matches_brute_force(data, block_rows):
    it, qs, items, queries = data
    got = V.top_k_similar(qs, it, 5, block_rows=block_rows)
    rows = got.orderBy("qid", "rank").collect()
    res = {}
    for r in rows:
        res.setdefault(r.qid, []).append(r.uid)
    assert res == brute(items, queries, 5)


@pytest.mark.parametrize("block_rows, tile_rows", [(7, 13), (5, 1000), (1000, 9)])
def test_topk_in_tiles_of_blocks(data, block_rows, tile_rows):
    it, qs, items, queries = data
    res = {}
    for r in V.top_k_similar(qs, it, 5, block_rows=block_rows, tile_rows=tile_rows).orderBy("qid", "rank").collect():
        res.setdefault(r.qid, []).append(r.uid)
    assert res == brute(items, queries, 5)


def test_small_blocks_copy_no_more_rows(spark):
    """Cells of the grid hold whole tiles, and items without a direction meet the queries by their smallest uids only."""
    seen = spark.sparkContext.accumulator(0)
    plain = V.block_topk

    def counted(qids, qgroups, qmat, uids, *rest):
        seen.add(len(qids) + len(uids))
        return plain(qids, qgroups, qmat, uids, *rest)

    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(600, 4))
    it = spark.createDataFrame([(i, v.tolist() if i % 3 else ([0.0] * 4 if i % 2 else None), 1 + i % 2) for i, v in enumerate(vecs)],
                               "uid long, embedding array<double>, m int")
    qs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(rng.normal(size=(500, 4)))] + [(999, None, 0)],
                               "qid long, embedding array<double>, g int")
    V.block_topk = counted
    try:
        got = V.top_k_similar(qs, it, 5, block_rows=16, q_group="g", i_mask="m").collect()
    finally:
        V.block_topk = plain
    assert seen.value <= 4 * 501 + 400 + 2 * 5  # at most 4 item tiles (a task each), one query tile
    rows = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        rows.setdefault(r["qid"], []).append(r["uid"])
    all_items = it.collect()
    for q in qs.collect():
        mine = [(r["uid"], r["embedding"] or [0.0] * 4) for r in all_items if r["m"] >> q["g"] & 1]
        assert rows.get(q["qid"], []) == (brute(mine, [(0, q["embedding"] or [0.0] * 4)], 5)[0] if mine else [])


def test_a_query_meets_the_items_in_few_tiles(spark):
    """Its first k items are found again in every item tile, so these hold many times ``tile_rows`` rows."""
    seen = spark.sparkContext.accumulator(0)
    plain = V.block_topk

    def counted(qids, qgroups, qmat, uids, *rest):
        seen.add(len(qids) + len(uids))
        return plain(qids, qgroups, qmat, uids, *rest)

    rng = np.random.default_rng(4)
    items = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(256, 5)))]
    queries = [(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(64, 5)))]
    it = spark.createDataFrame(items, "uid long, embedding array<double>").repartition(3)
    qs = spark.createDataFrame(queries, "qid string, embedding array<double>").repartition(3)
    V.block_topk = counted
    try:
        got = V.top_k_similar(qs, it, 5, tile_rows=8).collect()
    finally:
        V.block_topk = plain
    assert seen.value <= 2 * (64 + 256)  # 4 x 8 queries and 16 x 8 items meet in a task
    rows = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rank"])):
        rows.setdefault(r["qid"], []).append(r["uid"])
    assert rows == brute(items, queries, 5)


@pytest.mark.parametrize("rows", [3, 700])
def test_kernel_over_many_blocks_keeps_ties_in_order(rows):
    """Blocks that give some queries nothing, repeated items in other blocks, vectors of any length, none that are not finite."""
    rng = np.random.default_rng(6)
    imat = rng.integers(-2, 3, size=(900, 4)).astype(np.float32)
    imat[5] = np.nan
    qmat = rng.integers(-2, 3, size=(70, 4)).astype(np.float32) * 3
    uids, masks, groups = rng.permutation(900), rng.integers(1, 4, 900), rng.integers(0, 2, 70)
    best = V.block_topk(np.arange(70), groups, qmat, uids, masks, imat, 6, rows)
    got = {q: [u for _, u in sorted(zip(-x["similarity"].round(9), x["uid"]))] for q, x in best.groupby("qid")}
    unit = lambda m: m / np.maximum(np.linalg.norm(m.astype(float), axis=1), 1e-300)[:, None]
    sims = np.round(unit(qmat) @ unit(imat).T, 9)
    for q in range(70):
        can = [i for i in range(900) if masks[i] >> groups[q] & 1 and i != 5]
        assert got[q] == [u for _, u in sorted((-sims[q, i], uids[i]) for i in can)[:6]]


def test_stand_in_embedder_by_its_definition():
    import hashlib
    texts = ["A  b b\nc a", "", "ÄÖ ß", None, " "] + [f"w{i} w{i % 7}" for i in range(50)]
    for text, got in zip(texts, V.hashing_embedder(5)(texts)):
        want = [0.0] * 5
        for word in filter(None, (text or "").lower().split(" ")):
            h = hashlib.md5(word.encode()).hexdigest()
            want[int(h[:8], 16) % 5] += 1.0 if h[8] >= "8" else -1.0
        assert got == want


def test_tie_lower_uid_first_and_zero_vector(data):
    it, qs, _, _ = data
    got = {(r.qid, r.rank): (r.uid, r.similarity) for r in V.top_k_similar(qs, it, 3).collect()}
    assert got[(200, 1)][0] == 5 and got[(200, 2)][0] == 61       # tie at 1.0 -> lower uid first
    assert got[(201, 1)] == (0, 0.0)                               # zero query: all 0.0, by uid


def test_k_larger_than_n(spark):
    it = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "uid long, embedding array<float>")
    qs = spark.createDataFrame([(9, [1.0, 1.0])], "qid long, embedding array<float>")
    assert V.top_k_similar(qs, it, 10).count() == 2


def test_single_vector_path(data):
    it, _, items, _ = data
    q = items[3][1]
    got = [r.uid for r in V.top_k_for_vector(it, q, k=4).orderBy("rank").collect()]
    assert got == brute(items, [(0, q)], 4)[0]


def test_slot_mask_eligibility(spark):
    rows = [(1, "3", "남", "2023", [1.0, 0.0]), (2, "12", "여", "2015", [0.9, 0.1]), (3, None, "남", None, [1.0, 0.1]),
            (4, "25", "남", "2014추정", [0.8, 0.0])]
    it = spark.createDataFrame(rows, "uid long, addinfo07 string, addinfo03 string, addinfo05 string, "
                                     "embedding array<float>").withColumn("slot_mask", PR.slot_mask())
    qs = spark.createDataFrame([(1, "소형", None, None, [1.0, 0.0]), (2, None, "고령", "남", [1.0, 0.0]),
                                (3, "중형", "어린", None, [1.0, 0.0]), (4, None, None, None, [1.0, 0.0])],
                               "qid long, size string, age string, gender string, embedding array<float>")
    qs = qs.withColumn("slot_group", PR.slot_group())
    got = V.top_k_similar(qs, it, 10, q_group="slot_group", i_mask="slot_mask").collect()
    res = {}
    for r in got:
        res.setdefault(r.qid, set()).add(r.uid)
    assert res == {1: {1}, 2: {4}, 4: {1, 2, 3, 4}}
    counts = {r.qid: r.eligible for r in PR.eligible_counts(
        qs, it.withColumn("state", F.lit("임보가능"))).collect()}
    assert counts == {1: 1, 2: 1, 3: 0, 4: 4}


def test_extract_slots_default_rules(spark):
    texts = ["활발하고 애교 많은 소형견을 원해요", "조용하고 얌전한 중형 강아지가 좋겠어요", "사람을 좋아하고 똑똑한 아이를 찾고 있어요"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    out = [(r["size"], r["age"], r["gender"]) for r in PR.extract_slots(df, "text").collect()]
    assert out == [("소형", None, None), ("중형", None, None), (None, None, None)]


def test_embed_fallback(spark):
    calls = {"n": 0}

    def flaky(texts):
        calls["n"] += 1
        if len(texts) > 1 or texts[0] == "bad":
            raise RuntimeError("batch failed")
        return [[1.0, 2.0]]

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "uid long, t string").coalesce(1)
    out = {r.uid: (list(r.embedding), r.failed) for r in V.embed(df, "t", flaky, 2).collect()}
    assert out == {1: ([1.0, 2.0], False), 2: ([0.0, 0.0], True), 3: ([1.0, 2.0], False)}


def test_cosine_column_matches_numpy(data):
    _, _, items, queries = data
    spark = data[0].sparkSession
    rows = [(u, q, a, b) for u, a in items for q, b in queries[-4:]]   # includes the zero vectors
    pairs = spark.createDataFrame(rows, "uid long, qid long, a array<float>, b array<float>")
    got = {(r.uid, r.qid): r.c for r in pairs.select("uid", "qid", V.cosine("a", "b").alias("c")).collect()}
    vecs, qv = dict(items), dict(queries)
    for (uid, qid), c in got.items():
        a, b = np.asarray(vecs[uid], float), np.asarray(qv[qid], float)
        d = np.linalg.norm(a) * np.linalg.norm(b)
        assert c == pytest.approx(a @ b / d if d else 0.0, abs=1e-9)


def test_embedding_hands_on_its_rows_in_pieces(spark):
    """A task holds the vectors of few texts, however many an Arrow batch has; calls still run on across batches."""
    seen, jobs = [], []

    class Table:
        schema = spark.createDataFrame([], "uid long, text string").schema

        def select(self, *cols):
            return self

        def mapInPandas(self, run, schema):
            jobs.append(run)

    V.embed(Table(), "text", lambda ts: seen.append(len(ts)) or [[float(len(t))] for t in ts], 1)
    frames = [pd.DataFrame({"uid": range(a, b), "text": ["x" * (i % 7) for i in range(a, b)]}) for a, b in ((0, 9950), (9950, 10020))]
    out = jobs[0](iter(frames))
    first = next(out)
    assert len(first) <= V.EMBED_ROWS and sum(seen) <= V.EMBED_ROWS
    rows = pd.concat([first, *out], ignore_index=True)
    assert rows["uid"].tolist() == list(range(10020)) and [v[0] for v in rows["embedding"]] == [float(i % 7) for i in range(10020)]
    assert seen == [100] * 100 + [20]
