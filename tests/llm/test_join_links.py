"""Numbers of links of the n-gram Jaccard join against all pairs."""

import numpy as np
import pytest

from pawgrid.llm.op5_links import jaccard_links, overlaps
from tests.llm.test_operators import components, shingles


def all_pairs(texts):
    sets = [shingles(t) for t in texts]
    return [sum(i != j and bool(s) and 100 * len(s & o) >= 75 * len(s | o) for j, o in enumerate(sets))
            for i, s in enumerate(sets)]


@pytest.mark.parametrize("blocks", [{}, {"block_entries": 2000, "block_sets": 7}])
def test_links_of_near_copies(spark, blocks):
    """Copies, edited copies, a shared passage, drifting texts and sizes around the bound; whole components and many blocks."""
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(3000)])
    base, passage = list(rng.choice(words, 90)), list(rng.choice(words, 50))
    texts = [" ".join(base)] * 40
    for _ in range(60):
        t = list(base)
        for k in rng.integers(0, len(t), rng.integers(1, 5)):
            t[k] = f"edit{rng.integers(1000)}"
        texts.append(" ".join(t))
    texts += [" ".join([*rng.choice(words, int(rng.integers(5, 150))), *passage]) for _ in range(40)]
    drift = list(rng.choice(words, 120))
    for _ in range(30):
        drift = list(drift)
        for k in rng.integers(0, 120, 3):
            drift[k] = f"d{rng.integers(10 ** 6)}"
        texts.append(" ".join(drift))
    texts += [" ".join(base[:k]) for k in range(3, 90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in jaccard_links(spark, docs, **blocks).collect()}
    assert [got[i]["n_links"] for i in range(len(texts))] == all_pairs(texts)
    assert [got[i]["component_id"] for i in range(len(texts))] == components([shingles(t) for t in texts])


def test_links_of_documents(spark, documents, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r["n_links"] for r in jaccard_links(spark, documents).collect()}
    assert [got[i] for i in ids] == all_pairs([texts[i] for i in ids])


def test_links_of_odd_rows(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(zip([str(i) for i, _ in rows], all_pairs([t for _, t in rows])))
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in jaccard_links(spark, odd).collect()) == want
    assert jaccard_links(spark, nothing).collect() == []


def test_overlaps_add_up():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(12)]
    got = list(overlaps(sets[:5], sets[5:]))
    assert [o.tolist() for o in got] == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
