"""Inside its class a word has a softmax over the context of its own."""

from __future__ import annotations

import numpy as np
import pytest

from pawgrid.llm import op10_lm_scoring as M


def test_context_chooses_between_words_of_a_class(spark):
    """Words that begin alike and are equally frequent: only the words before tell them apart."""
    rng = np.random.default_rng(5)
    filler = [f"{a}{b}" for a in "abcdefgh" for b in ("um", "el", "or")]
    rows = []
    for i in range(1500):
        words = [str(w) for w in rng.choice(filler, 40)]
        for j in (0, 20):
            words[j:j + 2] = ["red", "stone"] if i % 2 else ["blue", "stick"]
        rows.append((i, " ".join(words)))
    asked = {"red stone": 10 ** 6, "red stick": 10 ** 6 + 1, "blue stick": 10 ** 6 + 2, "blue stone": 10 ** 6 + 3}
    docs = spark.createDataFrame(rows + [(i, t) for t, i in asked.items()], "doc_id long, text string")
    # "red" and "blue" are as frequent, "stone" and "stick" too, and rarer than the 24 others (14 have classes of their own)
    got = {r["doc_id"]: r["score"] for r in M.lm_scores(spark, docs).filter("doc_id >= 1000000").collect()}
    assert got[asked["red stone"]] > got[asked["red stick"]] + 0.3
    assert got[asked["blue stick"]] > got[asked["blue stone"]] + 0.3


def test_probabilities_of_all_words_sum_to_one():
    rng = np.random.default_rng(1)
    n = 900
    h = np.concatenate(([M.END], rng.integers(1, 2 ** 63, n).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, n).astype(np.uint64)))
    spell = np.concatenate(([0], 1 + M.OWN_CLASS + rng.integers(0, M.SPELLING - 1, n)))  # the last class has no word
    c = np.sort(rng.integers(1, 10 ** 5, n + 1))[::-1]
    words = M.Words(zip(h.tolist(), spell.tolist()))
    y, m = words.find(h, spell)
    sums = {}
    for i in np.flatnonzero((m >= M.OWN_MEMBER) & (y > M.OWN_CLASS)):
        old = sums.get((int(y[i]), int(m[i]) - M.OWN_MEMBER), (0, 0))
        sums[int(y[i]), int(m[i]) - M.OWN_MEMBER] = (old[0] + int(c[i]), old[1] + 1)
    outer, mass = M.masses(words, dict(zip(h.tolist(), c.tolist())), sums)
    bias, inner = M.offsets(outer, mass)
    weights = rng.normal(size=(2 << M.ROWS_LOG2, M.CLASSES)).astype("f4")
    context = rng.integers(1, 2 ** 60, (3, 1)).astype(np.uint64)
    p_class = np.exp(M.log_softmax(weights, bias, M.features(list(context))))[0]
    total = p_class[0] + p_class[1:1 + M.OWN_CLASS].sum()
    for k in range(1 + M.OWN_CLASS, M.CLASSES):
        f = M.member_features(list(context), np.array([k]))
        p = p_class[k] * np.exp(M.log_softmax(weights, inner[[k]], f))[0]
        total += p[:M.OWN_MEMBER].sum()
        for g in range(M.OWN_MEMBER, M.MEMBERS):
            seen = (y == k) & (m == g)
            total += p[g] * ((c[seen] + 0.5).sum() + 0.5) / mass[k, g]
    assert total == pytest.approx(1, abs=1e-4)
    assert len(words.own) > M.OWN_CLASS + 10 * M.OWN_MEMBER
