"""Viterbi against all paths of short lattices, and what typed words keep."""

import itertools

import numpy as np
import pytest

from pawgrid.llm import op1_toxicity as O


def model(texts, weight=0.01):
    c3 = O.trigram_counts(texts).reshape(O.SYMBOLS, O.SYMBOLS, O.SYMBOLS) + weight
    return np.log(c3 / c3.sum(axis=2, keepdims=True)).astype(np.float32)


LM = model(["you are a stupid idiot and an ass with shit on the boot as it was said by them all in a little letter"] * 20)


def path_score(path, lm):
    """Channel plus trigram log-probability of one path, letter by letter."""
    x = y = 0
    total = 0.0
    for read_as, cost in path:
        total += cost
        for ch in read_as:
            s = O.symbol(ch)
            if s or y:
                total += float(lm[x, y, s])
            x, y = (y, s) if s else (0, 0)
    return total + (float(lm[x, y, 0]) if y else 0.0)


@pytest.mark.parametrize("token", ["a$$", "1d10t", "iiddiot", "s.t.u", "455", "b00t!", "l3tt3r", "a1@", "...", "7h3m"])
@pytest.mark.parametrize("letters_only", [False, True])
def test_viterbi_finds_the_best_of_all_paths(token, letters_only):
    stages = O.lattice(token, letters_only)
    paths = list(itertools.product(*stages))
    best = max(path_score(p, LM) for p in paths)
    found = O.viterbi(stages, LM)
    assert max(path_score(p, LM) for p in paths if "".join(r for r, _ in p) == found) == pytest.approx(best, abs=1e-4)


def test_typed_words_are_kept():
    assert O.restore("letter", LM)[0] == "letter" and O.restore("little", LM)[0] == "little"
    assert O.restore("2024", LM) == [] and O.restore("12", LM) == []
    assert "ass" in O.restore("455", LM) and "ass" in O.restore("a$$", LM)


def test_quick_rejection_loses_no_value():
    """With the letters that known words begin with, a reader gives what it gives without them."""
    words = {"idiot": 1, "stupid": 2, "ass": 3, "moron": 4}
    number = {f: i for w, i in words.items() for f in O.word_features(w)}
    starts = {f.lstrip("=")[:3] for f in number}

    def value(ws):
        return tuple(number[f] for w in ws for f in O.word_features(w) if f in number)

    rng = np.random.default_rng(2)
    bits = ["idiot", "iidiiot", "IDIOT!!", "st upid", "sstupid", "a$$", "as$", "aass", "mo ron", "i d i o t", "1diot", "(moron).", "letter",
            "little", "2024", "id", "iot", "st", "upid", "idi", "ot", "\"ass\"", "m o r o n", "x", "é", "…"]
    for _ in range(300):
        text = " ".join(rng.choice(bits, size=rng.integers(1, 12)))
        full = sorted(v for v in O.Reader(LM, value).read(text))
        quick = sorted(v for v in O.Reader(LM, value, O.LONGEST, starts).read(text))
        assert quick == full, text


def test_the_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(O, "CACHE_BYTES", 20_000)
    reader = O.Reader(LM, lambda ws: ws)
    for i in range(2000):
        reader.read(f"word{i} l3tter{i}")
    assert reader.size < 30_000 and len(reader.known) < 200
