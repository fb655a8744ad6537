"""License scan: base phrases and the set-similarity join against brute force."""

import math
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from pawgrid.llm import op13_license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def base(text):
    w = words(text)
    out = []
    for phrase, label in L.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), out


def brute_blocks(text, templates, threshold):
    """Every window of every template's size, by plain sets."""
    w, out = words(text), set()
    for t, (_, body) in enumerate(templates):
        tw = words(body)
        size = max(2, 1 << (2 * len(tw) - 1).bit_length())
        need = math.ceil(threshold * len(set(tw)) - 1e-9)
        for s in range(0, len(w), size // 2):
            part = w[s:s + size]
            common = len(set(part) & set(tw))
            if common >= need:
                out.add((t, s, len(part), common))
    return out


def blocks(row):
    return {(b["template"], b["first_word"], b["n_words"], b["overlap"]) for b in row["blocks"]}


@pytest.mark.parametrize("threshold", [0.9, 0.6, 0.3])
def test_blocks_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(5)
    pool = sorted({w for _, t in L.TEMPLATES for w in words(t)}) + [f"x{i}" for i in range(40)]
    texts = [" ".join(rng.choice(pool, size=n)) for n in (0, 1, 3, 30, 200, 900)]
    for _, body in L.TEMPLATES:  # templates with words lost, doubled and moved
        w = words(body)
        kept = [x for x in w if rng.random() > 0.08]
        texts.append(" ".join([*rng.choice(pool, size=rng.integers(0, 40)), *kept, *kept[:5], "end"]))
        texts.append(body.upper() + " tail " + body)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: blocks(r) for r in L.license_scan(spark, docs, threshold=threshold).collect()}
    assert got == {i: brute_blocks(t, L.TEMPLATES, threshold) for i, t in enumerate(texts)}
    assert sum(map(len, got.values())) > 40


def test_query_against_brute_force(spark, sf, texts):
    rows = entry.queries()["op13_license_scan"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places = base(texts[r["doc_id"]])
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        names = sorted({x for _, x in places})
        assert r["base_labels"] == ",".join(names)
        assert set(names) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
        assert r["labels"].split(",") == sorted(set(r["labels"].split(",")))
        if not names and not r["n_blocks"]:
            assert r["labels"] == "" and r["score"] == 0


def test_notices_without_a_phrase_are_named_and_prose_is_not(spark):
    mit = L.TEMPLATES[1][1]
    rows = [
        (1, "int x; // " + mit.replace("\n", " ") + " more words after it"),
        (2, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
            "of conditions and the following disclaimer."),
        (3, "Licensed under CC BY-NC 4.0."), (4, "licensed under CC BY 4.0"),
        (5, "The software was released under a lot of pressure, and the rights of any person to copy it were never clear."),
        (6, "Released under the Apache License."), (7, "xéMIT license mit LICENSE mit"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in L.license_scan(spark, docs).collect():
        got[r["doc_id"]] = ({p["label"] for p in r["places"]}, {b["label"] for b in r["blocks"] if b["specific"]})
    assert got[1] == (set(), {"mit-license"})
    assert got[2] == (set(), {"bsd"})
    assert got[3] == ({"cc-by"}, {"cc-by-nc-4.0"})
    assert got[4] == ({"cc-by"}, {"cc-by-4.0"})
    assert got[5] == (set(), set())
    assert got[6] == ({"apache"}, set())
    assert got[7] == ({"mit"}, set())


def test_edges(spark, odd, nothing):
    rows = L.license_scan(spark, odd).collect()
    assert len(rows) == odd.count()
    assert L.license_scan(spark, nothing).count() == 0
    assert sorted(r["n_words"] for r in rows) == sorted(len(words(r["text"])) for r in odd.collect())
    assert L.license_scan(spark, odd, templates=[("none", "..."), ("one", "cat")]).count() == len(rows)
    with pytest.raises(ValueError):
        L.license_scan(spark, odd, templates=[("big", "word " * 400_000)])
