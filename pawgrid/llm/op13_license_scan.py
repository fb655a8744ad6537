"""Operator 13: license scan by an exact set-similarity join of text blocks with license templates.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.  A text's blocks are
windows of L words, one every L / 2 words; L is the power of two that holds a template twice, so every
passage as long as a template lies whole in a block of its size.  A block joins a template when it
contains at least ``threshold`` of the template's distinct words.  With a = ceil(threshold * |T|), and all
sets in one global order, the rarest word of the corpus first:

* prefix filter: a pair needs a common word among the first |T| - a + 1 of the template and the first
  |B| - a + 1 of the block, so only blocks around such a word are looked at;
* length filter: |B| >= a;
* positional filter: a common word at places i of T and j of B leaves at most
  1 + min(|T| - i - 1, |B| - j - 1) common words, which has to reach a.

What remains is verified by the exact overlap, so no block is lost.  A block holds only the words
that some template has (others are in no overlap).  Templates are a parameter of bounded size
(``MAX_TEMPLATE_WORDS``) and their index is broadcast: the join moves no text.  One pass counts the
templates' words over the corpus (a task hands over one row per word), a second one joins.

Fixed phrases (``PHRASES``) are found beside it, at every place where their words stand consecutively.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import read, worker_state
from pawgrid.llm.kernels import Hasher, chunks, mix

THRESHOLD = 0.9
MAX_TEMPLATE_WORDS = 100_000  # words of all templates together: the bound of what is broadcast

# fixed values: the phrases of the contract and their labels
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# fixed values: public license notices and the one-line statements that name a license
TEMPLATES = (
    ("mit-license", "Released under the MIT License."),
    ("mit-license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
     "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
     "in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
     "KIND, either express or implied. See the License for the specific language governing permissions and "
     "limitations under the License."),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
     "your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
     "this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
     "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
     "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
     "binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
     "rights to this work."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
     "License."),
)

_SOLID = np.zeros(256, dtype=bool)  # bytes of a word; every byte of a character beyond ASCII is one
_SOLID[0x30:0x3A] = _SOLID[0x61:0x7B] = _SOLID[0x80:] = True


class Scanner(Hasher):
    """Words of whole batches of texts as hashes."""

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash per word, first word of each text and the end)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        a = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8).copy()
        a[(a >= 65) & (a <= 90)] += 32
        edge = np.flatnonzero(np.diff(np.concatenate(([False], _SOLID[a], [False])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        if len(a) > len(self.pow):
            self.grow(2 * len(a))
        run = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(self.codes[a] * self.pow[:len(a)], out=run[1:])
        h = mix((run[end] - run[start]) * self.inv[start] + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        bounds = np.cumsum([len(r) + 1 for r in raw])
        return h, np.concatenate(([0], np.searchsorted(start, bounds)))


def scanner() -> Scanner:
    return worker_state("license_scanner", Scanner)


class Vocabulary:
    """Numbers of the words of templates and phrases; other words have none."""

    def __init__(self, texts: Sequence[str]) -> None:
        hashes = [scanner().words([t])[0] for t in texts]
        self.known = np.unique(np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)]))
        self.sequences = [np.searchsorted(self.known, h) for h in hashes]
        self.low = np.zeros(1 << 16, dtype=bool)
        self.low[self.known & np.uint64(0xFFFF)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the known words among h, their numbers)."""
        at = np.flatnonzero(self.low[h & np.uint64(0xFFFF)])
        number = np.searchsorted(self.known, h[at])
        number[number == len(self.known)] = 0
        good = self.known[number] == h[at] if len(self.known) else np.zeros(len(at), dtype=bool)
        return at[good], number[good]


class Index:
    """The templates' sets in the global order, with what the filters need."""

    def __init__(self, vocabulary: Vocabulary, sequences: Sequence[np.ndarray], counts: np.ndarray, threshold: float) -> None:
        n = len(vocabulary.known)
        order = np.lexsort((vocabulary.known, counts))  # the rarest word of the corpus first
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        self.sets = [np.unique(self.rank[s]) for s in sequences]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        self.window = [max(2, 1 << (2 * len(s) - 1).bit_length()) for s in sequences]
        self.place = np.full((len(self.sets), n), -1, dtype=np.int64)  # of a word in the template's prefix
        self.member = np.zeros((len(self.sets), n), dtype=bool)
        for t, s in enumerate(self.sets):
            self.member[t, s] = True
            lead = s[:len(s) - self.need[t] + 1]
            self.place[t, lead] = np.arange(len(lead))
        self.sizes = {w: [t for t, v in enumerate(self.window) if v == w] for w in sorted(set(self.window))}

    def broader(self, t: int, u: int) -> bool:
        """Is t's set a proper part of u's?"""
        return len(self.sets[t]) < len(self.sets[u]) and bool(self.member[u][self.sets[t]].all())

    def blocks(self, at: np.ndarray, number: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """All (text, template, first word, words of the block, overlap) that reach the threshold.

        ``at`` and ``number`` are the places and numbers of the known words of a run of texts, of which
        text d has the words first[d] to first[d + 1]."""
        out: list[tuple[int, int, int, int, int]] = []
        rank = self.rank[number]
        doc = np.searchsorted(first, at, side="right") - 1
        inside = at - first[doc]
        for window, group in self.sizes.items():
            step = window // 2
            hit = (self.place[group] >= 0).any(axis=0)[rank]
            if not hit.any():
                continue
            k = inside[hit] // step
            key = np.unique(np.concatenate([(doc[hit] << 40) + k, ((doc[hit] << 40) + k - 1)[k > 0]]))
            d, k = key >> 40, key & ((1 << 40) - 1)
            begin = first[d] + k * step
            stop = np.minimum(begin + window, first[d + 1])
            lo, hi = np.searchsorted(at, begin), np.searchsorted(at, stop)
            n = hi - lo
            block = np.repeat(np.arange(len(key)), n)
            words = rank[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[block]]
            pairs = np.unique(block * len(self.rank) + words)  # sets of the blocks, in the global order
            block, words = pairs // len(self.rank), pairs % len(self.rank)
            size = np.bincount(block, minlength=len(key))
            j = np.arange(len(pairs)) - (np.cumsum(size) - size)[block]
            for t in group:
                need, i, b = self.need[t], self.place[t][words], size[block]
                passed = (i >= 0) & (b >= need) & (j <= b - need) & (np.minimum(len(self.sets[t]) - i, b - j) >= need)
                if not passed.any():
                    continue
                wanted = np.zeros(len(key), dtype=bool)
                wanted[block[passed]] = True
                common = np.bincount(block[self.member[t][words] & wanted[block]], minlength=len(key))
                for c in np.flatnonzero(common >= need):
                    out.append((int(d[c]), t, int(begin[c] - first[d[c]]), int(stop[c] - begin[c]), int(common[c])))
        return out


def phrase_places(sequence: np.ndarray, at: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places (among all words of the run of texts) where the phrase stands inside one text."""
    start = np.flatnonzero(number == sequence[0])
    for o, word in enumerate(sequence[1:], 1):
        start = start[start + o < len(at)]
        start = start[(number[start + o] == word) & (at[start + o] == at[start] + o)]
    begin = at[start]
    last = begin + len(sequence) - 1
    return begin[np.searchsorted(first, begin, side="right") == np.searchsorted(first, last, side="right")]


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each word of the vocabulary occurs in the corpus (a row per word and task is summed)."""
    n = len(vocabulary.known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n, dtype=np.int64)
        for pdf in batches:
            for part in chunks(pdf["text"]):
                total += np.bincount(vocabulary.find(scanner().words(part)[0])[1], minlength=n)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"word": some, "n": total[some]})

    out = np.zeros(n, dtype=np.int64)
    for r in docs.select("text").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]  # at most one row per word of the templates
    return out


BLOCK = "template int, label string, first_word long, n_words long, overlap long, containment double, specific boolean"
SCHEMA = f"doc_id long, n_words long, places array<struct<label string, word long>>, blocks array<struct<{BLOCK.replace(', ', ',')}>>"


def license_scan(spark: SparkSession, docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                 phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, places, blocks.

    ``places`` holds (label, word) of every phrase occurrence; ``blocks`` every text block that contains
    at least ``threshold`` of a template's distinct words, with the template's number and label, the
    block's first word and length, the overlap and its share.  ``specific`` is false where another
    template whose words include this one's matches in an overlapping block (CC BY inside CC BY-NC).

    Null and empty texts have no words and empty lists.  Repeated rows and null doc_ids keep a row
    each; other columns of any name are ignored; an empty table gives no rows.  Templates without a
    word match nothing.
    """
    templates = [(label, text) for label, text in templates if len(scanner().words([text])[0])]
    texts = [t for _, t in templates] + [p for p, _ in phrases]
    if sum(map(len, texts)) > 8 * MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates are broadcast: at most {8 * MAX_TEMPLATE_WORDS} characters together")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = Vocabulary(texts)
    sequences, spoken = vocabulary.sequences[:len(templates)], vocabulary.sequences[len(templates):]
    index = Index(vocabulary, sequences, word_counts(docs, vocabulary), threshold)
    shared = spark.sparkContext.broadcast((vocabulary, index))
    labels, names = [label for label, _ in templates], [label for _, label in phrases]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, index = shared.value
        for pdf in batches:
            n_words, places, blocks = [], [[] for _ in range(len(pdf))], [[] for _ in range(len(pdf))]
            for part in chunks(pdf["text"]):
                base = len(n_words)
                h, first = scanner().words(part)
                n_words.extend(np.diff(first).tolist())
                at, number = vocabulary.find(h)
                for name, sequence in zip(names, spoken):
                    for p in phrase_places(sequence, at, number, first):
                        d = int(np.searchsorted(first, p, side="right")) - 1
                        places[base + d].append({"label": name, "word": int(p - first[d])})
                for d, t, begin, n, common in index.blocks(at, number, first):
                    blocks[base + d].append({"template": t, "label": labels[t], "first_word": begin, "n_words": n,
                                             "overlap": common, "containment": common / len(index.sets[t]), "specific": True})
            for found in blocks:
                for x in found:
                    x["specific"] = not any(
                        index.broader(x["template"], y["template"]) and y["first_word"] < x["first_word"] + x["n_words"]
                        and x["first_word"] < y["first_word"] + y["n_words"] for y in found)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_words": n_words, "places": places, "blocks": blocks})

    return docs.mapInPandas(scan, SCHEMA)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(spark, read(spark, sf_dir, "documents"))
    named = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.col("places.label")
    own = F.transform(F.filter("blocks", lambda b: b["specific"]), lambda b: b["label"])
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        named(base).alias("base_labels"), named(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))).alias("score"),
        F.size("blocks").cast("long").alias("n_blocks"))


ORACLE: dict[str, str] = {}
QUERIES = {"op13_license_scan": op13_license_scan}
