"""Token alignment against the libraries and a two-pointer walk."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from pawgrid.llm import op11_token_alignment as A
from pawgrid.llm.tokenizing import BYTE_SYMBOLS


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(libraries, text):
    """[(id, bytes)] of A and B, or None."""
    tok, sp = libraries
    if not text:
        return None
    back = {chr(b): b for b in range(256)} | {s: b for b, s in BYTE_SYMBOLS.items()}
    a = [(i, bytes(back[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else None


def walk(pair):
    """Groups [(A ids, B ids)] by two pointers."""
    a, b = pair
    groups, left, right, i, j, pa, pb = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if pa <= pb and i < len(a):
            left.append(a[i][0])
            pa += len(a[i][1])
            i += 1
        else:
            right.append(b[j][0])
            pb += len(b[j][1])
            j += 1
        if pa == pb:
            groups.append((left, right))
            left, right = [], []
    return groups


def brute(libraries, rows):
    found = [(d, t, g, walk(g) if g else []) for d, t in rows for g in [tokens(libraries, t)]]
    count = Counter((a[-1], b[-1]) for *_, groups in found for a, b in groups)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for d, _, g, groups in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((d, len(g[0]) if g else 0, len(g[1]) if g else 0, len(groups), len(links), sum(count[p] == best[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
                   for r in df.collect()), key=str)


def test_query_equals_the_libraries(spark, sf, texts, libraries):
    assert got(entry.queries()["op11_token_alignment"](spark, sf)) == brute(libraries, texts.items())


@pytest.mark.parametrize("piece, table_pairs", [(1, 1), (7, 3), (64, 50), (1 << 15, 1 << 16)])
def test_pieces_are_stitched_wherever_they_are_cut(spark, libraries, texts, piece, table_pairs):
    rows = [(i, t[:400]) for i, t in sorted(texts.items())[:30]]
    rows += [(100, "a"), (101, " "), (102, "  \n\n x"), (103, "日本語 <|endoftext|> <s> ½ ﬁ"), (104, "▁ is lost"), (105, None), (106, ""),
             (107, "é" * 50), (107, "é" * 50), (None, "nobody's text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(A.token_alignment(spark, docs, piece=piece, table_pairs=table_pairs)) == brute(libraries, rows)


def test_diagonals_divide_the_work_evenly():
    rng = np.random.default_rng(1)
    for n, m, step in ((0, 0, 4), (1, 5, 2), (300, 200, 16), (50, 500, 33)):
        a, b = (np.cumsum(rng.integers(1, 4, size=k)) for k in (n, m))
        i, j = A.diagonals(a, b, step)
        assert (np.diff(i + j)[:-1] == step).all() and (i[-1], j[-1]) == (n, m)
        both = sorted([(e, 0) for e in a] + [(e, 1) for e in b])
        for x, y in zip(i, j):
            first = both[:x + y]
            assert (sum(s == 0 for _, s in first), sum(s == 1 for _, s in first)) == (x, y)


@pytest.mark.parametrize("piece", [1, 5, 1 << 15])
def test_overlaps(spark, libraries, texts, piece):
    rows = [(i, t[:300]) for i, t in sorted(texts.items())[:8]] + [(90, None), (91, "x▁y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for d, t in rows:
        pair = tokens(libraries, t)
        if pair:
            spans = []
            for side in pair:
                at, out = 0, []
                for k, (i, raw) in enumerate(side):
                    out.append((k, i, at, at + len(raw)))
                    at += len(raw)
                spans.append(out)
            for k, i, s, e in spans[0]:
                for q, o, u, v in spans[1]:
                    if max(s, u) < min(e, v):
                        want.add((d, k, i, q, o, max(s, u), min(e, v) - max(s, u), e == v))
    assert {tuple(r) for r in A.overlaps(spark, docs, piece=piece).collect()} == want


def test_edges(spark, odd, nothing, libraries):
    assert A.token_alignment(spark, nothing).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(A.token_alignment(spark, odd)) == brute(libraries, rows)
