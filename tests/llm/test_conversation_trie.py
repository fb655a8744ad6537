"""Conversation prefix trie against brute force over whole conversations."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from pawgrid.llm.op12_conversation_trie import conversation_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tie(role, text):
    h = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return int(h[:15], 16), int(h[15:30], 16)


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0, *tie(role, text)), (role, text)))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                children[tuple(seq[:d - 1])].add(tuple(seq[:d]))
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        kids = children[node]
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = sum(saved[k] for k in kids) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    out = entry.queries()["op12_conversation_trie"](spark, sf)
    assert out.columns == COLUMNS
    assert got(out) == brute([tuple(r) for r in rows])


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


@pytest.mark.parametrize("band", [2, 3, 16])
def test_deep_and_shared_conversations(spark, band):
    """Conversations of up to 90 turns that leave each other at any depth; hash blocks of 8 turns."""
    rng = np.random.default_rng(band)
    trunk = [("user" if i % 2 else "bot", f"turn {i} é" * (i % 4)) for i in range(90)]
    rows = []
    for c in [*range(0, 40), *range(300, 330), 5000, 9999, 70_000]:
        keep = int(rng.integers(0, 90))
        seq = trunk[:keep] + [("user", f"own {c % 7} {i}") for i in range(int(rng.integers(0, 6)))]
        rows += [(c, i, *t) for i, t in enumerate(seq)]
    assert got(conversation_trie(spark, table(spark, rows), band=band, block=8)) == brute(rows)


def test_one_conversation_of_a_third_of_all_rows_and_ties(spark):
    """A long conversation (equal turn numbers and repeated rows among them) and many equal copies."""
    rows = [(100, i // 3, "user", f"t{i % 5}") for i in range(600)] + [(100, None, "user", "first")] * 3
    rows += [(c, t, "user", f"hello {t}") for c in range(200, 9000, 9) for t in range(2)]
    rows += [(c, None, None, None) for c in range(9000, 9020)] + [(None, 1, "user", "nobody")] * 2
    assert got(conversation_trie(spark, table(spark, rows), band=4, block=16)) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert conversation_trie(spark, table(spark, [])).collect() == []
    rows = [(7, 0, "user", ""), (7, 1, None, "x" * 20_000), (8, 0, "", None)]
    odd = table(spark, rows).selectExpr("*", "1 AS depth", "'a' AS x1", "2 AS pos", "3 AS part", "'z' AS gid", "null AS block")
    assert got(conversation_trie(spark, odd)) == brute(rows)
