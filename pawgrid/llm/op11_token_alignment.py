"""Operator 11: alignment of two tokenizers' tokens by merge-path partitioning.

A text's tokens of A and of B cover the same bytes; their end offsets are two rising lists.  Merging
the lists is work that binary searches on the diagonals of the merge grid divide into pieces of
``piece`` steps each: on diagonal s, the first s merged ends are i of A and s - i of B, and i is found by
bisection.  A piece needs nothing but its slices and the end just before them.  It emits the overlaps
(byte ranges that one A token and one B token share) and the cuts (offsets where both end); equal ends
count for A first, so a cut belongs to the piece that holds its B end, also if the A end is the
last of the piece before.

Short texts lie in a row in one pair of lists, as all bytes of a text are covered by both.  The pieces
of a text longer than one are rows of their own, spread over the cluster, and give fragments: tokens
before the first cut, whole groups, tokens after the last cut.  Fragments are stitched in the order
of the pieces, as a stream.

Corpus-wide counts: a document hands over its linked id pairs with their numbers.  The pairs
are summed over the corpus; the most frequent ``TABLE_PAIRS`` are broadcast and looked up where the
documents are, the others are joined by pair, so no common pair crosses the network twice.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import read, stage, worker_state
from pawgrid.llm.kernels import chunks
from pawgrid.llm.tokenizing import BYTE_SYMBOLS, make_tokenizer, tokenizer_json

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
PIECE = 1 << 15        # merge steps of a piece
TABLE_PAIRS = 1 << 16  # id pairs whose counts are broadcast
ID_BITS = 32           # of the B id in a pair


# ----------------------------------------------------------------------------------------------
# Tokenizers
# ----------------------------------------------------------------------------------------------
class ByteLevel:
    """Tokenizer A: byte-level BPE of a tokenizer file, special strings inside texts as plain text.

    Where the file's merges stand in the order of their ids and its splitting is the default one of
    byte-level BPE, the same vocabulary runs in the faster library; else in the file's own."""

    def __init__(self, source: str, pattern: str) -> None:
        body = json.loads(source)
        vocabulary = body["model"]["vocab"]
        back = {chr(b): b for b in range(256)} | {symbol: b for b, symbol in BYTE_SYMBOLS.items()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1 + len(body.get("added_tokens") or []))
        special = {t["content"] for t in body.get("added_tokens") or []}
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in special else bytes(back[c] for c in token)
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in body["model"]["merges"]]
        split = body.get("pre_tokenizer") or {}
        default = (split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
                   and not body.get("normalizer") and merged == sorted(merged) and not body["model"].get("ignore_merges"))
        if default:
            import tiktoken
            ranks = {self.bytes[i]: i for t, i in vocabulary.items() if t not in special}
            fast = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [np.asarray(fast.encode_ordinary(t), dtype=np.int64) for t in texts]
        else:
            slow = make_tokenizer(source)
            slow.encode_special_tokens = True
            self.encode = lambda texts: [np.asarray(e.ids, dtype=np.int64) for e in slow.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a sentencepiece model with byte fallback; it adds the space before the text."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(sp.get_piece_size())]
        self.encode = lambda texts: [np.asarray(ids, dtype=np.int64) for ids in sp.encode(texts, num_threads=1)]


class Sides:
    """Both tokenizers with their tables; one per Python worker."""

    def __init__(self, files: tuple[str, bytes, str]) -> None:
        self.a, self.b = ByteLevel(files[0], files[2]), Pieces(files[1])
        self.a_len, self.b_len = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b))
        n = max(len(self.a_len), len(self.b_len))
        self.text = [f"{i}{c}" for i in range(n) for c in ",|;"]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(A ids, B ids) per text; None for those without tokens."""
        spaced = [" " + t for t in texts]
        out: list = []
        for text, a, b in zip(spaced, self.a.encode(spaced), self.b.encode(texts)):
            raw = text.encode("utf-8", "surrogatepass")
            same = len(raw) > 1 and all(
                b"".join(map(t.bytes.__getitem__, ids.tolist())) == raw for t, ids in ((self.a, a), (self.b, b)))
            same = same and self.a_len[a].all() and self.b_len[b].all()  # a token without bytes has no place
            out.append((a, b) if same else None)
        return out


def token_files(a: str, b: str) -> tuple[str, bytes, str]:
    """The files of both tokenizers and the splitting pattern (read on the driver; of fixed size)."""
    import public_tokenizers
    with open(b if os.path.exists(b) else public_tokenizers.path(b), "rb") as f:
        return tokenizer_json(a), f.read(), public_tokenizers.PATTERN


# ----------------------------------------------------------------------------------------------
# Merge path
# ----------------------------------------------------------------------------------------------
def diagonals(a_end: np.ndarray, b_end: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge stands every ``piece`` steps: so many ends of A and of B are before (equal: A first)."""
    n, m = len(a_end), len(b_end)
    s = np.append(np.arange(0, n + m, piece), n + m)
    low, high = np.maximum(0, s - m), np.minimum(s, n)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        taken = np.zeros(len(s), dtype=bool)
        taken[open_] = a_end[mid[open_]] <= b_end[s[open_] - mid[open_] - 1]
        low = np.where(open_ & taken, mid + 1, low)
        high = np.where(open_ & ~taken, mid, high)
    return low, s - low


def merge_piece(a_end: np.ndarray, b_end: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece from its slices and the merged end ``before`` it (-1: at the beginning).

    Gives overlaps as rows (A index, B index, first byte, end) and the cuts' A and B counts: how many
    tokens of the slices are at or before each cut (0 of A: the A token ended the piece before)."""
    ends = np.concatenate([a_end, b_end])
    order = np.argsort(ends, kind="stable")
    ends = ends[order]
    of_a = order < len(a_end)
    seen_a = np.cumsum(of_a)
    seen_b = np.arange(1, len(ends) + 1) - seen_a
    previous = np.concatenate([[before], ends[:-1]])
    fresh, cut = ends > previous, ends == previous
    overlaps = np.stack([(seen_a - of_a)[fresh], (seen_b - ~of_a)[fresh], np.maximum(previous, 0)[fresh], ends[fresh]])
    return overlaps, seen_a[cut], seen_b[cut], ends[cut]


def merged(a_end: np.ndarray, b_end: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of two whole lists put together: overlaps, and the cuts' A and B counts."""
    i, j = diagonals(a_end, b_end, piece)
    parts = []
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:]):
        overlaps, cut_a, cut_b, _ = merge_piece(a_end[i0:i1], b_end[j0:j1], last_end(a_end, b_end, i0, j0))
        overlaps[0] += i0
        overlaps[1] += j0
        parts.append((overlaps, cut_a + i0, cut_b + j0))
    if not parts:
        return np.zeros((4, 0), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x, axis=-1) for x in zip(*parts))


def last_end(a_end: np.ndarray, b_end: np.ndarray, i: int, j: int) -> int:
    return max(int(a_end[i - 1]) if i else -1, int(b_end[j - 1]) if j else -1)


def written(text: list[str], a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The tokens as text, A before B in each group, with the mark that follows each; tokens up to each cut.

    Tokens beyond the last cut are left out."""
    sizes_a, sizes_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    a, b = a[:cut_a[-1]], b[:cut_b[-1]]
    mark_a, mark_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    mark_a[cut_a - 1], mark_b[cut_b - 1] = 1, 2
    out = np.empty(len(a) + len(b), dtype=np.int64)
    out[np.arange(len(a)) + np.repeat(cut_b - sizes_b, sizes_a)] = 3 * a + mark_a
    out[np.arange(len(b)) + np.repeat(cut_a, sizes_b)] = 3 * b + mark_b
    return list(map(text.__getitem__, out.tolist())), cut_a + cut_b


def linked_pairs(a: np.ndarray, b: np.ndarray, owner: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct (A id << 32 | B id) of each of n owners, with their numbers."""
    pair, code = np.unique((a << ID_BITS) | b, return_inverse=True)
    mine, times = np.unique(owner * max(len(pair), 1) + code, return_counts=True)
    whose = mine // max(len(pair), 1)
    at = np.searchsorted(whose, np.arange(n + 1))
    value = pair[mine - whose * max(len(pair), 1)] if len(pair) else pair
    return [(value[lo:hi], times[lo:hi].astype(np.int32)) for lo, hi in zip(at[:-1], at[1:])]


# ----------------------------------------------------------------------------------------------
# Documents
# ----------------------------------------------------------------------------------------------
ALIGNED = "rid long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
CUT = "piece int, before long, a binary, b binary, a_start long, b_start long"
FRAGMENT = "rid long, piece int, n_a long, n_b long, n_groups long, head_a string, head_b string, body string, tail_a string, tail_b string, " \
           "pairs array<long>, times array<int>"


def _short(sides: Sides, tokens: list[tuple[np.ndarray, np.ndarray]], piece: int) -> list[tuple]:
    """(n_a, n_b, n_groups, groups_sha256, pairs, times) of texts that lie in a row."""
    a, b = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
    a_end, b_end = np.cumsum(sides.a_len[a]), np.cumsum(sides.b_len[b])
    _, cut_a, cut_b = merged(a_end, b_end, piece)
    last_a = np.cumsum([len(t[0]) for t in tokens])  # the end of a text is a cut
    group_end = np.searchsorted(cut_a, last_a)
    flat, upto = written(sides.text, a, b, cut_a, cut_b)
    owner = np.repeat(np.arange(len(tokens)), np.diff(group_end, prepend=-1))
    pairs = linked_pairs(a[cut_a - 1], b[cut_b - 1], owner, len(tokens))
    out, lo, groups = [], 0, 0
    for (x, y), g, (pair, times) in zip(tokens, group_end.tolist(), pairs):
        hi = int(upto[g])
        digest = hashlib.sha256("".join(flat[lo:hi])[:-1].encode()).hexdigest()
        out.append((len(x), len(y), g + 1 - groups, digest, pair, times))
        lo, groups = hi, g + 1
    return out


def _cut(sides: Sides, a: np.ndarray, b: np.ndarray, piece: int) -> Iterator[tuple]:
    """The pieces of a long text: (piece, before, A ids, B ids, byte starts); the A ids begin with the one before (0 at the beginning)."""
    a_end, b_end = np.cumsum(sides.a_len[a]), np.cumsum(sides.b_len[b])
    i, j = diagonals(a_end, b_end, piece)
    for p, (i0, i1, j0, j1) in enumerate(zip(i[:-1], i[1:], j[:-1], j[1:])):
        head = np.concatenate([a[i0 - 1:i0] if i0 else [0], a[i0:i1]]).astype("<i4")
        yield (p, last_end(a_end, b_end, i0, j0), head.tobytes(), b[j0:j1].astype("<i4").tobytes(),
               int(a_end[i0 - 1]) if i0 else 0, int(b_end[j0 - 1]) if j0 else 0)


def _fragment(sides: Sides, before: int, a_blob: bytes, b_blob: bytes, a_start: int, b_start: int) -> tuple:
    """What a piece hands over to be stitched."""
    lead, b = np.frombuffer(a_blob, dtype="<i4").astype(np.int64), np.frombuffer(b_blob, dtype="<i4").astype(np.int64)
    a = lead[1:]
    _, cut_a, cut_b, _ = merge_piece(a_start + np.cumsum(sides.a_len[a]), b_start + np.cumsum(sides.b_len[b]), before)
    plain = lambda ids: "".join(sides.text[3 * i] for i in ids.tolist())
    if not len(cut_a):
        return len(a), len(b), 0, plain(a), plain(b), None, "", "", [], []
    (pair, times), = linked_pairs(lead[cut_a], b[cut_b - 1], np.zeros(len(cut_a), dtype=np.int64), 1)
    x, y = cut_a[0], cut_b[0]
    body = ""
    if len(cut_a) > 1:
        flat, _ = written(sides.text, a[x:], b[y:], cut_a[1:] - x, cut_b[1:] - y)
        body = "".join(flat)
    return (len(a), len(b), len(cut_a), plain(a[:x]), plain(b[:y]), body, plain(a[cut_a[-1]:]), plain(b[cut_b[-1]:]), pair, times)


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fragments, sorted by text and piece, to one row a text."""
    rid, sha, sums, left, right = None, None, None, "", ""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if row.rid != rid:
                if sha:
                    out.append((rid, *sums, sha.hexdigest()))
                rid, sha, sums, left, right = row.rid, hashlib.sha256(), (0, 0, 0), "", ""
            left, right = left + row.head_a, right + row.head_b
            if row.n_groups:
                group = f"{left[:-1]}|{right[:-1]};{row.body}"[:-1]
                sha.update((";" if sums[2] else "").encode() + group.encode())
                left, right = row.tail_a, row.tail_b
            sums = (sums[0] + row.n_a, sums[1] + row.n_b, sums[2] + row.n_groups)
        yield pd.DataFrame(out, columns=["rid", "n_a", "n_b", "n_groups", "groups_sha256"])
    if sha:
        yield pd.DataFrame([(rid, *sums, sha.hexdigest())], columns=["rid", "n_a", "n_b", "n_groups", "groups_sha256"])


def aligned_documents(spark: SparkSession, docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B,
                      piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(documents, links): ``documents`` has rid (a row number), doc_id, n_a, n_b, n_groups, groups_sha256;
    ``links`` has rid, pairs, times: the linked id pairs (A id << 32 | B id) and how often they are linked.

    ``links`` may hold several rows of a text, each for some of its bytes."""
    files = spark.sparkContext.broadcast(token_files(a, b))
    key = f"aligned_{a}_{b}"
    empty = np.zeros(0, dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = worker_state(key, lambda: Sides(files.value))
        columns = [c.split()[0] for c in f"{ALIGNED}, {CUT}".split(", ")]
        for pdf in batches:
            at = 0
            for part in chunks(pdf["text"]):
                rid, doc_id = pdf["rid"].to_numpy()[at:at + len(part)], pdf["doc_id"].astype("Int64").iloc[at:at + len(part)]
                at += len(part)
                out, short = [], []
                for r, d, t in zip(rid, doc_id, sides.tokens(part)):
                    if t is None:
                        out.append((r, d, 0, 0, 0, "", empty, empty, *[None] * 6))
                    elif len(t[0]) + len(t[1]) <= piece:
                        short.append((r, d, t))
                    else:
                        out.extend((r, d, 0, 0, 0, None, empty, empty, *c) for c in _cut(sides, *t, piece))
                if short:
                    done = _short(sides, [t for _, _, t in short], piece)
                    out.extend((r, d, *row, *[None] * 6) for (r, d, _), row in zip(short, done))
                frame = pd.DataFrame(out, columns=columns)
                for c in ("doc_id", "piece", "before", "a_start", "b_start"):
                    frame[c] = frame[c].astype("Int64")
                yield frame

    def fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = worker_state(key, lambda: Sides(files.value))
        columns = [c.split()[0] for c in FRAGMENT.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([(r.rid, r.piece, *_fragment(sides, r.before, r.a, r.b, r.a_start, r.b_start))
                                for r in pdf.itertuples(index=False)], columns=columns)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stage(spark, rows.mapInPandas(run, f"{ALIGNED}, {CUT}"), "aligned")
    whole = first.where(F.col("piece").isNull())
    cut = first.where(F.col("piece").isNotNull())
    parts = stage(spark, cut.select("rid", *[c.split()[0] for c in CUT.split(", ")]).repartition("rid", "piece")
                  .mapInPandas(fragments, FRAGMENT), "fragments")
    stitched = (parts.drop("pairs", "times").repartition("rid").sortWithinPartitions("rid", "piece")
                .mapInPandas(_stitch, "rid long, n_a long, n_b long, n_groups long, groups_sha256 string")
                .join(cut.where(F.col("piece") == 0).select("rid", "doc_id"), "rid"))
    columns = ["rid", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    return (whole.select(*columns).unionByName(stitched.select(*columns)),
            whole.select("rid", "pairs", "times").unionByName(parts.select("rid", "pairs", "times")))


def pair_counts(spark: SparkSession, links: DataFrame) -> DataFrame:
    """pair, count, best: how many links of the corpus hold the pair, and whether no pair of its B id has more."""
    pairs = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = stage(spark, pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # a row per B id: bounded by the vocabulary
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def token_alignment(spark: SparkSession, docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, piece: int = PIECE,
                    table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs``.

    Texts that are null or empty, or whose tokens' bytes differ from the text after a space (or that have
    a token without bytes), have no tokens: zeros and ''.  Repeated rows and null doc_ids keep a row
    each and count each; other columns are ignored; an empty table gives no rows.  Every token has
    bytes, so each group's end is one link."""
    documents, links = aligned_documents(spark, docs, a, b, piece)
    counts = stage(spark, pair_counts(spark, links), "counts")
    frequent = F.broadcast(counts.orderBy(F.desc("count"), "pair").limit(table_pairs))  # a fixed size
    each = links.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("rid", F.col("p.pairs").alias("pair"), "p.times")
    sums = lambda df: df.groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    near = sums(each.join(frequent, "pair"))
    rare = sums(each.join(frequent, "pair", "left_anti").join(counts, "pair"))
    total = near.unionByName(rare).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return documents.join(total, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


OVERLAP = "doc_id long, a_index long, a_id long, b_index long, b_id long, first_byte long, n_bytes long, ends_both boolean"


def overlaps(spark: SparkSession, docs: DataFrame, a: str = TOKENIZER_A, b: str = TOKENIZER_B, piece: int = PIECE) -> DataFrame:
    """One row per byte range that an A token and a B token share (offsets in space + text); ``ends_both``
    marks the links.  Texts without tokens have no rows."""
    files = spark.sparkContext.broadcast(token_files(a, b))
    columns = [c.split()[0] for c in OVERLAP.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = worker_state(f"aligned_{a}_{b}", lambda: Sides(files.value))
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                for t in sides.tokens([text if isinstance(text, str) else ""]):
                    if t is None:
                        continue
                    a_end, b_end = np.cumsum(sides.a_len[t[0]]), np.cumsum(sides.b_len[t[1]])
                    (i, j, start, end), _, _ = merged(a_end, b_end, piece)
                    frame = pd.DataFrame(dict(zip(columns, (doc_id, i, t[0][i], j, t[1][j], start, end - start, (a_end[i] == end) & (b_end[j] == end)))))
                    frame["doc_id"] = frame["doc_id"].astype("Int64")
                    yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, OVERLAP)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(spark, read(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op11_token_alignment": op11_token_alignment}
