"""Numpy text kernels: word and shingle hashes of whole batches of texts.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, hashed on their UTF-8 bytes.
A word's hash is a polynomial over random byte codes modulo 2^64, read off one running sum
(sum of code * p^i, divided by p^start), then mixed; no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 20  # texts hashed at a time; a longer text makes a chunk of its own
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xC2B2AE3D27D4EB4F
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Keeps the power tables between chunks."""

    def __init__(self) -> None:
        self.codes = byte_codes()
        self.grow(CHUNK_BYTES + (1 << 16))

    def grow(self, n: int) -> None:
        self.pow, self.inv = powers(_P, n), powers(_P_INV, n)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash per word, text number per word, first word of each text and the end, bytes, word starts)."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        a = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8).copy()
        a[(a >= 65) & (a <= 90)] += 32
        solid = (a != 32) & ((a < 9) | (a > 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        if len(a) > len(self.pow):
            self.grow(2 * len(a))
        run = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(self.codes[a] * self.pow[:len(a)], out=run[1:])
        h = mix((run[end] - run[start]) * self.inv[start] + (end - start).astype(np.uint64) * _U(_Q))
        bounds = np.cumsum([len(r) + 1 for r in raw])
        doc = np.searchsorted(bounds, start, side="right")
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        return h, doc, first, a, start

    def shingles(self, texts: list[str], n: int = 5) -> Iterator[np.ndarray]:
        """Sorted distinct hashes of the n-word shingles of each text.  A text of 1 to n-1 words has
        one shingle, its whole sequence; a text without words has none."""
        h, _, first, _, _ = self.words(texts)
        q = powers(_Q | 1, n + 1)
        rows = max(0, len(h) - n + 1)
        full = np.zeros(rows, dtype=np.uint64)
        for j in range(n):
            full += h[j:j + rows] * q[j]
        full = mix(full + q[n])
        for d in range(len(texts)):
            lo, hi = first[d], first[d + 1]
            if hi - lo >= n:
                yield np.unique(full[lo:hi - n + 1])
            elif hi > lo:
                yield mix((h[lo:hi] * q[:hi - lo]).sum(dtype=np.uint64, keepdims=True) + _U(int(hi - lo)))
            else:
                yield np.zeros(0, dtype=np.uint64)


def chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Runs of consecutive texts (None: empty) of about CHUNK_BYTES together; texts are never cut."""
    out, size = [], 0
    for t in texts:
        t = t if isinstance(t, str) else ""
        if out and size + len(t) > CHUNK_BYTES:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out
