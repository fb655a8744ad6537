"""Exact encoding through caches of whitespace-bounded units, shared by token counts and packing.

No pre-token of the two vocabularies crosses from a non-space character to white space, so a text
is a sequence of units that the library encodes alike alone and in context; each distinct unit is
encoded once per worker while it stays in the cache.
"""

from __future__ import annotations

import os
import re

CACHE_UNITS = 200_000  # entries of a generation of a worker's cache
SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to Python but not to the library


def _byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is
    printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_SYMBOLS = _byte_symbols()


def tokenizer_json(name_or_path: str) -> str:
    """The text of a tokenizer file (read on the driver, sent to the workers; its size is fixed)."""
    path = name_or_path
    if not os.path.exists(path):
        import public_tokenizers
        path = public_tokenizers.path(name_or_path)
    with open(path, encoding="utf-8") as f:
        return f.read()


def make_tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_str(text)
    tok.no_padding()
    tok.no_truncation()
    return tok


class UnitCache:
    """unit -> value, where value is computed from the library's ids of the unit.

    ``plain(word)`` tells whether the library's normaliser leaves a word of letters as it is.  Such
    a word is one pre-token (with the space before it, for a vocabulary that keeps spaces), so the
    library's model encodes it directly; marks after a word are a pre-token of their own.  All else
    goes through the whole library.  Two generations of entries are kept: when the younger is full
    it becomes the elder, and units met again move over.
    """

    def __init__(self, tokenizer, value, plain) -> None:
        self.tok, self.value, self.plain, self.known, self.elder = tokenizer, value, plain, {}, {}
        self.model = tokenizer.model

    def encode(self, texts: list[str]) -> list:
        return [self.value(e.ids) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def word(self, unit: str):
        """The value of letters, or of a space and letters."""
        if unit.isascii():  # letters stand for themselves
            symbols = unit.replace(" ", BYTE_SYMBOLS[32])
        else:
            symbols = unit.encode().decode("latin-1").translate(BYTE_SYMBOLS)
        return self.value([t.id for t in self.model.tokenize(symbols)])

    def learn(self, units: set[str]) -> None:
        """Make every unit known."""
        known, elder, value = self.known, self.elder, None
        marked, todo = [], set()
        for u in units.difference(known):
            value = elder.get(u)
            if value is None:
                stem = u.rstrip(".,;:!?")
                word = stem[1:] if stem[:1] == " " else stem
                if word.isalpha() and self.plain(word):
                    value = known.get(stem)
                    if value is None:
                        value = known[stem] = self.word(stem)
                    if len(stem) < len(u):
                        marked.append((u, value, u[len(stem):]))
                        continue
                else:
                    todo.add(u)
                    continue
            known[u] = value
        todo.update(tail for _, _, tail in marked if tail not in known)
        part = list(todo)
        for i in range(0, len(part), 4096):
            known.update(zip(part[i:i + 4096], self.encode(part[i:i + 4096])))
        for u, value, tail in marked:
            known[u] = value + known[tail]

    def trim(self) -> None:
        if len(self.known) > CACHE_UNITS:
            self.known, self.elder = {}, self.known
