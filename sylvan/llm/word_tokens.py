"""Exact and fast encoding with a word-level BPE of the ``tokenizers`` library.

The library's pre-tokenizer never lets a token cross white space and its normaliser works within a
word. So words whose letters lower-case one by one and need no normalisation are cut into pre-tokens
here, by one expression over a whole text; every other word is one piece. Arrow numbers the distinct
pieces of a batch: a pre-token goes to the library's BPE model, a whole word through its whole
pipeline, each once, and the texts' ids are gathered by number. A worker keeps the ids (unsigned
32-bit, little-endian) of recent pieces up to a bound, until its task ends.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import steady_memory

CACHE_PIECES = 200_000
#: ASCII, and Latin-1 letters: one-to-one lower case, already composed.
_PLAIN = re.compile(r"[!-~\xC0-\xD6\xD8-\xF6\xF8-\xFE]*")
_PLAIN_TEXT = re.compile(r"[\t\n\r -~\xC0-\xD6\xD8-\xF6\xF8-\xFE]*")
#: The pre-tokens of a plain lower-case text.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFE]+|[0-9]|[^a-z0-9\xDF-\xF6\xF8-\xFE\t\n\r ]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            table[b] = chr(b)
        else:
            table[b], extra = chr(extra), extra + 1
    return table


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ids = max(self.tokenizer.get_vocab().values()) + 1
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(specials) or "(?!)").search
        self.table = {b: c for b, c in enumerate(byte_alphabet()) if chr(b) != c}
        self.limit = cache_pieces
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """Pre-tokens, and whole words where only the library's pipeline can tell."""
        if _PLAIN_TEXT.fullmatch(text) and not self.special(text):
            return _PIECES.findall(text.lower())
        out = []
        for word in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if _PLAIN.fullmatch(word) and not self.special(word):
                out += _PIECES.findall(word.lower())
            else:
                out.append(word)
        return out

    def learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if _PLAIN.fullmatch(p) and not self.special(p)]
        shown = [p if p.isascii() else p.encode().decode("latin-1").translate(self.table) for p in plain]
        found = [[t.id for t in tokens] for tokens in map(self.model.tokenize, shown)]
        if len(plain) < len(pieces):
            odd = list(set(pieces).difference(plain))
            plain += odd
            found += [x.ids for x in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        ends = (4 * np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))).tolist()
        raw = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        self.known.update(zip(plain, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        pieces, counts = [], []
        for t in texts:
            found = self.cut(t or "")
            pieces += found
            counts.append(len(found))
        if not pieces:
            return [b""] * len(counts)
        joined = pa.array([" ".join(pieces)], pa.large_string())
        del pieces
        coded = pc.split_pattern(joined, " ").flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        new = [p for p in distinct if p not in self.known]
        again = [p for p in new if p in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        self.learn(list(set(new).difference(again)))
        ids = pa.array(map(self.known.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        ends, raw = np.frombuffer(ids.buffers()[1], np.int64), ids.buffers()[2].to_pybytes()
        bounds = ends[np.cumsum(counts)].tolist()
        return [raw[a:b] for a, b in zip([0, *bounds], bounds)]


_encoders: dict[str, WordEncoder] = {}


@contextmanager
def word_encoder(path: str) -> Iterator[WordEncoder]:
    """One encoder per Python worker and vocabulary, for the length of a task: what it has learned goes at the end."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    with steady_memory():
        try:
            yield _encoders[path]
        finally:
            _encoders[path].forget()
