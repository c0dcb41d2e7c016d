"""Byte-level BPE through a lazily determinised finite-state transducer, and streaming decoding.

Two facts about BPE with merge ranks make left-to-right encoding exact: each prefix of the input has
one encoding, and a sequence of tokens is an encoding just if every token and every adjacent pair
encode to themselves. So every place of the input has one last token before it, found when the place
is read: the longest vocabulary entry ending there that may follow the last token at its own start. The
last tokens make a tree of the prefixes' encodings. A place is live while a vocabulary entry could
begin there and go on; an automaton over the vocabulary's trie with failure links names the live places
and the entries that end at a place. What the encodings of all live places and of the end have in common
can't change any more and is emitted, and no output is ever taken back. The transducer reads bytes; a
state is (last emitted token, last tokens of the bytes held back). States and moves are made when
needed for the second time and kept up to a bound. Lookahead is bounded by the longest vocabulary entry.

Arrow numbers the distinct pre-tokens of a batch of texts; the transducer reads each of them once.

A null text is empty: no ids, as is an empty one. Every row is encoded by itself, so repeated rows, ties and
an empty table need no care. A very long text is one list of ids in its worker; decoding never holds
more than a block of ids and the bytes of one unfinished character besides its output.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import small_batches, steady_memory

CACHE_ENTRIES = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_by_rank(ranks: dict[bytes, int], data: bytes, stop: int = 1) -> list[int]:
    """The definition: merge the adjacent pair of lowest rank, leftmost first, until none (or stop parts) is left."""
    return [ranks[p] for p in merged_parts(ranks, data, stop)]


def merged_parts(ranks: dict[bytes, int], data: bytes, stop: int = 1) -> list[bytes]:
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > stop:
        found = [(ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
        best = min((x for x in found if x[0] is not None), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def last_merge(ranks: dict[bytes, int], token: bytes) -> list[bytes]:
    """The two parts that the last merge of a token joins."""
    return merged_parts(ranks, token, 2)


class State:
    """The last emitted token, the last token at each place held back, and the automaton's node at the end."""

    __slots__ = ("before", "last", "node", "moves")

    def __init__(self, before: int, last: tuple[int, ...], node: int):
        self.before, self.last, self.node = before, last, node
        self.moves: dict[int, tuple[State, tuple[int, ...]] | tuple[()]] = {}  # empty: asked for once


class Automaton:
    """Trie of the vocabulary. For a node: goes (by node << 8 | byte; filled in when first needed), the entries that end
    there (id, length), and the lengths of the endings from which an entry could go on; longest first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.goes: dict[int, int] = {}
        self.parent, self.depth, self.token, self.grows = [(0, 0)], [0], [-1], [True]
        for entry, rank in ranks.items():
            node = 0
            for byte in entry:
                to = self.goes.get(node << 8 | byte)
                if to is None:
                    to = self.goes[node << 8 | byte] = len(self.depth)
                    self.parent.append((node, byte))
                    self.depth.append(self.depth[node] + 1)
                    self.token.append(-1)
                    self.grows.append(False)
                    self.grows[node] = True
                node = to
            self.token[node] = rank
        self.fails: list[int | None] = [None] * len(self.depth)
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.depth)
        self.live: list[tuple[int, ...]] = [()] * len(self.depth)

    def fail(self, node: int) -> int:
        """The node of the longest proper ending that is in the trie."""
        if self.fails[node] is None:
            above, byte = self.parent[node]
            self.fails[node] = self.go(self.fail(above), byte) if above else 0
        return self.fails[node]

    def go(self, node: int, byte: int) -> int:
        to = self.goes.get(node << 8 | byte)
        if to is None:
            to = self.goes[node << 8 | byte] = self.go(self.fail(node), byte) if node else 0
        return to

    def look(self, node: int) -> tuple[tuple[int, int], ...]:
        """Fills in and gives the entries that end at a node."""
        ends, live, at = [], [], node
        while at:
            if self.token[at] >= 0:
                ends.append((self.token[at], self.depth[at]))
            if self.grows[at]:
                live.append(self.depth[at])
            at = self.fail(at)
        self.live[node] = tuple(live)
        self.ends[node] = tuple(ends)
        return self.ends[node]


class Transducer:
    """move(state, byte) gives the next state and the tokens emitted; finish(state) the tokens held back."""

    def __init__(self, ranks: dict[bytes, int], entries: int = CACHE_ENTRIES):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.automaton = Automaton(ranks)
        #: rank of what two ids are together, by left << 32 | right
        self.together = {ranks[t[:n]] << 32 | ranks[t[n:]]: i for t, i in ranks.items() for n in range(1, len(t)) if t[:n] in ranks and t[n:] in ranks}
        self.entries = entries
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.reset()

    def reset(self) -> None:
        self.start = State(-1, (), 0)
        self.states: dict[tuple[int, tuple[int, ...]], State] = {(-1, ()): self.start}

    def spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The parts at one edge of a token's merge tree (side 1: right), each with the ranks between which
        merging has it: made at the first (bytes: -1) and merged into a larger part at the second."""
        known = self.spines[side].get(token)
        if known is None:
            known, until, part = [], len(self.ranks) + 1, self.tokens[token]
            while True:
                made = self.ranks[part] if len(part) > 1 else -1
                known.append((self.ranks[part], made, until))
                if len(part) == 1:
                    break
                until, part = made, last_merge(self.ranks, part)[side]
            self.spines[side][token] = known
        return known

    def follows(self, before: int, token: int) -> bool:
        """Whether token may stand after before (-1: at the start) in an encoding: no merge across their
        border comes before the merges that build them. Of equal ranks the left one is merged first."""
        key = before << 32 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * self.entries:
                self.pairs.clear()
            if before < 0:
                known = merge_by_rank(self.ranks, self.tokens[token]) == [token]
            else:
                known = self.follows(-1, token) and not self._crossed(before, token)
            self.pairs[key] = known
        return known

    def _crossed(self, before: int, token: int) -> bool:
        get, rights = self.together.get, self.spine(token, 0)
        for left, made, until in self.spine(before, 1):
            for right, made_2, until_2 in rights:
                rank = get(left << 32 | right)
                if rank is not None and rank < until and rank <= until_2 and max(made, made_2) < min(until, until_2):
                    return True
        return False

    def step(self, before: int, last: tuple[int, ...], node: int, byte: int) -> tuple[int, tuple[int, ...], int, tuple[int, ...]]:
        """(before, last, node) of the state after a byte, and the tokens emitted."""
        auto, pairs = self.automaton, self.pairs
        to = auto.goes.get(node << 8 | byte)
        if to is None:
            to = auto.go(node, byte)
        end = len(last) + 1
        for token, length in auto.ends[to] or auto.look(to):
            left = last[end - length - 1] if end > length else before
            fits = pairs.get(left << 32 | token)
            if fits or (fits is None and self.follows(left, token)):
                break
        else:
            raise ValueError("the vocabulary lacks some byte")
        last = (*last, token)
        live, meet = auto.live[to], end
        if live:
            meet = end - live[0]
            if not meet:  # the first place held back is live
                return before, last, to, ()
            # Where the encodings of all live places and of the end part: walk back from each until they meet.
            size = self.size
            for length in (*live[1:], 0):
                at = end - length
                while at != meet:
                    if at > meet:
                        at -= size[last[at - 1]]
                    else:
                        meet -= size[last[meet - 1]]
            if not meet:
                return before, last, to, ()
        return last[meet - 1], last[meet:], to, self.path(last, meet)

    def move(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The next state and the tokens emitted; from now on known."""
        got = state.moves.get(byte)
        if not got:
            before, last, node, emitted = self.step(state.before, state.last, state.node, byte)
            to = self.states.get((before, last))
            if to is None:
                to = self.states[before, last] = State(before, last, node)
            got = state.moves[byte] = to, emitted
        return got

    def path(self, last: Sequence[int], at: int) -> tuple[int, ...]:
        """The tokens up to a place."""
        out = []
        while at:
            out.append(last[at - 1])
            at -= self.size[last[at - 1]]
        return tuple(out[::-1])

    def finish(self, state: State) -> tuple[int, ...]:
        return self.path(state.last, len(state.last))

    def encode(self, data: bytes) -> list[int]:
        return array("i", self.encode_many([data])[0]).tolist()

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (signed 32-bit) of each piece. Follows known moves. A move asked for the first time is only noted and the
        last bytes of the piece read without making states, as most endings of rare words never come back: the last
        token at each place, then the way back from the end. Asked for again, it is made."""
        if len(self.states) > self.entries:
            self.reset()
            gc.collect()  # states refer to each other
        auto, size, known, follows, move_to, path = self.automaton, self.size, self.pairs.get, self.follows, self.move, self.path
        goes, ends, go, look, start = auto.goes.get, auto.ends, auto.go, auto.look, self.start
        done = []
        for data in pieces:
            out: list[int] = []
            state, i = start, 0
            for byte in data:
                move = state.moves.get(byte)
                if move:
                    state, emitted = move
                elif move is None:
                    state.moves[byte] = ()
                    break
                else:
                    state, emitted = move_to(state, byte)
                i += 1
                if emitted:
                    out += emitted
            if i == len(data):
                out += path(state.last, len(state.last))
            else:
                before, last, node, n = state.before, list(state.last), state.node, len(state.last)
                for byte in data[i:]:
                    to = goes(node << 8 | byte)
                    node = go(node, byte) if to is None else to
                    for token, length in ends[node] or look(node):
                        left = last[n - length] if n >= length else before
                        fits = known(left << 32 | token)
                        if fits or (fits is None and follows(left, token)):
                            break
                    else:
                        raise ValueError("the vocabulary lacks some byte")
                    last.append(token)
                    n += 1
                at = len(out)
                while n:
                    token = last[n - 1]
                    out.insert(at, token)
                    n -= size[token]
            done.append(array("i", out).tobytes())
        return done


#: Classes of bytes in UTF-8 and, per state, the next state: 0 between characters, 1 to 3 so many
#: continuation bytes to come, 4 to 7 after E0, ED, F0, F4 (whose next byte has a narrower range), 8 wrong.
def _utf8_table() -> list[list[int]]:
    table = [[8] * 256 for _ in range(9)]
    for b in range(256):
        table[0][b] = 0 if b < 0x80 else 1 if 0xC2 <= b <= 0xDF else {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}.get(b, 2 if 0xE1 <= b <= 0xEF else 3 if 0xF1 <= b <= 0xF3 else 8)
        if 0x80 <= b <= 0xBF:
            table[1][b], table[2][b], table[3][b] = 0, 1, 2
            table[4][b] = 1 if b >= 0xA0 else 8
            table[5][b] = 1 if b <= 0x9F else 8
            table[6][b] = 2 if b >= 0x90 else 8
            table[7][b] = 2 if b <= 0x8F else 8
    return table


_UTF8 = _utf8_table()
#: Whole characters, many at a time: what leads the machine from between characters to there again.
_WHOLE = re.compile(
    rb"(?:[\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
    rb"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})*+"
)


class TokenTable:
    """The bytes of each id, to be joined for many ids at once."""

    def __init__(self, entries: dict[int, bytes]):
        self.entries = pa.array([entries.get(i) for i in range(max(entries, default=-1) + 1)], pa.large_binary())

    def joined(self, ids) -> bytes:
        """The ids' bytes one after the other; ids: an array of numbers."""
        return self.split(ids)[1]

    def split(self, ids) -> tuple[np.ndarray, bytes]:
        """The ends of the ids' bytes (0 first), and the bytes."""
        found = self.entries.take(pa.array(ids, pa.int32()))
        if found.null_count:
            raise ValueError("an id without a token")
        return np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1], (found.buffers()[2] or pa.py_buffer(b"")).to_pybytes()


class StreamDecoder:
    """Ids in, text out as soon as its characters are whole; bytes that can't be UTF-8 become U+FFFD."""

    def __init__(self, tokens: dict[int, bytes] | TokenTable):
        self.tokens, self.state, self.held = tokens, 0, b""

    def feed(self, ids: Iterable[int]) -> str:
        tokens = self.tokens
        return self.feed_bytes(tokens.joined(ids) if isinstance(tokens, TokenTable) else b"".join([tokens[i] for i in ids]))

    def feed_bytes(self, data: bytes) -> str:
        data = self.held + data
        state, whole, at = self.state, 0, len(self.held)
        while at < len(data):
            if state == 0:
                at = whole = _WHOLE.match(data, at).end()
                if at == len(data):
                    break
            state = _UTF8[state][data[at]]
            if state == 8:
                # The bytes since the last whole character are wrong; a byte that may begin one is read again.
                out, rest = data[:whole].decode() + "\ufffd", data[at:] if at > whole else data[at + 1 :]
                self.state, self.held = 0, b""
                return out + self.feed_bytes(rest) if len(rest) < 256 else "".join([out, *self._slices(rest)])
            at += 1
            if state == 0:
                whole = at
        self.state, self.held = state, data[whole:]
        return data[:whole].decode()

    def _slices(self, data: bytes) -> Iterator[str]:
        """Wrong bytes split a long rest; fed in slices, no nesting grows with it."""
        for i in range(0, len(data), 128):
            yield self.feed_bytes(data[i : i + 128])

    def finish(self) -> str:
        out = "\ufffd" if self.held else ""
        self.state, self.held = 0, b""
        return out


def numbered(pieces: list[str]) -> tuple[pa.DictionaryArray, list[str]]:
    """The pieces by number, and the distinct ones. Joined and split again by Arrow, which is faster than one by one, if
    there is a character to join them by."""
    joined = "\x00".join(pieces)
    if not pieces or joined.count("\x00") >= len(pieces):
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        return coded, coded.dictionary.to_pylist()
    coded = pc.split_pattern(pa.array([joined], pa.large_string()), "\x00").flatten().dictionary_encode()
    apart = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar("\x00", pa.large_string()))
    return coded, apart[0].as_py().split("\x00")


class Codec:
    """A worker's transducer with the ids of pre-tokens already seen, until it forgets them."""

    def __init__(self, path: str, pattern: str, entries: int = CACHE_ENTRIES):
        import regex

        self.transducer = Transducer(load_ranks(path), entries)
        self.find = regex.compile(pattern).findall
        tokens = self.transducer.tokens
        self.bytes_of, self.decimal = TokenTable(tokens), TokenTable({i: b"%d " % i for i in tokens})
        self.entries = entries
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.transducer.reset()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text: Arrow numbers the distinct pre-tokens of all of them, each is looked up once."""
        pieces: list[str] = []
        counts = []
        for text in texts:
            found = self.find(text)
            pieces += found
            counts.append(len(found))
        coded, distinct = numbered(pieces)
        del pieces
        if len(self.seen) > self.entries:
            self.seen, self.older = {}, self.seen
        new = [p for p in distinct if p not in self.seen]
        again = [p for p in new if p in self.older]
        self.seen.update(zip(again, map(self.older.__getitem__, again)))
        new = [p for p in new if p not in self.seen]
        self.seen.update(zip(new, self.transducer.encode_many(list(map(str.encode, new)))))
        ids = pa.array(map(self.seen.__getitem__, distinct), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        whole = np.frombuffer(ids.buffers()[2] or b"", "<i4")
        bounds = (ends[np.cumsum(counts)] // 4).tolist()
        return [whole[a:b] for a, b in zip([0, *bounds], bounds)]

    def encode_text(self, text: str) -> str:
        """The ids in decimal, joined by spaces."""
        return " ".join(map(str, self.encode_batch([text])[0].tolist()))

    def ids_sha256(self, ids: np.ndarray) -> str:
        """Of the ids in decimal, joined by spaces."""
        return hashlib.sha256(memoryview(self.decimal.joined(ids))[: -1 if len(ids) else 0]).hexdigest()

    def decoded_sha256(self, ids: str | np.ndarray, block: int = 4096) -> str:
        """Of the text in UTF-8 that the streaming decoder gives, block ids at a time."""
        row = np.array(ids.split(), np.int32) if isinstance(ids, str) else ids
        stream, sha = StreamDecoder(self.bytes_of), hashlib.sha256()
        for i in range(0, len(row), block):
            sha.update(stream.feed(row[i : i + block]).encode())
        sha.update(stream.finish().encode())
        return sha.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


@contextmanager
def codec(path: str, pattern: str) -> Iterator[Codec]:
    """One per Python worker, vocabulary and pattern, for the length of a task: what it has seen goes at the end."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    with steady_memory():
        try:
            yield _codecs[path, pattern]
        finally:
            _codecs[path, pattern].forget()
            gc.collect()  # states refer to each other


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the ids (array of int) to every row; other columns pass through, but one of that name is replaced."""
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for batch in batches:
                found = own.encode_batch([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int32()))], ["row", "ids"])

    return _beside(docs, F.col(text), "text", encode, "array<int>", "ids", to)


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the ids decode to, through the streaming decoder; null ids give null."""
    small_batches(docs.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for batch in batches:
                out = []
                for row in batch.column("ids").to_pylist():
                    stream = StreamDecoder(own.bytes_of)
                    out.append(None if row is None else "".join([*(stream.feed(row[i : i + 4096]) for i in range(0, len(row), 4096)), stream.finish()]))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "decoded"])

    return _beside(docs, F.col(ids), "ids", decode, "string", "decoded", to)


def _beside(docs: DataFrame, column, name: str, run, kind: str, made: str, to: str) -> DataFrame:
    """Runs an Arrow function over (row, column) and puts what it makes beside the row's other columns."""
    schema = StructType([StructField("row", docs.schema), StructField(made, _parse_datatype_string(kind))])
    found = docs.select(F.struct(*docs.columns).alias("row"), column.alias(name)).mapInArrow(run, schema)
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != to), F.col(made).alias(to))


def codec_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded again by the streaming decoder."""
    small_batches(docs.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(path, pattern) as own:
            for batch in batches:
                ids = own.encode_batch([t or "" for t in batch.column(1).to_pylist()])
                columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array(map(own.ids_sha256, ids), pa.string()), pa.array(map(own.decoded_sha256, ids), pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
