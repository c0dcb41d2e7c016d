"""Blocks of documents as numbered words, and the packed messages that blocks and dictionaries exchange.

A block is what one Arrow batch held: its documents' ids and word counts, its distinct words in order, and the numbers
of all words in turn. Blocks are written once; later passes read numbers, not texts. Words are runs of chosen bytes,
lower-cased in A-Z only, so every step on them is an array operation over the bytes of the whole batch.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, steady_memory, written

#: Bytes of words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text, and [^\x20\x09-\x0D]+.
ALNUM = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
VISIBLE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
BLOCK = "block long, ks array<long>, n array<long>, words binary, ids binary"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def listed(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Strings from their bytes, which stand one after the other."""
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of an array of large strings."""
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(strings) else np.zeros(0, np.uint8)
    return at - at[0], data


def joined(strings: pa.Array) -> bytes:
    """Strings without line feeds, as lines."""
    if not len(strings):
        return b""
    at, data = raw(strings)
    out = np.full(len(data) + len(strings) - 1, 10, np.uint8)
    line = np.ones(len(out), bool)
    line[at[1:-1] + np.arange(len(strings) - 1)] = False
    out[line] = data
    return out.tobytes()


def lines(text: bytes, n: int) -> pa.Array:
    """What joined was given: n strings."""
    if not n:
        return pa.array([], pa.large_string())
    data = np.frombuffer(text, np.uint8)
    line = data != 10
    ends = np.r_[np.flatnonzero(~line), len(data)] - np.arange(n)
    return listed(np.r_[0, ends], data[line])


def numbers(x: np.ndarray) -> bytes:
    """Numbers under 2 ** 32, byte by byte: like bytes stand together."""
    return np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unnumbers(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(kind)


def packed(*parts: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(b"".join([np.array([len(parts), *map(len, parts)], "<u8").tobytes(), *parts]))


def unpacked(data: bytes) -> list[bytes]:
    import zstandard

    whole = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n = int(np.frombuffer(whole[:8], "<u8")[0])
    ends = 8 + 8 * n + np.r_[0, np.cumsum(np.frombuffer(whole[8 : 8 + 8 * n], "<u8").astype(np.int64))]
    return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def words_of(texts: pa.Array, kept: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in turn, lower-cased; the number of words before each text and at the end)."""
    at, data = raw(texts.cast(pa.large_string()))
    low = _LOWER[data]
    inside = kept[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # no word goes over the end of a text
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    return listed(np.r_[0, np.cumsum(ends - starts)], low[inside]), np.searchsorted(starts, at)


@dataclass
class Block:
    block: int
    ks: list[int | None]
    n: np.ndarray
    words: pa.Array
    ids: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        """64 bits of each distinct word."""
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, joined(self.words).split(b"\n")), np.uint64, len(self.words)) if len(self.words) else np.zeros(0, np.uint64)


def numbered(block: int, ks: pa.Array, texts: pa.Array, kept: np.ndarray, end: bool) -> Block:
    """With end every text has the empty word after its last."""
    words, at = words_of(texts, kept)
    found = words.dictionary_encode()
    ids, distinct = found.indices.to_numpy(), found.dictionary
    order = pc.sort_indices(distinct).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    ids, distinct, n = place[ids], distinct.take(pa.array(order)), np.diff(at)
    if end:
        ids = np.insert(ids + 1, at[1:], 0)
        distinct, n = pa.concat_arrays([pa.array([""], pa.large_string()), distinct]), n + 1
    return Block(block, ks.to_pylist(), n, distinct, ids)


def row(b: Block) -> dict:
    return {"block": b.block, "ks": b.ks, "n": b.n.tolist(), "words": packed(joined(b.words), numbers(np.array([len(b.words)]))), "ids": packed(numbers(b.ids))}


def block_of(block: int, ks: list, n: list, words: bytes, ids: bytes) -> Block:
    text, count = unpacked(words)
    return Block(block, ks, np.array(n, np.int64), lines(text, int(unnumbers(count)[0])), unnumbers(unpacked(ids)[0], np.int32))


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The blocks of batches whose columns are those of BLOCK."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield block_of(*(batch.column(i)[k].as_py() for i in range(5)))


def blocks(docs: DataFrame, kept: np.ndarray, end: bool, doc_id: str, text: str, more: str = "", extra: Callable[[Block], dict] | None = None, size: str = "16m") -> DataFrame:
    """The table of blocks, written; more: further columns, which extra gives. A null text is empty. A batch ends at so many
    bytes; a longer text is a block of its own, the one thing that has to fit in memory."""
    small_batches(docs.sparkSession, rows=1_000_000, size=size)
    schema = BLOCK + more

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory(arrays=True):
            part = TaskContext.get().partitionId()
            names = pa.schema([("block", pa.int64()), ("ks", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("words", pa.binary()), ("ids", pa.binary())])
            for i, batch in enumerate(batches):
                b = numbered(part << 32 | i, batch.column(0), batch.column(1), kept, end)
                found = row(b)
                columns = [pa.array([found[f.name]], f.type) for f in names]
                also = extra(b) if extra else {}
                yield pa.RecordBatch.from_arrays([*columns, *also.values()], [*names.names, *also])

    out = written(docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(rows, schema), "blocks")
    small_batches(docs.sparkSession, rows=64, size=size)
    return out


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(key, its rows) for rows sorted by their first column; a key's rows are taken before the next key."""
    from itertools import groupby

    rows = (tuple(c[k].as_py() for c in batch.columns) for batch in batches for k in range(batch.num_rows))
    yield from groupby(rows, key=lambda r: r[0])


def forget(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
