"""Packing by shortest-pack-first over the length histogram.

Every document's ids are cut into pieces of at most ``size`` ids. Only the histogram of piece lengths
(at most ``size`` rows) reaches the driver, where lengths are placed longest first: a length goes to
the pattern with most room, whole counts of a pattern at a time, so the work and the number of patterns
depend on ``size`` and not on the number of documents. Patterns give each length a list of rank
ranges; a piece's rank among its length's pieces then names its sequence and offset. Ranks are counted
per input task and shifted by the counts of the tasks before, so a length that a third of all pieces
share is never gathered. Nulls are empty texts: one end token. No rows give no rows. Each row is a document of its
own, so repeated rows are packed again and ties need no rule. A very long text is cut into as many pieces as it takes.
Only doc_id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written
from .word_tokens import word_encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, local long"


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns (how many sequences, ((length, times), ...)) that hold every length's count exactly."""
    by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # room left -> patterns
    rooms: list[int] = []  # ascending rooms in use
    for length in sorted(counts, reverse=True):
        left = counts[length]
        placed: list[tuple[int, int, tuple]] = []  # not open again for this length: it already took all it can
        while left:
            room = rooms[-1] if rooms else 0
            if room >= length:
                n, pattern = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop()
            else:
                room, n, pattern = size, max(1, left // (size // length)), ()
            # One of this length to each sequence of the pattern; many to each where there are plenty.
            times = max(1, min(room // length, left // n))
            used = min(n, left // times)
            if used < n:
                if not by_room[room]:
                    rooms.insert(bisect_right(rooms, room), room)
                by_room[room].append((n - used, pattern))
            left -= used * times
            placed.append((room - times * length, used, (*pattern, (length, times))))
            if placed[-1][0] >= length or not rooms or rooms[-1] < length:
                for room, n, pattern in placed:
                    if not by_room[room]:
                        rooms.insert(bisect_right(rooms, room), room)
                    by_room[room].append((n, pattern))
                placed = []
        for room, n, pattern in placed:
            if not by_room[room]:
                rooms.insert(bisect_right(rooms, room), room)
            by_room[room].append((n, pattern))
    return [x for room in sorted(by_room) for x in by_room[room]]


def slots_of(patterns: list[tuple[int, tuple]]) -> dict[int, tuple[list[int], list[tuple[int, int, int, int]]]]:
    """Per length: first ranks, and (first rank, first sequence, offset, times) of each range."""
    taken: dict[int, int] = defaultdict(int)
    out: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    first = 0
    for n, pattern in patterns:
        offset = 0
        for length, times in pattern:
            out[length][0].append(taken[length])
            out[length][1].append((taken[length], first, offset, times))
            taken[length] += n * times
            offset += length * times
        first += n
    return dict(out)


def pieces(docs: DataFrame, vocabulary: str, size: int, end_id: int | None) -> DataFrame:
    small_batches(docs.sparkSession)
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_encoder(vocabulary) as encoder:
            part = TaskContext.get().partitionId()
            seen: dict[int, int] = defaultdict(int)
            for batch in batches:
                rows = []
                for k, ids in zip(batch.column(0).to_pylist(), encoder.encode_batch(batch.column(1).to_pylist())):
                    ids += tail
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        raw = ids[4 * start : 4 * (start + size)]
                        rows.append((k, start, len(raw) // 4, zlib.crc32(raw), total, part, seen[len(raw)]))
                        seen[len(raw)] += 1
                columns = zip(*rows) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int | None = 2) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary, size, end_id), "pieces")
    per_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = pack_histogram(counts, size)
    full: list[tuple[int, int]] = []  # first sequence of each pattern, and its tokens
    first = 0
    for n, pattern in patterns:
        full.append((first, sum(length * times for length, times in pattern)))
        first += n
    shared = spark.sparkContext.broadcast((slots_of(patterns), full))  # bounded by size, see pack_histogram

    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_task.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shift"))
    ranked = cut.join(shift, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("shift") + F.col("local")).alias("rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, full = shared.value
        firsts = [x[0] for x in full]
        for batch in batches:
            sequences, offsets, filled, padded = [], [], [], []
            for length, rank in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist()):
                ranks, ranges = slots[length]
                low, sequence, offset, times = ranges[bisect_right(ranks, rank) - 1]
                nth, within = divmod(rank - low, times)
                sequences.append(sequence + nth)
                offsets.append(offset + within * length)
                tokens = full[bisect_right(firsts, sequence + nth) - 1][1]
                filled.append(tokens)
                padded.append(tokens if tokens & (tokens - 1) == 0 else size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array(x, pa.int64()) for x in (sequences, offsets, filled, padded))], names)

    return ranked.mapInArrow(place, ", ".join(f"{n} long" for n in names))
