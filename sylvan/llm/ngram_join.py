"""N-gram Jaccard join by token-combination prefixes, and its components.

A document is the set of its shingles (``width`` words, ASCII letters in lower case), hashed to 64 bits.
Two link when 100 |A & B| >= percent |A | B|; so of n shingles at most e = floor(n (100 - percent) / 100) may be
missing from the partner. All shingles have one global order: class 1 (rare) by hash, then class 2
(frequent) by hash. A prefix is extended until (class-1 shingles) + sum over buckets of max(0, class-2
shingles in it - 1) exceeds e. Of two linked documents take the one whose prefix ends first: its shared
shingles lie in both prefixes, and as at most e of them are not shared, some class-1 shingle or two
class-2 shingles of one bucket are. So single rare shingles and pairs of frequent ones in a bucket
are indexed, nothing else. Buckets keep the number of pairs near half of n; their number follows the
size band (factor 100 / percent), and as linked sizes are in the same or the next band, a document
indexes pairs for its own and the next.

Which shingles are frequent is read from one counting sketch of fixed size over all documents; any
answer gives the same links, a good one fewer candidates.

Candidates are verified without listing all pairs of a group. First each document meets the smallest
document of its index entries, the one it shares most entries with; verified links give components.
Then every pair of an entry whose documents are in different components is tested: those inside one
component can change nothing. Sizes, the number and places of shared entries, and a parity bitmap (512
bits) bound the overlap from above and drop pairs that can't link; the rest is intersected exactly. Pair tests and results refer to doc_id: rows
with one doc_id count as one document (linked if any of its texts is); rows with a null doc_id have
a null component. Null or wordless texts have no shingles and no links. A very long text is one set in its
task. An empty table gives no rows. Only doc_id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steady_memory, whole_text, written
from .components import components

WIDTH, PERCENT = 5, 75
SKETCH_BITS = 20
BLOOM_BITS = 23
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out += _mix(h[i : len(words) - n + 1 + i] + _MULTIPLY[i % 8] * np.uint64(i // 8 + 1)) * _MULTIPLY[i % 8]
    return np.unique(_mix(out + np.uint64(n)))


def missing_allowed(n: int, percent: int = PERCENT) -> int:
    return n * (100 - percent) // 100


class Bands:
    """Ascending least sizes of the bands, each at least 100 / percent times the one before."""

    def __init__(self, percent: int = PERCENT):
        self.least, at = [1], Fraction(1)
        while self.least[-1] < 1 << 40:
            at = at * 100 / percent
            self.least.append(-(-at.numerator // at.denominator))

    def of(self, n: int) -> int:
        return bisect_right(self.least, n) - 1

    def buckets(self, band: int) -> int:
        return max(1, self.least[band] // 8)


def index_entries(tokens: np.ndarray, frequent: np.ndarray, bands: Bands, percent: int = PERCENT) -> tuple[np.ndarray, bool]:
    """The 64-bit index entries of one document, and whether they are single shingles in order, the k-th being
    the k-th of all its shingles; frequent: which of its ascending tokens are class 2."""
    n = len(tokens)
    need = missing_allowed(n, percent) + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need], True
    out = [rare]
    common = tokens[frequent]
    for band in (bands.of(n), bands.of(n) + 1):
        bucket = (common & np.uint64(0x3FFFFFFF)) % np.uint64(bands.buckets(band))
        # The prefix ends where the shingles beyond the first of each bucket make up what is still needed.
        first = np.zeros(len(common), bool)
        first[np.unique(bucket, return_index=True)[1]] = True
        enough = np.searchsorted(np.cumsum(~first), need - len(rare), "left") + 1
        t, b = common[:enough], bucket[:enough]
        order = np.lexsort((t, b))
        t, b = t[order], b[order]
        for apart in range(1, len(t)):
            same = b[apart:] == b[:-apart]
            if not same.any():
                break
            out.append(_mix(t[:-apart][same] * np.uint64(0x9E3779B97F4A7C15) + _mix(t[apart:][same]) + np.uint64(band)))
    return np.unique(np.concatenate(out)), False


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def parity(tokens: np.ndarray) -> np.ndarray:
    bits = (np.bincount((tokens & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


_FACTS = "doc_id long, n int, digest binary, block int, counts binary, " + ", ".join(f"b{i} long" for i in range(8))


def document_facts(docs: DataFrame, width: int) -> DataFrame:
    """A row per document (n, digest, bitmap), and per task rows of its sketch (block, counts)."""
    names = [c.split()[0] for c in _FACTS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), *[pa.int64()] * 8]

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            sketch = np.zeros(1 << SKETCH_BITS, np.int64)
            passed: set[bytes] = set()
            for batch in batches:
                n, digests, maps, counted = [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingles(text, width)
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    n.append(len(s))
                    digests.append(digest)
                    maps.append(parity(s))
                    if digest not in passed:  # copies within a task count once
                        counted.append(s)
                        if len(passed) < 200_000:  # only saves work: copies that get by are as good
                            passed.add(digest)
                if counted:
                    sketch += np.bincount((np.concatenate(counted) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                m = np.array(maps, np.int64).reshape(-1, 8)
                nothing = [None] * len(n)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip([n, digests, nothing, nothing, *m.T], types[1:]))], names)
            if sketch.any():
                parts = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in np.split(sketch, 16)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[None] * 16, [None] * 16, [None] * 16, range(16), parts, *[[None] * 16] * 8], types)], names)

    return docs.mapInArrow(facts, _FACTS)


def frequent_sketch(facts: DataFrame) -> np.ndarray:
    """Which of the sketch's counters are frequent: a bit array of fixed size."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    part = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
                    sums[block] = sums[block] + part if block in sums else part
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])

    rows = facts.where("block is not null").select("block", "counts").repartition(16, "block").mapInArrow(total, "block int, counts binary")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    size = len(counts) // 16
    for r in rows.collect():  # 16 rows
        counts[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    mean = counts.mean()
    return counts > mean + max(96.0, 8.0 * mean**0.5)


def indexed(docs: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    """(entry, doc_id, n, place): the index; n also holds, above 32 bits, the first 16 bits of the document's last
    entry; place: the shingle's in the document's order, -1 where entries are not all single. Exact
    copies within a task are entered once."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))
    least = 2 if percent > 50 else 1  # above one half a single shingle links with its copies only, which meet by digest

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            flags, bands = np.unpackbits(shared.value).astype(bool), Bands(percent)
            passed: set[bytes] = set()
            for batch in batches:
                found, ids, sizes, places = [], [], [], []
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    s = shingles(text, width)
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    if len(s) < least or key in passed:
                        continue
                    if len(passed) < 200_000:  # only saves work: copies that get by are as good
                        passed.add(key)
                    e, single = index_entries(s, flags[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], bands, percent)
                    places.append(np.arange(len(e), dtype=np.int32) if single else np.full(len(e), -1, np.int32))
                    found.append(e)
                    ids.append(k)
                    sizes.append(len(s) | int(e[-1] >> np.uint64(48)) << 32)
                lengths = [len(f) for f in found]
                e = _signed(np.concatenate(found)) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(np.repeat(np.array(ids, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int64), lengths)), pa.array(np.concatenate([*places, np.zeros(0, np.int32)]))], ["entry", "doc_id", "n", "place"])

    return docs.mapInArrow(entries, "entry long, doc_id long, n long, place int")


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of consecutive rows, cut so that equal first columns stay together where they fit in memory."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        now = tuple(batch.column(i).to_numpy() for i in range(columns))
        if not len(now[0]):
            continue
        held.append(now)
        if sum(len(h[0]) for h in held) < 200_000:
            continue
        whole = tuple(np.concatenate(c) for c in zip(*held))
        cut = int(np.searchsorted(whole[0], whole[0][-1], "left"))
        if cut:
            yield tuple(c[:cut] for c in whole)
        held = [tuple(c[cut:] for c in whole)]
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


PIVOTS = 3


def shared_entries(index: DataFrame) -> DataFrame:
    """(entry, doc_id, n, place, p0, p1, p2): entries of two documents or more; the pivots are the entry's smallest
    doc_ids (null where there are fewer). Rows come sorted, so an entry's pivots are known before its other rows
    and no entry is held in memory."""
    names = ["entry", "doc_id", "n", "place", *(f"p{k}" for k in range(PIVOTS))]

    def marked(e, d, n, p, given) -> pa.RecordBatch:
        start = np.r_[True, e[1:] != e[:-1]]
        first, group = np.flatnonzero(start), np.cumsum(start) - 1
        size = np.diff(np.r_[first, len(e)])
        keep = size[group] > 1
        out = []
        for k in range(PIVOTS):
            at = d[np.minimum(first + k, len(d) - 1)]
            none = size <= k
            if given is not None:
                at[0], none[0], keep[: size[0]] = given[k], False, True
            out.append(pa.array(at[group][keep], mask=none[group][keep]))
        return pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in (e, d, n, p)), *out], names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            given: tuple[int, np.ndarray] | None = None  # the entry that goes on, and its pivots
            held: list[np.ndarray] | None = None  # or its rows, while they are no more than the pivots
            for batch in batches:
                now = [batch.column(i).to_numpy() for i in range(4)]
                if not len(now[0]):
                    continue
                if held is not None:
                    now = [np.concatenate(c) for c in zip(held, now)]
                e, d = now[:2]
                pivots = given[1] if given is not None and given[0] == e[0] else None
                cut = int(np.flatnonzero(np.r_[True, e[1:] != e[:-1]])[-1])
                held = None
                if cut == 0 and pivots is not None:
                    yield marked(*now, pivots)
                    continue
                if len(e) - cut <= PIVOTS:
                    held, given = [c[cut:] for c in now], None
                    now = [c[:cut] for c in now]
                else:
                    given = (e[-1], d[cut : cut + PIVOTS].copy())
                if len(now[0]):
                    yield marked(*now, pivots)
            if held is not None:
                yield marked(*held, None)

    return index.repartition("entry").sortWithinPartitions("entry", "doc_id").mapInArrow(mark, "entry long, doc_id long, n long, place int, p0 long, p1 long, p2 long")


def by_key(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the documents: never sent whole to all tasks, also where it happens to be small, so a
    run over few documents moves what one over many does."""
    return rows.hint("merge")


_UNKNOWN = -2
#: Rows up to which an entry's pairs are made together with those of others.
FEW = 8
_PAIRS = ("x", "y", "xn", "yn", "xp", "yp", "xe", "ye")


def cross_pairs(rows: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """(x, y) of documents in one entry but different components that may link by sizes and places.

    Where both documents' entries are single shingles in order, all c shared ones are counted. With the last of
    them at places i and j, the overlap is at most c + min(n - i, m - j) - 1; and if one prefix surely ends
    first, no other shingle of it is shared: at most c + n less that prefix. Documents with entries of two
    shingles bring their parity bitmaps along and are tested before a pair is made.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for e, d, n, p, c, w, *maps in _groups(batches, 14):
                maps = np.stack(maps, 1).view(np.uint64)

                def made(i: np.ndarray, j: np.ndarray, columns=(d, n, p, w)) -> None:
                    nonlocal held
                    swap = d[j] < d[i]
                    out.append(tuple(np.where(swap, v[b], v[a]) for v in columns for a, b in ((i, j), (j, i))))
                    held += len(i)

                first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
                size = np.diff(np.r_[first, len(e)])
                small = np.repeat(size <= FEW, size)
                for apart in range(1, FEW):  # entries of few rows, all at once: each row and the one so many behind
                    i = np.flatnonzero((e[apart:] == e[:-apart]) & small[:-apart])
                    i = i[(c[i] != c[i + apart]) & (n[i + apart] <= n[i].astype(np.int64) * 100 // percent)]
                    j = i + apart
                    if len(i):
                        total = n[i].astype(np.int64) + n[j]
                        differ = np.bitwise_count(maps[i] ^ maps[j]).sum(1, dtype=np.int64)
                        use = (p[i] != -1) | (p[j] != -1) | ((total - differ) * (100 + percent) >= 2 * percent * total)
                        made(i[use], j[use])
                for a, b in zip(first[size > FEW].tolist(), (first + size)[size > FEW].tolist()):
                    # Rows of an entry come by size: partners are those up to the largest size that may link.
                    ends = a + np.searchsorted(n[a:b], n[a:b].astype(np.int64) * 100 // percent, "right")
                    for i in range(a, b):
                        at = np.flatnonzero(c[i + 1 : ends[i - a]] != c[i]) + i + 1
                        if p[i] == -1 and len(at):
                            apart = np.bitwise_count(maps[at] ^ maps[i]).sum(1, dtype=np.int64)
                            total = n[at].astype(np.int64) + n[i]
                            at = at[(p[at] != -1) | ((total - apart) * (100 + percent) >= 2 * percent * total)]
                        if len(at):
                            made(np.full(len(at), i), at)
                    if held > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], list(_PAIRS))
                        out, held = [], 0
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], list(_PAIRS))
                    out, held = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], list(_PAIRS))

    bits = [f"b{i}" for i in range(8)]
    known = facts.groupBy("doc_id").agg(*(F.max(b).alias(b) for b in bits), F.count("*").alias("same")).where("same = 1").drop("same")
    paired = rows.where("place < 0").join(by_key(known), "doc_id", "left")
    # A doc_id of several rows has no bitmap of its own: its place says that nothing is known, its bits agree with none.
    rows = rows.where("place >= 0").select("*", *(F.lit(0).cast("long").alias(b) for b in bits)).unionByName(paired.withColumn("place", F.when(F.col("b0").isNull(), _UNKNOWN).otherwise(F.col("place")))).select("entry", "doc_id", "n", "place", "c", "w", *(F.coalesce(b, F.lit(0)).alias(b) for b in bits))
    made = rows.repartition("entry").sortWithinPartitions("entry", "n", "doc_id").mapInArrow(pairs, "x long, y long, xn int, yn int, xp int, yp int, xe int, ye int")
    counted = made.groupBy("x", "y").agg(F.count("*").alias("c"), F.max("xn").alias("xn"), F.max("yn").alias("yn"), F.max("xp").alias("xp"), F.max("yp").alias("yp"), F.max("xe").alias("xe"), F.max("ye").alias("ye"), F.min(F.least("xp", "yp")).alias("least"))
    beyond = lambda p: F.col(f"{p}n") - F.floor(F.col(f"{p}n") * (100 - percent) / 100) - 1  # noqa: E731  shingles after its prefix
    most = F.col("c") + F.least(
        F.col("xn") - F.col("xp") - 1, F.col("yn") - F.col("yp") - 1, F.when(F.col("xe") < F.col("ye"), beyond("x")), F.when(F.col("ye") < F.col("xe"), beyond("y"))
    )
    total = (F.col("xn") + F.col("yn")).cast("long")
    return counted.where((F.col("least") < 0) | (most * (100 + percent) >= percent * total)).select("x", "y")


def possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and parity bitmaps don't rule out: overlap <= (n + m - differing bits) / 2."""
    one = lambda p: by_key(facts.select(F.col("doc_id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("n", *(f"b{i}" for i in range(8))))))
    apart = sum((F.bit_count(F.col(f"x_b{i}").bitwiseXOR(F.col(f"y_b{i}"))) for i in range(1, 8)), F.bit_count(F.col("x_b0").bitwiseXOR(F.col("y_b0"))))
    total = (F.col("x_n") + F.col("y_n")).cast("long")
    return pairs.join(one("x"), "x").join(one("y"), "y").where((total - apart) * (100 + percent) >= 2 * percent * total).select("x", "y").distinct()


def folded_parity(tokens: np.ndarray) -> bytes:
    """A parity bitmap of about four bits a shingle; a longer one folds to a shorter one's length by exclusive or."""
    size = 1 << max(9, (4 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Differing bits of two parity bitmaps, at most the size of the sets' symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that link. Sets are made only of documents in pairs: a bit filter of fixed size names them (and
    a few more); the join takes exactly the pairs' own. Pairs first meet on bitmaps that grow with the
    sets, an eighth of a set's or less; those not ruled out are intersected exactly."""
    spark = docs.sparkSession
    pairs = written(pairs, "pairs")
    bit = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(1 << BLOOM_BITS))
    ids = pairs.select(F.explode(F.array("x", "y")).alias("d")).distinct()
    words = ids.select(F.explode(F.array(bit("d", 1), bit("d", 2), bit("d", 3))).alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m"))
    filled = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    got = words.toArrow()  # at most 2^17 rows of 12 bytes
    filled[got.column("w").to_numpy()] = got.column("m").to_numpy()
    shared = spark.sparkContext.broadcast(filled)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            bits = shared.value
            for batch in batches:
                places = [batch.column(i).to_numpy() for i in (2, 3, 4)]
                there = np.logical_and.reduce([(bits[p >> 6] >> (p & 63)) & 1 for p in places]).astype(bool)
                chosen = batch.filter(pa.array(there))
                raw = [shingles(t, width) for t in chosen.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([chosen.column(0), pa.array([len(s) for s in raw], pa.int32()), pa.array([folded_parity(s) for s in raw], pa.binary()), pa.array([s.tobytes() for s in raw], pa.binary())], ["d", "n", "b", "s"])

    flagged = docs.select("doc_id", "text", *(bit("doc_id", s).alias(f"p{s}") for s in (1, 2, 3)))
    made = written(flagged.mapInArrow(sets, "d long, n int, b binary, s binary").join(by_key(ids), "d", "left_semi"), "sets")

    @F.arrow_udf("boolean")
    def may_link(n: pa.Array, m: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        rows = zip(n.to_pylist(), m.to_pylist(), a.to_pylist(), b.to_pylist())
        return pa.array([(i + j - bits_apart(x, y)) * (100 + percent) >= 2 * percent * (i + j) for i, j, x, y in rows], pa.bool_())

    @F.arrow_udf("boolean")
    def links(a: pa.Array, b: pa.Array) -> pa.Array:
        def one(x: bytes, y: bytes) -> bool:
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    of = lambda p, *columns: by_key(made.select(F.col("d").alias(p), *(F.col(c).alias(f"{p}{c}") for c in columns)))
    near = written(pairs.join(of("x", "n", "b"), "x").join(of("y", "n", "b"), "y").where(may_link("xn", "yn", "xb", "yb")).select("x", "y").distinct(), "near")
    return near.join(of("x", "s"), "x").join(of("y", "s"), "y").where(links("xs", "ys")).select("x", "y").distinct()


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(facts, classes): doc_id, n, digest of every row; doc_id, component of every document with a link."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    facts = written(document_facts(docs, width), "facts")
    flags = frequent_sketch(facts)
    own = facts.where("block is null").drop("block", "counts")
    named = own.where("doc_id is not null and n > 0")
    entered = docs.where("doc_id is not null")
    shared = written(shared_entries(indexed(entered, flags, width, percent)), "entries")

    # Equal sets link at once: each copy with the smallest document of its set.
    first = named.groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = named.join(by_key(first), "digest").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))

    # A document's best pivots, one of each rank: those it shares most entries with, if likely near copies; the rest
    # comes below. Three tries leave few near copies apart.
    size = F.col("n").bitwiseAND(F.lit(0xFFFFFFFF))
    best = None
    for k in range(PIVOTS):
        counted = shared.where(f"doc_id <> p{k}").groupBy("doc_id", F.col(f"p{k}").alias("p")).agg(F.count("*").alias("times"), F.max(size).alias("n")).where("20 * times >= n")
        one = counted.groupBy("doc_id").agg(F.max(F.struct(F.col("times"), (-F.col("p")).alias("q"))).alias("b")).select(F.greatest("doc_id", -F.col("b.q")).alias("y"), F.least("doc_id", -F.col("b.q")).alias("x"))
        best = one if best is None else best.unionByName(one)
    found = verified(possible(best.distinct(), named, percent), entered, width, percent)
    links = written(copies.unionByName(found.select(F.col("x").alias("a"), F.col("y").alias("b"))), "links")
    so_far = written(components(links), "components")

    placed = shared.select("entry", "doc_id", "n", "place").join(by_key(so_far.withColumnRenamed("node", "doc_id")), "doc_id", "left").select("entry", "doc_id", size.cast("int").alias("n"), "place", F.coalesce("component", "doc_id").alias("c"), F.shiftright("n", 32).cast("int").alias("w"))
    mixed = placed.groupBy("entry").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("entry")
    rest = cross_pairs(placed.join(by_key(mixed), "entry").select("entry", "doc_id", "n", "place", "c", "w"), named, percent)
    more = verified(possible(rest, named, percent), entered, width, percent)
    every = links.unionByName(more.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return own, components(every).select(F.col("node").alias("doc_id"), "component")


def query(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    own, classes = join(docs, width, percent)
    return own.join(by_key(classes), "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component; rows with equal ids and text stay as they are."""
    _, classes = join(docs)
    moved = classes.where("component <> doc_id").select("doc_id")
    return docs.join(moved, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * i >= 75 * (a.n + b.n - i)),
r(d, c) AS (SELECT x, x FROM l UNION SELECT l.y, r.c FROM r JOIN l ON r.d = l.x),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON d = doc_id
"""
