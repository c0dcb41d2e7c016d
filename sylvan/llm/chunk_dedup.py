"""Substring dedup by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text: shifted left by one for each byte, plus a random value
of the byte, in 32 bits, so it depends on the last 32 bytes. A chunk ends where the bits under ``MASK``
are all zero; a stretch of over ``GREATEST`` bytes is cut again where its hash is smallest. Chunk ends follow
content, so an insertion moves the chunks around it and no others. Chunks are matched by digest (78 bits
of the xxh3 of their bytes): the first occurrence by (doc_id, offset) stays.

The ends of a passage never fall on chunk ends, so chunks are anchors only. Every run of neighbouring
repeated chunks is compared byte by byte, at both sides, with another occurrence of its chunks: the first,
or the last where that is itself or alike on neither side. Short chunks repeat by chance, so only stretches of
``least`` bytes or more after that count (with least=0 all do); stretches as long that occurred before are
cut from the text, at whole characters. A digest that collides would have to do so for all chunks of a run.

Chunks meet by digest in one shuffle, but for those of very frequent digests, see ``placed``. Null and empty
texts have no chunks and stay as they are. Rows of a doc_id that stands more than once, or of none, are told apart by 64 bits
of their text under a seed that is tried on them first, see ``keyed``; rows equal in both are one document with each row cut
alike. Null doc_ids come first. A very long text
is cut in one task, as is a text whose chunks all repeat. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, steady_memory, written

MASK = 0xF8000000
LEAST = 100
GREATEST = 128
#: Bytes compared on either side of a run. A longer match would hold a chunk end of its own at each side.
REACH = 2 * GREATEST + 32
#: Bytes of neighbouring chunks that a comparison steps over, and bytes compared on either side where that will do, see far.
SHORT, LEFT, RIGHT = 48, 160, 128
#: Chunks of at most SMALL bytes bring a hash of 32 bytes on either side, others of 16: so many of these at most are
#: equal to those of another place whose hash differs.
SMALL, WIDE, BESIDE = 36, 31, 15
#: Digests that go by the way for very frequent ones, at most.
HOT = 1024
CUT = "kept string, repeated_bytes long, spans array<struct<start:long,end:long>>, n_repeated_chunks long"
_GEAR = np.random.default_rng(20240607).integers(0, 1 << 32, 256, dtype=np.uint32)
_NULL_ID = -(1 << 63)


def hashes(data: bytes) -> np.ndarray:
    """The gear hash at every byte. Its low n bits depend on the last n bytes alone."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # windows of 2, 4, ... 32 bytes: five passes in place of a loop over bytes
        h[step:] += h[:-step] << np.uint32(step)
    return h


def chunk_ends(data: bytes, h: np.ndarray | None = None) -> np.ndarray:
    """Ascending ends of the chunks of data; the last is its length."""
    if not data:
        return np.zeros(0, np.int64)
    h = hashes(data) if h is None else h
    h = hashes(data) if h is None else h
    ends = np.flatnonzero((h & np.uint32(MASK)) == 0) + 1
    ends = ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))
    starts, more = np.r_[0, ends[:-1]], []
    long = ends - starts > GREATEST
    todo = list(zip(starts[long].tolist(), ends[long].tolist()))
    while todo:
        a, b = todo.pop()
        at = a + 16 + int(h[a + 15 : b - 16].argmin())
        more.append(at)
        todo += [x for x in ((a, at), (at, b)) if x[1] - x[0] > GREATEST]
    return np.sort(np.append(ends, more).astype(np.int64)) if more else ends


def far(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether to compare further than LEFT and RIGHT bytes before and after each chunk: as far as REACH.

    A chunk end common to two texts whose last 32 bytes are common is an end in both. So a match that goes on to the
    left holds the chunks before but for its first 32 bytes, and one that goes on to the right those after it; these have
    matches of their own. As short chunks' other places may be elsewhere by chance, at least SHORT bytes of them
    are stepped over. Ends that no hash gave follow from the whole stretch: there the reach is full.
    """
    starts, n = np.r_[0, ends[:-1]], len(ends)
    given = np.r_[True, (h[ends[:-1] - 1] & np.uint32(MASK)) == 0, True]  # of the places 0, and each end
    places = np.r_[0, ends]
    i = np.arange(n)
    to_left = np.maximum(np.searchsorted(places, starts - SHORT, "right") - 1, 0)
    to_right = np.minimum(np.searchsorted(places, np.maximum(ends, starts + 32) + SHORT), n)
    return (starts - places[to_left] + 32 > LEFT) | ~given[i] | ~given[to_left], (places[to_right] - ends > RIGHT) | ~given[i + 1] | ~given[to_right]


def beside(h: np.ndarray, short: np.ndarray) -> np.ndarray:
    """8 bits of the last 32 bytes (short) or 16 bytes before a place. Mixed, as the high bits are the same at all chunk ends."""
    return (np.where(short, h, h & np.uint32(0xFFFF)) * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64)


def _digests(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash at every byte of a text, its chunks' ends and their digests (two numbers each)."""
    import xxhash

    data = text.encode("utf-8", "surrogatepass")
    h = hashes(data)
    ends = chunk_ends(data, h)
    digest, at = xxhash.xxh3_128_digest, ends.tolist()
    return h, ends, np.frombuffer(b"".join([digest(data[a:b]) for a, b in zip([0, *at], at)]), np.int64).reshape(-1, 2)


def _cut(batches: Iterator[pa.RecordBatch], chosen: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(th, k, at, digest, size) of the chunks of each batch of (k, th, t), see chunks; of chosen digests only, if given."""
    for batch in batches:
        n, parts = [], []
        for text in batch.column(2).to_pylist():
            h, ends, d = _digests(text)
            use = slice(None) if chosen is None else np.flatnonzero(np.isin(d[:, 0], chosen))
            n.append(len(d[use]))
            if not n[-1]:
                continue
            start = np.r_[0, ends[:-1]]
            left, right = far(h, ends)
            short = ends - start <= SMALL
            before = beside(h[start - 1], short)
            after = beside(h[np.minimum(np.where(short, ends + 31, ends + 15), len(h) - 1)], short)
            size = ends - start | before << 8 | after << 16 | left.astype(np.int64) << 24 | right.astype(np.int64) << 25 | (d[:, 1] & 0x3FFF) << 26
            parts.append((start[use], d[use, 0], size[use]))
        k, th = (np.repeat(batch.column(i).to_numpy(), n) for i in (0, 1))
        at, digest, size = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*parts) if parts else ((), (), ())))
        yield th, k, at, digest, size


CHUNK = "th long, k long, at long, digest long, size long"


def chunks(docs: DataFrame, without: list[int] = ()) -> DataFrame:
    """(th, k, at, digest, size) of every chunk but those of some digests; k and th: see keyed; at: offset; size: 8 bits of it,
    then 8 bits of the hash of the bytes before and of those after the chunk (see SMALL), whether to compare far to the
    left and right, and 14 more of the digest. As every byte of these rows is shuffled, the bits left over are zeros at
    the end, and th, which is nearly always 0, comes first."""
    hot = np.sort(np.array(without, np.int64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            for columns in _cut(batches):
                if len(hot):
                    stay = ~np.isin(columns[3], hot)
                    columns = [c[stay] for c in columns]
                for lo in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in columns], ["th", "k", "at", "digest", "size"])

    return docs.select("k", "th", "t").mapInArrow(rows, CHUNK)


def hot_digests(docs: DataFrame, most: int = HOT) -> list[int]:
    """At most so many digests, among them all that more than 2 / most of all chunks have: a summary of the counts in
    each task that drops the least ones, then their sums. It only tells which chunks take which way."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            kept, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            total = 0
            for batch in batches:
                digest = np.concatenate([*(_digests(t)[2][:, 0] for t in batch.column(2).to_pylist()), np.zeros(0, np.int64)])
                total += len(digest)
                kept, at = np.unique(np.concatenate([kept, digest]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, np.ones(len(digest), np.int64)]), len(kept)).astype(np.int64)
                if len(kept) > most:  # the counts beyond the greatest ones, taken from all
                    counts -= np.partition(counts, -most - 1)[-most - 1]
                    kept, counts = kept[counts > 0], counts[counts > 0]
            yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(counts), pa.array(np.full(len(kept), total))], ["digest", "n", "total"])

    found = docs.select("k", "th", "t").mapInArrow(counted, "digest long, n long, total long").withColumn("part", F.spark_partition_id())
    summed = written(found, "hot")
    total = summed.groupBy("part").agg(F.max("total").alias("t")).agg(F.sum("t")).head()[0] or 0
    best = summed.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > max(1000, total // most)).orderBy(F.desc("n")).limit(most)
    return [r["digest"] for r in best.collect()]


_PLACE = ("k", "at", "th", "size")
_ENDS = ["digest", "more", *(f"{e}{c}" for e in "fl" for c in _PLACE)]


def hot_marks(docs: DataFrame, hot: list[int]) -> DataFrame:
    """placed, of the chunks of so many digests: each task finds their first and last place in its rows, an aggregate those
    over all, and these few rows go to every task that marks its own chunks, which are never brought together."""
    chosen = np.sort(np.array(hot, np.int64))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            best: dict[tuple[int, int], tuple] = {}
            for th, k, at, digest, size in _cut(batches, chosen):
                for row in zip(digest.tolist(), (size >> 26).tolist(), k.tolist(), at.tolist(), th.tolist(), size.tolist()):
                    key, place = row[:2], row[2:]
                    first, last = best.get(key, (place, place))
                    best[key] = min(first, place), max(last, place)
            columns = list(zip(*((*key, *first, *last) for key, (first, last) in best.items()))) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _ENDS)

    texts = docs.select("k", "th", "t")
    each = texts.mapInArrow(ends, ", ".join(f"{c} long" for c in _ENDS))
    over = each.groupBy("digest", "more").agg(F.min(F.struct(*(f"f{c}" for c in _PLACE))).alias("f"), F.max(F.struct(*(f"l{c}" for c in _PLACE))).alias("l")).select("digest", "more", "f.*", "l.*")
    # As many rows as hot digests but for collisions of 64 bits.
    table = {tuple(r[:2]): tuple(r[2:]) for r in over.collect() if tuple(r[2:5]) != tuple(r[6:9])}
    names = [*_PLACE, *_ENDS[2:]]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            for th, k, at, digest, size in _cut(batches, chosen):
                found = [table.get(key) for key in zip(digest.tolist(), (size >> 26).tolist())]
                use = np.flatnonzero(np.array([x is not None for x in found], bool))
                more = np.array([x for x in found if x is not None], np.int64).reshape(-1, 8)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k[use], at[use], th[use], size[use], *more.T)], names)

    return texts.mapInArrow(mark, ", ".join(f"{c} long" for c in names)).select(*_PLACE, *(F.struct(*(F.col(f"{e}{c}").alias(c) for c in _PLACE)).alias(name) for name, e in (("first", "f"), ("last", "l"))))


def joined_spans(spans) -> list[tuple[int, int]]:
    """The union of (start, end, ...): ascending, apart from each other."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(x[:2] for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_runs(text: str, marks: list[tuple[int, int, bool]], least: int, matched: list[tuple[int, int, bool]] = ()) -> tuple[str, int, list[tuple[int, int]]]:
    """(what stays, repeated bytes, removed byte spans) of a text with repeated chunks (start, size, first occurrence)
    and matched spans beside them (start, end, whether the other place comes before)."""
    data = text.encode("utf-8", "surrogatepass")
    kept_runs = [x for x in joined_spans([*((at, at + size) for at, size, _ in marks), *matched]) if x[1] - x[0] >= least]
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    removed = joined_spans([*((at, at + size) for at, size, first in marks if not first), *(x for x in matched if x[2])])
    whole, at, out = [], 0, []
    for a, b in removed:
        if b - a < least:  # a short chunk inside a passage's first occurrence that stood elsewhere before
            continue
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            whole.append((a, b))
            out.append(data[at:a])
            at = b
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass"), sum(b - a for a, b in kept_runs), whole


def same_end(a: bytes, b: bytes) -> int:
    """Length of the longest common suffix."""
    n = min(len(a), len(b))
    if not n:
        return 0
    differ = int.from_bytes(a[-n:], "big") ^ int.from_bytes(b[-n:], "big")
    return n if not differ else ((differ & -differ).bit_length() - 1) // 8


def unpacked(marks: pa.ListArray) -> dict[str, np.ndarray]:
    """The marks of all rows of a batch, by row and place: doc (row), at, size, near and first (bool), left and right (bytes
    to compare), pk, plo and pth (another place)."""
    flat = marks.flatten()
    packed, *other = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    doc = np.repeat(np.arange(len(marks)), pc.list_value_length(marks).fill_null(0).to_numpy(zero_copy_only=False))
    by = np.lexsort((packed, doc))
    packed = packed[by]
    bit = lambda n: packed >> n & 1 > 0
    found = {"doc": doc[by], "at": packed >> 32, "size": packed & 0xFF, "near": bit(8), "first": bit(9), "left": np.where(bit(10), REACH, LEFT), "right": np.where(bit(11), REACH, RIGHT)}
    return found | {name: x[by] for name, x in zip(("pk", "plo", "pth"), other)}


def places(per_doc: DataFrame, least: int) -> DataFrame:
    """Where else to look around every run: (k, th, span, reach, pk, pth, plo), span being lo, then 31 bits of hi, reach
    left, then 16 bits of right: one row for each place of the chunks within least bytes of a run's edges (short ones may be elsewhere by chance); those at one distance share a row.
    A place whose hashes beside the chunk differ gives few bytes at either side; it is asked only where these may decide
    whether a run is long enough."""
    names = ("k", "th", "span", "reach", "pk", "pth", "plo")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = unpacked(batch.column(2))
            at, doc, end = m["at"], m["doc"], m["at"] + m["size"]
            if not len(at):
                continue
            # What stood before and what comes again later are runs of their own: only the former is cut.
            starts = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != end[:-1]) | (m["first"][1:] != m["first"][:-1])]
            run = np.cumsum(starts) - 1
            first, last = np.flatnonzero(starts), np.flatnonzero(np.r_[starts[1:], True])
            wanted = (at - at[first][run] < least) | (end[last][run] - end < least)
            total = end[last][run] - at[first][run]
            close = (total < least) & (total + 2 * np.where(m["size"] <= SMALL, WIDE, BESIDE) >= least)
            use = wanted & (close | m["near"])
            x = np.stack([run, m["pk"], m["pth"], m["plo"] - at, at, end, doc, m["left"], m["right"]])[:, use]
            x = x[:, np.lexsort(x[3::-1])]
            if not x.shape[1]:
                continue
            new = np.flatnonzero(np.r_[True, (x[:4, 1:] != x[:4, :-1]).any(0)])
            lo, hi = np.minimum.reduceat(x[4], new), np.maximum.reduceat(x[5], new)
            left, right = (np.maximum.reduceat(x[i], new) for i in (7, 8))
            x = x[:, new]
            cols = [batch.column(0).to_numpy()[x[6]], batch.column(1).to_numpy()[x[6]], lo << 31 | hi, left << 16 | right, x[1], x[2], x[3] + lo]
            for i in range(0, len(lo), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000].astype(np.int64)) for c in cols], list(names))

    return per_doc.select("k", "th", "marks").mapInArrow(find, ", ".join(f"{c} long" for c in names))


def placed(texts: DataFrame) -> DataFrame:
    """(k, at, th, size, first, last) of every chunk that occurs twice or more: its first and last place.

    Chunks meet by digest, once; the window over a digest spills. Those of the few digests that a large share of all
    chunks may have don't meet, see hot_marks.
    """
    hot = hot_digests(texts)
    by = Window.partitionBy("digest", F.shiftright("size", 26))
    place = F.struct(*_PLACE)
    other = F.struct("first.k", "first.at", "first.th") != F.struct("last.k", "last.at", "last.th")
    own = chunks(texts, hot).select(*_PLACE, F.min(place).over(by).alias("first"), F.max(place).over(by).alias("last")).where(other)
    return own.unionByName(hot_marks(texts, hot)) if hot else own


def text_hash(seed: int, value):
    return F.xxhash64(F.lit(seed), value)


def keyed(docs: DataFrame, text: str, doc_id: str, seeds: int = 8) -> DataFrame:
    """k (doc_id, or the least long), th and row (all columns of docs). th is 0 where k stands once, else 64 bits of the text
    under the first seed that gives no two texts of one k the same: texts are told apart by a second hash, so only two that agree
    in 128 bits would be taken for one. Texts are read here only if some k stands twice."""
    k = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID))
    again = written(docs.select(k.alias("k")).groupBy("k").count().where("count > 1").select("k", F.lit(True).alias("again")), "again")
    if again.isEmpty():
        # th is 0, but no constant, which the optimizer would put into one use of a plan that is used twice. Both are expressions,
        # so that rows under other names are the same rows, and exchanged once.
        return docs.select(k.alias("k"), k.bitwiseXOR(k).alias("th"), F.struct("*").alias("row"))
    rows = docs.select(k.alias("k"), F.struct("*").alias("row"))
    rows = rows.join(again, "k", "left")
    value = F.coalesce(F.col("row")[text], F.lit(""))
    hashed = lambda seed: F.when(F.col("again"), text_hash(seed, value)).otherwise(0)
    for seed in range(seeds):
        same = rows.where("again").select("k", hashed(seed).alias("th"), text_hash(-1, value).alias("h")).groupBy("k", "th").agg((F.min("h") != F.max("h")).alias("two"))
        if same.where("two").isEmpty():
            return rows.select("k", hashed(seed).alias("th"), "row")
    raise RuntimeError("no seed tells the texts of one doc_id apart")


def _found(docs: DataFrame, least: int, text: str, doc_id: str) -> DataFrame:
    """row (all columns of docs) and c (kept, repeated_bytes, spans, n_repeated_chunks) of every row."""
    small_batches(docs.sparkSession)
    rows = keyed(docs, text, doc_id)
    texts = rows.select("k", "th", F.coalesce(F.col("row")[text], F.lit("")).alias("t")).where("t <> ''")
    size = F.col("size").bitwiseAND(F.lit(0xFF))
    own_first, own_last = ((F.col(f"{c}.k") == F.col("k")) & (F.col(f"{c}.at") == F.col("at")) & (F.col(f"{c}.th") == F.col("th")) for c in ("first", "last"))
    same = lambda c, bits: (F.col("size").bitwiseXOR(F.col(f"{c}.size")).bitwiseAND(F.lit(bits)) == 0).cast("int")
    sides = lambda c: same(c, 0xFF00) + same(c, 0xFF0000)
    # The first place, as it decides what is cut; the last one if the first is the chunk itself or alike on neither side.
    other_last = own_first | (~own_last & (sides("first") == 0) & (sides("last") > 0))
    near = F.when(other_last, sides("last")).otherwise(sides("first")) > 0
    # A chunk whose neighbouring bytes differ from those there, and that would be too short with the few bytes a side that
    # may be equal, is elsewhere by chance.
    found = placed(texts).select("*", near.alias("near"), own_first.alias("own_first"), F.when(other_last, F.col("last")).otherwise(F.col("first")).alias("other")).where(F.col("near") | (size + F.when(size <= SMALL, 2 * WIDE).otherwise(2 * BESIDE) >= least))
    bits = size + F.when(F.col("near"), 1 << 8).otherwise(0) + F.when(F.col("own_first"), 1 << 9).otherwise(0) + F.shiftleft(F.shiftright("size", 24).bitwiseAND(F.lit(3)), 10)
    mark = F.struct((F.shiftleft("at", 32) + bits).alias("packed"), F.col("other.k").alias("pk"), F.col("other.at").alias("plo"), F.col("other.th").alias("pth"))
    # The filter is what the join below would infer: so both uses of the marks are one plan, made once.
    marks = found.where("k IS NOT NULL AND th IS NOT NULL").select("k", "th", mark.alias("m"))
    # Bounded by a document's own chunks; rows equal in id and text repeat their marks, hence the set.
    per_doc = marks.groupBy("k", "th").agg(F.collect_set("m").alias("marks"))

    @F.arrow_udf("before binary, after binary")
    def around(texts: pa.Array, plos: pa.Array, spans: pa.Array, reach: pa.Array, _: pa.Array) -> pa.Array:
        before, after, last, data = [], [], None, b""
        plo, span, far = plos.to_numpy(), spans.to_numpy(), reach.to_numpy()
        his = plo + (span & 0x7FFFFFFF) - (span >> 31)
        for i, (lo, hi, left, right) in enumerate(zip(plo.tolist(), his.tolist(), (far >> 16).tolist(), (far & 0xFFFF).tolist())):
            t = texts[i].as_buffer()
            if last is None or not t.equals(last):
                last, data = t, t.to_pybytes()
            before.append(data[max(0, lo - left) : lo])
            after.append(data[hi : hi + right])
        return pa.StructArray.from_arrays([pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["before", "after"])

    # All columns of rows are read, so that one exchange of them serves both joins.
    asked = places(per_doc, least)
    seen = asked.join(rows.withColumnsRenamed({"k": "pk", "th": "pth"}), ["pk", "pth"]).withColumn("c", around(F.col("row")[text], "plo", "span", "reach", F.xxhash64("row")))
    earlier = F.struct("pk", "plo", "pth") < F.struct(F.col("k").alias("pk"), F.shiftright("span", 31).alias("plo"), F.col("th").alias("pth"))
    span = F.shiftleft("span", 1) + earlier.cast("long")
    matches = seen.select("k", "th", F.struct(span.alias("span"), "c.before", "c.after").alias("m")).groupBy("k", "th").agg(F.collect_set("m").alias("near"))

    @F.arrow_udf(CUT)
    def cut(texts: pa.Array, marks: pa.Array, near: pa.Array) -> pa.Array:
        m = unpacked(marks)
        chunk = list(zip(m["at"].tolist(), m["size"].tolist(), m["first"].tolist()))
        of_doc = np.searchsorted(m["doc"], np.arange(len(texts) + 1)).tolist()
        sides = near.flatten()
        span = sides.field(0).to_numpy(zero_copy_only=False)
        side = list(zip((span >> 32).tolist(), (span >> 1 & 0x7FFFFFFF).tolist(), (span & 1 > 0).tolist(), sides.field(1).to_pylist(), sides.field(2).to_pylist()))
        of_side = np.r_[0, np.cumsum(pc.list_value_length(near).fill_null(0).to_numpy(zero_copy_only=False))].tolist()
        out = []
        for i in range(len(texts)):
            t, mine = texts[i].as_py(), chunk[of_doc[i] : of_doc[i + 1]]
            if t is None or not mine:
                out.append((t, 0, [], 0))
                continue
            data, matched = t.encode("utf-8", "surrogatepass"), []
            for lo, hi, early, before, after in side[of_side[i] : of_side[i + 1]]:
                left, right = same_end(data[max(0, lo - REACH) : lo], before), same_end(data[hi : hi + len(after)][::-1], after[: len(data) - hi][::-1])
                matched += [(lo - left, lo, early), (hi, hi + right, early)]
            kept, repeated, spans = cut_runs(t, mine, least, matched)
            out.append((kept, repeated, [{"start": a, "end": b} for a, b in spans], len(mine)))
        removed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = [pa.string(), pa.int64(), removed, pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * 4, kinds)], ["kept", "repeated_bytes", "spans", "n_repeated_chunks"])

    return rows.join(per_doc, ["k", "th"], "left").join(matches, ["k", "th"], "left").select("row", cut(F.col("row")[text], "marks", "near").alias("c"))


def dedup(docs: DataFrame, least: int = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row with kept_text, repeated_bytes (in stretches that also occur elsewhere), removed_bytes, spans
    (start:end in bytes of what was removed) and n_repeated_chunks; other columns pass through, those of these
    names are replaced."""
    found = _found(docs, least, text, doc_id)
    removed = F.aggregate("c.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    spans = F.array_join(F.transform("c.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    made = {"kept_text": F.col("c.kept"), "repeated_bytes": F.col("c.repeated_bytes"), "removed_bytes": removed, "spans": spans, "n_repeated_chunks": F.col("c.n_repeated_chunks")}
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in made), *(v.alias(c) for c, v in made.items()))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, repeated_bytes, removed_bytes, has_repeats, spans, text (what stays) of every document."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", F.length("kept_text").cast("long").alias("n_chars"), "repeated_bytes", "removed_bytes", (F.col("repeated_bytes") > 0).alias("has_repeats"), "spans", F.col("kept_text").alias("text"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut; n_chars follows where a text changed, all other columns stay, whatever
    their names."""
    changed = {"text": F.col("c.kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("c.spans") > 0, F.length("c.kept").cast("long")).otherwise(F.col("row")["n_chars"])
    return _found(docs, LEAST, "text", "doc_id").select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
