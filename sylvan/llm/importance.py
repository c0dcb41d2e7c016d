"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Features are runs of one to three words. Each block of documents sends its distinct features, with counts, to the
dictionary, which is dealt out by a hash of a feature's words. There every distinct string is hashed to its bucket
once, counts are summed by bucket, and each block is sent the buckets of its features, in the order it sent them. Target texts
go through a dictionary of their own. Sums of both give the gain of every bucket, and the join of gains with a block's
features and its documents' counts of them gives the weights.

Features travel packed, and what begins alike is said once, so they are dealt by their first word. The runs of two that begin with
a frequent word are dealt by both words, and the runs of three with a frequent pair by all three: words and pairs of
1 / ``FREQUENT`` of all places or more, so at most as many each, are found from what blocks list. A dictionary task keeps the
distinct strings of one share of the hash at a time and takes what the blocks send in turns. Scores are ranked within ranges of
the score, and shifted by the counts of the ranges before.

A null text has no features: weight 0. Rows of equal doc_id, or of none, count each by itself (no id: the
draw's hash is of the empty one). Ties in score go to the smaller doc_id, null first. A very long text is one block, held whole
in a task. Without documents the result is empty; without target texts T and t are 0. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import steady_memory, written
from .word_blocks import ALNUM, Block, block_of, blocks, forget, groups, joined, lines, numbers, packed, read, unnumbers, unpacked

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 42, 20, 5
#: Words for each share of the hash, and features that a dictionary task takes at once.
SHARE, AT_ONCE = 1_000_000, 2_000_000
FREQUENT = 4096
#: Of compression: features are most of what is shuffled.
LEVEL = 6


class Frequent(NamedTuple):
    words: pa.Array
    firsts: pa.Array
    seconds: pa.Array


class Grams(NamedTuple):
    """Distinct features of a block, in order: v is the number of words; a pair is first * v + second, a three its pair's number * v +
    third. Which of them stands at each of the places (of first words) in pairs_at and threes_at."""

    v: int
    pair: np.ndarray
    n_pair: np.ndarray
    pair_at: np.ndarray
    pairs_at: np.ndarray
    three: np.ndarray
    n_three: np.ndarray
    three_at: np.ndarray
    threes_at: np.ndarray


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(keys):
        return keys.astype(np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    found, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return found, n.astype(np.int32), at.astype(np.int32)


def _pairs_at(b: Block) -> np.ndarray:
    """Places whose next word stands in the same text."""
    follows = np.ones(len(b.ids), bool)
    follows[np.cumsum(b.n)[b.n > 0] - 1] = False
    return np.flatnonzero(follows).astype(np.int32)


def grams(b: Block) -> Grams:
    v = max(len(b.words), 1)
    two = _pairs_at(b)
    pair, n_pair, pair_at = _distinct(b.ids[two].astype(np.int64) * v + b.ids[two + 1])
    last = np.flatnonzero(two[1:] == two[:-1] + 1).astype(np.int32)  # a pair that another follows in the same text
    three, n_three, three_at = _distinct(pair_at[last].astype(np.int64) * v + b.ids[two[last] + 2])
    return Grams(v, pair, n_pair, pair_at, two, three, n_three, three_at, two[last])


def _text(*words: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if len(words[0]) else pa.array([], pa.large_string())


def common(b: Block) -> dict[str, pa.Array]:
    """Words, and pairs of these, that are 1 / (2 * FREQUENT) of a block's or more, with their counts."""
    least, n_word = max(2, -(-len(b.ids) // (2 * FREQUENT))), np.bincount(b.ids, minlength=len(b.words))
    two = _pairs_at(b)
    two = two[(n_word >= least)[b.ids[two]]]
    pair, n_pair = np.unique(b.ids[two].astype(np.int64) * len(b.words) + b.ids[two + 1], return_counts=True)
    one, two = np.flatnonzero(n_word >= least), np.flatnonzero(n_pair >= least)
    take = lambda at: b.words.take(pa.array(at))
    text = pa.concat_arrays([take(one), _text(take(pair[two] // max(len(b.words), 1)), take(pair[two] % max(len(b.words), 1)))]).cast(pa.string())
    rows = pa.StructArray.from_arrays([text, pa.array(np.concatenate([n_word[one], n_pair[two]]), pa.int64())], ["text", "times"])
    return {"common": pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)}


def _numbers_of(b: Block, words: pa.Array) -> np.ndarray:
    """The number of each word in a block, or -1."""
    return pc.index_in(words, value_set=b.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


class Layout:
    """Which share of the hash each feature of a block goes to, in the order [words, pairs, threes of other pairs, threes of
    frequent pairs] and within these as sorted. A pair goes where its first word goes, or, if that is frequent, by both."""

    def __init__(self, b: Block, frequent: Frequent, shares: int):
        self.g = g = grams(b)
        h, v = b.hashes, g.v
        often = np.zeros(v, bool)
        often[[k for k in _numbers_of(b, frequent.words) if k >= 0]] = True
        mix = lambda *xs: self.mixed(xs, shares)
        first, second = h[g.pair // v], h[g.pair % v]
        second[~often[g.pair // v]] = 0
        pair_to = mix(first, second)
        del first, second
        x, y = _numbers_of(b, frequent.firsts), _numbers_of(b, frequent.seconds)
        far = np.isin(g.pair, (x * v + y)[(x >= 0) & (y >= 0)])[g.three // v]
        self.grouped, self.loose = np.flatnonzero(~far).astype(np.int32), np.flatnonzero(far).astype(np.int32)
        k = g.three[self.loose] // v
        to = [mix(h), pair_to, pair_to[g.three[self.grouped] // v], mix(h[g.pair[k] // v], h[g.pair[k] % v], h[g.three[self.loose] % v])]
        self.order = [np.argsort(t, kind="stable").astype(np.int32) for t in to]
        to = [t[o] for t, o in zip(to, self.order)]
        self.shares = np.unique(np.concatenate([np.unique(t) for t in to]))
        self.cuts = [(np.searchsorted(t, self.shares), np.searchsorted(t, self.shares, "right")) for t in to]

    @staticmethod
    def mixed(xs: tuple[np.ndarray, ...], shares: int) -> np.ndarray:
        out = np.zeros(len(xs[0]), np.uint64)
        for x in xs:
            out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return (out % np.uint64(shares)).astype(np.int32)

    def parts(self, k: int) -> list[slice]:
        return [slice(a, b) for a, b in zip(*(x.tolist() for x in self.cuts[k]))]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal neighbours."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(x)])


def _send(b: Block, frequent: Frequent, shares: int) -> Iterator[tuple[int, bytes]]:
    """(share, body) of all features of a block; see _received. What begins alike is said once: first words with the number of
    their pairs, second words with the number of theirs, third words."""
    if not len(b.ids):
        return
    lay = Layout(b, frequent, shares)
    g, v = lay.g, lay.g.v
    words, pairs, grouped, loose = lay.order
    grouped, loose = lay.grouped[grouped], lay.loose[loose]
    take = lambda at: b.words.take(pa.array(at))
    n_word, below = np.bincount(b.ids, minlength=v), np.bincount(g.three[lay.grouped] // v, minlength=len(g.pair)).astype(np.int32)
    for share, w, p, t, o in zip(lay.shares.tolist(), *(lay.parts(k) for k in range(4))):
        w, p, t, o = words[w], pairs[p], grouped[t], loose[o]
        first, above = g.pair[p] // v, g.three[o] // v
        start, size = _runs(first)
        far, far_size = _runs(above)
        above = g.pair[above[far]]
        yield share, packed(
            joined(take(w)), numbers(n_word[w]),
            joined(take(first[start])), numbers(size), joined(take(g.pair[p] % v)), numbers(below[p]), numbers(g.n_pair[p]),
            joined(take(g.three[t] % v)), numbers(g.n_three[t]),
            joined(_text(take(above // v), take(above % v))), numbers(far_size), joined(take(g.three[o] % v)), numbers(g.n_three[o]),
            level=LEVEL,
        )


def _received(body: bytes) -> tuple[pa.Array, np.ndarray]:
    """(features, counts) in the order of Layout."""
    part = iter(unpacked(body))
    text = lambda: (lambda t, n: (lines(t, len(n)), n))(next(part), unnumbers(next(part)))
    each = lambda x, n: x.take(pa.array(np.repeat(np.arange(len(n)), n)))
    single, n_word = text()
    firsts, size = text()
    seconds, below = text()
    n_pair = unnumbers(next(part))
    pairs = _text(each(firsts, size), seconds)
    thirds, n_three = text()
    above, far_size = text()
    others, n_far = text()
    return pa.concat_arrays([single, pairs, _text(each(pairs, below), thirds), _text(each(above, far_size), others)]), np.concatenate([n_word, n_pair, n_three, n_far])


def _hashed(strings: pa.Array) -> np.ndarray:
    return np.fromiter(map(crc32, joined(strings).split(b"\n")), np.int64, len(strings)) % BUCKETS if len(strings) else np.zeros(0, np.int64)


ANSWER = "share long, block long, body binary, buckets array<long>, times array<long>"


def _answers(rows: Iterator[tuple[int, int, bytes]], share: int, answer: bool) -> Iterator[tuple]:
    """Rows of ANSWER for one share of the hash: the buckets of each block's features, and at the end the sums."""
    known, known_to, sums = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(BUCKETS, np.int64)

    def taken(held: list) -> Iterator[tuple]:
        nonlocal known, known_to
        found = pa.concat_arrays([x for _, x, _ in held]).dictionary_encode()
        strings = found.dictionary
        if len(known):  # strings of earlier turns have their bucket
            at = pc.index_in(strings, value_set=known)
            new = at.is_null().to_numpy(zero_copy_only=False)
            to = known_to[at.fill_null(0).to_numpy()]
            to[new] = _hashed(strings.filter(pa.array(new)))
            known, known_to = pa.concat_arrays([known, strings.filter(pa.array(new))]), np.concatenate([known_to, to[new]])
        else:
            to = known_to = _hashed(strings)
            known = strings
        to = to[found.indices.to_numpy()]
        sums[:] += np.bincount(to, np.concatenate([n for _, _, n in held]), BUCKETS).astype(np.int64)
        at = 0
        for block, x, _ in held:
            if answer:
                yield share, block, packed(np.ascontiguousarray(to[at : at + len(x)], "<u2").view(np.uint8).reshape(-1, 2).T.tobytes()), None, None
            at += len(x)

    held, size = [], 0
    for _, block, body in rows:
        held.append((block, *_received(body)))
        size += len(held[-1][1])
        if size >= AT_ONCE:
            yield from taken(held)
            held, size = [], 0
    if held:
        yield from taken(held)
    used = np.flatnonzero(sums)
    yield share, -1, None, used.tolist(), sums[used].tolist()


_ANSWER = pa.schema([("share", pa.int64()), ("block", pa.int64()), ("body", pa.binary()), ("buckets", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def dictionary(docs: DataFrame, doc_id: str, text: str, answer: bool = True) -> tuple[DataFrame, DataFrame, Frequent, int, np.ndarray]:
    """(blocks, answers, what is frequent, shares, count of all features by bucket) of documents. Sums of BUCKETS numbers and
    at most FREQUENT words and pairs each come to the driver."""
    spark = docs.sparkSession
    table = blocks(docs, ALNUM, False, doc_id, text, ", common array<struct<text:string,times:long>>", common, size="12m")
    total = table.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).head()[0] or 0
    often = table.select(F.inline("common")).groupBy("text").agg(F.sum("times").alias("times")).where(F.col("times") * FREQUENT >= total).select(F.split("text", " ").alias("t")).collect()
    column = lambda n, k: pa.array([r["t"][k] for r in often if len(r["t"]) == n], pa.large_string())
    frequent = Frequent(column(1, 0), column(2, 0), column(2, 1))
    shares = max(1, total // SHARE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory(arrays=True):
            for b in read(batches):
                for share, body in _send(b, frequent, shares):
                    yield pa.RecordBatch.from_arrays([pa.array([share]), pa.array([b.block]), pa.array([body], pa.binary())], ["share", "block", "body"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory(arrays=True):
            for share, rows in groups(batches):
                for r in _answers(rows, share, answer):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(r, _ANSWER)], _ANSWER.names)

    sent = table.select("block", "ks", "n", "words", "ids").mapInArrow(send, "share long, block long, body binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(sent.repartition(n, "share").sortWithinPartitions("share", "block").mapInArrow(answers, ANSWER), "buckets")
    forget(spark)
    sums = np.zeros(BUCKETS, np.int64)
    for r in found.where("block < 0").select(F.explode(F.arrays_zip("buckets", "times")).alias("x")).groupBy("x.buckets").agg(F.sum("x.times").alias("n")).collect():
        sums[r["buckets"]] = r["n"]
    return table, found, frequent, shares, sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weights(b: Block, lay: Layout, buckets: dict[int, np.ndarray], gain: np.ndarray) -> list[tuple]:
    """(doc_id, n_words, n_features, weight) of a block's documents."""
    g = lay.g
    value = [np.zeros(n, np.int32) for n in (len(b.words), len(g.pair), len(lay.grouped), len(lay.loose))]
    for share, *parts in zip(lay.shares.tolist(), *(lay.parts(k) for k in range(4))):
        got, at = gain[buckets.pop(share)], 0
        for k, part in enumerate(parts):
            n = part.stop - part.start
            value[k][lay.order[k][part]] = got[at : at + n]
            at += n
    three = np.zeros(len(g.three), np.int32)
    three[lay.grouped], three[lay.loose] = value[2], value[3]
    each = value[0][b.ids].astype(np.int64)  # by the place of a feature's first word
    each[g.pairs_at] += value[1][g.pair_at]
    each[g.threes_at] += three[g.three_at]
    ends = np.r_[0, np.cumsum(b.n)]
    total = np.diff(np.r_[0, np.cumsum(each)][ends])
    n_features = b.n + np.maximum(b.n - 1, 0) + np.maximum(b.n - 2, 0)
    return [b.ks, b.n.tolist(), n_features.tolist(), total.tolist()]


def weights(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every document: the log ratio of target to source, summed over its features."""
    spark = docs.sparkSession
    table, found, frequent, shares, source = dictionary(docs, doc_id, text)
    *_, wanted = dictionary(target.select(F.lit(0).alias("_k"), F.col(target_text).alias("_t")), "_k", "_t", answer=False)
    gain = gains(source, wanted)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory(arrays=True):
            for _, rows in groups(batches):
                b, buckets = None, {}
                for block, share, body, ks, n, words, ids in rows:
                    if share < 0:
                        b = block_of(block, ks, n, words, ids)
                    else:
                        data = np.frombuffer(unpacked(body)[0], np.uint8)
                        buckets[share] = np.ascontiguousarray(data.reshape(2, -1).T).view("<u2").ravel().astype(np.int64)
                columns = _weights(b, Layout(b, frequent, shares), buckets, gain) if len(b.ids) else [b.ks, *([[0] * len(b.ks)] * 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_words", "n_features", "weight"])

    own = table.select("block", F.lit(-1).cast("long").alias("share"), F.lit(None).cast("binary").alias("body"), "ks", "n", "words", "ids")
    sent = found.where("block >= 0").select("block", "share", "body", *(F.lit(None).cast(t).alias(c) for c, t in (("ks", "array<long>"), ("n", "array<long>"), ("words", "binary"), ("ids", "binary"))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return own.unionByName(sent).repartition(n, "block").sortWithinPartitions("block", "share").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **columns: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document: a draw without replacement, by weight plus Gumbel noise of the id, of
    floor(percent * N / 100) of the N documents with at least so many words."""
    spark = docs.sparkSession
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weights(docs, target, **columns).withColumn("score", F.col("weight") + noise), "scored")
    forget(spark)
    fit = scored.where(F.col("n_words") >= least_words)
    draw = percent * fit.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(fit.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(F.broadcast(sizes), "part").withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))
    names = ["doc_id", "n_features", "weight", "score"]
    drawn = local.select(*names, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(*(spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c) for t, c in (("documents", ("doc_id", "text")), ("benchmark", ("text",)))))


# The same with a hash for each distinct feature by the table of crc32, a byte at a time, and windows over all scores.
ORACLE = r"""
WITH RECURSIVE step(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, true AS own, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -row_number() OVER (), false, NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT r, own, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
x AS (SELECT r, own, unnest(ws) AS a, unnest(ws[2:]) AS b, unnest(ws[3:]) AS c FROM w),
f AS (SELECT r, own, a AS g FROM x UNION ALL SELECT r, own, a || ' ' || b FROM x WHERE b IS NOT NULL UNION ALL SELECT r, own, a || ' ' || b || ' ' || c FROM x WHERE c IS NOT NULL),
n AS (SELECT r, own, g, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM n)),
k AS (SELECT g, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, y: xor(a >> 8, t[1 + (xor(a, y) & 255)]))) % 10000 AS bucket FROM u, crc),
m AS (SELECT n.*, bucket FROM n JOIN k USING (g)),
s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0) AS t FROM m GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
weight AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM m JOIN gain USING (bucket) WHERE own GROUP BY r),
score AS (SELECT w.r, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM w LEFT JOIN weight USING (r) WHERE own),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS rank, count(*) FILTER (WHERE n_words >= 20) OVER () AS fit FROM score)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * fit // 100 THEN rank END AS rank FROM ranked"""
