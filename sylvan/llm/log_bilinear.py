"""Language-model scores by a log-bilinear model, trained with noise-contrastive estimation.

The model predicts a token's unit from those of the ``CONTEXT`` tokens before it in its text. Units are the end of a
text, the ``SHORT`` most frequent training tokens, and ``ENDINGS`` classes of all other tokens by a hash of their last two bytes. With
context vectors R, position weights C, target vectors Q and biases b, h = sum of C[j] * R[unit before by j], and the
unit's log-probability is h . Q[u] + b[u] less the log of the sum of its exponential over all units: one matrix product for a batch
of tokens. Within a class a token has its share of the class's training count, plus a half for each token and for one
unknown token of the class, so the probabilities of all tokens and the unknown ones sum to one.

Counts are exact and over all training texts: every block of documents sends its distinct tokens with their training
counts to a dictionary dealt out by a hash of the token, and is sent the sums. Vectors are learnt from all training texts: each task runs
through its blocks from the vectors given, in batches, against ``NOISE`` units drawn from the unigram shares for each
batch; the tasks' vectors are averaged by their tokens, ``ROUNDS`` times. Only sums and the most frequent tokens come
to the driver, as many as the parameters say.

A null text is empty: it has the end alone. Rows of equal doc_id are scored each by itself and lie on the same side; a
null id counts as an empty one. Without training texts all tokens are unknown and every base is 0. A very long text is
a block of its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steady_memory, written
from .word_blocks import VISIBLE, Block, block_of, blocks, forget, groups, joined, lines, numbers, packed, raw, read, unnumbers, unpacked

SHORT, ENDINGS, CONTEXT, WIDTH = 159, 96, 3, 16
NOISE, BATCH, ROUNDS, RATE = 64, 4096, 2, 0.1
#: Tokens for each share of the dictionary; a share's distinct tokens are in memory at once.
SHARE = 4_000_000
FOLDS, HELD_OUT = 5, 1


def held_out(doc_id: int | None) -> bool:
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def endings(words: pa.Array) -> np.ndarray:
    """Class of each token, from its last two bytes."""
    at, data = raw(words)
    size = np.diff(at)
    data = np.r_[np.zeros(2, np.uint8), data].astype(np.uint64)
    last, before = np.where(size > 0, data[at[1:] + 1], 0), np.where(size > 1, data[at[1:]], 0)
    return ((last * 257 + before + 1) * 0x9E3779B1 % (1 << 32) // 64 % ENDINGS).astype(np.int64)


def trained(b: Block) -> np.ndarray:
    """Whether each token of a block stands in a training text."""
    return np.repeat(np.array([not held_out(k) for k in b.ks], bool), b.n)


def wide(x: np.ndarray) -> bytes:
    return numbers(x & 0xFFFFFFFF) + numbers(x >> 32)


def unwide(data: bytes) -> np.ndarray:
    half = len(data) // 2
    return unnumbers(data[:half]) | unnumbers(data[half:]) << 32


def dealt(b: Block, shares: int) -> list[tuple[int, np.ndarray]]:
    """(share, distinct tokens, ascending) for every share of the dictionary that a block asks."""
    to = (b.hashes % np.uint64(shares)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    used, start = np.unique(to[order], return_index=True)
    return list(zip(used.tolist(), np.split(order, start[1:])))


COUNTED = "share long, block long, body binary, tokens long, distinct long, top array<struct<word:string,n:long>>, class array<long>, class_n array<long>, class_v array<long>"


def _counted(rows: Iterator[tuple[int, int, bytes]], share: int) -> Iterator[dict]:
    """Sums of one share: a row for each block, then the share's own figures."""
    held = []
    for _, block, body in rows:
        words, n = unpacked(body)
        n = unnumbers(n)
        held.append((block, lines(words, len(n)), n))
    found = pa.concat_arrays([w for _, w, _ in held]).dictionary_encode()
    at, words = found.indices.to_numpy(), found.dictionary
    sums = np.bincount(at, np.concatenate([n for *_, n in held]), len(words)).astype(np.int64)
    i = 0
    for block, w, _ in held:
        yield {"share": share, "block": block, "body": packed(wide(sums[at[i : i + len(w)]]))}
        i += len(w)
    real = np.flatnonzero((sums > 0) & (np.diff(raw(words)[0]) > 0))
    kind = endings(words)[real]
    class_n, class_v = np.bincount(kind, sums[real], ENDINGS).astype(np.int64), np.bincount(kind, minlength=ENDINGS)
    used = np.flatnonzero(class_v)
    # Ties at the cut go by the word, as in the whole.
    least = np.partition(sums[real], -SHORT)[-SHORT] if len(real) > SHORT else 1
    top = real[sums[real] >= least]
    top = sorted(zip((-sums[top]).tolist(), words.take(pa.array(top)).to_pylist()))[:SHORT]
    yield {"share": share, "block": -1, "tokens": int(sums.sum()), "distinct": int((sums > 0).sum()), "top": [{"word": w, "n": -n} for n, w in top], "class": used.tolist(), "class_n": class_n[used].tolist(), "class_v": class_v[used].tolist()}


_COUNTED = pa.schema([
    ("share", pa.int64()), ("block", pa.int64()), ("body", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()),
    ("top", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))), *((c, pa.list_(pa.int64())) for c in ("class", "class_n", "class_v")),
])


@dataclass
class Units:
    """The units and what their probabilities start from."""

    tokens: int  # N
    distinct: int  # V
    short: pa.Array
    count: np.ndarray  # of each unit
    class_n: np.ndarray
    class_v: np.ndarray

    def of(self, words: pa.Array) -> np.ndarray:
        """The unit of each token; the empty word is the end."""
        found = pc.index_in(words, value_set=self.short).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.where(np.diff(raw(words)[0]) == 0, 0, np.where(found >= 0, found + 1, 1 + len(self.short) + endings(words)))

    def within(self, units: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of a token's share of its unit."""
        k = units - 1 - len(self.short)
        n, v = self.class_n[np.maximum(k, 0)], self.class_v[np.maximum(k, 0)]
        return np.where(k >= 0, np.log10((c + 0.5) / (n + 0.5 * (v + 1))), 0.0)

    @property
    def shares(self) -> np.ndarray:
        return (self.count + 0.5) / (self.count + 0.5).sum()


def counts(table: DataFrame) -> tuple[DataFrame, Units, int]:
    """(training counts of each block's tokens, units, shares)."""
    spark = table.sparkSession
    total = table.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).head()[0] or 0
    shares = max(1, total // SHARE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            for b in read(batches):
                n = np.bincount(b.ids[trained(b)], minlength=len(b.words))
                rows = [(share, packed(joined(b.words.take(pa.array(at))), numbers(n[at]))) for share, at in dealt(b, shares)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([b.block] * len(rows), pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["share", "block", "body"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            for share, rows in groups(batches):
                for r in _counted(rows, share):
                    yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in _COUNTED}], schema=_COUNTED)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(table.mapInArrow(send, "share long, block long, body binary").repartition(n, "share").sortWithinPartitions("share", "block").mapInArrow(sums, COUNTED), "counts")
    own = found.where("block < 0")
    tokens, distinct = own.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).head()
    top = own.select(F.inline("top")).orderBy(F.desc("n"), "word").limit(SHORT).collect()
    short = pa.array([r["word"] for r in top], pa.large_string())
    class_n, class_v = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in own.select(F.explode(F.arrays_zip("class", "class_n", "class_v")).alias("x")).groupBy("x.class").agg(F.sum("x.class_n").alias("n"), F.sum("x.class_v").alias("v")).collect():
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    n_short = np.array([r["n"] for r in top], np.int64)
    ends = tokens - class_n.sum()
    if len(short):  # the most frequent ones are units of their own
        kind = endings(short)
        class_n -= np.bincount(kind, n_short, ENDINGS).astype(np.int64)
        class_v -= np.bincount(kind, minlength=ENDINGS)
    return found, Units(tokens, distinct, short, np.concatenate([[ends], n_short, class_n]), class_n, class_v), shares


@dataclass
class Model:
    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @classmethod
    def start(cls, units: Units, seed: int = 1) -> Model:
        rng, n = np.random.default_rng(seed), len(units.count)
        vectors = lambda k: rng.normal(0, 0.1, (k, WIDTH)).astype(np.float32)
        return cls(vectors(n), vectors(n), np.ones((CONTEXT, WIDTH), np.float32) / CONTEXT, np.log(units.shares).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c, self.b)])

    def unflat(self, x: np.ndarray) -> Model:
        shapes = [y.shape for y in (self.r, self.q, self.c, self.b)]
        parts = np.split(x.astype(np.float32), np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
        return Model(*(p.reshape(s) for p, s in zip(parts, shapes)))

    def contexts(self, before: np.ndarray) -> np.ndarray:
        """h for rows of the units before."""
        h = self.r[before[:, 0]] * self.c[0]
        for j in range(1, CONTEXT):
            h += self.r[before[:, j]] * self.c[j]
        return h

    def log_probabilities(self, before: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Natural log of P(unit | units before), normalised over all units by a matrix product for each batch."""
        out = np.empty(len(units))
        ones = np.ones(len(self.b), np.float32)
        for lo in range(0, len(units), BATCH):
            at = slice(lo, lo + BATCH)
            h = self.contexts(before[at])
            s = h @ self.q.T
            s += self.b
            own = s[np.arange(len(h)), units[at]].astype(np.float64)
            top = s.max() if s.size else 0
            # One shift for the batch will do where no row's terms vanish by it.
            shift = np.full((len(h), 1), top) if top - s.max(1).min() < 60 else s.max(1, keepdims=True)
            s -= shift
            np.exp(s, out=s)
            out[at] = own - (np.log((s @ ones).astype(np.float64)) + shift[:, 0])
        return out


def before(units: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The units of the CONTEXT tokens before each token, nearest first; the end stands before a text."""
    place = np.arange(len(units)) - np.repeat(np.cumsum(n) - n, n)
    return np.stack([np.where(place >= j, np.r_[np.zeros(j, np.int64), units[:-j]], 0) for j in range(1, CONTEXT + 1)], 1)


class Trainer:
    """Noise-contrastive steps with one adaptive rate for each number (Adagrad)."""

    def __init__(self, model: Model, shares: np.ndarray):
        self.m, self.log_noise = Model(*(x.copy() for x in (model.r, model.q, model.c, model.b))), np.log(NOISE * shares).astype(np.float32)
        self.edges = np.cumsum(shares)
        self.squares = [np.full_like(x, 1e-2) for x in (self.m.r, self.m.q, self.m.c, self.m.b)]
        self.tokens = 0

    def step(self, ahead: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> None:
        m, width = self.m, WIDTH
        noise = np.minimum(np.searchsorted(self.edges, rng.random(NOISE)), len(m.b) - 1)
        h = m.contexts(ahead)
        chance = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        data = 1 - chance((h * m.q[u]).sum(1) + m.b[u] - self.log_noise[u])
        drawn = -chance(h @ m.q[noise].T + m.b[noise] - self.log_noise[noise])
        dh = data[:, None] * m.q[u] + drawn @ m.q[noise]
        summed = lambda at, x: np.bincount((at[:, None] * width + np.arange(width)).ravel(), x.ravel(), len(m.b) * width).reshape(-1, width)
        dq = summed(u, data[:, None] * h) + summed(noise, drawn.T @ h)
        db = np.bincount(u, data, len(m.b)) + np.bincount(noise, drawn.sum(0), len(m.b))
        dr = sum(summed(ahead[:, j], dh * m.c[j]) for j in range(CONTEXT))
        dc = np.stack([(m.r[ahead[:, j]] * dh).sum(0) for j in range(CONTEXT)])
        for x, g, sq in zip((m.r, m.q, m.c, m.b), (dr, dq, dc, db), self.squares):
            g = (g / len(u)).astype(np.float32) * 64
            sq += g * g
            x += RATE * g / np.sqrt(sq)
        self.tokens += len(u)

    def block(self, b: Block, units: Units) -> None:
        """All tokens of a block's training texts."""
        u = units.of(b.words)[b.ids]
        use = np.flatnonzero(trained(b))
        ahead, u, rng = before(u, b.n)[use], u[use], np.random.default_rng(b.block)
        order = rng.permutation(-(-len(u) // BATCH))
        for k in order.tolist():
            at = slice(k * BATCH, (k + 1) * BATCH)
            self.step(ahead[at], u[at], rng)


_FINE = 1 << 20


def train(table: DataFrame, units: Units, rounds: int = ROUNDS) -> Model:
    model = Model.start(units)
    for _ in range(rounds if units.tokens else 0):
        given = model

        def learn(batches: Iterator[pa.RecordBatch], given: Model = given) -> Iterator[pa.RecordBatch]:
            with steady_memory():
                t = Trainer(given, units.shares)
                for b in read(batches):
                    t.block(b, units)
                if t.tokens:
                    x = np.round(t.m.flat().astype(np.float64) * _FINE).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x), pa.array(np.full(len(x), t.tokens))], ["i", "x", "tokens"])

        # Whole numbers, so that sums don't depend on the order of tasks.
        sums = table.mapInArrow(learn, "i long, x long, tokens long").groupBy("i").agg((F.sum(F.col("x").cast("decimal(20,0)") * F.col("tokens").cast("decimal(18,0)")) / F.sum("tokens").cast("decimal(20,0)")).cast("double").alias("x"))
        x = np.zeros(len(model.flat()))
        for r in sums.collect():
            x[r["i"]] = r["x"] / _FINE
        model = model.unflat(x)
    return model


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    table = blocks(docs, VISIBLE, True, doc_id, text, size="8m")
    found, units, shares = counts(table)
    forget(spark)
    model = train(table, units)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            for _, rows in groups(batches):
                b, got = None, {}
                for block, share, body, ks, n, words, ids in rows:
                    if share < 0:
                        b = block_of(block, ks, n, words, ids)
                    else:
                        got[share] = unwide(unpacked(body)[0])
                c = np.zeros(len(b.words), np.int64)
                for share, at in dealt(b, shares):
                    c[at] = got[share]
                unit = units.of(b.words)
                base = np.log10((c + 0.5) / (units.tokens + 0.5 * (units.distinct + 1)))
                u = unit[b.ids]
                logs = model.log_probabilities(before(u, b.n), u) / np.log(10) + units.within(unit, c)[b.ids]
                starts = np.cumsum(b.n) - b.n
                sums = [np.add.reduceat(x, starts) for x in ((c > 0)[b.ids].astype(np.int64), base[b.ids], logs)]
                columns = [b.ks, [held_out(k) for k in b.ks], b.n, sums[0], np.full(len(b.n), units.tokens), *sums[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SCORED)], _SCORED.names)

    own = table.select("block", F.lit(-1).cast("long").alias("share"), F.lit(None).cast("binary").alias("body"), "ks", "n", "words", "ids")
    sent = found.where("block >= 0").select("block", "share", "body", *(F.lit(None).cast(t).alias(c) for c, t in (("ks", "array<long>"), ("n", "array<long>"), ("words", "binary"), ("ids", "binary"))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return own.unionByName(sent).repartition(n, "block").sortWithinPartitions("block", "share").mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
