"""The prefix trie of conversations, with subtree totals by leaf-peeling message passing.

A node is a distinct sequence of the first turns. Its key is its depth and two sums, of 64 bits each, over the turns'
hashes times powers of an odd number by place: a sequence's sums follow from those of any part before it, so the
turns of one conversation may be ranked and summed in many tasks. Turns go by ranges of (conversation, turn); what a
task's first conversation has before comes from a table of one row a task.

Neighbouring nodes on a path with the same members are one link of the peeling, told by (smallest member, number of
members): a long tail of one conversation, or of its copies, takes one round and not one a turn. Each link holds how
many child links remain. In a round those with none left send their totals (leaves, saved words) to their parents, by
a grouped sum; the others count down. It ends when the root has been peeled. A round reads the links that remain.

Turns come by ``turn``, null first, then by a hash of role and text where turns are equal; equal rows all count. A null
role or text is empty; turns without a conv_id belong to no conversation and are left out. Very long texts are read
once, in the task of their row, and only their hashes go on. An empty table has no nodes, not even a root. Columns of
other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, work_path, written

BLOCK, HEADS = 20, 4
#: Odd numbers whose powers weigh the places, one for either sum.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_FULL = 1 << 64
_MOST = HEADS - 1
#: Bytes of joined ids after which a piece of a node's list ends.
PIECE = 1 << 16
KEY = ("depth", "k1", "k2")
_RANKED = "part long, c long, i long, a long, b long, words long, s1 long, s2 long, w long"
_REBUILT = "c long, depth long, k1 long, k2 long, p1 long, p2 long, words long, w long, ends boolean"


def _signed(x: int) -> int:
    return (x & (_FULL - 1)) - _FULL * (x >> 63 & 1)


def turns(conversations: DataFrame) -> DataFrame:
    """c, turn, a, b (hashes of role and text) and words of every turn; texts go no further."""
    both = [F.coalesce(F.col(x), F.lit("")) for x in ("role", "text")]
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", F.xxhash64(F.lit(1), *both).alias("a"), F.xxhash64(F.lit(2), *both).alias("b"), F.regexp_count(both[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def _powers(n: int) -> np.ndarray:
    """The first n powers of both bases."""
    out = np.empty((2, n), np.uint64)
    for row, base in zip(out, BASES):
        row[:] = base
        row[:1] = 1
        np.multiply.accumulate(row, out=row)
    return out


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and running sums of each turn among the turns of its conversation in this task."""
    part, last, count, sums, power = TaskContext.get().partitionId(), None, 0, np.zeros(3, np.uint64), np.ones(2, np.uint64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        c = batch.column(0).to_numpy()
        a, b, words = (batch.column(k).to_numpy() for k in (1, 2, 3))
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        size = np.diff(np.r_[start, n])
        at = np.arange(n) - np.repeat(start, size)
        goes_on = slice(0, size[0] if last == c[0] else 0)
        pw = _powers(size.max())
        terms = [a.view(np.uint64) * pw[0][at], b.view(np.uint64) * pw[1][at], words.view(np.uint64)]
        for k in (0, 1):
            terms[k][goes_on] *= power[k]
        out = []
        for k, term in enumerate(terms):
            total = np.cumsum(term, dtype=np.uint64)
            total -= np.repeat((total - term)[start], size)
            total[goes_on] += sums[k]
            out.append(total)
        at[goes_on] += count
        last, count, sums = c[-1], int(at[-1]) + 1, np.array([x[-1] for x in out])
        power = np.array([pow(base, count, _FULL) for base in BASES], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(n, part), c, at, a, b, words, *(x.view(np.int64) for x in out))], [x.split()[0] for x in _RANKED.split(", ")])


def ranked(conversations: DataFrame) -> DataFrame:
    """_RANKED over all of a conversation: i is a turn's place, s1, s2 and w the sums up to it and with it."""
    spark = conversations.sparkSession
    small_batches(spark, rows=50_000)
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    rows = written(turns(conversations), "turns")
    local = written(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).select("c", "a", "b", "words").mapInArrow(_rank, _RANKED), "ranked")
    # Only a task's first conversation may have turns before. One row for each task and such conversation.
    firsts = F.broadcast(local.groupBy("part").agg(F.min("c").alias("c")).select("c").distinct())
    ends = local.join(firsts, "c").groupBy("c", "part").agg(F.max(F.struct("i", "s1", "s2", "w")).alias("e")).orderBy("c", "part").collect()
    carry, before = [], None
    for r in ends:
        if before is None or before[0] != r["c"]:
            before = (r["c"], 0, 0, 0, 0)
        _, n, s1, s2, w = before
        m1, m2 = (pow(base, n, _FULL) for base in BASES)
        if n:
            carry.append((r["part"], r["c"], n, _signed(s1), _signed(s2), w, _signed(m1), _signed(m2)))
        before = (r["c"], n + r["e"]["i"] + 1, s1 + m1 * r["e"]["s1"], s2 + m2 * r["e"]["s2"], w + r["e"]["w"])
    if not carry:
        return local
    moved = local.join(F.broadcast(spark.createDataFrame(carry, "part long, c long, n0 long, x1 long, x2 long, w0 long, m1 long, m2 long")), ["part", "c"], "left")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {name: batch.column(k).fill_null(int(name[0] == "m")).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names)}
            col["i"] = col["i"] + col["n0"]
            for k in ("1", "2"):
                col["s" + k] = (col["x" + k].view(np.uint64) + col["m" + k].view(np.uint64) * col["s" + k].view(np.uint64)).view(np.int64)
            col["w"] = col["w"] + col["w0"]
            names = [x.split()[0] for x in _RANKED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(col[x]) for x in names], names)

    return moved.mapInArrow(shift, _RANKED)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a conversation's own turns after those that it takes from another: c, i, a, b, words, s1, s2, w, total, taken, h
    and the sums of both heads (t: taken, o: own)."""
    inverse = [pow(base, -1, _FULL) for base in BASES]
    for batch in batches:
        col = {name: batch.column(k).to_numpy() for k, name in enumerate(batch.schema.names)}
        depth = col["i"] - col["h"] + col["taken"] + 1
        less = col["h"] - col["taken"]  # 0 to 3
        keys, above = [], []
        depths, place = np.unique(depth, return_inverse=True)
        for k, (s, e) in enumerate((("s1", "a"), ("s2", "b"))):
            u = {x: col[x].view(np.uint64) for x in (s, "o" + s, "t" + s, e)}
            back = np.array([pow(inverse[k], n, _FULL) for n in range(HEADS)], np.uint64)[less]
            key = u["t" + s] + (u[s] - u["o" + s]) * back
            pw = np.array([pow(BASES[k], n - 1, _FULL) for n in depths.tolist()], np.uint64)[place]
            keys.append(key.view(np.int64))
            above.append((key - u[e] * pw).view(np.int64))
        out = [col["c"], depth, *keys, *above, col["words"], col["tw"] + col["w"] - col["ow"], depth == col["total"]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], [x.split()[0] for x in _REBUILT.split(", ")])


def rebuilt(rows: DataFrame) -> DataFrame:
    """_REBUILT: a row for every turn of every rebuilt conversation, and one of depth 0; p1, p2: the key above."""
    heads = F.sort_array(F.collect_list(F.when(F.col("i") < _MOST, F.struct("i", "s1", "s2", "w", "words"))))  # at most 3
    convs = rows.groupBy("c").agg(heads.alias("own"), (F.max("i") + 1).alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    base = convs.where(F.col("c") % BLOCK == 0).select(F.col("c").alias("base"), F.col("own").alias("head"))
    info = convs.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % BLOCK).join(base, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(base.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    info = info.withColumn("taken", F.size("head").cast("long")).withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    zero = F.lit(0).cast("long")
    last = lambda array, n, c: F.coalesce(F.get(array, (n - 1).cast("int"))[c], zero)
    sums = [last(F.col(array), F.col(n), s).alias(f"{p}{s}") for p, array, n in (("t", "head", "taken"), ("o", "own", "h")) for s in ("s1", "s2", "w")]
    info = written(info.select("c", "h", "n", "taken", "total", "head", *sums), "convs")
    node = lambda depth, k1, k2, p1, p2, words, w: F.struct(depth.cast("long").alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), words.alias("words"), w.alias("w"))
    none = F.lit(None).cast("long")
    above = lambda x, s: F.coalesce(F.get("head", (x["i"] - 1).cast("int"))[s], zero)
    taken = F.transform("head", lambda x: node(x["i"] + 1, x["s1"], x["s2"], above(x, "s1"), above(x, "s2"), x["words"], x["w"]))
    first = info.select("c", "total", F.inline(F.concat(F.array(node(zero, zero, zero, none, none, zero, zero)), taken))).withColumn("ends", F.col("depth") == F.col("total")).drop("total")
    own = rows.join(info.drop("head", "n"), "c").where(F.col("i") >= F.col("h")).select("c", "i", "a", "b", "words", "s1", "s2", "w", "h", "taken", "total", "ts1", "ts2", "tw", "os1", "os2", "ow")
    return first.select("c", *KEY, "p1", "p2", "words", "w", "ends").unionByName(own.mapInArrow(_rebuild, _REBUILT))


def nodes(paths: DataFrame) -> DataFrame:
    """A row for each node; members are counted in the map tasks first."""
    return paths.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.max("words").alias("words"), F.max("w").alias("w"), F.count_if("ends").alias("n_ends"), F.min(F.when(F.col("ends"), F.col("c"))).alias("first_end"))


def linked(trie: DataFrame) -> DataFrame:
    """Nodes with n_children and their parent's conv_id and n_convs."""
    kids = trie.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = trie.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    return trie.join(kids, list(KEY), "left").join(parents, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def peeled(tree: DataFrame) -> DataFrame:
    """conv_id, n_convs, n_leaves, saved, before of every link: totals of the subtree below its top, and the words above it."""
    spark = tree.sparkSession
    least = lambda c: F.min_by(c, "depth")
    links = tree.groupBy("conv_id", "n_convs").agg(least("parent_conv_id").alias("up"), least("parent_n").alias("up_n"), least(F.col("w") - F.col("words")).alias("before"), F.max("w").alias("w"), F.max_by("n_children", "depth").alias("remaining"))
    state = links.select("conv_id", "n_convs", "up", "up_n", "before", "remaining", F.when(F.col("remaining") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * (F.col("w") - F.col("before"))).alias("saved"))
    paths, schema = [], state.schema
    while True:
        paths.append(work_path(spark, "peeled"))
        state.write.parquet(paths[-1])
        state = spark.read.schema(schema).parquet(paths[-1])
        rest = state.where("remaining > 0")
        if rest.isEmpty():
            break
        sent = state.where("remaining = 0").groupBy(F.col("up").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("n"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0).cast("long"))).alias(c)
        state = rest.join(sent, ["conv_id", "n_convs"], "left").select("conv_id", "n_convs", "up", "up_n", "before", (F.col("remaining") - F.coalesce("n", F.lit(0).cast("long"))).alias("remaining"), plus("n_leaves", "more_leaves"), plus("saved", "more_saved"))
    return spark.read.schema(schema).parquet(*paths).where("remaining = 0").select("conv_id", "n_convs", "n_leaves", "saved", "before")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node in order, joined until a piece is long enough: (key, first, piece)."""
    names = [*KEY, "first", "piece"]
    now, ids, size = None, [], 0
    for batch in batches:
        out = []
        for *key, c in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if (key != now or size >= PIECE) and ids:
                out.append((*now, ids[0], ",".join(map(str, ids))))
                ids, size = [], 0
            now = key
            ids.append(c)
            size += 20
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, ids[0], ",".join(map(str, ids)))], names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    for batch in batches:
        out = []
        for *key, _, piece in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if key != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*KEY, "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], [*KEY, "sha"])


def end_digests(paths: DataFrame, trie: DataFrame) -> DataFrame:
    """depth, k1, k2, sha of every node at which two conversations or more end. Ids are sorted by ranges, so a node with very
    many is joined in many tasks; one task then reads its pieces in order, a batch at a time, as a digest must."""
    spark = paths.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = paths.where("ends").select(*KEY, "c").join(trie.where("n_ends > 1").select(*KEY), list(KEY))
    pieces = many.repartitionByRange(n, *KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, piece string")
    return pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digest, "depth long, k1 long, k2 long, sha string")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    paths = written(rebuilt(written(ranked(conversations), "places")), "paths")
    trie = written(nodes(paths), "nodes")
    tree = written(linked(trie), "tree")
    single = F.when(F.col("n_ends") == 0, _sha(F.lit(""))).otherwise(_sha(F.col("first_end").cast("string")))
    out = tree.join(peeled(tree), ["conv_id", "n_convs"]).join(end_digests(paths, trie), list(KEY), "left")
    saved = F.col("saved") - (F.col("n_convs") - 1) * (F.col("w") - F.col("words") - F.col("before"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.coalesce("sha", single).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# The same by windows and joins over whole paths. crc32 by its table, one byte at a time.
ORACLE = r"""
WITH RECURSIVE step(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
cs AS (SELECT c, n, c - c % 20 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]))) % 4 AS h
       FROM (SELECT c, count(*) AS n FROM o GROUP BY c), crc),
r AS (SELECT cs.c, 0 AS half, i, d, words FROM cs JOIN o ON o.c = cs.base AND o.i < h UNION ALL SELECT cs.c, 1, i, d, words FROM cs JOIN o ON o.c = cs.c AND o.i >= h),
q AS (SELECT c, row_number() OVER w AS depth, words, string_agg(d, '') OVER w AS prefix FROM r WINDOW w AS (PARTITION BY c ORDER BY half, i)),
p AS (SELECT c, depth, words, md5(prefix) AS k FROM q UNION ALL SELECT c, 0, 0, 'root' FROM cs),
n AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY depth, k),
l AS (SELECT p.c, p.depth, p.k, lag(p.k) OVER (PARTITION BY p.c ORDER BY p.depth) AS up FROM p),
e AS (SELECT DISTINCT depth, k, up FROM l),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM e WHERE up IS NOT NULL GROUP BY 1, 2),
full_n AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, k)),
below AS (SELECT p.depth, p.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved FROM full_n f JOIN p ON p.c = f.conv_id AND p.depth <= f.depth GROUP BY 1, 2),
ended AS (SELECT depth, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT *, max(depth) OVER (PARTITION BY c) AS last FROM p) WHERE depth = last GROUP BY depth, k)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_n f JOIN below USING (depth, k) JOIN e USING (depth, k) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.k = e.up LEFT JOIN ended ON ended.depth = f.depth AND ended.k = f.k"""
