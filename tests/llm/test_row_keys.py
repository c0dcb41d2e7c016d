"""Rows of equal doc_ids, or of none: other texts are other documents, also where parts of their hashes agree."""

import random

import xxhash
from pyspark.sql import functions as F

from sylvan.llm import chunk_dedup

SCHEMA = "doc_id long, text string"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n))


def short_hash_pair(seed):
    """Two texts without anything in common whose 64-bit hashes agree in their last 24 bits."""
    seen, k = {}, 0
    while True:
        text = prose(random.Random(seed + k), 40)
        h = xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFF
        if h in seen and seen[h] != text:
            return seen[h], text
        seen[h], k = text, k + 1


def kept(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["spans"]) for r in df.collect())


def expected(rows):
    """Every row under an id of its own, in the order of (id, text hash is not known): texts that stand once stay whole."""
    return sorted((k is None, k or 0, t, "") for k, t in rows)


def test_nothing_that_stands_once_is_cut(spark):
    a, b = short_hash_pair(1)
    passage = prose(random.Random(99), 60)
    alone = prose(random.Random(5), 80)
    for k in (7, None):
        rows = [(k, a), (k, b), (8, alone)]
        assert kept(chunk_dedup.query(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
        # One of the two holds a passage that stands before: only there, and only it, is cut.
        before = -5 if k else 3
        more = [(before, passage), (k, a), (k, b + " " + passage)] if k else [(k, a), (k, b + " " + passage), (before, passage)]
        got = {(r["doc_id"], r["text"]) for r in chunk_dedup.query(spark.createDataFrame(more, SCHEMA)).collect()}
        assert (k, a) in got
        assert any(d == k and t.startswith(b) for d, t in got)


def test_many_rows_without_an_id(spark):
    r = random.Random(11)
    passage = prose(r, 70)
    rows = [(None, prose(r, 30)) for _ in range(3000)] + [(None, prose(r, 20) + " " + passage) for _ in range(3)] + [(4, "x " + passage), (4, prose(r, 30)), (4, prose(r, 25))]
    got = chunk_dedup.query(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    cut = [g for g in got if g["removed_bytes"]]
    # Of four places with the passage the first in order stays; which text of no id that is follows from their hashes.
    assert len(cut) == 3 and all(len(passage) - 3 <= g["removed_bytes"] <= len(passage) + 3 for g in cut)
    assert sum(passage in g["text"] for g in got) == 1
    whole = {t for _, t in rows}
    assert all(g["text"] in whole for g in got if not g["removed_bytes"])


def test_equal_rows_are_one_document(spark):
    r = random.Random(12)
    text = prose(r, 60)
    rows = [(1, text), (1, text), (2, prose(r, 10))]
    assert kept(chunk_dedup.query(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    rows.append((3, "new " + text))
    got = chunk_dedup.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [g["removed_bytes"] > 0 for g in sorted(got, key=lambda g: g["doc_id"])] == [False, False, False, True]


def test_the_next_seed_where_one_does_not_do(spark, monkeypatch):
    real = chunk_dedup.text_hash
    monkeypatch.setattr(chunk_dedup, "text_hash", lambda seed, v: F.lit(5).cast("long") + 0 * real(seed, v) if seed in (0, 1) else real(seed, v))
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c")], SCHEMA)
    got = {(r["k"], r["row"]["text"], r["th"]) for r in chunk_dedup.keyed(docs, "text", "doc_id").collect()}
    assert len(got) == 3 and len({th for *_, th in got}) == 3 and (2, "c", 0) in got
