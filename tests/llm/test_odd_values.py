"""Whole results on rows with equal ids, without ids and without texts, and on very long texts."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from sylvan.llm import fingerprints, license_scan, ngram_join, queries, token_records

SCHEMA = "doc_id long, text string"


def text_hash(t):
    return int(np.array([xxhash.xxh64_intdigest(t.encode(), 42)], np.uint64).view(np.int64)[0])


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("ka mo ti re su la".split()) + r.choice("ln pe xo by da".split()) for _ in range(n))


ROWS = [(None, "no id"), (None, None), (None, prose(1, 30)), (3, "three"), (3, prose(2, 20)), (3, "three"), (-5, ""), (8, None), (9, "é́ 日本 \U0001f600 x"), (10, prose(3, 5000))]


def ordered(rows):
    return sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, text_hash(x[1])))


def test_fingerprints(spark):
    rows = ordered(ROWS)
    want = []
    for (k, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprints.query(spark.createDataFrame(ROWS, SCHEMA).repartition(4)).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    same = {r["fingerprint"] for r in got if r["doc_id"] == 3 and r["n_chars"] == 5}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_records(spark):
    tokenizer = Tokenizer.from_file(queries.WORD_BPE)
    start, want = 0, []
    # Of rows with one id a null text goes by the hash of nothing, which is the seed.
    rows = sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, 42 if x[1] is None else text_hash(x[1])))
    for k, t in ((k, t or "") for k, t in rows):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_records.digest_query(spark.createDataFrame(ROWS, SCHEMA).repartition(3), queries.WORD_BPE).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join(spark):
    base = prose(5, 200)
    words = base.split()
    near = " ".join([*words[:-6], "other", "end"])
    rows = [*ROWS, (20, base), (21, near), (22, near), (22, prose(6, 50)), (23, prose(6, 50) + " x"), (None, base), (24, prose(7, 4000)), (25, prose(7, 4000) + " more"), (26, "one"), (27, "ONE"), (28, "\t \n")]
    sets = [(k, shingles(t)) for k, t in rows]
    parent = {k: k for k, _ in rows if k is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if a != b and 100 * len(x & y) >= 75 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    want = sorted(((k, len(s), None if k is None else find(k)) for k, s in sets), key=repr)
    got = sorted((tuple(r) for r in ngram_join.query(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("words", [40_000])
def test_license_scan_of_a_long_text(spark, words):
    text = prose(8, words) + " Released under the MIT License. " + prose(9, words) + " all rights reserved, no part of this publication may be reproduced"
    got = license_scan.scan(spark.createDataFrame([(1, text), (1, text), (None, None)], SCHEMA)).collect()
    for r in got:
        if r["doc_id"] == 1:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (2 * words + 16, 1, words + 1, words + 1, "mit", "mit,proprietary")
        else:
            assert (r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, 0, None, "", 0.0)


def test_license_scan_with_many_long_templates(spark, oracle, monkeypatch):
    """Fifty templates of 100 to 1,500 words, by SQL; the plan is the one of a few."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = random.Random(4)
    words = [w for row in docs.select("text").limit(60).collect() for w in (row["text"] or "").lower().split() if w.isascii() and w.isalnum()]
    templates = {f"t{k}": " ".join(r.choice(words) for _ in range(r.randint(100, 1500))) for k in range(47)}
    whole = [row["text"] for row in docs.where("length(text) between 700 and 4000").orderBy("doc_id").limit(3).collect()]
    for k, t in enumerate(whole):  # and some that documents hold
        kept = [w for w in t.lower().replace("'", " ").split() if w.isascii() and w.isalnum()]
        templates[f"own{k}"] = " ".join(kept)
    got = license_scan.scan(docs, templates=templates).drop("blocks")
    out = oracle(got, license_scan.oracle_sql(templates=templates))
    assert out["labels"].str.contains("own").sum() >= 2
    size = lambda t: len(license_scan.scan(docs, templates=t)._jdf.queryExecution().optimizedPlan().toString())
    assert size(templates) < 1.2 * size(dict(list(templates.items())[:5]))
