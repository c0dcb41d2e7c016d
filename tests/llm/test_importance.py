"""Importance resampling against brute force over n-grams."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sylvan.llm import importance, word_blocks

SCHEMA = "doc_id long, text string, weight string, n_words string"


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute(rows, target):
    sums = []
    for texts in ([t for _, t in rows], target):
        s = Counter()
        for t in texts:
            for g, n in features(t)[1].items():
                s[zlib.crc32(g.encode()) % 10000] += n
        sums.append(s)
    s, t = sums
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    out = []
    for k, text in rows:
        n, fs = features(text)
        weight = sum(c * gain(zlib.crc32(g.encode()) % 10000) for g, c in fs.items())
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, n, sum(fs.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    for i, x in enumerate(fit[: 5 * len(fit) // 100]):
        x[5] = i + 1
    return sorted(([x[0], *x[2:]] for x in out), key=repr)


def rows_of(n, seed, words=("Alpha", "beta", "gamma_x", "délta", "日本", "e5", "of", "the", "ÄRGER")):
    r = random.Random(seed)
    out = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for k in range(n)]
    return [*out, (None, "no id, but words"), (n, None), (n + 1, ""), (n + 2, "!! -- \n"), (n + 3, "of the " * 400), (n + 4, out[3][1]), (3, out[3][1]), (3, "another text with the id")]


@pytest.fixture(scope="module")
def target(spark):
    texts = ["Alpha beta gamma of the e5", "beta beta", None, "", "the of 日本 délta"]
    return texts, spark.createDataFrame([(t,) for t in texts], "text string")


def found(df):
    return sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in df.collect()), key=repr)


@pytest.mark.parametrize("few", [False, True])
def test_against_brute_force(spark, target, monkeypatch, few):
    if few:  # many shares, several turns in a share, few words and no pairs frequent
        monkeypatch.setattr(importance, "FREQUENT", 12)
        monkeypatch.setattr(importance, "SHARE", 200)
        monkeypatch.setattr(importance, "AT_ONCE", 30)
    rows = rows_of(300, 1)
    docs = spark.createDataFrame([(*x, "own", "n") for x in rows], SCHEMA).repartition(6)
    assert found(importance.resample(docs, target[1])) == brute(rows, target[0])


def test_frequent_pairs_are_dealt_by_the_third_word(spark, target):
    rows = rows_of(50, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frequent = importance.dictionary(docs, "doc_id", "text")[2]
    assert ("of", "the") in list(zip(frequent.firsts.to_pylist(), frequent.seconds.to_pylist())) and {"of", "the"} <= set(frequent.words.to_pylist())


def test_no_documents_and_no_target(spark, target):
    docs = spark.createDataFrame(rows_of(30, 3), "doc_id long, text string")
    assert importance.resample(docs.limit(0), target[1]).count() == 0
    assert found(importance.resample(docs, target[1].limit(0))) == brute(rows_of(30, 3), [])
    assert {r["weight"] for r in importance.resample(docs.withColumn("text", F.lit(None).cast("string")), target[1]).collect()} == {0}


def test_a_text_longer_than_a_batch(spark, target):
    rows = [(1, "word of the day " * 60_000), (2, "beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(importance.resample(docs, target[1])) == brute(rows, target[0])


def test_scores_in_ranges(spark, target):
    """Over a thousand documents of one score range, with ties: ranks are 1, 2, 3 without a gap."""
    rows = [(k // 2, "the same text of some words " * 5) for k in range(3000)]
    got = found(importance.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), target[1]))
    assert got == brute(rows, target[0]) and sorted(r[4] for r in got if r[4]) == list(range(1, 151))


def test_lines_and_numbers_go_round():
    import numpy as np
    import pyarrow as pa

    for strings in ([], [""], ["", "a"], ["a", "é b", "", "c"]):
        assert word_blocks.lines(word_blocks.joined(pa.array(strings, pa.large_string())), len(strings)).to_pylist() == strings
    for x in ([], [0, 1, 255, 256, 70000, 2**32 - 1]):
        assert word_blocks.unnumbers(word_blocks.numbers(np.array(x, np.int64))).tolist() == x
    assert [bytes(x) for x in word_blocks.unpacked(word_blocks.packed(b"ab", b"", b"c"))] == [b"ab", b"", b"c"]
