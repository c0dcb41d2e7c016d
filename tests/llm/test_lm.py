"""Language-model scores: base and counts against brute force, normalisation, and held-out gain."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylvan.llm import log_bilinear as lm
from sylvan.llm import word_blocks as wb

SCHEMA = "doc_id long, text string, score string, tokens string"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def held(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1


def brute(rows):
    c = Counter(t for k, text in rows if not held(k) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return sorted(((k, held(k), len(ts := tokens(text)), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6)) for k, text in rows), key=repr)


def found(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()), key=repr)


def rows_of(n, seed):
    """Sentences of a small chain of words, so that the words before tell the next."""
    r = random.Random(seed)
    follows = {w: r.sample(range(400), 3) for w in range(400)}
    out = []
    for k in range(n):
        w, text = r.randrange(400), []
        for _ in range(r.randint(1, 150)):
            text.append(f"W{w % 17}x{w}")
            w = r.choice(follows[w])
        out.append((k, " ".join(text)))
    return [*out, (None, "no id"), (n, None), (n + 1, ""), (n + 2, "é x ÄB \x1f a\x0bb"), (n + 3, "long " * 300_000), (3, out[3][1]), (3, "same id")]


@pytest.mark.parametrize("share", [lm.SHARE, 5000])
def test_against_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(lm, "SHARE", share)
    rows = rows_of(200, 1)
    docs = spark.createDataFrame([(*x, "own", "t") for x in rows], SCHEMA).repartition(5)
    out = lm.score(docs).persist()
    assert found(out) == brute(rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out.collect())


def test_the_model_learns_from_context(spark):
    rows = rows_of(700, 2)
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("held_out AND doc_id < 700").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    assert got[0] / got[2] > got[1] / got[2] + 0.05


def test_real_documents_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).head()
    assert got[0] / got[2] > got[1] / got[2] + 0.1


def test_probabilities_sum_to_one():
    """Over all units by the model; over the tokens of a class and one unknown by their shares."""
    words = pa.array([f"w{k}" for k in range(300)], pa.large_string())
    kind = lm.endings(words)
    n = np.arange(1, 301)
    units = lm.Units(int(n.sum()) + 50, 301, words.slice(290, 10), np.concatenate([[50], n[290:], np.bincount(kind[:290], n[:290], lm.ENDINGS)]).astype(np.int64), np.bincount(kind[:290], n[:290], lm.ENDINGS).astype(np.int64), np.bincount(kind[:290], minlength=lm.ENDINGS))
    model = lm.Model.start(units)
    model.q *= 30
    every = np.arange(len(units.count))
    ahead = np.array([[3, 1, 0], [250 % len(every), 0, 0]])
    for a in ahead:
        assert abs(np.exp(model.log_probabilities(np.repeat(a[None], len(every), 0), every)).sum() - 1) < 1e-5
    of = units.of(words)
    share = 10 ** units.within(of, n)
    for u in np.unique(of[:290]):
        unknown = 10 ** units.within(np.array([u]), np.array([0]))[0]
        assert abs(share[of == u].sum() + unknown - 1) < 1e-9


def test_equal_runs_and_tables_without_training_texts(spark):
    rows = rows_of(40, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    twice = [sorted(map(tuple, lm.score(docs).collect()), key=repr) for _ in range(2)]
    assert twice[0] == twice[1]
    assert lm.score(docs.limit(0)).count() == 0
    only = [(k, "a b a") for k in range(60) if held(k)]
    out = lm.score(spark.createDataFrame(only, "doc_id long, text string"))
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in out.collect()} == {(0, 0, 0.0)}
    assert found(out) == brute(only)


def test_endings_follow_the_last_two_bytes():
    words = pa.array(["", "a", "xa", "yxa", "zzxa", "é"], pa.large_string())
    e = lm.endings(words).tolist()
    assert e[2] == e[3] == e[4] and all(0 <= x < lm.ENDINGS for x in e)
    assert lm.endings(words.slice(3, 1)).tolist() == e[3:4]
    assert wb.words_of(pa.array(["ab", "c d", None, ""], pa.string()).fill_null(""), wb.VISIBLE)[0].to_pylist() == ["ab", "c", "d"]
