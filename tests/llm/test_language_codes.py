"""Loss-weighted decoding against a plain one, and the bounds of the training sample."""

import math
import random

import numpy as np
import pytest

from sylvan.llm import language_id

LETTERS = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst", "ee": "uvwxy", "ff": "äöüßé"}


def texts(n, seed, langs=LETTERS):
    r = random.Random(seed)
    return [(" ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(3, 40))), lang) for _ in range(n) for lang in langs]


def plain_decode(model, text, margin=0.1, slack=1.5):
    f = language_id.features(text)
    if f is None:
        return "und", 0.0, None, False, False
    margins = [min(6.0, max(-6.0, sum(float(v) * float(model.weights[i, bit]) for i, v in enumerate(f) if v) + float(model.weights[-1, bit]))) for bit in range(model.code.shape[1])]
    loss = [sum(float(model.trust[k, bit]) * math.exp(-float(model.code[k, bit]) * m) for bit, m in enumerate(margins)) for k in range(len(model.languages))]
    shares = [math.exp(min(loss) - x) for x in loss]
    shares = [x / sum(shares) for x in shares]
    order = sorted(range(len(shares)), key=lambda k: (-shares[k], k))
    second = shares[order[1]] if len(order) > 1 else 0.0
    return model.languages[order[0]], shares[order[0]], model.languages[order[1]] if len(order) > 1 else None, shares[order[0]] - second < margin, min(loss) > slack * model.learned


@pytest.mark.parametrize("langs", [("aa",), ("aa", "bb", "cc"), tuple(LETTERS)])
def test_decoding_equals_a_plain_one(spark, langs):
    rows = texts(12, 1, langs)
    model = language_id.fit([t for t, _ in rows], [lang for _, lang in rows])
    mixed = [*[t for t, _ in texts(4, 2)], "abc fgh", "xyz 12", "12 !!", "", None, "ÄÖÜ abc"]
    docs = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for k, t in enumerate(mixed):
        want = plain_decode(model, t)
        assert (got[k]["lang_pred"], got[k]["lang_second"]) == (want[0], want[2]) or abs(want[1] - 0.5) < 1e-4, (k, want)
        assert abs(got[k]["score"] - want[1]) < 1e-4
        if abs(want[1] - 0.55) > 1e-3:
            assert got[k]["ambiguous"] == want[3]


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 5, 6, 40):
        code = language_id.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (2 ** (n - 2) if n <= 5 else 0.25 * code.shape[1])


def test_the_sample_keeps_its_bounds(spark):
    rows = [(k, ("w" * 9 + " ") * 10, lang) for k, lang in enumerate(["aa", "bb", "cc"] * 200)] + [(9000, "x" * 5000, "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.training_rows(docs, per_language=50, chars_per_language=1000)
    for lang in ("aa", "bb", "cc"):
        assert 1 <= len([t for t, x in found if x == lang]) <= 10
    assert [len(t) for t, x in found if x == "dd"] == [5000]  # the first of a language, whole
    assert len(language_id.training_rows(docs, per_language=50, chars_per_language=10**6, most=40)) <= 40
    model = language_id.fit([t for t, _ in found], [x for _, x in found])
    assert np.isfinite(model.weights).all()
