"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; one binary classifier per bit, logistic regression over
hashed character n-grams (1 to 3 letters, case-folded, other characters as one space), predicts that bit. Loss-weighted
decoding sums the exponential loss of each language's codeword over the bits, weighted by how well each
bit's classifier does for that language on the training rows, and takes the smallest. The score is the
share of exp(-loss) of the best language; a row is ambiguous if the second is within ``margin`` of it. It is
unlike the languages learned if its least loss is over ``slack`` times the greatest of the training rows
that are predicted right; one learned language alone has the same loss for all texts, so none is unlike it.

Classifiers are fitted on the driver on a bounded sample: at most ``per_language`` rows a language and ``rows`` in all, shared
out evenly, those of smallest hash of id and text. Texts are whole; a language's first is taken however long it is, further
ones while all its texts have at most ``chars_per_language`` characters. So the matrix has at most ``rows`` times ``DIMENSIONS``
numbers of 4 bytes, 655 MB, read in slices. Over ``languages`` languages are an error, none is left out. Prediction reads every whole text. A text that is null or without a letter is ``und`` with score 0.
Each row is judged by itself, repeated ones alike; of equal scores the language first in order wins. With no labelled
row (an empty table, or none with a language) nothing is learned and every text is ``und``. A very long text is one
vector of its n-gram counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steady_memory

UNDETERMINED = "und"
DIMENSIONS = 1 << 13
_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point to lower-case letter; other characters, emoji among them, to a space."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in filter(str.isalpha, map(chr, range(0x110000))):
            low = c.lower()
            table[ord(c)] = ord(low) if len(low) == 1 else ord(c)
        _FOLD = table
    return _FOLD


def features(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Square-root frequencies of hashed n-grams, of length one; None without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = fold_table()[points]
    letters = low != 32
    if not letters.any():
        return None
    low = low[letters | np.r_[True, letters[:-1]]]  # a run of other characters is one space
    low = np.r_[np.uint32(32), low, np.uint32(32)].astype(np.uint32)
    one = low * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x55555555)) * np.uint32(0x85EBCA6B) + low[1:] * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + low[2:] * np.uint32(0x165667B1)
    counts = np.zeros(dimensions, np.float64)
    for grams in (one, two, three):
        counts += np.bincount(((grams ^ (grams >> np.uint32(16))) * np.uint32(0x45D9F3B)) >> np.uint32(32 - dimensions.bit_length() + 1), minlength=dimensions)
    counts = np.sqrt(counts)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits for up to five languages, else the best of random codes of 10 log2 n bits."""
    if n <= 5:
        return np.array([[1 if i == 0 or (bit >> (i - 1)) & 1 == 0 else -1 for bit in range(1, 1 << (n - 1))] for i in range(n)]) if n > 1 else np.ones((1, 1))
    rng, best, found = np.random.default_rng(7), -1, None
    for _ in range(200):
        code = rng.choice([-1, 1], (n, int(np.ceil(10 * np.log2(n)))))
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > best and (abs(code.sum(0)) < n).all():
            best, found = apart, code
    return found


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (features + 1, bits)
    trust: np.ndarray  # (languages, bits), rows sum to 1
    dimensions: int = DIMENSIONS
    learned: float = np.inf  # greatest loss of a training row predicted right

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Every language's loss, for each row."""
        margins = np.clip(x @ self.weights[:-1] + self.weights[-1], -6, 6)
        return (self.trust[None] * np.exp(-self.code[None] * margins[:, None, :])).sum(2)

    @staticmethod
    def shares(loss: np.ndarray) -> np.ndarray:
        """Every language's score, for each row."""
        share = np.exp(-loss + loss.min(1, keepdims=True))
        return share / share.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], dimensions: int = DIMENSIONS, rounds: int = 120) -> Model:
    rows = [(f, lang) for f, lang in ((features(t, dimensions), lang) for t, lang in zip(texts, langs)) if f is not None]
    languages = sorted({lang for _, lang in rows})
    code = codewords(max(1, len(languages)))
    x = np.zeros((len(rows), dimensions), np.float32)
    for i, (f, _) in enumerate(rows):
        x[i] = f
    of = np.array([languages.index(lang) for _, lang in rows], int)
    weights = np.zeros((dimensions + 1, code.shape[1]), np.float32)
    if len(languages) > 1:
        want = code[of].astype(np.float32)
        share = (1 / np.bincount(of)[of] / len(languages)).astype(np.float32)[:, None]  # every language weighs the same
        speed = np.zeros_like(weights)
        slices = [slice(lo, lo + 2048) for lo in range(0, len(x), 2048)]
        for _ in range(rounds):  # Nesterov's gradient on the regularised logistic loss
            ahead = weights + 0.9 * speed
            change = np.vstack([1e-5 * ahead[:-1], np.zeros((1, code.shape[1]), np.float32)])
            for at in slices:
                slope = -want[at] * share[at] / (1 + np.exp(np.clip(want[at] * (x[at] @ ahead[:-1] + ahead[-1]), -30, 30)))
                change[:-1] += x[at].T @ slope
                change[-1] += slope.sum(0)
            speed = 0.9 * speed - 4.0 * change
            weights = weights + speed
        right = np.concatenate([((x[at] @ weights[:-1] + weights[-1]) * want[at] > 0).astype(float) for at in slices])
        trust = np.array([right[of == i].mean(0) for i in range(len(languages))]) + 1e-6
    else:
        trust = np.ones(code.shape)
    model = Model(languages, code, weights, trust / trust.sum(1, keepdims=True), dimensions)
    if len(languages) > 1:
        loss = np.concatenate([model.losses(x[lo : lo + 256]) for lo in range(0, len(x), 256)])
        model.learned = float(loss.min(1)[loss.argmin(1) == of].max(initial=0.0))
    return model


def training_rows(labelled: DataFrame, per_language: int, chars_per_language: int, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", languages: int = 1000, most: int = 20_000):
    """The bounded sample, brought to the driver: a hash threshold per language, then exact bounds.
    ValueError if the rows have more than so many languages."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    h = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 30))
    counts = {r[0]: r[1:] for r in rows.groupBy(lang).agg(F.count("*"), F.sum(F.length(text)), F.min(h)).orderBy(F.desc("count(1)"), lang).limit(languages + 1).collect()}
    if len(counts) > languages:
        raise ValueError(f"over {languages} languages in column {lang}; raise the parameter languages")
    if not counts:
        return []
    per_language = max(1, min(per_language, most // len(counts)))
    # The hashes that are taken: so many that the bounds are met, and each language's least in any case.
    below = {k: max(least + 1, int((1 << 30) * min(1.0, per_language / n, chars_per_language / max(1, c)))) for k, (n, c, least) in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in below.items() for x in pair]), F.col(lang))
    sample = rows.where(h < limit).select(F.col(text), F.col(lang), h.alias("h"))
    taken, size = {}, {}
    out = []
    for r in sorted(sample.collect(), key=lambda r: (r[1], r[2], r[0])):
        if taken.get(r[1], 0) < per_language and (not taken.get(r[1]) or size[r[1]] + len(r[0]) <= chars_per_language):
            taken[r[1]] = taken.get(r[1], 0) + 1
            size[r[1]] = size.get(r[1], 0) + len(r[0])
            out.append((r[0], r[1]))
    return out


def train(labelled: DataFrame, per_language: int = 500, chars_per_language: int = 3_000_000, languages: int = 1000, rows: int = 20_000) -> Model:
    found = training_rows(labelled, per_language, chars_per_language, languages=languages, most=rows)
    return fit([t for t, _ in found], [lang for _, lang in found])


PREDICTED = "lang_pred string, score double, lang_second string, ambiguous boolean, unlike boolean"


def judged(docs: DataFrame, model: Model, text: str = "text", margin: float = 0.1, slack: float = 1.5) -> DataFrame:
    """row (all columns of docs) and judged (lang_pred, score, lang_second, ambiguous, unlike)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages, bits and dimensions

    @F.arrow_udf(PREDICTED)
    def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with steady_memory():
            m = shared.value
            types = [pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.bool_()]
            for batch in batches:
                texts = batch.to_pylist()
                rows = [(UNDETERMINED, 0.0, None, False, False)] * len(texts)
                for lo in range(0, len(texts), 256):
                    found = [features(t, m.dimensions) for t in texts[lo : lo + 256]]
                    at = [i for i, f in enumerate(found) if f is not None]
                    if at and m.languages:
                        loss = m.losses(np.array([found[i] for i in at]))
                        for i, s, unlike in zip(at, m.shares(loss), loss.min(1) > slack * m.learned):
                            order = np.argsort(-s, kind="stable")
                            second = float(s[order[1]]) if len(order) > 1 else 0.0
                            rows[lo + i] = (m.languages[order[0]], float(s[order[0]]), m.languages[order[1]] if len(order) > 1 else None, float(s[order[0]]) - second < margin, bool(unlike))
                yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], [c.split()[0] for c in PREDICTED.split(", ")])

    return docs.select(F.struct("*").alias("row"), verdicts(F.col(text)).alias("judged"))


def predict(docs: DataFrame, model: Model, text: str = "text", margin: float = 0.1, slack: float = 1.5) -> DataFrame:
    """Adds lang_pred, score, lang_second, ambiguous and unlike to every row; other columns pass through, those of
    these names are replaced."""
    made = [c.split()[0] for c in PREDICTED.split(", ")]
    return judged(docs, model, text, margin, slack).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in made), "judged.*")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_second, ambiguous of every document."""
    model = train(docs.where(~held_out()))
    return predict(docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text"), model).drop("text", "unlike")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Drops the documents whose language is undetermined or ambiguous, or that are unlike the languages learned.
    All columns stay, whatever their names."""
    found = judged(docs, train(docs.where(~held_out())))
    return found.where((F.col("judged.lang_pred") != UNDETERMINED) & ~F.col("judged.ambiguous") & ~F.col("judged.unlike")).select("row.*")
