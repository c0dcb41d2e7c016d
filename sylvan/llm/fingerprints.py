"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's terms are its words (between ASCII white space) weighted by how often they occur. For each
of ``samples`` draws every term gets, from hashes of the term and the draw alone, r and c from the
gamma distribution of shape 2 and b uniform in (0, 1). With weight S, t = floor(ln S / r + b) and
a = c exp(-r (t + 1 - b)); the draw's sample is the (term, t) of least a. Two documents draw the same
sample with the probability of their generalised Jaccard similarity, the sum of the smaller over the
sum of the larger weights. As a is a function of (term, t) only, equal samples have equal a and others
differ but for chance, so the least a stands for its sample and a plain minimum aggregates it.

The fingerprint is four hexadecimal digits of each draw's hash; likeness is the share of equal draws.
A text without a word has the fingerprint of no terms. Nulls are empty texts. Rows are ordered by
doc_id, null first, rows with equal ids by a hash of the text (equal rows in any order: they give equal results);
the row after the last is the first. A very long text is exploded to its distinct words, a row each. An empty table
gives no rows. Only doc_id and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

SAMPLES = 48
_NULL_ID = -(1 << 63)


def sample_value(term: str, log_weight: str, draw: int) -> Column:
    """a of a term (a hash) for one draw."""
    h, g = f"xxhash64({term}, {2 * draw})", f"xxhash64({term}, {2 * draw + 1})"
    odd = lambda bits, shift, n: f"((shiftrightunsigned({bits}, {shift}) & {(1 << n) - 1}L) + 0.5D)"
    r = f"-ln({odd(h, 0, 21)} * {odd(h, 21, 21)} * {2.0**-42!r}D)"
    b = f"({odd(h, 42, 22)} * {2.0**-22!r}D)"
    c = f"-ln({odd(g, 0, 32)} * {odd(g, 32, 32)} * {2.0**-64!r}D)"
    return F.expr(f"({c}) * exp(({r}) * ({b} - 1D - floor({log_weight} / ({r}) + {b})))")


def weighted_terms(text: Column) -> Column:
    """array<struct<term, n>> of a text: hashes of words sorted, runs counted."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def runs(sorted_hashes: Column) -> Column:
    ends = F.filter(F.transform(sorted_hashes, lambda h, i: F.when(F.coalesce(F.get(sorted_hashes, i + 1) != h, F.lit(True)), i)), lambda i: i.isNotNull())
    return ends


def fingerprints(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys, draws (array of long) per row of texts; rows must differ in keys.

    No shuffle if texts is already partitioned by some of the keys.
    """
    hashed = texts.select(*keys, weighted_terms(F.col(text)).alias("h"))
    ended = hashed.select("*", runs(F.col("h")).alias("e"))
    terms = ended.select(*keys, F.transform("e", lambda i, j: F.struct(F.get("h", i).alias("term"), F.log((i - F.coalesce(F.get("e", j - 1), F.lit(-1))).cast("double")).alias("w"))).alias("terms"))
    rows = terms.select(*keys, F.explode_outer("terms").alias("x")).select(*keys, "x.term", "x.w")
    least = rows.groupBy(*keys).agg(*(F.min(sample_value("term", "w", k)).alias(f"a{k}") for k in range(samples)))
    return least.select(*keys, F.array(*(F.xxhash64(f"a{k}") for k in range(samples))).alias("draws"))


def shown(draws: Column) -> Column:
    return F.array_join(F.transform(draws, lambda d: F.lower(F.lpad(F.hex(d.bitwiseAND(F.lit(0xFFFF))), 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a).cast("double")


def key_ranges(rows: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending keys that exist in rows and cut it into about equal ranges, the least key first; at most parts + 1."""
    at = [i / parts for i in range(1, parts)] or [0.5]
    found = rows.agg(F.min(key).alias("least"), F.percentile_approx(key, at, max(10_000, 100 * parts)).alias("cuts")).head()
    return sorted({found["least"], *(found["cuts"] if parts > 1 else [])}) if found["least"] is not None else []


def range_of(key: str, bounds: list[int]) -> Column:
    """How many bounds are at or below the key, in two steps of about the root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    longs = lambda b: F.lit(b).cast("array<long>")
    coarse = F.size(F.filter(longs(bounds[::step]), lambda b: b <= F.col(key)))
    return F.when(coarse > 0, (coarse - 1) * step + F.size(F.filter(F.slice(longs(bounds), (coarse - 1) * step + 1, step), lambda b: b <= F.col(key)))).otherwise(0)


def with_next(docs: DataFrame, parts: int, tasks: int) -> tuple[DataFrame, Window]:
    """Every row with part, rid and next_text (of the row after it), and the window over its part.

    Parts are ranges of doc_id. The rows at the lower end of a part are sent to the part before as guests
    as well, after its own rows, so that the one shuffle brings every row's next row along.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("k"), whole_text().alias("t"))
    bounds = key_ranges(rows, "k", parts)
    n = max(1, len(bounds))
    own = range_of("k", bounds) if bounds else F.lit(1)
    placed = rows.withColumn("own", own.cast("int"))
    first = F.col("k") == F.get(F.lit(bounds or [0]).cast("array<long>"), F.col("own") - 1)
    guest = F.when(first, F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("guest")), F.struct(F.when(F.col("own") == 1, n).otherwise(F.col("own") - 1).alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("guest"))))
    sent = placed.select("doc_id", "k", "t", F.xxhash64("t").alias("th"), F.explode(guest).alias("to")).select("to.part", "to.guest", "doc_id", "k", "th", "t")
    window = Window.partitionBy("part").orderBy("guest", "k", "th")
    return sent.repartition(tasks, "part").select("*", F.row_number().over(window).alias("rid"), F.lead("t").over(window).alias("next_text")), window


def query(docs: DataFrame, samples: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, _ = with_next(docs, parts or 4 * tasks, tasks)  # several parts a task even out how they hash
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("guest"), F.concat(F.substring("t", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    keyed = rows.select("part", "guest", "rid", "doc_id", n.cast("long").alias("n_chars"), "t", edited.alias("edited"))
    sides = keyed.select(
        "part", "guest", "rid", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.explode(F.when(F.col("guest"), F.array(F.struct(F.lit(False).alias("changed"), F.col("t").alias("x")))).otherwise(F.array(F.struct(F.lit(False).alias("changed"), F.col("t").alias("x")), F.struct(F.lit(True).alias("changed"), F.col("edited").alias("x"))))).alias("side"),
    ).select("part", "guest", "rid", "doc_id", "n_chars", "edited_sha256", "side.changed", "side.x")
    found = fingerprints(sides, ["part", "guest", "rid", "doc_id", "n_chars", "edited_sha256", "changed"], "x", samples)
    # Still partitioned by part: both sides of a row, then the next row's, without another shuffle.
    order = Window.partitionBy("part").orderBy("changed", "guest", "rid")
    by_row = Window.partitionBy("part", "rid").orderBy("changed")
    near = found.select("*", F.lead("draws").over(by_row).alias("edited_draws")).select("*", F.lead("draws").over(order).alias("next_draws"))
    d = F.col("draws")
    return near.where(~F.col("changed") & ~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256", shown(d).alias("fingerprint"), shown(F.col("edited_draws")).alias("edited_fingerprint"), likeness(d, F.col("edited_draws")).alias("near_edited"), likeness(d, F.col("next_draws")).alias("near_next")
    )
