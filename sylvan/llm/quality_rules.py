"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document's counts become four rates: characters a word, symbols a word, repeated lines a line,
repeated words a word. A KLL sketch of each rate is built per language and source in the tasks that
hold the rows and merged: per group, per language, and over all. A group of ``least`` rows or more has
fences from its own sketch, a smaller one those of its language, or of all rows. A rate may be as far
beyond the middle as ``reach`` times the way from the median to the 90th percentile (for word length,
the 10th too), plus a slack that keeps a group without spread from rejecting everything.

The base rule on few words or many repeated ones stays and comes first. Nulls: a null text has no
words and fails; a null language or source is a group like any other. Repeated rows are each judged.
Windows are compared by 64-bit hash, within one text only; a very long text is an array of as many
hashes as it has words, in one row. An empty table gives no rows. Only doc_id, text and the two group
columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
SKETCH_K = 4096
#: rate -> slack above the fence
RATES = {"word_length": 2.0, "symbol_rate": 1.0, "line_rate": 0.35, "repeat_rate": 0.25}
SCHEMA = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(placed: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; placed: (hash, place) in order, a column of its own."""
    beside = F.filter(placed, lambda s, i: (s["h"] == F.get(placed, i - 1)["h"]) | (s["h"] == F.get(placed, i + 1)["h"]))
    starts = F.sort_array(F.transform(beside, lambda s: s["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"), i.alias("last")),
        lambda a: a["sum"],
    )


def counts(docs: DataFrame, keep: tuple[str, ...] = ("lang", "source"), text: str = "text") -> DataFrame:
    """doc_id, the base counts, n_lines (those with a word) and the columns to keep.

    Arrays that a later expression looks into by place are columns of their own, so each is made once a row.
    """
    t = F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    trimmed = F.trim(t, F.lit(SPACES))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, whole_text(text).alias("t"))
    two = one.select(
        "doc_id",
        *keep,
        F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")).alias("words"),
    )
    three = two.select(
        "doc_id",
        *keep,
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    h = F.col("h")
    windows = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))
    four = three.withColumn("w", windows).drop("h")
    # Only texts with some window twice are sorted at all.
    w = F.col("w")
    placed = F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    five = four.withColumn("placed", placed).drop("w")
    repeated = F.when(F.col("placed").isNotNull(), _covered(F.col("placed"))).otherwise(F.lit(0))
    return five.select(*SCHEMA[:5], repeated.cast("long").alias("n_repeat_words"), "n_lines", *keep)


def with_rates(rows: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.select(
        "*",
        per("word_chars", "n_words").alias("word_length"),
        per("n_symbols", "n_words").alias("symbol_rate"),
        per("n_dup_lines", "n_lines").alias("line_rate"),
        per("n_repeat_words", "n_words").alias("repeat_rate"),
    )


def _fences(sketches: DataFrame, reach: float) -> DataFrame:
    at = lambda c, p: F.kll_sketch_get_quantile_double(F.col(c), F.lit(p))
    out = []
    for rate, slack in RATES.items():
        out.append((at(rate, 0.5) + reach * (at(rate, 0.9) - at(rate, 0.5)) + slack).alias(f"{rate}_high"))
    out.append((at("word_length", 0.5) - reach * (at("word_length", 0.5) - at("word_length", 0.1)) - RATES["word_length"]).alias("word_length_low"))
    return sketches.select("*", *out).drop(*RATES)


FENCES = [*(f"{r}_high" for r in RATES), "word_length_low"]


def thresholds(rows: DataFrame, least: int = 100, reach: float = 3.0, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The fences that each (language, source) gets, from merged sketches."""
    lang, source = keys
    sketched = rows.groupBy(lang, source).agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATES))
    groups = written(sketched, "sketches")
    merge = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATES)]
    own = _fences(groups, reach)
    of_lang = _fences(groups.groupBy(lang).agg(*merge), reach)
    of_all = _fences(groups.agg(*merge), reach)
    pick = lambda f: F.when(F.col("o.n") >= least, F.col(f"o.{f}")).when(F.col("l.n") >= least, F.col(f"l.{f}")).otherwise(F.col(f"a.{f}")).alias(f)
    # One row per group, language and corpus: the last join's right side is a single row.
    return own.alias("o").join(of_lang.alias("l"), F.col(f"o.{lang}").eqNullSafe(F.col(f"l.{lang}")), "left").join(F.broadcast(of_all.alias("a")), F.lit(True), "left").select(f"o.{lang}", f"o.{source}", *(pick(f) for f in FENCES))


def judge(docs: DataFrame, least: int = 100, reach: float = 3.0) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and what failed."""
    rows = written(with_rates(counts(docs)), "rates")
    found = rows.alias("r").join(thresholds(rows, least, reach).alias("f"), F.col("r.lang").eqNullSafe(F.col("f.lang")) & F.col("r.source").eqNullSafe(F.col("f.source")), "left")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    high = [F.when(F.col(r) > F.col(f"{r}_high"), F.lit(r)) for r in RATES]
    failed = F.concat_ws(",", F.when(base_failed, F.lit("base")), *high, F.when(F.col("word_length") < F.col("word_length_low"), F.lit("short_words")))
    return found.select(*SCHEMA, base_failed.alias("base_failed"), failed.alias("failed")).withColumn("kept", F.col("failed") == "")


ORACLE = r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, sum(least(8, i - p)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS p FROM d) GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN r USING (doc_id)),
x AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS word_length, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_rate,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS line_rate, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_rate FROM c),
q AS (SELECT lang, source, grouping(lang, source) AS lv, count(*) AS n,
        quantile_disc(word_length, [0.1, 0.5, 0.9]) AS wl, quantile_disc(symbol_rate, [0.5, 0.9]) AS sr, quantile_disc(line_rate, [0.5, 0.9]) AS lr, quantile_disc(repeat_rate, [0.5, 0.9]) AS rr
      FROM x GROUP BY GROUPING SETS ((lang, source), (lang), ())),
f AS (SELECT *, wl[2] + 3.0 * (wl[3] - wl[2]) + 2.0 AS wh, wl[2] - 3.0 * (wl[2] - wl[1]) - 2.0 AS wlo, sr[1] + 3.0 * (sr[2] - sr[1]) + 1.0 AS sh,
        lr[1] + 3.0 * (lr[2] - lr[1]) + 0.35 AS lh, rr[1] + 3.0 * (rr[2] - rr[1]) + 0.25 AS rh FROM q),
p AS (SELECT o.lang, o.source, CASE WHEN o.n >= 100 THEN o WHEN l.n >= 100 THEN l ELSE a END AS z
      FROM (SELECT * FROM f WHERE lv = 0) o LEFT JOIN (SELECT * FROM f WHERE lv = 1) l ON o.lang IS NOT DISTINCT FROM l.lang LEFT JOIN (SELECT * FROM f WHERE lv = 3) a ON true),
v AS (SELECT x.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, z FROM x LEFT JOIN p ON x.lang IS NOT DISTINCT FROM p.lang AND x.source IS NOT DISTINCT FROM p.source),
o AS (SELECT *, concat_ws(',', CASE WHEN base_failed THEN 'base' END, CASE WHEN word_length > z.wh THEN 'word_length' END, CASE WHEN symbol_rate > z.sh THEN 'symbol_rate' END,
        CASE WHEN line_rate > z.lh THEN 'line_rate' END, CASE WHEN repeat_rate > z.rh THEN 'repeat_rate' END, CASE WHEN word_length < z.wlo THEN 'short_words' END) AS failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, failed = '' AS kept FROM o
"""
