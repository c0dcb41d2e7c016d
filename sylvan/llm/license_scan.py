"""License scans as an exact set-similarity join, in DataFrame functions only.

Base: places where a phrase's words stand one after the other. The method adds labels: a text block
(``block`` words, a new one every ``block // 2`` words, so that any ``block // 2`` words stand together
in some block; at least twice the words of the longest template) gets a template's label if it holds at
least ``threshold`` of the template's distinct words. The templates' tokens are put in one global order,
rarest first, by counts over all documents; a block is the list of its tokens in that order. A template of
n words that needs k of them in a block has a prefix of n - k + 1 rarest words; a block with none of
these can't reach k (prefix filter), nor can one with fewer than k tokens (length filter), nor one whose
first token in common stands at place i of n and j of m with 1 + min(n - i, m - j) < k (positional
filter). What is left is verified by intersection, so every block at the threshold is found and no other.

Templates are met through an index: a table of their prefix words, joined with the words that a document has of any
template. So a document's blocks are compared with the templates it met, however many there are, and the
plan holds none of them. Documents are split into words twice: to count, and to scan.

Templates and phrases are parameters; their number bounds all that is broadcast (a row for each prefix word of each
template, and one row of all words), and either may be empty. A
null text is empty: no words, null places, score 0. Repeated rows each keep their own row, ties and an
empty table need no care. A very long text is an array of its words in one row. Only doc_id and text are
read, so further columns of any name do no harm.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text, written

#: Phrase -> label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label -> template words.
TEMPLATES = {
    "apache-2": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "proprietary": "all rights reserved no part of this publication may be reproduced",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 64
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """The words of a lower-cased text. Only at its ends can a split be empty; it is named once, as it is dear."""
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case. lower() is faster and differs only on texts with a letter outside ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    want = F.array(*map(F.lit, parts))
    return F.filter(F.transform(words, lambda w, i: F.when((w == parts[0]) & (F.slice(words, i + 1, len(parts)) == want), i)), lambda i: i.isNotNull())


def one_row(spark: SparkSession, **arrays: list[str]) -> DataFrame:
    """A table of one row: arrays of the templates' words, which the plan refers to and doesn't hold."""
    schema = ", ".join(f"{name} array<string>" for name in arrays)
    return F.broadcast(spark.createDataFrame([tuple(arrays.values())], schema))


def token_counts(docs: DataFrame, tokens: list[str], text: str = "t") -> dict[str, int]:
    """How many documents hold each token, over all documents; at most a row per token reaches the driver."""
    if not tokens:
        return {}
    held = docs.crossJoin(one_row(docs.sparkSession, tokens=sorted(tokens))).select(F.explode(F.array_intersect("tokens", words_of(F.col(text)))).alias("w"))
    return {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def template_plan(templates: dict[str, str], counts: dict[str, int], threshold: float) -> list[tuple[str, list[str], int]]:
    """(label, distinct words in global order, words needed) of each template."""
    order = lambda w: (counts.get(w, 0), w)
    out = []
    for label, words in sorted(templates.items()):
        distinct = sorted(set(words.split()), key=order)
        out.append((label, distinct, ceil(round(threshold * len(distinct), 9))))
    return out


def block_words(templates: dict[str, str], block: int | None) -> int:
    """The block that is given, or BLOCK; twice the longest template if that is more."""
    return max(block or BLOCK, 2 * max((len(t.split()) for t in templates.values()), default=0))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (label, first word, share)."""
    spark, block = docs.sparkSession, block_words(templates, block)
    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(whole_text()).alias("t"))
    counts = token_counts(lowered, sorted({w for t in templates.values() for w in t.split()}))
    plan = template_plan(templates, counts, threshold)
    order = sorted({w for _, words, _ in plan for w in words}, key=lambda w: (counts.get(w, 0), w))
    heads = sorted({p.split()[0] for p in phrases})
    strings = "array<string>"

    w = F.col("ws")
    words = lowered.select("doc_id", words_of(F.col("t")).alias("ws")).crossJoin(one_row(spark, order=order, heads=heads))
    # held: the document's words of any template, in the global order.
    filtered = words.select("doc_id", "ws", F.size("ws").alias("n"), F.array_intersect("order", "ws").alias("held"), F.array_intersect("heads", "ws").alias("begun"))
    listed = [F.when(F.array_contains("begun", p.split()[0]), F.struct(F.lit(label).alias("label"), phrase_starts(w, p).alias("at"), F.lit(len(p.split())).alias("len"))) for p, label in phrases.items()]
    hits = F.filter(F.array(*listed), lambda h: F.size(h["at"]) > 0) if listed else F.array().cast("array<struct<label:string,at:array<int>,len:int>>")
    # Words go on only for documents long enough for some template; the row number is fixed as it is written.
    least = min((need for *_, need in plan), default=1 << 30)
    kept = F.when(F.size("held") >= least, w)
    rows = written(filtered.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("n").cast("long").alias("n_words"), hits.alias("hits"), "held", kept.alias("ws")), "licenses")

    # The index: each template under the words of its prefix. A document meets a template by its words there, once:
    # by the first of them in order.
    index = spark.createDataFrame([(word, label) for label, ws, need in plan for word in ws[: len(ws) - need + 1]], "word string, label string")
    table = spark.createDataFrame([(label, ws, ws[: len(ws) - need + 1], need) for label, ws, need in plan], f"label string, want {strings}, prefix {strings}, need int")
    asked = rows.where("ws IS NOT NULL").select("row", "held", "ws", F.explode("held").alias("word")).join(F.broadcast(index), "word").join(F.broadcast(table), "label")
    met = asked.where((F.get(F.array_intersect("held", "prefix"), F.lit(0)) == F.col("word")) & (F.size("held") >= F.col("need")))

    half = max(1, block // 2)
    starts = F.transform(F.sequence(F.lit(0), F.greatest((F.size("ws") - 1 - half) / half, F.lit(0)).cast("int")), lambda i: i * half)
    blocks = F.transform(starts, lambda s: F.struct(s.alias("at"), F.array_intersect("held", F.slice("ws", s + 1, block)).alias("ws")))

    def share(b: Column) -> Column:
        n, m = F.size("want"), F.size(b["ws"])
        first = F.get(F.array_intersect("prefix", b["ws"]), F.lit(0))  # null: prefix filter
        behind = F.least(n - F.array_position("want", first), m - F.array_position(b["ws"], first))
        inside = F.size(F.array_intersect("want", b["ws"]))
        found = F.when(inside >= F.col("need"), F.struct(b["at"].alias("at"), F.col("label").alias("label"), (inside / n.cast("double")).alias("share")))
        # Length and positional filter first; the intersection is read only behind them.
        return F.when((m >= F.col("need")) & (behind + 1 >= F.col("need")), found)

    added = met.select("row", F.explode(F.filter(F.transform(blocks, share), lambda x: x.isNotNull())).alias("b"))
    # Bounded by a document's own blocks and templates.
    by_row = added.groupBy("row").agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: F.struct(b["label"].alias("label"), b["at"].alias("at"), b["share"].alias("share"))).alias("blocks"))
    none = F.array().cast("array<struct<label:string,at:int,share:double>>")
    three = rows.select("row", "doc_id", "n_words", "hits").join(by_row, "row", "left").withColumn("blocks", F.coalesce("blocks", none))
    starts = F.flatten(F.transform("hits", lambda h: h["at"]))
    base = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["label"])))
    every = F.array_sort(F.array_distinct(F.concat(F.transform("hits", lambda h: h["label"]), F.transform("blocks", lambda b: b["label"]))))
    return three.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.when(F.size("hits") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0))).alias("score"),
        "blocks",
    )


def oracle_sql(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, block: int | None = None) -> str:
    """The same rows without blocks, every block compared with every template."""
    ph = ", ".join(f"('{label}', ['{"', '".join(p.split())}'])" for p, label in phrases.items())
    tp = ", ".join(f"('{label}', ['{"', '".join(sorted(set(t.split())))}'], {ceil(round(threshold * len(set(t.split())), 9))})" for label, t in templates.items())
    block = block_words(templates, block)
    half = max(1, block // 2)
    return rf"""
WITH p(label, ws) AS (VALUES {ph}), tp(label, ws, need) AS (VALUES {tp}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
h AS (SELECT doc_id, label, i FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM d) x JOIN p ON x.ws[i + 1] = p.ws[1] AND x.ws[i + 1 : i + len(p.ws)] = p.ws),
b AS (SELECT DISTINCT doc_id, w.label, least(1.0, len(list_intersect(w.ws, c)) / len(w.ws)) AS share
      FROM (SELECT doc_id, list_distinct(ws[s * {half} + 1 : s * {half} + {block}]) AS c FROM d, unnest(range(0, greatest(0, (len(ws) - 1 - {half}) // {half}) + 1)) AS u(s)) x, tp w
      WHERE len(list_intersect(w.ws, c)) >= need),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM h GROUP BY doc_id),
e AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION SELECT doc_id, label FROM b) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM b GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0))::DOUBLE AS score
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN s USING (doc_id)"""
