"""Writers (K2, K6, K7): node tables, triples, bindings as TOML. Raw arrays and files by row are in exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(nodes: DataFrame, path: str) -> None:
    """The node table for use in Spark: document ranges in files of their own, sorted, so that scans can skip."""
    nodes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "node_id").write.mode("overwrite").parquet(path)


def write_turtle(lines: DataFrame, path: str, prefixes: dict[str, str]) -> None:
    """K2: triples as text, documents in ranges; the prefixes are a file of their own that sorts first."""
    head = lines.sparkSession.createDataFrame([(f"@prefix {p}: <{iri}> .",) for p, iri in prefixes.items()], "value string")
    head.coalesce(1).write.mode("overwrite").text(path)
    lines.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "at").select("value").write.mode("append").text(path)


def toml_string(value):
    out = value
    for a, b in (("\\", "\\\\"), ('"', '\\"')):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _head():
    return F.concat(F.lit("canonical_fn = "), toml_string(F.col("canonical_fn")), F.lit("\nsibling_fn = "), toml_string(F.col("sibling_fn")), F.lit("\n\n"))


def _ordered(rows: DataFrame, order: str, key: str, value: str, name: str) -> DataFrame:
    """The lines of each function pair, in order: few, as a pair's bindings are."""
    line = F.concat(toml_string(F.col(key)), F.lit(" = "), toml_string(F.col(value)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: F.concat(x["l"], F.lit("\n"))), "")
    return rows.groupBy("canonical_fn", "sibling_fn").agg(text.alias(name))


def bindings_toml(pairs: DataFrame) -> DataFrame:
    """K7: canonical_fn, sibling_fn, value: a text for each function pair of pairs (canonical_fn, sibling_fn, k, v), keys sorted."""
    return _ordered(pairs, "k", "k", "v", "body").select("canonical_fn", "sibling_fn", F.concat(_head(), F.lit("[bindings]\n"), "body").alias("value"))


def report_toml(idents: DataFrame, types: DataFrame) -> DataFrame:
    """K6: a text for each function pair of either table (canonical_fn, sibling_fn, canonical, sibling, first), rows in first-seen
    order; a repeated key stays visible."""
    by = ["canonical_fn", "sibling_fn"]
    both = _ordered(idents, "first", "canonical", "sibling", "i").join(_ordered(types, "first", "canonical", "sibling", "t"), by, "full")
    part = lambda name, c: F.concat(F.lit(f"[{name}]\n"), F.coalesce(c, F.lit("")))
    return both.select(*by, F.concat(_head(), part("c_idents", "i"), F.lit("\n"), part("c_types", "t")).alias("value"))
