"""Dictionaries in first-seen order, encoding and corpus counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..work import written


def vocabulary(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """Distinct values numbered from 1 by where each is first seen; 0 stands for the empty value (A1).

    Rows are combined to one per value before the numbering; numbers are counted within ranges of the
    order and shifted by the ranges before, so the vocabulary is never sorted in one task.
    """
    first = rows.where((F.col(value).isNotNull()) & (F.col(value) != "")).groupBy(F.col(value).alias("value")).agg(F.min(F.struct(*order)).alias("first"))
    return numbered(first, "first").select("value", (F.col("n") + 1).alias("index"))


def _ranged(rows: DataFrame, key: str) -> DataFrame:
    """rows with range (ascending with the key) and within (the place in it from 0); written once, as bounds are drawn anew
    each time that ranges are made."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # An explicit number, as ranges must stay one partition each; the id is read off the partition.
    ranged = rows.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id())
    return written(ranged.withColumn("range", F.shiftright("at", 33)).withColumn("within", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at"), "ranges")


def _shifted(ranged: DataFrame, total) -> DataFrame:
    """ranged with shift, the totals of the ranges before; the window has a row per range."""
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(total.alias("total"))
    return ranged.join(totals.select("range", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("shift")), "range")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds n, the row's rank by key from 0 (keys differ). Ranges of the key are ranked apart and shifted by those before."""
    return _shifted(_ranged(rows, key), F.count("*")).withColumn("n", F.col("shift") + F.col("within")).drop("range", "within", "shift")


def encode(rows: DataFrame, value: str, vocab: DataFrame, to: str) -> DataFrame:
    """Replaces a value by its index, 0 if it has none (J1). Spark broadcasts vocab where statistics show it small."""
    return rows.join(vocab.withColumnRenamed("value", "_v"), F.col(value) == F.col("_v"), "left").withColumn(to, F.coalesce("index", F.lit(0))).drop("_v", "index", value)


def corpus_counts(nodes: DataFrame, doc: str, bytes_per_node: int = 37) -> DataFrame:
    """Documents, nodes, distinct kinds, identifiers and types, bytes in all and a node (A2)."""
    found = nodes.agg(F.count_distinct(doc).alias("n_docs"), F.count("*").alias("n_nodes"), *(F.count_distinct(F.nullif(F.col(c), F.lit(""))).alias(f"n_{c}s") for c in ("kind", "ident", "type")))
    return found.withColumn("total_bytes", F.col("n_nodes") * bytes_per_node).withColumn("bytes_per_node", F.expr("total_bytes div greatest(n_nodes, 1)"))


def cumulative(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Rows of each group and the total up to it, by order (A3): summed within ranges of the order, shifted by those before."""
    counted = rows.groupBy(group).agg(F.count("*").alias("added"))
    by = Window.partitionBy("range").orderBy("within").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _shifted(_ranged(counted, order), F.sum("added")).select(F.col(group), "added", (F.col("shift") + F.sum("added").over(by)).alias("total"))


def vocab_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_type", "p_partkey")


def encode_with_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    return encode(orders, "o_orderpriority", vocabulary(orders, "o_orderpriority", "o_orderkey"), "priority_idx")


def counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tree import page_nodes

    return corpus_counts(page_nodes(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")), "page_id")


def cumulative_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cumulative(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id"), "conv_id", "conv_id")


def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _nodes_sql() -> str:
    from .tree import _NODES

    return _NODES


QUERIES = {"vocab_first_seen": vocab_first_seen, "encode_with_vocab": encode_with_vocab, "corpus_counts": counts_query, "cumulative_nodes": cumulative_nodes, "token_histogram": token_histogram}
ORACLE_SQL = {
    "vocab_first_seen": "SELECT p_type AS value, row_number() OVER (ORDER BY min(p_partkey)) AS index FROM part GROUP BY p_type",
    "encode_with_vocab": "WITH v AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY min(o_orderkey)) AS i FROM orders GROUP BY 1) SELECT o_orderkey, coalesce(i, 0)::BIGINT AS priority_idx FROM orders LEFT JOIN v ON o_orderpriority = p",
    "corpus_counts": f"WITH {_nodes_sql()} SELECT count(DISTINCT page_id) AS n_docs, count(*) AS n_nodes, count(DISTINCT kind) AS n_kinds, 0::BIGINT AS n_idents, 0::BIGINT AS n_types, count(*) * 37 AS total_bytes, count(*) * 37 // greatest(count(*), 1) AS bytes_per_node FROM n",
    "cumulative_nodes": "SELECT conv_id, count(*) AS added, (sum(count(*)) OVER (ORDER BY conv_id))::BIGINT AS total FROM conversations GROUP BY conv_id",
    "token_histogram": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) GROUP BY word",
}
