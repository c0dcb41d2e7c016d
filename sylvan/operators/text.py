"""Line scans: whole-word matches per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_word(line: Column, word: str) -> Column:
    """Whether word stands in line with no letter, digit or underscore of any script beside it."""
    return line.rlike(rf"(^|[^\p{{L}}\p{{N}}_])\Q{word}\E($|[^\p{{L}}\p{{N}}_])")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per line with its number from 1; a null text has none."""
    return docs.select("*", F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos", text)


def word_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lines_of(docs).where(whole_word(F.col("line"), "the")).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


QUERIES = {"word_scan_lines": word_scan_lines}
ORACLE_SQL = {
    "word_scan_lines": r"""
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM d)
        SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')""",
}
