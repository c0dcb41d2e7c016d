"""Readers (S6, S15, S16, S17, J12): AST documents of a run manifest, whole text files, vocabularies. Raw arrays are in exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import ARRAYS, read_files

__all__ = ["ARRAYS", "capabilities", "load_vocabulary", "manifest_documents", "manifest_sources", "plain_path", "spec", "text_files"]

MANIFEST = "mode string, ok array<struct<source:string,ast_json:string,llvm_ir:string>>, failed array<struct<source:string,error:string>>, stats struct<total:int,succeeded:int,failed:int>"


def text_files(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(path, text) of whole files; missing ones give no rows."""
    if glob and isinstance(path, str):
        return read_files(spark, path, glob, missing=True)
    reader = spark.read.option("ignoreMissingFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def manifest_sources(spark: SparkSession, manifest: str) -> DataFrame:
    """(source, file) of the manifest's ok rows in source order, which fixes the corpus order."""
    rows = spark.read.option("multiLine", True).schema(MANIFEST).json(manifest)
    return rows.select(F.explode("ok").alias("o")).select("o.source", F.coalesce("o.ast_json", "o.llvm_ir").alias("file"))


def plain_path(uri):
    """A file's path without scheme, host and percent signs."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit("+"), F.lit("%2B")))


def manifest_documents(spark: SparkSession, manifest: str, root: str) -> tuple[DataFrame, DataFrame]:
    """(readable, skipped): (doc_id, source) of documents that are JSON, and the files that aren't or are missing.

    A file below root belongs to the manifest's file whose path ends in its path from there; the longest such path wins, so
    files of one name in different folders are different, and a run's folder may have moved.
    """
    listed = manifest_sources(spark, manifest).select(F.col("source").alias("doc_id"), "file")
    parts = F.filter(F.split("file", "/"), lambda p: ~p.isin("", "."))
    ends = listed.select("doc_id", "file", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("at"))
    top = F.regexp_replace(plain_path(F.lit(root)), "/+$", "")
    files = text_files(spark, root, "*.json").select(F.substring(plain_path(F.col("path")), F.length(top) + 2, F.lit(1 << 30)).alias("at"), "text")
    best = ends.join(files, "at").groupBy("doc_id", "file").agg(F.max_by("text", F.length("at")).alias("text"))
    met = listed.join(best, ["doc_id", "file"], "left")
    ok = F.try_parse_json("text").isNotNull()
    return met.where(ok).select("doc_id", F.col("text").alias("source")), met.where(~F.coalesce(ok, F.lit(False))).select("doc_id", "file")


def load_vocabulary(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(index, value) of a vocabulary file, a JSON array of strings."""
    rows = spark.read.text(f"{folder}/{name}.json", wholetext=True).select(F.from_json("value", "array<string>").alias("v"))
    return rows.select(F.posexplode("v").alias("index", "value"))


def spec(srcs: list[str], module: str, symbol: str, spark: SparkSession) -> DataFrame:
    """One declared spec."""
    return spark.createDataFrame([(srcs, module, symbol)], "srcs array<string>, module string, symbol string")


#: What a codec service can be asked.
OPERATIONS = ("Capabilities", "Deparse", "Health", "Parse")


def capabilities(spark: SparkSession, languages: dict[str, tuple[str, ...]]) -> DataFrame:
    """(language, operation) of a codec service (S19, U8): those asked for a language, and Health and Capabilities for each.
    An operation it doesn't have is an error."""
    unknown = {o for ops in languages.values() for o in ops} - set(OPERATIONS)
    if unknown:
        raise ValueError(f"no such operation: {', '.join(sorted(unknown))}")
    return spark.createDataFrame([(name, o) for name, ops in languages.items() for o in sorted({*ops, "Capabilities", "Health"})], "language string, operation string")
