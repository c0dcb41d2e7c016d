"""Compile databases: entries, flags, paths, commands and macro hits."""

from __future__ import annotations

import fnmatch
import posixpath
import re
import shlex

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .text import lines_of, whole_word

ENTRIES = "array<struct<file:string,directory:string,arguments:array<string>,command:string>>"
#: Flags kept as they are, prefixes of flags kept whole, flags kept with the next token.
KEEP_BARE = ("-fno-asynchronous-unwind-tables", "-fno-builtin", "-fno-omit-frame-pointer", "-fno-stack-protector", "-fno-strict-aliasing", "-fwrapv", "-m32", "-m64", "-pthread")
KEEP_PREFIX = ("-D", "-I", "-U", "-fno-", "-iquote=", "-isysroot=", "-isystem=", "-march=", "-mcpu=", "-mtune=", "-std=", "-target")
KEEP_TWO = ("-include", "-iquote", "-isysroot", "-isystem", "-target")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a database file (S2); one that is no array is an error."""
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    rows = F.when(F.ltrim("v").startswith("["), F.from_json("v", ENTRIES)).otherwise(F.raise_error(F.lit("the database is no array")).cast(ENTRIES))
    return text.select(F.inline(rows))


def argv(entries: DataFrame) -> DataFrame:
    """Adds argv: the list if there is one, else the command split as a shell would; an entry with neither is an error (P5)."""
    ship(entries.sparkSession)

    @F.arrow_udf("array<string>")
    def split(commands: pa.Array) -> pa.Array:
        return pa.array([None if c is None else shlex.split(c) for c in commands.to_pylist()], pa.list_(pa.string()))

    given = F.when(F.col("arguments").isNotNull(), F.col("arguments")).when(F.col("command").isNotNull(), split("command"))
    return entries.withColumn("argv", F.coalesce(given, F.raise_error(F.concat(F.lit("no arguments and no command: "), F.coalesce("file", F.lit("?")))).cast("array<string>")))


def kept_flags(tokens: Column) -> Column:
    """The flags to keep, in order (F4, W5): one fold that carries a flag still waiting for its argument.

    "-I" alone is kept by its prefix but is no two-token flag, so its separate argument goes.
    A two-token flag at the very end falls back to the other rules.
    """
    text = F.array().cast("array<string>")
    keep = lambda t: t.isin(*KEEP_BARE) | F.array_contains(F.transform(F.lit(list(KEEP_PREFIX)), lambda p: t.startswith(p)), True)
    step = lambda a, t: (
        F.when(a["wait"].isNotNull(), F.struct(F.concat(a["out"], F.array(a["wait"], t)).alias("out"), F.lit(None).cast("string").alias("wait")))
        .when(t.isin(*KEEP_TWO), F.struct(a["out"].alias("out"), t.alias("wait")))
        .when(keep(t), F.struct(F.concat(a["out"], F.array(t)).alias("out"), F.lit(None).cast("string").alias("wait")))
        .otherwise(a)
    )
    end = lambda a: F.when(a["wait"].isNotNull() & keep(a["wait"]), F.concat(a["out"], F.array(a["wait"]))).otherwise(a["out"])
    return F.aggregate(tokens, F.struct(text.alias("out"), F.lit(None).cast("string").alias("wait")), step, end)


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs; no globs match all."""
    if not globs:
        return F.lit(True)
    pattern = lambda g: re.sub(r"^\(\?s:(.*)\)\\[zZ]$", r"(?s)^(?:\1)$", fnmatch.translate(g)).replace("(?>", "(?:")
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(pattern(g))
    return found


def resolved(file: Column, directory: Column) -> Column:
    """An absolute path as it is, else joined to its directory and normalised."""

    @F.arrow_udf("string")
    def normal(paths: pa.Array) -> pa.Array:
        return pa.array([None if p is None else posixpath.normpath(p) for p in paths.to_pylist()], pa.string())

    return F.when(file.startswith("/"), file).otherwise(normal(F.concat_ws("/", F.coalesce(directory, F.lit(".")), file)))


def substituted(flags: Column, values: dict[str, str | None]) -> Column:
    """Replaces sentinels inside flags; a flag with one that has no value goes."""
    for name, value in values.items():
        flags = F.filter(flags, lambda f: ~f.contains(name)) if value is None else F.transform(flags, lambda f: F.replace(f, F.lit(name), F.lit(value)))
    return flags


def commands(entries: DataFrame, mode: str, globs: list[str] | None = None, sentinels: dict[str, str | None] | None = None, copts: tuple[str, ...] = ()) -> DataFrame:
    """source, flags, cmd, out for each entry that a glob takes; the glob reads the raw file name."""
    head = {"ast": ["clang", "-Xclang", "-ast-dump=json", "-fsyntax-only"], "llvm": ["clang", "-S", "-emit-llvm", "-o", "-"]}[mode]
    suffix = {"ast": ".ast.json", "llvm": ".ll"}[mode]
    found = argv(entries.where(matches_any(F.col("file"), globs or [])))
    rows = found.select(resolved(F.col("file"), F.col("directory")).alias("source"), substituted(kept_flags(F.slice("argv", 2, 1 << 30)), sentinels or {}).alias("flags"))
    return rows.select("source", "flags", F.concat(F.lit(head), F.col("flags"), F.lit(list(copts)).cast("array<string>"), F.array("source")).alias("cmd"), F.concat(F.ltrim("source", F.lit("/")), F.lit(suffix)).alias("out"))


def quoted(cmd: Column) -> Column:
    """A shell line of a command (P25)."""
    return F.array_join(F.transform(cmd, lambda a: F.when(a.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), a).otherwise(F.concat(F.lit("'"), F.replace(a, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))), " ")


def macro_hits(files: DataFrame, macros: list[str]) -> DataFrame:
    """source, hits: map from each macro found to its lines, one hit a line (A7, K5); files without hits have an empty map."""
    lines = lines_of(files)
    named = lines.select("source", "line_no", F.explode(F.filter(F.array(*(F.when(whole_word(F.col("line"), m), F.lit(m)) for m in macros)), lambda m: m.isNotNull())).alias("macro"))
    by_macro = named.groupBy("source", "macro").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))
    hits = by_macro.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("macro", F.transform("lines", lambda n: F.struct(n.alias("line")))))).alias("hits"))
    return files.select("source").distinct().join(hits, "source", "left").withColumn("hits", F.coalesce("hits", F.create_map().cast("map<string,array<struct<line:int>>>")))


def run_manifest(results: DataFrame, mode: str, database: str, root: str) -> DataFrame:
    """One JSON row of a run (K3, A6): results are source, out, error (null if ok)."""
    ok = F.col("error").isNull()
    key = "ast_json" if mode == "ast" else "llvm_ir"
    return results.agg(
        F.sort_array(F.collect_list(F.when(ok, F.struct("source", F.col("out").alias(key))))).alias("ok"),
        F.sort_array(F.collect_list(F.when(~ok, F.struct("source", "error")))).alias("failed"),
        F.struct(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed")).alias("stats"),
    ).select(F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(database).alias("compileCommands"), F.lit(root).alias("sourceRoot"), "ok", "failed", "stats")).alias("manifest"))


def manifest_lines(results: DataFrame, mode: str, database: str, root: str) -> DataFrame:
    """section, source, value: the same manifest as lines, one for each source, whose texts in the order of (section, source) are the JSON
    document (K3, A6). No row holds a run: only its counts, and each list's first source, which has no comma before it, are gathered."""
    key = "ast_json" if mode == "ast" else "llvm_ir"
    ok = F.col("error").isNull()
    rows = results.select(F.when(ok, 1).otherwise(3).alias("section"), "source", F.when(ok, F.to_json(F.struct("source", F.col("out").alias(key)))).otherwise(F.to_json(F.struct("source", "error"))).alias("json"))
    first = rows.groupBy("section").agg(F.min(F.struct("source", "json")).alias("first"))
    lines = rows.join(F.broadcast(first), "section").select("section", "source", F.concat(F.when(F.struct("source", "json") == F.col("first"), "").otherwise(","), "json").alias("value"))
    stats = results.agg(F.struct(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed")).alias("stats")).select(F.to_json(F.struct("stats")).alias("s"))
    head = F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(database).alias("compileCommands"), F.lit(root).alias("sourceRoot")))
    line = lambda section, value: F.struct(F.lit(section).alias("section"), F.lit("").alias("source"), value.alias("value"))
    begin, end = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"ok":[')), F.concat(F.lit("],"), F.substring("s", 2, 1 << 30))
    fixed = stats.select(F.inline(F.array(line(0, begin), line(2, F.lit('],"failed":[')), line(4, end))))
    return lines.unionByName(fixed)


def write_manifest(lines: DataFrame, path: str) -> None:
    """The lines as text files whose names sort as their lines do."""
    lines.repartitionByRange("section", "source").sortWithinPartitions("section", "source").select("value").write.text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """source, out, error of every line of a manifest that was written so, read in as many tasks as its files are split into."""
    item = "source string, ast_json string, llvm_ir string, error string"
    rows = spark.read.text(path).where(F.col("value").rlike(r'^,?\{"source":')).select(F.from_json(F.ltrim("value", F.lit(",")), item).alias("r"))
    return rows.select("r.source", F.coalesce("r.ast_json", "r.llvm_ir").alias("out"), "r.error")


def with_sources(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds error to commands (F11): null where files (path) has the source, else that it is not found."""
    there = files.select(F.col("path").alias("source")).distinct().withColumn("_there", F.lit(True))
    return rows.join(there, "source", "left").withColumn("error", F.when(F.col("_there").isNull(), F.concat(F.lit("source file not found: "), "source"))).drop("_there")


def macro_files(results: DataFrame, files: DataFrame, macros: list[str]) -> DataFrame:
    """source, out, value: the macro sidecar of every source (K5), those that failed or that files (source, text) lacks too."""
    hits = macro_hits(files, macros)
    every = results.select("source").distinct().join(hits, "source", "left")
    empty = F.create_map().cast("map<string,array<struct<line:int>>>")
    body = F.to_json(F.struct("source", F.lit(macros).alias("scanned_macros"), F.coalesce("hits", empty).alias("hits")))
    return every.select("source", F.concat(F.ltrim("source", F.lit("/")), F.lit(".macros.json")).alias("out"), body.alias("value"))


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where(matches_any(F.col("url"), ["http://t*/fr/*", "*page=[12]&*"])).select("page_id", "url")


def macro_hits_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("source"), "text")
    hits = macro_hits(files, ["the", "der", "les", "que"])
    return hits.select("source", F.explode("hits").alias("macro", "lines")).select("source", "macro", F.size("lines").cast("long").alias("n_lines"), F.col("lines")[0]["line"].cast("long").alias("first_line"))


QUERIES = {f.__name__: f for f in (glob_filter, macro_hits_map)}
ORACLE_SQL = {
    "glob_filter": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '^http://t.*/fr/.*$') OR regexp_matches(url, '^.*page=[12]&.*$')",
    "macro_hits_map": r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), h AS ("""
    + " UNION ALL ".join(rf"SELECT doc_id, '{m}' AS macro, n FROM l WHERE regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_]){m}($|[^\p{{L}}\p{{N}}_])')" for m in ("the", "der", "les", "que"))
    + ") SELECT doc_id::VARCHAR AS source, macro, count(*) AS n_lines, min(n)::BIGINT AS first_line FROM h GROUP BY 1, 2",
}
