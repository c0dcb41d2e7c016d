"""Key-to-value bindings: naming policy, overrides, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: C type -> name in the target language.
PRIMITIVES = {
    "uint8": "u8", "uint16": "u16", "uint32": "u32", "uint64": "u64", "int8": "i8", "int16": "i16", "int32": "i32", "int64": "i64",
    "size_t": "usize", "ssize_t": "isize", "char": "u8",
}


#: Fixed value: what a type's name is freed of. A name that ends in const or volatile loses it.
DECORATION = r"\s*(?:\*|const\b|volatile\b|\[\d*\])\s*"


def base_type(t: Column) -> Column:
    """A type without pointer, const, volatile and array marks."""
    return F.trim(F.regexp_replace(t, DECORATION, " "))


def pascal_name(t: Column) -> Column:
    """Without the pg_ prefix, each part between underscores capitalised."""
    parts = F.filter(F.split(F.regexp_replace(t, "^pg_", ""), "_"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def _all_lower(c: Column) -> Column:
    return (c == F.lower(c)) & (c != F.upper(c))


def _all_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def ident_rule(c: Column) -> Column:
    """Which rule names an identifier (P20); none means identity and a warning."""
    snake = _all_lower(c) & c.contains("_")
    return F.when(c.startswith("PG_") & _all_upper(c), "macro").when(c.startswith("pg_") & snake, "function").when(snake, "constant").otherwise("none")


def ident_name(c: Column) -> Column:
    return F.when(ident_rule(c) == "constant", F.upper(c)).otherwise(c)


def type_name(c: Column, override: Column | None = None) -> Column:
    """Override if present, else primitive, else prefix rule, else identity."""
    base = base_type(c)
    known = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])[base]
    found = F.coalesce(known, F.when(base.startswith("pg_"), pascal_name(base)), base)
    return found if override is None else F.coalesce(override, found)


def conflicts(pairs: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """Keys with more than one value, and how many (A10)."""
    return pairs.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def unique_bindings(pairs: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """One row a key; a key with two values is an error (A10). Repeats collapse; then self-bindings go (F8)."""
    lo, hi = F.min(value).alias("lo"), F.max(value).alias("hi")
    one = pairs.groupBy(key).agg(lo, hi)
    kept = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.concat(F.lit("conflicting values for "), F.col(key))).cast("string"))
    return one.select(key, kept.alias(value)).where(F.col(key) != F.col(value))


def derive(idents: DataFrame, types: DataFrame, overrides: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(k, v) of paired identifiers and types (canonical, sibling), as the policy renames both sides.

    An identifier's override counts only if not empty, a type's also when empty (J9). Function types and
    empty base types are left out (F7). structural_pairs and structural_type_pairs are taken as they
    stand and extra_bindings come last; any conflict among all of these is an error.
    """
    spark, o = idents.sparkSession, overrides or {}
    frame = lambda name: spark.createDataFrame(list(o.get(name, {}).items()) or [], "o string, n string")

    def renamed(rows: DataFrame, column: str, table: DataFrame, name, usable) -> DataFrame:
        t = table.select(F.col("o"), F.col("n").alias("_n"))
        return rows.join(t, F.col(column) == F.col("o"), "left").withColumn(column, F.coalesce(F.when(usable(F.col("_n")), F.col("_n")), name(F.col(column)))).drop("o", "_n")

    ident_o, type_o = frame("ident_overrides"), frame("type_overrides")
    i = idents.select(F.col("canonical").alias("k"), F.col("sibling").alias("v"))
    for c in ("k", "v"):
        i = renamed(i, c, ident_o, ident_name, lambda n: n != "")
    t = types.where(~F.col("canonical").contains("(") & ~F.col("sibling").contains("(")).select(base_type(F.col("canonical")).alias("k"), base_type(F.col("sibling")).alias("v")).where("k <> '' and v <> ''")
    for c in ("k", "v"):
        t = renamed(t, c, type_o, type_name, lambda n: n.isNotNull())
    given = [frame(n).select(F.col("o").alias("k"), F.col("n").alias("v")) for n in ("structural_pairs", "structural_type_pairs", "extra_bindings")]
    for more in (t, *given):
        i = i.unionByName(more)
    return unique_bindings(i)


def valid_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, ignored) pairs (k, v): k must be in left's values and v in right's."""
    ok = pairs.join(left.select(F.col("value").alias("k")).distinct(), "k", "left_semi").join(right.select(F.col("value").alias("v")).distinct(), "v", "left_semi").select("k", "v")
    return ok, pairs.join(ok, ["k", "v"], "left_anti")


def naming_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    c_type = F.concat(F.lit("const pg_"), F.regexp_replace("p_name", " ", "_"), F.lit(" *"))
    ident = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("p_name", " ", "_")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("PG_"), F.upper(F.regexp_replace("p_name", " ", "_")))).otherwise(F.col("p_type"))
    return part.select("p_partkey", base_type(c_type).alias("base"), type_name(c_type).alias("type_name"), ident_rule(ident).alias("rule"), ident_name(ident).alias("ident_name"))


def conflict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.sha2("text", 256).alias("k"), F.col("source").alias("v")))



_PG = "replace(p_name, ' ', '_')"
QUERIES = {f.__name__: f for f in (naming_policy, conflict_keys)}
ORACLE_SQL = {
    "naming_policy": f"""WITH x AS (SELECT p_partkey, 'pg_' || {_PG} AS base, CASE p_partkey % 3 WHEN 0 THEN {_PG} WHEN 1 THEN 'PG_' || upper({_PG}) ELSE p_type END AS i,
          list_filter(string_split({_PG}, '_'), lambda p: p <> '') AS parts FROM part),
        r AS (SELECT *, CASE WHEN i LIKE 'PG\\_%' ESCAPE '\\' AND i = upper(i) THEN 'macro' WHEN i LIKE 'pg\\_%' ESCAPE '\\' AND i = lower(i) THEN 'function' WHEN i = lower(i) AND contains(i, '_') THEN 'constant' ELSE 'none' END AS rule FROM x)
        SELECT p_partkey, base, array_to_string(list_transform(parts, lambda p: upper(p[1:1]) || lower(p[2:])), '') AS type_name, rule, CASE WHEN rule = 'constant' THEN upper(i) ELSE i END AS ident_name FROM r""",
    "conflict_keys": "SELECT sha256(text) AS k, count(DISTINCT source) AS n_values FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1",
}
