"""SQL files made of the parts table: queries over their trees, and over objects that change name, schema and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ddl, sqltext
from .units import _text


def _by_ten(rows: DataFrame, folder: str) -> DataFrame:
    """path, sql, dialect of rows (k, t): a file each ten keys, a text a line."""
    files = rows.groupBy(F.floor(F.col("k") / 10).alias("file")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n").alias("sql"))
    return files.select(F.concat(F.lit(f"{folder}/"), F.lpad(F.col("file").cast("string"), 8, "0"), F.lit(".sql")).alias("path"), "sql", F.lit("postgres").alias("dialect"))


def sql_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as trees, with escaped strings, nested comments, names in quotes and brackets left open."""
    k = F.col("p_partkey")
    table = _text('CREATE TABLE "my table ', k, "\" (a int DEFAULT E'it\\'s; ", k, "', b text);\n")
    loose = _text("/* a /* b */ ; c */ create unlogged table U", k, " (x int);\n")
    view = _text("create view v", k, ' as select * from "my table ', k, '" m, (select 1) z;\n')
    index = _text("create index i", k, " on u", k, " (x);\n")
    last = F.when(k % 7 == 0, _text("create table broken", k, " (a int;")).otherwise("select $q$ ; $q$;")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), F.concat(table, loose, view, index, last).alias("t"))
    one = sqltext.sql_nodes(_by_ten(rows, "t"), columns=("doc_id", "path", "depth", "kind", "ident", "type", "ref_name", "start_line")).where("depth > 0").groupBy(F.col("doc_id").alias("path"), F.get("path", F.lit(1)).cast("long").alias("seq"))
    own = lambda c: F.max(F.when(F.col("depth") == 1, F.col(c)))
    return one.agg(own("start_line").alias("line"), F.count("*").alias("size"), F.max("depth").alias("depth"), F.count_if(F.col("kind") == "group").alias("n_groups"), F.count_if(F.col("kind") == "error").alias("n_errors"), own("ident").alias("statement"), own("type").alias("head"), own("ref_name").alias("refs"))


def sql_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that are renamed, moved to another schema and dropped, with what depends on them."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    k = F.col("k")
    renamed = F.concat(F.when(k % 3 == 0, "r").otherwise("t"), k.cast("string"))
    last = F.concat(F.when(k % 5 == 0, "z.").otherwise("s."), renamed)
    phases = (
        (F.lit(True), _text("create table s.t", k, " (x int); create index i", k, " on s.t", k, " (x);")),
        (k % 4 == 0, _text("create view v", k, " as select x from s.t", k, "; create view w", k, " as select x from v", k, ";")),
        (k % 3 == 0, _text("alter table s.t", k, " rename to r", k, ";")),
        (k % 5 == 0, _text("ALTER TABLE s.", renamed, " SET SCHEMA z;")),
        (k % 7 == 0, _text("drop table ", last, F.when(k % 14 == 0, " cascade;").otherwise(";"))),
    )
    files = None
    for n, (which, text) in enumerate(phases):
        rows = _by_ten(part.where(which).select("k", text.alias("t")), f"h{n}")
        files = rows if files is None else files.unionByName(rows)
    return ddl.catalog(ddl.statements(files)).select("kind", "name", "definition")


QUERIES = {f.__name__: f for f in (sql_tree, sql_history)}
ORACLE_SQL = {
    "sql_tree": r"""WITH p AS (SELECT p_partkey AS k, 't/' || lpad((p_partkey // 10)::VARCHAR, 8, '0') || '.sql' AS path, 5 * (row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1) AS base FROM part),
        s AS (SELECT path, base AS seq, 12 AS size, 3 AS depth, 1 AS n_groups, 0 AS n_errors, 'CREATE TABLE "my table ' || k || '" (a int DEFAULT E''it\''s; ' || k || ''', b text)' AS statement, 'create table "my table ' || k || '" ()' AS head, '[]' AS refs FROM p
        UNION ALL SELECT path, base + 1, 8, 3, 1, 0, 'create unlogged table U' || k || ' (x int)', 'create unlogged table u' || k || ' ()', '[]' FROM p
        UNION ALL SELECT path, base + 2, 15, 3, 1, 0, 'create view v' || k || ' as select * from "my table ' || k || '" m, (select 1) z', 'create view v' || k || ' as select * from "my table ' || k || '" m , () z', '["\"my table ' || k || '\""]' FROM p
        UNION ALL SELECT path, base + 3, 8, 3, 1, 0, 'create index i' || k || ' on u' || k || ' (x)', 'create index i' || k || ' on u' || k || ' ()', '["u' || k || '"]' FROM p
        UNION ALL SELECT path, base + 4, 8, 3, 1, 1, 'create table broken' || k || ' (a int', 'create table broken' || k || ' () <error>', '[]' FROM p WHERE k % 7 = 0
        UNION ALL SELECT path, base + 4, 3, 2, 0, 0, 'select $q$ ; $q$', 'select ''''', '[]' FROM p WHERE k % 7 <> 0) SELECT *, seq + 1 AS line FROM s""",
    "sql_history": """WITH p AS (SELECT p_partkey AS k FROM part), t AS (SELECT 'table' AS kind, CASE WHEN k % 5 = 0 THEN 'z.' ELSE 's.' END || CASE WHEN k % 3 = 0 THEN 'r' ELSE 't' END || k AS name, 'create table s.t' || k || ' (x int)' AS definition FROM p WHERE k % 7 <> 0)
        SELECT * FROM t UNION ALL SELECT 'index', 'i' || k, 'create index i' || k || ' on s.t' || k || ' (x)' FROM p WHERE k % 7 <> 0
        UNION ALL SELECT 'view', 'v' || k, 'create view v' || k || ' as select x from s.t' || k FROM p WHERE k % 4 = 0 AND k % 14 <> 0 UNION ALL SELECT 'view', 'w' || k, 'create view w' || k || ' as select x from v' || k FROM p WHERE k % 4 = 0 AND k % 14 <> 0""",
}
