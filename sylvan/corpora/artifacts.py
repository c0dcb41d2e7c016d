"""Files that other tools take, written and read back: raw arrays, artifacts at their own paths, a run's manifest and
documents, SQL sources; and levels of a dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import closure, compdb, ddl, dictionary, lockstep, tree
from ..sources import exchange, readers, writers
from ..work import work_path, written
from .pages import _walked
from .units import _text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all pages as raw arrays, numbered through, and read back by ranges."""
    nodes = written(tree.links(tree.page_nodes(_table(spark, sf_dir, "pages").select("page_id", "html")), "page_id"), "pages")
    ends = dictionary.cumulative(nodes, "page_id", "page_id").select("page_id", (F.col("total") - F.col("added")).alias("before"))
    pages = dictionary.numbered(ends, "page_id").withColumnRenamed("n", "tu_idx")
    vocab = written(dictionary.vocabulary(nodes, "kind", "page_id", "node_id"), "kinds")
    through = lambda c: F.coalesce(F.col(c) + F.col("before"), F.lit(-1))
    rows = dictionary.encode(nodes, "kind", vocab, "kind_idx").join(pages.hint("merge"), "page_id")
    none = [F.lit(0).alias(c) for c in ("start_line", "start_col", "end_line", "end_col", "ident_idx", "type_idx")]
    table = rows.select((F.col("node_id") + F.col("before")).alias("node_id"), F.col("kind_idx").alias("kind"), *(through(c).alias(c) for c in ("parent", "first_child", "next_sibling")), F.least("depth", F.lit(255)).alias("depth"), *none, "tu_idx")
    folder = work_path(spark, "arrays")
    kinds = [r["value"] for r in vocab.orderBy("index").collect()]  # element names: as many as the vocabulary file has
    n_pages, n_nodes = pages.count(), nodes.count()
    types = exchange.wider(kind=len(kinds), tu_idx=n_pages - 1, parent=n_nodes, first_child=n_nodes, next_sibling=n_nodes)
    exchange.write_arrays(table, {"kinds": ["", *kinds]}, folder, types)
    back = exchange.load_tensor(spark, folder, ("kind", "parent", "first_child", "next_sibling", "depth", "tu_idx"), rows=10_000)
    names = readers.load_vocabulary(spark, folder, "kinds").select(F.col("index").cast("long").alias("kind"), "value")
    sums = [F.sum(c).alias(f"{c}s") for c in ("parent", "first_child", "next_sibling", "depth")]
    return back.join(names, "kind").groupBy("tu_idx", F.col("value").alias("kind")).agg(F.count("*").alias("n"), F.min("node_id").alias("first"), *sums)


def binding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bindings and report of every page pair, each a file at its own path, read back."""
    reached, *_ = _walked(spark, sf_dir)
    pairs = lockstep.bindings(reached, "ident").select(F.concat(F.lit('page "'), F.col("pair").cast("string"), F.lit('"')).alias("canonical_fn"), F.concat(F.lit("page"), (F.col("pair") + 1).cast("string")).alias("sibling_fn"), "pair", "canonical", "sibling", "first")
    by = pairs.select("canonical_fn", "sibling_fn", "pair").distinct()
    one = writers.bindings_toml(pairs.select("canonical_fn", "sibling_fn", F.col("canonical").alias("k"), F.col("sibling").alias("v")))
    two = writers.report_toml(pairs.where("first < 5"), pairs.where("first >= 5"))
    at = lambda name: F.concat(F.lit("of/"), (F.col("pair") % 7).cast("string"), F.lit("/"), F.col("pair").cast("string"), F.lit(f"/{name}.toml")).alias("path")
    files = one.join(by, ["canonical_fn", "sibling_fn"]).select(at("bindings"), "value").unionByName(two.join(by, ["canonical_fn", "sibling_fn"]).select(at("report"), "value"))
    root = work_path(spark, "bindings")
    exchange.write_files(files, root)
    back = readers.text_files(spark, root, "*.toml")
    return back.select(F.regexp_extract("path", r"(of/\d+/\d+/[a-z]+\.toml)$", 1).alias("path"), "text")


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at the paths that a run's manifest lists; some are missing, some are no JSON."""
    k = F.col("p_partkey")
    part = _table(spark, sf_dir, "part")
    source = F.when(k % 5 == 0, _text("/abs/p", k, ".c")).otherwise(_text("d", k % 3, "/p", k, ".c"))
    rows = part.select(k, source.alias("source"), F.concat(F.lit("out/"), F.ltrim(source, F.lit("/")), F.lit(".ast.json")).alias("out"), F.when(k % 17 == 3, "failed").alias("error"))
    body = F.when(k % 13 == 5, "{bad").otherwise(_text('{"kind":"TranslationUnitDecl","id":"', k, '"}'))
    root = work_path(spark, "run")
    exchange.write_files(rows.where(k % 11 != 4).select(F.substring("out", 5, 1 << 30).alias("path"), body.alias("value")), f"{root}/files")
    manifest = compdb.run_manifest(rows.select("source", "out", "error"), "ast", "db.json", "/").select(F.lit("run.json").alias("path"), F.col("manifest").alias("value"))
    exchange.write_files(manifest, f"{root}/manifest")
    good, bad = readers.manifest_documents(spark, f"{root}/manifest/run.json", f"{root}/files")
    return good.select("doc_id", F.col("source").alias("text")).unionByName(bad.select("doc_id", F.lit(None).cast("string").alias("text")))


def sql_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL files below a folder, and only these, with their statements and the name of their tree's file."""
    k = F.col("p_partkey")
    rows = _table(spark, sf_dir, "part").select(_text("s", k % 5, "/p", k, F.when(k % 7 == 0, ".txt").otherwise(".sql")).alias("path"), _text("create table t", k, " (x int);\nselect ", k, ";").alias("value"))
    root = work_path(spark, "sql")
    exchange.write_files(rows, root)
    sources = ddl.sql_sources(spark, root)
    found = ddl.parsed(ddl.statements(sources.join(ddl.one_dialect(sources), "dialect")))
    suffix = ddl.ast_suffix(F.when(F.col("dialect") == "postgres", "pg_query").otherwise("other"))
    path = F.regexp_extract("path", r"(s\d/p\d+\.\w+)$", 1)
    return found.select(path.alias("path"), F.concat(path, suffix).alias("tree"), F.col("seq").cast("long").alias("seq"), "action", "name", "statement")


def part_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are made of others: how high each stands, and the kinds of all that is in it."""
    part = _table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    edges = part.where(k > 1).select(k.alias("src"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("dst")).where("dst > 0").distinct()
    values = part.select(k.alias("node"), F.when(k % 3 == 0, _text("c", k % 7)).otherwise("plain").alias("value"))
    return closure.levels(edges).join(closure.along(edges, values), "node").select("node", "level", F.array_join("values", ",").alias("kinds"))


_PAIR_LINE = """'"' || l_kind || '" = "' || r_kind || '"' || chr(10)"""
QUERIES = {f.__name__: f for f in (raw_arrays, binding_files, manifest_documents, sql_source_files, part_levels)}
ORACLE_SQL = {
    "raw_arrays": f"""WITH {tree._NODES}, pg AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS tu_idx, sum(c) OVER (ORDER BY page_id) - c AS before FROM (SELECT page_id, count(*) AS c FROM n GROUP BY 1)),
        x AS (SELECT n.*, tu_idx, before, CASE WHEN parent IS NOT NULL THEN lead(node_id) OVER (PARTITION BY page_id, parent ORDER BY node_id) END AS next, (SELECT min(c.node_id) FROM n c WHERE c.page_id = n.page_id AND c.parent = n.node_id) AS child FROM n JOIN pg USING (page_id))
        SELECT tu_idx, kind, count(*) AS n, min(node_id + before)::BIGINT AS first, sum(coalesce(parent + before, -1))::BIGINT AS parents, sum(coalesce(child + before, -1))::BIGINT AS first_childs, sum(coalesce(next + before, -1))::BIGINT AS next_siblings, sum(depth)::BIGINT AS depths FROM x GROUP BY 1, 2""",
    "binding_files": lockstep._walked(1) + f""", bd AS (SELECT pair, l_kind, r_kind, min(l_node_id) AS first FROM z WHERE status <> 'kind' GROUP BY ALL),
        h AS (SELECT *, 'canonical_fn = "page \\"' || pair || '\\""' || chr(10) || 'sibling_fn = "page' || (pair + 1) || '"' || chr(10) || chr(10) AS head, 'of/' || pair % 7 || '/' || pair AS dir FROM bd)
        SELECT dir || '/bindings.toml' AS path, any_value(head) || '[bindings]' || chr(10) || string_agg({_PAIR_LINE}, '' ORDER BY l_kind) AS text FROM h GROUP BY dir
        UNION ALL SELECT dir || '/report.toml', any_value(head) || '[c_idents]' || chr(10) || coalesce(string_agg({_PAIR_LINE}, '' ORDER BY first) FILTER (WHERE first < 5), '') || chr(10) || '[c_types]' || chr(10) || coalesce(string_agg({_PAIR_LINE}, '' ORDER BY first) FILTER (WHERE first >= 5), '') FROM h GROUP BY dir""",
    "manifest_documents": """SELECT CASE WHEN k % 5 = 0 THEN '/abs/p' || k || '.c' ELSE 'd' || k % 3 || '/p' || k || '.c' END AS doc_id, CASE WHEN k % 11 <> 4 AND k % 13 <> 5 THEN '{"kind":"TranslationUnitDecl","id":"' || k || '"}' END AS text
        FROM (SELECT p_partkey AS k FROM part) WHERE k % 17 <> 3""",
    "sql_source_files": """WITH p AS (SELECT p_partkey AS k, 's' || p_partkey % 5 || '/p' || p_partkey || '.sql' AS path FROM part WHERE p_partkey % 7 <> 0)
        SELECT path, path || '.pgpb' AS tree, 0::BIGINT AS seq, 'create' AS action, 't' || k AS name, 'create table t' || k || ' (x int)' AS statement FROM p UNION ALL SELECT path, path || '.pgpb', 1, NULL, NULL, 'select ' || k FROM p""",
    "part_levels": """WITH RECURSIVE p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'c' || p_partkey % 7 ELSE 'plain' END AS v FROM part),
        r AS (SELECT k, k AS a, 0 AS d FROM p UNION SELECT r.k, x.b, d + 1 FROM r, LATERAL (SELECT unnest([a // 2, a // 3]) AS b) x WHERE x.b > 0)
        SELECT r.k AS node, max(d)::BIGINT AS level, string_agg(DISTINCT p.v, ',' ORDER BY p.v) AS kinds FROM r JOIN p ON p.k = r.a WHERE r.k > 0 GROUP BY r.k""",
}
