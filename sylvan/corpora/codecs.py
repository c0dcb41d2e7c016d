"""Messages read as trees and written again, and trees rendered as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tree
from ..sources import messages
from ..work import written
from . import programs


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests of packed_manifests as trees, every seventh with a field that the schema doesn't know, and every eleventh cut off."""
    k = F.col("conv_id")
    data = F.unhex("manifest")
    data = F.when(k % 7 == 3, F.concat(data, F.unhex(F.lit("7a026869")))).otherwise(data)  # field 15, "hi"
    data = F.when(k % 11 == 5, F.concat(data, F.unhex(F.lit("1aff01")))).otherwise(data)  # a text of 255 bytes that isn't there
    return written(messages.message_nodes(programs.packed_manifests(spark, sf_dir).select(k.alias("doc_id"), data.alias("source")), messages.MANIFEST, "Manifest"), "messages")


def manifest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every manifest, what isn't known and what can't be read among them."""
    nodes = _nodes(spark, sf_dir).where("depth > 0 AND n_children = 0")
    said = messages.diagnostics(_nodes(spark, sf_dir))
    return nodes.join(said, "doc_id").select(F.col("doc_id").cast("long").alias("conv_id"), F.col("path")[1].cast("long").alias("place"), "kind", "type", "ident", "ok")


def manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the trees, equal to those read."""
    return messages.encoded(_nodes(spark, sf_dir), messages.MANIFEST).select(F.col("doc_id").cast("long").alias("conv_id"), F.lower(F.hex("message")).alias("manifest"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of every page as text, in two languages, by what each writes around a kind."""
    nodes = written(tree.page_nodes(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).select("page_id", "node_id", "parent", "ord", "depth", "kind", "ident"), "pages")
    languages = {"lisp": ({}, ("({}", "", ")")), "marked": ({"br": ("<{}/>", "", ""), "li": ("* ", "; ", "\n")}, ("<{}>", ",", "</>"))}
    out = None
    for name, (templates, default) in languages.items():
        roots = tree.render(nodes, templates, default, "page_id")
        text = roots.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "value"))), lambda x: x["value"]), "\n").alias("text"))
        rows = text.select("page_id", F.lit(name).alias("language"), "text")
        out = rows if out is None else out.unionByName(rows)
    return out


_PACKED = programs.ORACLE_SQL["packed_manifests"]
_MANIFEST = f"WITH m AS ({_PACKED})"
QUERIES = {f.__name__: f for f in (manifest_fields, manifest_round_trip, page_text)}
ORACLE_SQL = {
    "manifest_round_trip": f"{_MANIFEST} SELECT conv_id, manifest || CASE WHEN conv_id % 7 = 3 THEN '7a026869' ELSE '' END || CASE WHEN conv_id % 11 = 5 THEN '1aff01' ELSE '' END AS manifest FROM m",
    "manifest_fields": """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n, CASE role WHEN 'user' THEN '2' ELSE '4' END AS l, 'o/' || turn AS o, role || coalesce(':' || length(text), '') AS s FROM conversations),
        c AS (SELECT DISTINCT conv_id, n FROM t),
        f AS (SELECT conv_id, 0 AS place, 'string' AS kind, 'name' AS type, 'c' || conv_id AS ident FROM c UNION ALL SELECT conv_id, 0, 'string', 'version', '1' FROM c UNION ALL SELECT conv_id, 0, 'string', 'revision', 'r' FROM c
          UNION ALL SELECT conv_id, i, 'Language', 'language', l FROM t UNION ALL SELECT conv_id, i, 'string', 'out_path', o FROM t UNION ALL SELECT conv_id, i, 'string', 'source', s FROM t
          UNION ALL SELECT conv_id, n + 1, 'string', 'deps', 'dep' FROM c UNION ALL SELECT conv_id, n + 2, 'unknown', '15', '7a026869' FROM c WHERE conv_id % 7 = 3
          UNION ALL SELECT conv_id, n + 2 + CASE WHEN conv_id % 7 = 3 THEN 1 ELSE 0 END, 'error', 'a field is cut off', '1aff01' FROM c WHERE conv_id % 11 = 5)
        SELECT *, conv_id % 11 <> 5 AS ok FROM f""",
    "page_text": f"""WITH RECURSIVE {tree._NODES}, o AS (SELECT n.*, lead(depth) OVER (PARTITION BY page_id ORDER BY node_id) AS next FROM n),
        lisp AS (SELECT page_id, 'lisp' AS language, string_agg('(' || kind || repeat(')', (depth - coalesce(next, 0) + 1)::INT) || CASE WHEN next = 0 THEN chr(10) ELSE '' END, '' ORDER BY node_id) AS text FROM o GROUP BY page_id),
        -- Every node writes its start; its end, and what stands before its next sibling, follow its last descendant.
        e AS (SELECT page_id, node_id, node_id + size - 1 AS last, depth, ord, parent, kind, (SELECT max(x.ord) FROM n x WHERE x.page_id = n.page_id AND x.parent IS NOT DISTINCT FROM n.parent) AS top, (SELECT x.kind FROM n x WHERE x.page_id = n.page_id AND x.node_id = n.parent) AS above FROM n),
        w AS (SELECT page_id, node_id AS pos, 0 AS half, depth AS o, CASE kind WHEN 'br' THEN '<br/>' WHEN 'li' THEN '* ' ELSE '<' || kind || '>' END AS t FROM e
          UNION ALL SELECT page_id, last, 1, -depth, CASE kind WHEN 'br' THEN '' WHEN 'li' THEN chr(10) ELSE '</>' END || CASE WHEN ord = top THEN '' WHEN parent IS NULL THEN chr(10) WHEN above = 'br' THEN '' WHEN above = 'li' THEN '; ' ELSE ',' END FROM e)
        SELECT * FROM lisp UNION ALL SELECT page_id, 'marked', string_agg(t, '' ORDER BY pos, half, o) FROM w GROUP BY page_id""",
}
