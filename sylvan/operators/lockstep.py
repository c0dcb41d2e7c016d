"""Lockstep diff of two trees.

Two subtrees are walked together, children paired by ordinal, until kinds or child counts differ. With
ordinal paths this needs no recursion: nodes of both sides meet by an equi-join on (pair, relative path),
and a met pair is reached unless some proper ancestor's pair is a hole; ancestors are the path's
proper prefixes, so that test is an anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..work import written
from .tree import page_nodes, subtree, subtree_summary

SIDE = ("node_id", "kind", "ident", "type", "n_children", "size")


def side(nodes: DataFrame, roots: DataFrame, prefix: str, doc: str = "doc_id") -> DataFrame:
    """One side: every node under each pair's root with its path from there. roots: pair, doc, node_id, size."""
    r = roots.select(F.col("pair").alias("_pair"), F.col(doc).alias("d"), F.col("node_id").alias("root"), F.col("size").alias("reach"), F.col("path").alias("_top"))
    below = nodes.join(r.hint("merge"), (F.col(doc) == F.col("d")) & (F.col("node_id") >= F.col("root")) & (F.col("node_id") < F.col("root") + F.col("reach")))
    rel = F.slice("path", F.size("_top") + 1, F.size("path"))
    return below.select(F.col("_pair").alias("pair"), rel.alias("path"), *(F.col(c).alias(f"{prefix}_{c}") for c in SIDE))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of nodes that the walk reaches: status is aligned, kind (kinds differ) or children (their counts do).

    A hole's subtree is a range of left ids, so a met pair is below a hole if the furthest end of the holes before it in
    pre-order lies beyond it: one window over a pair's nodes."""
    status = F.when(F.col("l_kind") != F.col("r_kind"), "kind").when(F.col("l_n_children") != F.col("r_n_children"), "children").otherwise("aligned")
    met = left.join(right.hint("merge"), ["pair", "path"]).withColumn("status", status)
    ahead = Window.partitionBy("pair").orderBy("l_node_id").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max(F.when(F.col("status") != "aligned", F.col("l_node_id") + F.col("l_size"))).over(ahead)
    return met.withColumn("_end", end).where(F.col("_end").isNull() | (F.col("_end") <= F.col("l_node_id"))).drop("_end")


def bindings(reached: DataFrame, field: str) -> DataFrame:
    """Distinct (left, right) values of ident or type with the first node of each (A8). A kind hole gives none,
    a child-count hole still does; an empty value on either side gives none."""
    rows = reached.where((F.col("status") != "kind") & (F.col(f"l_{field}") != "") & (F.col(f"r_{field}") != ""))
    return rows.groupBy("pair", F.col(f"l_{field}").alias("canonical"), F.col(f"r_{field}").alias("sibling")).agg(F.min("l_node_id").alias("first"))


def holes(reached: DataFrame, left_nodes: DataFrame, right_nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Diverging pairs with a summary of either subtree (R7). The node tables carry pair."""
    found = reached.where("status <> 'aligned'")
    out = found.select("pair", "path", "status", "l_node_id", "r_node_id", "l_kind", "r_kind")
    for p, nodes in (("l", left_nodes), ("r", right_nodes)):
        roots = found.select("pair", F.col(f"{p}_node_id").alias("node_id"), F.col(f"{p}_size").alias("size")).distinct()
        out = out.join(subtree_summary(nodes, roots, "pair").select("pair", F.col("root").alias(f"{p}_node_id"), F.col("summary").alias(f"{p}_subtree")).hint("merge"), ["pair", f"{p}_node_id"])
    return out


def same_structure(reached: DataFrame) -> DataFrame:
    """pair, same of every pair walked: whether its trees have one structure, that is no hole."""
    return reached.groupBy("pair").agg(F.bool_and(F.col("status") == "aligned").alias("same"))


def loose_symbols(reached: DataFrame, nodes: DataFrame, prefix: str, field: str = "ident") -> DataFrame:
    """Distinct values under one side's holes, first seen first."""
    roots = reached.where("status <> 'aligned'").select("pair", F.col(f"{prefix}_node_id").alias("node_id"), F.col(f"{prefix}_size").alias("size")).distinct()
    return subtree(nodes, roots, "pair").where(F.col(field) != "").groupBy("pair", field).agg(F.min("node_id").alias("first"))


def page_pairs(spark: SparkSession, sf_dir: str, apart: int) -> DataFrame:
    """Every page against the page so many ids on."""
    nodes = written(page_nodes(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).select("page_id", "path", *SIDE), "pages")
    roots = nodes.where("node_id = 0").select("page_id", "node_id", F.lit(1 << 40).alias("size"), F.array().cast("array<int>").alias("path"))
    left, right = roots.withColumn("pair", F.col("page_id")), roots.withColumn("pair", F.col("page_id") - apart)
    return diff(side(nodes, left, "l", "page_id"), side(nodes, right, "r", "page_id"))


def lockstep_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_pairs(spark, sf_dir, 1).select("pair", "l_node_id", "r_node_id", "l_kind", "r_kind", "status")


def lockstep_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tree against itself: nothing but aligned pairs."""
    return page_pairs(spark, sf_dir, 0).groupBy("status").agg(F.count("*").alias("n"))


def _walked(apart: int) -> str:
    from .tree import _NODES

    return f"""WITH RECURSIVE {_NODES},
c AS (SELECT n.*, (SELECT count(*) FROM n1 x WHERE x.page_id = n.page_id AND x.parent = n.node_id) AS kids FROM n),
w AS (SELECT a.page_id AS pair, a.node_id AS l, b.node_id AS r, a.kind AS lk, b.kind AS rk, a.kids AS lc, b.kids AS rc, a.size AS ls, b.size AS rs
      FROM c a JOIN c b ON b.page_id = a.page_id + {apart} AND b.ord = a.ord WHERE a.parent IS NULL AND b.parent IS NULL
      UNION ALL
      SELECT w.pair, a.node_id, b.node_id, a.kind, b.kind, a.kids, b.kids, a.size, b.size FROM w JOIN c a ON a.page_id = w.pair AND a.parent = w.l
      JOIN c b ON b.page_id = w.pair + {apart} AND b.parent = w.r AND b.ord = a.ord WHERE w.lk = w.rk AND w.lc = w.rc),
z AS (SELECT pair, l::BIGINT AS l_node_id, r::BIGINT AS r_node_id, lk AS l_kind, rk AS r_kind, ls, rs, CASE WHEN lk <> rk THEN 'kind' WHEN lc <> rc THEN 'children' ELSE 'aligned' END AS status FROM w)
"""


QUERIES = {"lockstep_diff": lockstep_diff, "lockstep_self": lockstep_self}
ORACLE_SQL = {"lockstep_diff": _walked(1) + "SELECT pair, l_node_id, r_node_id, l_kind, r_kind, status FROM z", "lockstep_self": _walked(0) + "SELECT status, count(*) AS n FROM z GROUP BY status"}
