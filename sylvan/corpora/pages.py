"""Queries over what the lockstep walk finds between every page and the next, with elements' names as their identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lockstep, tree
from ..work import written


def _walked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reached, left nodes, right nodes), the nodes with pair."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    nodes = written(tree.page_nodes(pages, ("node_id", "path", "kind", "type", "n_children", "size")).withColumn("ident", F.col("kind")), "pages")
    roots = nodes.where("node_id = 0").select("page_id", "node_id", F.lit(1 << 40).alias("size"), F.array().cast("array<int>").alias("path"))
    left, right = (lambda d: d.withColumn("pair", F.col("page_id"))), (lambda d: d.withColumn("pair", F.col("page_id") - 1))
    reached = lockstep.diff(lockstep.side(nodes, left(roots), "l", "page_id"), lockstep.side(nodes, right(roots), "r", "page_id"))
    return written(reached, "reached"), left(nodes), right(nodes)


def lockstep_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return lockstep.bindings(_walked(spark, sf_dir)[0], "ident")


def lockstep_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7, O4, P26."""
    return lockstep.holes(*_walked(spark, sf_dir)).select("pair", "status", "l_node_id", "r_node_id", "l_subtree", "r_subtree")


def lockstep_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names under either side's holes, first seen first."""
    reached, left, right = _walked(spark, sf_dir)
    one = lambda nodes, side: lockstep.loose_symbols(reached, nodes, side).withColumn("side", F.lit(side))
    return one(left, "l").unionByName(one(right, "r"))


def same_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K13."""
    return lockstep.same_structure(_walked(spark, sf_dir)[0])


def page_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    nodes = tree.page_nodes(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return tree.children(nodes, "page_id").select("page_id", "node_id", "ord", "child", "child_kind")


_WALKED = lockstep._walked(1)
_SUMMARY = """(SELECT string_agg(x.kind || '(' || x.kind || ')', ' > ' ORDER BY x.node_id) FROM n x WHERE x.page_id = {page} AND x.node_id >= {node} AND x.node_id < {node} + least({size}, 16)) || CASE WHEN {size} > 16 THEN ' > ...' ELSE '' END"""
_BELOW = "SELECT pair, '{s}' AS side, x.kind AS ident, min(x.node_id)::BIGINT AS first FROM z JOIN n x ON x.page_id = pair + {at} AND x.node_id >= {s}_node_id AND x.node_id < {s}_node_id + {s}s WHERE status <> 'aligned' GROUP BY ALL"

QUERIES = {f.__name__: f for f in (lockstep_bindings, lockstep_holes, lockstep_symbols, same_structure, page_children)}
ORACLE_SQL = {
    "lockstep_bindings": _WALKED + "SELECT pair, l_kind AS canonical, r_kind AS sibling, min(l_node_id) AS first FROM z WHERE status <> 'kind' GROUP BY ALL",
    "lockstep_holes": _WALKED + f"SELECT pair, status, l_node_id, r_node_id, {_SUMMARY.format(page='pair', node='l_node_id', size='ls')} AS l_subtree, {_SUMMARY.format(page='pair + 1', node='r_node_id', size='rs')} AS r_subtree FROM z WHERE status <> 'aligned'",
    "lockstep_symbols": _WALKED + _BELOW.format(s="l", at=0) + " UNION ALL " + _BELOW.format(s="r", at=1),
    "same_structure": _WALKED + "SELECT pair, bool_and(status = 'aligned') AS same FROM z GROUP BY pair",
    "page_children": f"WITH {tree._NODES} SELECT page_id, parent::BIGINT AS node_id, ord::BIGINT AS ord, node_id::BIGINT AS child, kind AS child_kind FROM n WHERE parent IS NOT NULL",
}
