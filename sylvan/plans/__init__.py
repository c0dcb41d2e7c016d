"""Plans made of several operators: corpus to bindings, corpus to triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bindings, graph, lockstep, tree

#: The steps that a plan takes as parameters (U6): documents to nodes, two sides to reached pairs, pairs to bindings.
Walk = Callable[[DataFrame], DataFrame]
Diff = Callable[[DataFrame, DataFrame], DataFrame]
Derive = Callable[[DataFrame, DataFrame, "dict | None"], DataFrame]


def cluster_diff(documents: DataFrame, canonical: str, sibling: str, walk: Walk = tree.ast_nodes, diff: Diff = lockstep.diff) -> DataFrame:
    """AST documents (doc_id, source) to the reached pairs of two named functions, as one pair 0."""
    nodes = walk(documents)
    sides = []
    for name, prefix in ((canonical, "l"), (sibling, "r")):
        at = tree.find_function(nodes, name)
        roots = nodes.join(at, ["doc_id", "node_id"]).select(F.lit(0).alias("pair"), "doc_id", "node_id", "size", "path")
        sides.append(lockstep.side(nodes, roots, prefix))
    return diff(*sides)


def cluster_bindings(documents: DataFrame, canonical: str, sibling: str, overrides: dict | None = None, walk: Walk = tree.ast_nodes, diff: Diff = lockstep.diff, derive: Derive = bindings.derive) -> DataFrame:
    """AST documents to (k, v): what the canonical function's names become for its sibling."""
    reached = cluster_diff(documents, canonical, sibling, walk, diff)
    return derive(lockstep.bindings(reached, "ident"), lockstep.bindings(reached, "type"), overrides)


def document_turtle(documents: DataFrame, strict: bool = True) -> DataFrame:
    """AST documents to Turtle lines (doc_id, at, value)."""
    return graph.turtle(graph.triples(tree.ast_nodes(documents, prune=False), strict), "c")
