import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sylvan.operators import graph, lockstep, tree
from sylvan.plans import cluster_bindings, cluster_diff, document_turtle


def n(kind, *inner, **more):
    return {"kind": kind, **more, **({"inner": list(inner)} if inner else {})}


def ref(name, id, kind="FunctionDecl"):
    return n("DeclRefExpr", referencedDecl={"id": id, "name": name, "kind": kind})


def call(name, id, *args):
    return n("CallExpr", n("ImplicitCastExpr", ref(name, id)), *args)


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, source string")


def test_pruned_subtree_vanishes_and_ordinals_close_up():
    unit = n("TranslationUnitDecl", n("A", n("B"), isImplicit=True), n("C", loc={"includedFrom": {"file": "x"}}), n("D", n("E"), range={"begin": {"line": 3, "col": 70000}}))
    rows = tree.ast_rows("d", json.dumps(unit))
    assert [(r["kind"], r["ord"], r["depth"], r["size"], r["path"]) for r in rows] == [("TranslationUnitDecl", 0, 0, 3, [0]), ("D", 0, 1, 2, [0, 0]), ("E", 0, 2, 1, [0, 0, 0])]
    assert len(tree.ast_rows("d", json.dumps(unit), prune=False)) == 6


def test_unreadable_documents_give_no_rows(spark):
    assert tree.ast_nodes(docs(spark, "{", "[1]", "", json.dumps(n("X")))).select("doc_id").collect() == [("d3",)]


def test_export_caps_and_sentinels(spark):
    deep = n("X")
    for _ in range(300):
        deep = n("X", deep, name="")
    deep["range"] = {"begin": {"line": 7, "col": 70000}}
    row = {r["node_id"]: r for r in tree.node_export(tree.ast_nodes(docs(spark, json.dumps(deep)))).collect()}
    assert row[0]["parent"] == -1 and row[0]["start_col"] == 65535 and row[0]["end_line"] == 7 and row[0]["first_child"] == 1
    assert row[300]["depth"] == 255 and row[300]["start_line"] == 0 and row[300]["first_child"] == -1 and row[300]["next_sibling"] == -1


trees = st.recursive(st.just([]), lambda kids: st.lists(kids, max_size=4), max_leaves=30)


@settings(max_examples=40, deadline=None)
@given(trees)
def test_random_trees_keep_their_links(shape):
    def build(t):
        return n("K", *map(build, t))

    rows = tree.ast_rows("d", json.dumps(build(shape)))
    by_id = {r["node_id"]: r for r in rows}
    assert sorted(by_id) == list(range(len(rows)))
    for r in rows:
        below = [x for x in rows if x["path"][: len(r["path"])] == r["path"]]
        assert [x["node_id"] for x in below] == list(range(r["node_id"], r["node_id"] + r["size"]))
        assert r["n_children"] == sum(x["parent"] == r["node_id"] for x in rows)
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)


def function(name, *body, id="0x1", params=()):
    return n("FunctionDecl", *params, n("CompoundStmt", *body), name=name, id=id)


def test_lockstep_statuses_and_early_end(spark):
    left = function("f", n("ReturnStmt", n("IntegerLiteral")), n("IfStmt", n("A"), n("B")), n("NullStmt"))
    right = function("g", n("ReturnStmt", n("IntegerLiteral")), n("IfStmt", n("A")), n("BreakStmt", n("Z")))
    d = docs(spark, json.dumps(n("TranslationUnitDecl", left)), json.dumps(n("TranslationUnitDecl", right)))
    got = {(r["l_kind"], r["r_kind"], r["status"]) for r in cluster_diff(d, "f", "g").collect()}
    assert got == {("FunctionDecl", "FunctionDecl", "aligned"), ("CompoundStmt", "CompoundStmt", "aligned"), ("ReturnStmt", "ReturnStmt", "aligned"), ("IntegerLiteral", "IntegerLiteral", "aligned"), ("IfStmt", "IfStmt", "children"), ("NullStmt", "BreakStmt", "kind")}
    assert {r["status"] for r in cluster_diff(d, "f", "f").collect()} == {"aligned"}


def test_bindings_of_a_renamed_constant(spark):
    unit = lambda name, const, ctx: n("TranslationUnitDecl", function(name, n("DeclStmt", ref(const, "0x9", "VarDecl")), n("DeclStmt", n("VarDecl", name="buffer", type={"qualType": ctx}))))
    d = docs(spark, json.dumps(unit("pg_a_init", "a_len", "pg_a_ctx *")), json.dumps(unit("pg_b_init", "b_len", "const pg_b_ctx")))
    assert {tuple(r) for r in cluster_bindings(d, "pg_a_init", "pg_b_init").collect()} == {("pg_a_init", "pg_b_init"), ("A_LEN", "B_LEN"), ("ACtx", "BCtx")}


def test_missing_function_errors(spark):
    d = tree.ast_nodes(docs(spark, json.dumps(n("TranslationUnitDecl", n("VarDecl", name="v")))))
    for name in ("nothing", "v"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            tree.find_function(d, name).collect()


def test_holes_and_loose_symbols(spark):
    left, right = function("f", n("IfStmt", ref("a", "1"), ref("b", "2"))), function("f", n("IfStmt", ref("c", "3")))
    nodes = tree.ast_nodes(docs(spark, json.dumps(left), json.dumps(right))).withColumn("pair", F.lit(1))
    l, r = nodes.where("doc_id = 'd0'"), nodes.where("doc_id = 'd1'")
    root = lambda x: x.where("node_id = 0").select("pair", "doc_id", "node_id", "size", "path")
    met = lockstep.diff(lockstep.side(l, root(l), "l"), lockstep.side(r, root(r), "r"))
    hole = lockstep.holes(met, l, r).collect()
    assert [(h["status"], h["l_subtree"], h["r_subtree"]) for h in hole] == [("children", "IfStmt > DeclRefExpr(a) > DeclRefExpr(b)", "IfStmt > DeclRefExpr(c)")]
    assert {x["ident"] for x in lockstep.loose_symbols(met, l, "l").collect()} == {"a", "b"}


def unit_with_calls():
    callee = function("g", id="0xg")
    caller = function("f", call("g", "0xg", ref("x", "0xp", "ParmVarDecl")), n("IfStmt", call("g", "0xg", ref("x", "0xp")), call("g", "0xg"), call("late", "0xl")), id="0xf", params=(n("ParmVarDecl", id="0xq"), n("ParmVarDecl", id="0xp", name="x")))
    return n("TranslationUnitDecl", callee, caller, function("late", id="0xl"), n("RecordDecl", name="u", tagUsed="union", id="0xu"), n("VarDecl", call("g", "0xg"), name="v", id="0xv"), n("VarDecl", name="h", loc={"includedFrom": {"file": "x"}}))


def test_strict_edges_and_corrected_edges(spark):
    nodes = tree.ast_nodes(docs(spark, json.dumps(unit_with_calls())), prune=False)
    strict = sorted((r["pred"], r["iri"]) for r in graph.edges(nodes).collect())
    assert strict == [("calls", "urn:c:fn:d0#g"), ("calls", "urn:c:unknown#0xl"), ("refs", "urn:c:fn:d0#f/x")]
    fixed = sorted((r["pred"], r["iri"]) for r in graph.edges(nodes, strict=False).collect())
    assert fixed == sorted(2 * [("calls", "urn:c:fn:d0#g"), ("refs", "urn:c:fn:d0#f/x")] + [("calls", "urn:c:fn:d0#late")])


def test_turtle_lines(spark):
    lines = {r["value"] for r in document_turtle(docs(spark, json.dumps(unit_with_calls()))).collect()}
    assert "<urn:c:union:d0#u> a c:UnionDecl ." in lines
    assert '<urn:c:fn:d0#f/arg0> c:paramIndex "0"^^xsd:integer .' in lines
    assert "<urn:c:fn:d0#f> c:hasParam <urn:c:fn:d0#f/x> ." in lines
    assert not any("#h>" in x for x in lines)
    with pytest.raises((PySparkException, Py4JJavaError)):
        document_turtle(docs(spark, json.dumps(n("TranslationUnitDecl", n("VarDecl", name="a<b"))))).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        document_turtle(docs(spark, json.dumps(n("Other", n("VarDecl", name="a"))))).collect()


def test_plans_take_other_steps(spark):
    unit = n("TranslationUnitDecl", function("f", n("A"), n("B")), function("g", n("A"), n("C")))
    d = docs(spark, json.dumps(unit))
    assert cluster_diff(d, "f", "g").where("status = 'kind'").count() == 1
    loose = lambda left, right: lockstep.diff(left.withColumn("l_kind", F.lit("x")), right.withColumn("r_kind", F.lit("x")))
    assert cluster_diff(d, "f", "g", diff=loose).where("status = 'kind'").count() == 0
    assert cluster_diff(d, "f", "g", walk=lambda x: tree.ast_nodes(x, prune=False)).count() == cluster_diff(d, "f", "g").count()
    names = spark.createDataFrame([("f",), ("g",), ("h",)], "name string")
    left, right = tree.ast_nodes(d), tree.ast_nodes(docs(spark, json.dumps(n("TranslationUnitDecl", function("f", n("A"), n("B")), function("g", n("A")), function("h")))))
    assert {tuple(r) for r in tree.structure_suite(left, right, names).collect()} == {("f", True, None), ("g", False, "structures differ"), ("h", False, "missing on the left")}
    assert {r["name"] for r in tree.structure_suite(left, right, names, same=lambda a, b: F.lit(True)).where("passed").collect()} == {"f", "g"}
