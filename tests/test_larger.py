"""Tables with values that the generated ones lack, and plans that must not send growing tables through the driver."""

import json
import os

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from sylvan import queries
from sylvan.corpora import pages, units
from sylvan.operators import ddl, graph, lockstep, sqltext, tree
from sylvan.sources import exchange, readers
from sylvan.streaming import events

DIR = "/root/testdata/sf0.001"


def changed(folder, **tables):
    """A copy of the tables by links, some of them changed; its name for the oracle."""
    for name in os.listdir(DIR):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{DIR}/{name}", folder / name)
    for name, make in tables.items():
        pq.write_table(make(pq.read_table(f"{DIR}/{name}.parquet")), folder / f"{name}.parquet")
    return f"../..{folder}"


def put(table, column, values):
    at = table.column_names.index(column)
    return table.set_column(at, table.schema.field(at), pa.chunked_array([pa.array(values, table.schema.field(at).type)]) if isinstance(values, list) else values)


def test_a_statement_at_line_0_has_a_place(spark, oracle, tmp_path):
    def orders(t):
        first = pc.equal(t["o_orderkey"], 0)
        return put(put(t, "o_orderstatus", pc.if_else(first, "O", t["o_orderstatus"])), "o_custkey", pc.if_else(first, 1, t["o_custkey"]))

    sf = changed(tmp_path, orders=orders)
    oracle(queries.QUERIES["unit_walk"](spark, str(tmp_path)), queries.ORACLE_SQL["unit_walk"], sf)


def by_key(df):
    """The rows of a frame whose joins are all by key, though its tables are small enough to be broadcast."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
    return rows


def test_pages_meet_by_key(spark):
    reached, left, right = pages._walked(spark, DIR)
    assert by_key(lockstep.holes(reached, left, right))
    assert by_key(lockstep.loose_symbols(reached, left, "l"))
    roots = left.where("node_id = 0").select("page_id", "pair", "node_id", F.lit(1 << 40).alias("size"), F.array().cast("array<int>").alias("path"))
    assert by_key(lockstep.diff(lockstep.side(left, roots, "l", "page_id"), lockstep.side(left, roots, "r", "page_id")))


def test_units_meet_by_key(spark):
    """Texts shrink in a shuffle and would be taken for small."""
    docs = units.units(spark, DIR)
    assert len(by_key(docs)) > 1
    nodes = tree.ast_nodes(docs)
    wanted = nodes.select(F.col("ident").alias("name"))
    assert by_key(tree.structure_suite(nodes, nodes, wanted))
    assert by_key(tree.function_classes(nodes))


def test_arrays_of_more_documents_than_two_bytes_count(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("node_id"), *((F.col("id") + 65530 if n == "tu_idx" else F.lit(3)).alias(n) for n in readers.ARRAYS))
    assert exchange.wider(tu_idx=65535, kind=70000, parent=1 << 31, depth=3) == {"kind": "u4", "parent": "i8"}
    exchange.write_arrays(rows, {}, str(tmp_path), exchange.wider(tu_idx=65539))
    made = json.loads((tmp_path / "manifest.json").read_text())
    assert made["arrays"]["tu_idx"] == {"file": "tu_idx.u4", "dtype": "u4", "length": 10, "bytes": 40} and made["bytes_per_node"] == 39
    assert sorted(map(tuple, exchange.load_tensor(spark, str(tmp_path), ("kind", "tu_idx")).collect())) == [(i, 3, 65530 + i) for i in range(10)]


def test_only_what_is_asked_leaves_the_walk(spark):
    """And what is kept of children grows in place: it was copied for each child."""
    docs = units.units(spark, DIR)
    found = tree.ast_nodes(docs, False, ("kind", "doc_id", "shape"), ("FunctionDecl",))
    assert found.columns == ["kind", "doc_id", "shape"]
    assert sorted(found.collect()) == sorted(tree.ast_nodes(docs, False).where("kind = 'FunctionDecl'").select("kind", "doc_id", "shape").collect())
    one = tree._Rows("d")
    one.enter(kind="a", ident="", type="")
    for _ in range(1000):
        one.node(kind="b", ident="", type="")
    assert isinstance(one.shapes[-1], bytearray) and len(one.shapes[-1]) == 8000


def test_links_are_counted_before_they_meet(spark):
    nodes = tree.ast_nodes(units.units(spark, DIR), False)
    found = graph.edges(nodes, False)
    one = graph.across_units(found, nodes).groupBy("doc_id", "to_doc", "pred").agg(F.count("*").alias("n"))
    two = graph.across_units(found.groupBy("doc_id", "pred", "iri").agg(F.count("*").alias("n")), nodes).groupBy("doc_id", "to_doc", "pred").agg(F.sum("n").alias("n"))
    assert sorted(one.collect()) == sorted(two.collect()) != []


def test_sql_files_are_walked_once(spark):
    """Whatever their dialect, and only what is asked for leaves the walk; a pattern is tried once a statement and use."""
    src = spark.createDataFrame([("p", "create table a (x int); -- c\nselect 1", "postgres"), ("q", "drop table [a b]; select 'x", "sqlite"), ("r", "select 1", "other")], "path string, sql string, dialect string")
    some = sqltext.sql_nodes(src, columns=("ord", "doc_id", "shape", "start_line"))
    assert some.columns == ["ord", "doc_id", "shape", "start_line", "dialect"]
    assert sorted(map(tuple, some.fillna(-1).collect())) == sorted(map(tuple, sqltext.sql_nodes(src).fillna(-1).select(some.columns).collect()))
    stmts = ddl.statements(src)
    assert stmts.groupBy("dialect").count().count() == 2
    plan = ddl.parsed(stmts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("^create (?:or") <= 4


def test_many_files_are_listed_and_read_by_tasks(spark, tmp_path):
    """As Spark's reader finds them, but not a task for every few files, nor all written by one."""
    names = [f"d{i % 3}/e{i % 2}/f{i}.json" for i in range(400)]
    odd = ["d0/a b%20#é?.json", "d0/.h.json", "d0/_h.json", "_d/x.json", "d0/_a=b.json", "d0/x.txt", "top.json"]
    exchange.write_files(spark.createDataFrame([(n, f"{n}\n") for n in names + odd], "path string, value string").coalesce(1), f"{tmp_path}/out")
    (tmp_path / "out" / "d1" / "bytes.json").write_bytes(b"\xff\x00")
    for root in (f"file://{tmp_path}/out", f"{tmp_path}/out/", f"{tmp_path}/out/top.json"):
        got = exchange.read_files(spark, root, "*.json")
        want = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        rows = lambda d: sorted(map(tuple, d.select("path", F.hex("text")).collect()))
        assert rows(got) == rows(want) and want.count() in (404, 1)
        assert got.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    with pytest.raises(FileNotFoundError):
        exchange.read_files(spark, f"{tmp_path}/none", "*.json")


def test_pages_leave_the_walk_as_asked(spark):
    docs = spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "html")
    assert tree.page_nodes(docs, ("size", "kind")).columns == ["size", "kind", "page_id"]
    assert len(pages._walked(spark, DIR)[1].columns) == 9


def test_jobs_of_a_cluster_in_many_batches_are_judged_as_one(spark, tmp_path):
    """Equal times go by id, whatever order and however many Arrow batches they come in."""
    jobs = spark.range(60).select((59 - F.col("id")).alias("event_id"), F.timestamp_seconds(F.floor((59 - F.col("id")) / 7) + 100).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("x").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
    jobs.write.parquet(f"{tmp_path}/in")
    stream = events.event_stream(spark, f"{tmp_path}/in").select(F.lit("c").alias("cluster"), "event_id", "at", F.when(F.col("event_id") == 40, "FAIL").otherwise("PASS").alias("status"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, 7)
    try:
        events.run_once(events.until_first_failure(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    finally:
        spark.conf.set(key, old)
    got = spark.read.schema(events.JUDGED).parquet(f"{tmp_path}/out").orderBy("event_id").collect()
    assert [(r["event_id"], r["n"], r["verdict"]) for r in got] == [(i, min(i, 40) + 1, "run" if i <= 40 else "stopped") for i in range(60)]


def test_units_in_parts_are_the_whole_units(spark):
    """Variables are walked once a digit, not once a unit: own nodes keep the numbers they have in the whole text, and triples and edges are the same."""
    own, variables = units.split_units(spark, DIR)
    whole = units.units(spark, DIR)
    for prune in (True, False):
        shared = tree.shared_nodes(variables, prune)
        assert 0 < shared.select("doc_id").distinct().count() <= variables.count() <= 10
        columns = [c for c in tree._NAMES if c != "shape"]
        found = tree.ast_nodes(tree.after_shared(own, shared), prune).select(columns)
        spread = shared.withColumnRenamed("doc_id", "part").join(units._parts(spark, DIR), "part").select(columns)
        assert sorted(map(repr, found.unionByName(spread).collect())) == sorted(map(repr, tree.ast_nodes(whole, prune).select(columns).collect()))
    nodes, both = tree.ast_nodes(tree.after_shared(own, shared), False), (shared, units._parts(spark, DIR))
    for strict in (True, False):
        assert sorted(map(repr, graph.triples(nodes, strict, both).collect())) == sorted(map(repr, graph.triples(tree.ast_nodes(whole, False), strict).collect()))
    with pytest.raises(Exception, match="can't be shared"):
        tree.shared_nodes(whole.withColumnRenamed("doc_id", "part")).count()


def test_the_lean_walk_finds_what_the_whole_walk_finds(spark):
    docs = units.units(spark, DIR).collect()[:2]
    odd = ['{"kind": "CallExpr", "inner": [1, {"kind": "CallExpr", "inner": [{"kind": "DeclRefExpr", "referencedDecl": {"id": 7}}]}, {"name": 3}]}', "{}", "[]", "{", "", '{"inner": 5, "range": 1, "loc": []}', '{"inner": [{"isImplicit": true, "inner": [{}]}]}']
    columns = tuple(c for c in tree._NAMES if c != "path")
    for doc_id, source in [*docs, *((str(i), x) for i, x in enumerate(odd))]:
        for prune in (True, False):
            for before in (0, 3):
                want = tree.ast_rows(doc_id, source, prune, before) or []
                for some in (columns, tree.STRUCTURE, graph.EDGE_COLUMNS, ("kind", "in_callee", "ref_id"), ("node_id", "start_line", "n_children")):
                    got = tree.asked_rows(doc_id, source, prune, before, some)
                    assert [[r.get(c) for c in some] for r in got] == [[r[c] for c in some] for r in want]
                assert [r["node_id"] for r in tree.asked_rows(doc_id, source, prune, before, ("kind",), (tree.ROOT, "CallExpr"))] == [r["node_id"] for r in want if r["node_id"] == 0 or r["kind"] == "CallExpr"]


def test_links_are_summed_by_class_before_they_are_opened(spark, monkeypatch):
    """Names of many and of few units that lead to one unit, one that a unit declares twice, a unit with the name it asks for."""
    tu = lambda *names: json.dumps({"kind": "TranslationUnitDecl", "inner": [{"kind": "VarDecl", "name": n, "id": n} for n in names]})
    docs = [("a", tu("x", "y")), ("b", tu("x", "y")), ("c", tu("x", "x", "z")), ("d", tu("z", "x")), ("e", tu("w")), ("f", tu())]
    nodes = tree.ast_nodes(spark.createDataFrame(docs, "doc_id string, source string"), False)
    found = spark.createDataFrame([(d, p, f"urn:c:var:{n}", k) for d in "abcf" for p in ("refs", "calls") for k, n in enumerate("xyzwu", 1)] + [("f", "refs", "urn:c:var:f#x", 9)], "doc_id string, pred string, iri string, n long")
    want = sorted(graph.across_units(found, nodes).groupBy("doc_id", "to_doc", "pred").agg(F.sum("n").alias("n")).collect())
    for many in (1, 3, 99):
        monkeypatch.setattr(graph, "MANY", many)
        monkeypatch.setattr(graph, "OPENED", 1)
        assert sorted(graph.link_counts(found, nodes).collect()) == want != []
