"""Translation units as compiler JSON: 20 customers make a unit, as functions; their orders are statements in
the bodies; suppliers are variables of every tenth unit. Queries over them and their SQL.

Every unit has what the walk and the emitters treat apart: generated functions (every 11th), variables from
headers (every 7th), up to three parameters, with and without a name, statements without a place or an end line, nested
statements, calls right in a body, columns beyond the cap, references to later functions, to other units
and to nothing, and a type whose text needs escapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, tree
from ..work import written

UNIT = 20
COPIES = 64
TYPE = 'say "x\\y"\n'


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _listed(rows: DataFrame, by: str, order: str, text: Column, to: str) -> DataFrame:
    """The texts of each group in order, joined by commas. A group is a unit or a function: bounded."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), text.alias("t")))), lambda x: x["t"]), ",").alias(to))


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """unit, fns; digit, vars: the functions of each unit, and the ten lists of variables at most, one for each last digit of the key."""
    orders, customer, supplier = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "supplier"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    target, var = c + o % 5 - 2, o % 25 + 1
    kind = F.when(F.col("o_orderstatus") == "F", "ReturnStmt").when(F.col("o_orderstatus") == "O", "IfStmt").otherwise("DeclStmt")
    col = o % 100 + 1 + F.when(o % 13 == 0, 70000).otherwise(0)
    end = F.when(o % 5 == 0, "").otherwise(_text('"line":', o + 1, ","))
    place = F.when(o % 9 == 0, "").otherwise(_text(',"range":{"begin":{"line":', o, ',"col":', col, ',"offset":', o * 7, '},"end":{', end, '"col":', col + 3, "}}"))
    nested = F.when(F.col("o_orderstatus") == "O", _text('{"id":"z', o, '","kind":"NullStmt","range":{"begin":{"line":', o, ',"col":', col + 50, '},"end":{"line":', o, ',"col":', col + 51, "}}},")).otherwise("")
    ref = lambda id, to, kind, name: _text('{"id":"', *id, '","kind":"DeclRefExpr","referencedDecl":{"id":"', *to, f'","kind":"{kind}","name":"', *name, '"}}')
    callee = lambda key, to: _text('{"id":"i', key, '","kind":"ImplicitCastExpr","inner":[', ref(("r", key), ("c", to), "FunctionDecl", ("f", to)), "]}")
    call = _text('{"id":"k', o, '","kind":"CallExpr","inner":[', callee(o, target), ",", ref(("q", o), ("s", var), "VarDecl", ("v", var)), ",", ref(("w", o), ("p", c), "ParmVarDecl", ("x",)), "]}")
    stmt = _text('{"id":"o', o, '","kind":"', kind, '"', place, ',"inner":[', nested, call, "]}")
    bodies = _listed(orders, "o_custkey", "o_orderkey", stmt, "stmts")

    k = F.col("c_custkey")
    direct = F.when(k % 4 == 0, _text('{"id":"d', k, '","kind":"CallExpr","inner":[', callee(_text("d", k), k), "]}", F.when(F.col("stmts") != "", ",").otherwise(""))).otherwise("")
    body = _text('{"id":"b', k, '","kind":"CompoundStmt","range":{"begin":{"line":', k, ',"col":20},"end":{"line":', k + 5, ',"col":1}},"inner":[', direct, F.col("stmts"), "]}")
    one = lambda id, name: _text(f'{{"id":"{id}', k, '","kind":"ParmVarDecl"', name, ',"type":{"qualType":"int"}}')
    n_params = F.when(k % 13 == 5, 0).otherwise(1 + k % 3)
    params = F.slice(F.array(one("p", F.when(k % 3 == 0, "").otherwise(',"name":"x"')), one("pb", F.lit(',"name":"y"')), one("pc", F.lit(""))), F.lit(1), n_params)
    implicit = F.when(k % 11 == 0, ',"isImplicit":true').otherwise("")
    fn = _text('{"id":"c', k, '","kind":"FunctionDecl","name":"f', k, '"', implicit, ',"type":{"qualType":"int (int)"},"range":{"begin":{"line":', k, ',"col":1,"offset":', k * 10, '},"end":{"line":', k + 5, ',"col":2}},"inner":[', F.array_join(F.concat(params, F.array(body)), ","), "]}")
    written = customer.join(bodies.hint("merge"), F.col("o_custkey") == k, "left").withColumn("stmts", F.coalesce("stmts", F.lit(""))).withColumn("unit", F.floor(k / UNIT))
    functions = _listed(written, "unit", "c_custkey", fn, "fns")

    s = F.col("s_suppkey")
    header = F.when(s % 7 == 0, ',"loc":{"includedFrom":{"file":"a.h"}}').otherwise("")
    variable = _text('{"id":"s', s, '","kind":"VarDecl","name":"v', s, '"', header, r',"type":{"qualType":"say \"x\\y\"\n"},"range":{"begin":{"line":', s, ',"col":2},"end":{"line":', s, ',"col":9}}}')
    return functions, _listed(supplier.withColumn("digit", s % 10), "digit", "s_suppkey", variable, "vars")


def _source(*lists: Column) -> Column:
    return F.concat(F.lit('{"id":"tu","kind":"TranslationUnitDecl","inner":['), *lists, F.lit("]}"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source."""
    functions, variables = _pieces(spark, sf_dir)
    # The lists of variables are long: joined by key, in copies, so that units
    # of one digit are shared out; texts shrink so much in a shuffle that Spark would else take them for small and send them through the driver.
    variables = variables.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long"))))
    at = functions.withColumn("digit", F.col("unit") % 10).withColumn("copy", F.floor(F.col("unit") / 10) % COPIES)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = at.repartition(tasks, "digit", "copy").join(variables.hint("merge"), ["digit", "copy"], "left")
    return found.select(_text("d", F.col("unit")).alias("doc_id"), _source(F.coalesce(F.concat("vars", F.lit(",")), F.lit("")), F.col("fns")).alias("source"))


def split_units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, part, source; part, source: the same documents, but the variables, which are the same text in every unit of a digit, are one
    source a digit, as a header that is compiled once (tree.shared_nodes). The texts of units() grow as units times suppliers."""
    functions, variables = _pieces(spark, sf_dir)
    own = functions.select(_text("d", F.col("unit")).alias("doc_id"), (F.col("unit") % 10).cast("string").alias("part"), _source(F.col("fns")).alias("source"))
    return own, variables.select(F.col("digit").cast("string").alias("part"), _source(F.col("vars")).alias("source"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, part of every unit."""
    unit = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(F.col("c_custkey") / UNIT).alias("unit")).distinct()
    return unit.select(_text("d", F.col("unit")).alias("doc_id"), (F.col("unit") % 10).cast("string").alias("part"))


def _nodes(spark: SparkSession, sf_dir: str, prune: bool, columns: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Nodes of every unit without those of its variables; nodes of the variables, part for doc_id. Together they are the units' nodes."""
    own, shared = split_units(spark, sf_dir)
    shared = written(tree.shared_nodes(shared, prune), "shared")
    return written(tree.ast_nodes(tree.after_shared(own, shared), prune, columns, kinds), "units"), shared


_WALKED = ("doc_id", "node_id", "parent", "ord", "depth", "size", "n_children", "kind", "ident", "type", "start_line", "start_col", "end_line", "end_col")


def _numbers(nodes: DataFrame) -> DataFrame:
    sums = nodes.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.sum("depth").alias("depths"), F.sum("size").alias("sizes"), F.max("depth").alias("deepest"), F.count_if(F.col("start_line").isNull()).alias("n_placeless"))
    stored = tree.node_export(nodes)
    links = stored.groupBy("doc_id").agg(
        F.count_if(F.col("first_child") == -1).alias("n_leaves"), F.count_if(F.col("next_sibling") == -1).alias("n_last"),
        F.sum(F.when(F.col("kind").endswith("Stmt"), F.col("end_line"))).alias("end_lines"), F.max("end_col").cast("long").alias("widest"),
    )
    return sums.join(links, "doc_id")


def unit_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pruned node table of every unit in numbers, and the stored form's links and caps. Shared nodes are leaves right below the root, which
    counts them already; the last of them is no last one if own nodes follow."""
    nodes, shared = _nodes(spark, sf_dir, True, _WALKED)
    both = _numbers(nodes).alias("o").join(_parts(spark, sf_dir), "doc_id").join(F.broadcast(_numbers(shared.select(*_WALKED)).withColumnRenamed("doc_id", "part")).alias("s"), "part", "left")  # a row a part
    own = lambda c: F.coalesce(f"o.{c}", F.lit(0))
    more = lambda c: F.coalesce(f"s.{c}", F.lit(0))
    summed = {c: (own(c) + more(c)).alias(c) for c in ("n_nodes", "depths", "sizes", "n_leaves", "n_placeless")}
    n_last = own("n_last") + F.when(F.col("o.n_nodes") > 1, 0).otherwise(more("n_last"))
    return both.select(
        "doc_id", summed["n_nodes"], summed["depths"], summed["sizes"], F.greatest("o.deepest", "s.deepest").alias("deepest"), summed["n_leaves"], n_last.alias("n_last"), summed["n_placeless"],
        F.coalesce(F.col("o.end_lines") + F.col("s.end_lines"), "o.end_lines", "s.end_lines").alias("end_lines"), F.greatest("o.widest", "s.widest").alias("widest"),
    )


def unit_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triple of every unit, with the recorded limits."""
    nodes, shared = _nodes(spark, sf_dir, False, graph.TRIPLE_COLUMNS, graph.TRIPLE_KINDS)
    return graph.triples(nodes, True, (shared, _parts(spark, sf_dir))).select("doc_id", "s", "p", "o", "o_kind")


def unit_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the limits, as Turtle lines."""
    nodes, shared = _nodes(spark, sf_dir, False, graph.TRIPLE_COLUMNS, graph.TRIPLE_KINDS)
    return graph.turtle(graph.triples(nodes, False, (shared, _parts(spark, sf_dir))), "c").select("doc_id", "value")


def unit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges of each kind a unit has, and how many of them resolve, with and without the limits."""
    nodes, shared = _nodes(spark, sf_dir, False, graph.EDGE_COLUMNS, graph.EDGE_KINDS)
    out = None
    for strict in (True, False):
        found = graph.edges(nodes, strict, (shared, _parts(spark, sf_dir))).groupBy("doc_id", "pred").agg(F.count("*").alias("n"), F.count_if(F.col("iri").startswith("urn:c:unknown#")).alias("n_unknown"), F.count_if(~F.col("iri").contains("#")).alias("n_bare")).withColumn("strict", F.lit(strict))
        out = found if out is None else out.unionByName(found)
    return out


def unit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which units refer to which others by bare names."""
    nodes, shared = _nodes(spark, sf_dir, False, graph.EDGE_COLUMNS, graph.EDGE_KINDS)
    shared = shared, _parts(spark, sf_dir)
    return graph.link_counts(graph.edges(nodes, False, shared).groupBy("doc_id", "pred", "iri").agg(F.count("*").alias("n")), nodes, shared)


def unit_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first function of a name is, with its parameters and its subtree's size."""
    nodes, _ = _nodes(spark, sf_dir, True, ("doc_id", "node_id", "kind", "ident", "size"))  # what is shared is no function and in none
    at = tree.find_function(nodes, "f27")
    one = nodes.join(F.broadcast(at.select("doc_id")), "doc_id", "left_semi")  # one row
    below = tree.subtree(one, one.join(at, ["doc_id", "node_id"], "left_semi").select("doc_id", "node_id", "size"))
    return below.groupBy("doc_id", "root").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kind") == "ParmVarDecl").alias("n_params"))


def unit_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of one structure, across all units."""
    return tree.function_classes(_nodes(spark, sf_dir, True, tree.STRUCTURE, tree.FUNCTIONS)[0]).select("doc_id", "ident", "size", "class_doc", "class_fn", "n")


def unit_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named function, and one that is nowhere, against units without generated functions in which every third has
    other statements."""
    docs, shared = split_units(spark, sf_dir)
    # The shared variables hold no statements; they only move a function's number.
    walked = lambda docs, prune, name: written(tree.ast_nodes(tree.after_shared(docs, tree.shared_nodes(shared, prune)), prune, tree.STRUCTURE, tree.FUNCTIONS), name)
    third = F.regexp_extract("doc_id", r"(\d+)", 1).cast("long") % 3 == 0
    changed = docs.withColumn("source", F.when(third, F.replace("source", F.lit("ReturnStmt"), F.lit("GotoStmt"))).otherwise(F.col("source")))
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(_text("f", F.col("c_custkey")).alias("name")).unionByName(spark.createDataFrame([("nowhere",)], "name string"))
    return tree.structure_suite(walked(docs, False, "left"), walked(changed, True, "right"), wanted)


def unit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference's identifier is the name of what it refers to."""
    nodes, _ = _nodes(spark, sf_dir, False, ("doc_id", "kind", "ident", "ref_kind", "in_callee"), ("DeclRefExpr",))
    return nodes.groupBy("doc_id", "ref_kind", "ident").agg(F.count("*").alias("n"), F.count_if(F.col("in_callee")).alias("n_callees"))


_BASE = f"""c AS (SELECT c_custkey AS k, c_custkey // {UNIT} AS u, c_custkey % 11 = 0 AS made, CASE WHEN c_custkey % 13 = 5 THEN 0 ELSE 1 + c_custkey % 3 END AS np FROM customer),
o AS (SELECT o_orderkey AS o, c.*, CASE o_orderstatus WHEN 'F' THEN 'ReturnStmt' WHEN 'O' THEN 'IfStmt' ELSE 'DeclStmt' END AS kind,
        o_orderkey % 100 + 1 + CASE WHEN o_orderkey % 13 = 0 THEN 70000 ELSE 0 END AS col, k + o_orderkey % 5 - 2 AS target, o_orderkey % 25 + 1 AS var FROM orders JOIN c ON o_custkey = k),
v AS (SELECT s_suppkey AS s, u FROM supplier, (SELECT DISTINCT u FROM c) WHERE s_suppkey % 10 = u % 10 AND s_suppkey % 7 <> 0),
fn AS (SELECT *, 'urn:c:fn:d' || u || '#f' || k AS iri FROM c WHERE NOT made),
pa AS (SELECT *, iri || '/' || coalesce(pname, 'arg' || i) AS piri FROM (SELECT fn.*, i, CASE WHEN i = 0 AND k % 3 <> 0 THEN 'x' WHEN i = 1 THEN 'y' END AS pname, ['p', 'pb', 'pc'][i + 1] || k AS pid FROM fn, range(3) r(i) WHERE i < np)),
st AS (SELECT o.*, fn.iri AS firi, 'urn:c:stmt:d' || o.u || '#' || CASE WHEN o % 9 = 0 THEN 'node-' || row_number() OVER (PARTITION BY o.u, o % 9 = 0 ORDER BY o.k, o)
          ELSE 'L' || o || 'C' || col || '-L' || (o + CASE WHEN o % 5 = 0 THEN 0 ELSE 1 END) || 'C' || (col + 3) END || ':' || kind AS iri FROM o JOIN fn ON o.k = fn.k),
bo AS (SELECT *, 'urn:c:stmt:d' || u || '#L' || k || 'C20-L' || (k + 5) || 'C1:CompoundStmt' AS biri FROM fn)"""
#: Depth of each node below the pruned root, a row a node.
_DEPTHS = """n AS (SELECT u, unnest([1, 2]) AS d, 'f' AS t, k, 0 AS o, unnest([1, 20]) AS col, unnest([k + 5, k + 5]) AS line, unnest([2, 1]) AS ecol, unnest(['', 'Stmt']) AS kind, 1 AS placed FROM fn
  UNION ALL SELECT u, 2, 'p', k, 0, 1, 0, 0, '', 0 FROM pa
  UNION ALL SELECT u, unnest([3, 4, 5]), 'd', k, 0, 0, 0, 0, '', 0 FROM fn WHERE k % 4 = 0
  UNION ALL SELECT u, 3, 's', k, o, col, CASE WHEN o % 9 = 0 THEN 0 WHEN o % 5 = 0 THEN o ELSE o + 1 END, CASE WHEN o % 9 = 0 THEN 0 ELSE col + 3 END, 'Stmt', CASE WHEN o % 9 = 0 THEN 0 ELSE 1 END FROM st
  UNION ALL SELECT u, 4, 'z', k, o, col, o, col + 51, 'Stmt', 1 FROM st WHERE kind = 'IfStmt'
  UNION ALL SELECT u, unnest([4, 5, 5, 5, 6]), 'k', k, o, 0, 0, 0, '', 0 FROM st
  UNION ALL SELECT u, 1, 'v', 0, 0, 2, s, 9, '', 1 FROM v
  UNION ALL SELECT DISTINCT u, 0, 'r', 0, 0, 0, 0, 0, '', 0 FROM c)"""
_PLACE = "{'p': 'line', 'o': %s, 'k': 'integer'}, {'p': 'column', 'o': %s, 'k': 'integer'}, {'p': 'endLine', 'o': %s, 'k': 'integer'}, {'p': 'endColumn', 'o': %s, 'k': 'integer'}, {'p': 'clangNodeId', 'o': %s, 'k': 'string'}"


def _place(line: str, col: str, end_line: str, end_col: str, id: str) -> str:
    return _PLACE % tuple(f"({x})::VARCHAR" for x in (line, col, end_line, end_col, id))


_QUALTYPE = "'say \"x\\y\"' || chr(10)"
_FACTS = f"""x AS (SELECT u, iri AS s, unnest([{{'p': 'a', 'o': 'FunctionDecl', 'k': 'class'}}, {{'p': 'name', 'o': 'f' || k, 'k': 'string'}}, {{'p': 'qualType', 'o': 'int (int)', 'k': 'string'}}, {{'p': 'offset', 'o': (k * 10)::VARCHAR, 'k': 'integer'}},
    {{'p': 'hasChild', 'o': 'urn:c:stmt:d' || u || '#L' || k || 'C20-L' || (k + 5) || 'C1:CompoundStmt', 'k': 'iri'}}, {_place("k", "1", "k + 5", "2", "'c' || k")}]) AS t FROM fn
  UNION ALL SELECT u, iri, {{'p': 'hasParam', 'o': piri, 'k': 'iri'}} FROM pa
  UNION ALL SELECT u, piri, unnest([{{'p': 'a', 'o': 'ParmVarDecl', 'k': 'class'}}, {{'p': 'paramIndex', 'o': i::VARCHAR, 'k': 'integer'}}, {{'p': 'name', 'o': pname, 'k': 'string'}}, {{'p': 'qualType', 'o': 'int', 'k': 'string'}}, {{'p': 'clangNodeId', 'o': pid, 'k': 'string'}}]) FROM pa
  UNION ALL SELECT u, 'urn:c:var:d' || u || '#v' || s, unnest([{{'p': 'a', 'o': 'VarDecl', 'k': 'class'}}, {{'p': 'name', 'o': 'v' || s, 'k': 'string'}}, {{'p': 'qualType', 'o': {_QUALTYPE}, 'k': 'string'}}, {_place("s", "2", "s", "9", "'s' || s")}]) FROM v
  UNION ALL SELECT u, biri, unnest([{{'p': 'a', 'o': 'CompoundStmt', 'k': 'class'}}, {_place("k", "20", "k + 5", "1", "'b' || k")}]) FROM bo
  UNION ALL SELECT st.u, st.iri, unnest([{{'p': 'a', 'o': kind, 'k': 'class'}}, {{'p': 'offset', 'o': CASE WHEN o % 9 <> 0 THEN (o * 7)::VARCHAR END, 'k': 'integer'}}, {_place("CASE WHEN o % 9 <> 0 THEN o END", "CASE WHEN o % 9 <> 0 THEN col END", "CASE WHEN o % 9 <> 0 AND o % 5 <> 0 THEN o + 1 END", "CASE WHEN o % 9 <> 0 THEN col + 3 END", "'o' || o")},
    {{'p': 'hasChild', 'o': CASE WHEN kind = 'IfStmt' THEN 'urn:c:stmt:d' || st.u || '#L' || o || 'C' || (col + 50) || '-L' || o || 'C' || (col + 51) || ':NullStmt' END, 'k': 'iri'}}]) FROM st
  UNION ALL SELECT bo.u, biri, {{'p': 'hasChild', 'o': st.iri, 'k': 'iri'}} FROM st JOIN bo ON st.k = bo.k
  UNION ALL SELECT u, 'urn:c:stmt:d' || u || '#L' || o || 'C' || (col + 50) || '-L' || o || 'C' || (col + 51) || ':NullStmt', unnest([{{'p': 'a', 'o': 'NullStmt', 'k': 'class'}}, {_place("o", "col + 50", "o", "col + 51", "'z' || o")}]) FROM st WHERE kind = 'IfStmt')"""
#: Edges: pred, iri of every statement, with the limits (strict) and without.
_EDGES = """e AS (SELECT st.u, st.iri AS s, 'calls' AS pred, true AS strict, coalesce(f.iri, 'urn:c:unknown#c' || target) AS iri FROM st LEFT JOIN fn f ON f.k = target AND f.u = st.u AND f.k <= st.k
  UNION ALL SELECT st.u, st.iri, 'calls', false, coalesce(f.iri, 'urn:c:fn:f' || target) FROM st LEFT JOIN fn f ON f.k = target AND f.u = st.u
  UNION ALL SELECT st.u, st.iri, 'refs', b, coalesce('urn:c:var:d' || v.u || '#v' || v.s, CASE WHEN b THEN 'urn:c:unknown#s' || var ELSE 'urn:c:var:v' || var END) FROM st CROSS JOIN (VALUES (true), (false)) t(b) LEFT JOIN v ON v.s = var AND v.u = st.u
  UNION ALL SELECT st.u, st.iri, 'refs', b, coalesce(piri, 'urn:c:unknown#p' || st.k) FROM st CROSS JOIN (VALUES (true), (false)) t(b) LEFT JOIN pa ON pa.k = st.k AND pa.i = 0
  UNION ALL SELECT u, biri, 'calls', false, iri FROM bo WHERE k % 4 = 0)"""
_TRIPLES = lambda strict: f"SELECT 'd' || u AS doc_id, s, t.p AS p, t.o AS o, t.k AS o_kind FROM x WHERE t.o IS NOT NULL UNION ALL SELECT 'd' || u, s, pred, iri, 'iri' FROM e WHERE {'strict' if strict else 'NOT strict'}"
_ESCAPED = r"""replace(replace(replace(o, '\', '\\'), '"', '\"'), chr(10), '\n')"""

QUERIES = {f.__name__: f for f in (unit_walk, unit_triples, unit_turtle, unit_edges, unit_links, unit_function, unit_classes, unit_suite, unit_references)}
ORACLE_SQL = {
    "unit_walk": f"""WITH {_BASE}, {_DEPTHS},
        last AS (SELECT u, count(*) AS n FROM (SELECT u FROM c GROUP BY u
          UNION ALL SELECT u FROM c GROUP BY u HAVING count(*) FILTER (WHERE NOT made) > 0 OR u IN (SELECT u FROM v)
          UNION ALL SELECT u FROM fn UNION ALL SELECT fn.u FROM fn WHERE k % 4 = 0 OR k IN (SELECT k FROM st)
          UNION ALL SELECT u FROM st UNION ALL SELECT u FROM st UNION ALL SELECT u FROM st
          UNION ALL SELECT unnest([u, u]) FROM fn WHERE k % 4 = 0) GROUP BY u)
        SELECT 'd' || n.u AS doc_id, count(*) AS n_nodes, sum(d)::BIGINT AS depths, sum(d + 1)::BIGINT AS sizes, max(d)::BIGINT AS deepest,
          count(*) FILTER (WHERE t = 'v' OR t = 'z' OR (t = 'd' AND d = 5) OR t = 'p' OR (t = 'k' AND d = 6)) + 2 * count(*) FILTER (WHERE t = 's')
            + count(*) FILTER (WHERE t = 'f' AND kind = 'Stmt' AND k % 4 <> 0 AND k NOT IN (SELECT k FROM st)) + count(*) FILTER (WHERE t = 'r' AND n.u NOT IN (SELECT u FROM fn) AND n.u NOT IN (SELECT u FROM v)) AS n_leaves,
          any_value(last.n) AS n_last, count(*) FILTER (WHERE placed = 0) AS n_placeless, (sum(CASE WHEN kind = 'Stmt' THEN line END))::BIGINT AS end_lines, max(least(ecol, 65535))::BIGINT AS widest
        FROM n JOIN last ON n.u = last.u GROUP BY n.u""",
    "unit_triples": f"WITH {_BASE}, {_FACTS}, {_EDGES} {_TRIPLES(True)}",
    "unit_turtle": f"""WITH {_BASE}, {_FACTS}, {_EDGES} SELECT doc_id, '<' || s || '> ' || CASE WHEN p = 'a' THEN 'a' ELSE 'c:' || p END || ' ' || CASE o_kind WHEN 'iri' THEN '<' || o || '>' WHEN 'class' THEN 'c:' || o
        WHEN 'integer' THEN '"' || o || '"^^xsd:integer' ELSE '"' || {_ESCAPED} || '"' END || ' .' AS value FROM ({_TRIPLES(False)})""",
    "unit_edges": f"WITH {_BASE}, {_EDGES} SELECT 'd' || u AS doc_id, pred, strict, count(*) AS n, count(*) FILTER (WHERE iri LIKE 'urn:c:unknown#%') AS n_unknown, count(*) FILTER (WHERE NOT contains(iri, '#')) AS n_bare FROM e GROUP BY ALL",
    "unit_links": f"""WITH {_BASE}, {_EDGES}, d AS (SELECT u, 'urn:c:fn:f' || k AS bare FROM fn UNION ALL SELECT u, 'urn:c:var:v' || s FROM v)
        SELECT 'd' || e.u AS doc_id, 'd' || d.u AS to_doc, pred, count(*) AS n FROM e JOIN d ON e.iri = d.bare AND e.u <> d.u WHERE NOT strict GROUP BY ALL""",
    "unit_classes": f"""WITH {_BASE}, g AS (SELECT fn.k, fn.u, any_value(fn.np) AS np, string_agg(st.kind, ',' ORDER BY o) AS kinds, count(o) AS n, count(*) FILTER (WHERE st.kind = 'IfStmt') AS ifs FROM fn LEFT JOIN st ON st.k = fn.k GROUP BY ALL),
        s AS (SELECT *, 'd' || u AS doc_id, 2 + np + 6 * n + ifs + CASE WHEN k % 4 = 0 THEN 3 ELSE 0 END AS size FROM g)
        SELECT doc_id, 'f' || k AS ident, size, first_value(doc_id) OVER w AS class_doc, 'f' || first_value(k) OVER w AS class_fn, count(*) OVER (PARTITION BY np, k % 4 = 0, kinds) AS n FROM s WINDOW w AS (PARTITION BY np, k % 4 = 0, kinds ORDER BY doc_id, k)""",
    "unit_suite": f"""WITH {_BASE}, r AS (SELECT 'f' || k AS name, CASE WHEN made THEN 'missing on the right' WHEN u % 3 = 0 AND k IN (SELECT k FROM st WHERE kind = 'ReturnStmt') THEN 'structures differ' END AS reason FROM c UNION ALL SELECT 'nowhere', 'missing on the left')
        SELECT name, reason IS NULL AS passed, reason FROM r""",
    "unit_references": f"""WITH {_BASE}, r AS (SELECT u, 'FunctionDecl' AS ref_kind, 'f' || target AS ident, 1 AS callee FROM o UNION ALL SELECT u, 'VarDecl', 'v' || var, 0 FROM o UNION ALL SELECT u, 'ParmVarDecl', 'x', 0 FROM o UNION ALL SELECT u, 'FunctionDecl', 'f' || k, 1 FROM c WHERE k % 4 = 0)
        SELECT 'd' || u AS doc_id, ref_kind, ident, count(*) AS n, sum(callee)::BIGINT AS n_callees FROM r GROUP BY ALL""",
    "unit_function": f"""WITH {_BASE}, {_DEPTHS} SELECT 'd1' AS doc_id, (1 + count(*) FILTER (WHERE t = 'v' OR (t <> 'r' AND k < 27)))::BIGINT AS root, count(*) FILTER (WHERE k = 27) AS n_nodes, count(*) FILTER (WHERE k = 27 AND t = 'p') AS n_params
        FROM n WHERE u = 1 HAVING count(*) FILTER (WHERE k = 27) > 0""",
}
