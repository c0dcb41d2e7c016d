"""Triples from AST node tables.

The walk that makes the nodes knows the scopes around each: its statement, its declaration, whether it is in a callee. So
who owns a reference is a column, and the one join left is that of references with declarations. Input nodes are not pruned (walk with
prune=False): here the header test is for top-level declarations only.

strict=True keeps three known limits of the recorded behaviour: calls right under a function's own block
get no edges, references resolve only to declarations that stand before them, and unresolved ones stay
unknown. strict=False gives the block its edges, resolves forward, and falls back to bare names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import written
from .tree import ROOT, STATEMENTS

#: Top-level kinds with their IRI part.
DECLARATIONS = {"EnumDecl": "enum", "FunctionDecl": "fn", "RecordDecl": "struct", "TypedefDecl": "typedef", "VarDecl": "var"}
PREFIXES = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": "http://www.w3.org/2001/XMLSchema#"}
#: The columns and kinds of nodes that edges, and those that triples, are made of.
EDGE_COLUMNS = ("doc_id", "node_id", "depth", "kind", "ident", "id", "ref_id", "ref_kind", "ref_name", "tag", "implicit", "stmt", "stmt_place", "top_fn", "param", "in_body", "in_callee", "to_id", "to_kind", "to_name")
EDGE_KINDS = (ROOT, *DECLARATIONS, "ParmVarDecl", "CallExpr", "DeclRefExpr")
TRIPLE_KINDS = (*EDGE_KINDS, *STATEMENTS)
TRIPLE_COLUMNS = (*EDGE_COLUMNS, "type", "start_line", "start_col", "end_line", "end_col", "start_offset", "place")
TRIPLE = ("doc_id", "s", "p", "o", "o_kind", "at")
#: Stands in an IRI for a document that is not known yet: an IRI's first part has none.
MARK = "\0"
#: Nodes that documents share, as tree.shared_nodes gives them, with doc_id, part of the documents.
Shared = tuple[DataFrame, DataFrame]
#: A name that so many units declare is met by classes of units (link_counts); units of a class that are opened by one row; copies of what is
#: met by all units of a part or a class, so that these are shared out.
MANY, OPENED, COPIES = 64, 1000, 64


def decl_iri(kind: Column, tag: Column, name: Column, doc: Column) -> Column:
    """P11; null for a declaration without a name or of another kind."""
    part = F.when((kind == "RecordDecl") & (tag == "union"), "union").otherwise(F.create_map(*[F.lit(x) for p in DECLARATIONS.items() for x in p])[kind])
    return F.when(name != "", F.concat(F.lit("urn:c:"), part, F.lit(":"), doc, F.lit("#"), name))


def escaped(value: Column) -> Column:
    """A literal's text: backslash, quote, line feed, carriage return, tab."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def top_level(nodes: DataFrame) -> DataFrame:
    """Declarations right under each document's root that come from the file itself (F1, F3), with iri."""
    roots = nodes.where("node_id = 0").select("doc_id", F.col("kind").alias("root_kind"))
    checked = nodes.where("depth = 1 AND NOT implicit").join(roots, "doc_id")
    ok = F.when(F.col("root_kind") == "TranslationUnitDecl", True).otherwise(F.raise_error(F.concat(F.lit("not a translation unit: "), "doc_id")).cast("boolean"))
    return _named(checked.where(ok)).drop("root_kind")


def _named(rows: DataFrame) -> DataFrame:
    """Those declarations that have an iri, with it."""
    return rows.where(F.col("kind").isin(*DECLARATIONS)).withColumn("iri", decl_iri(F.col("kind"), F.col("tag"), F.col("ident"), F.col("doc_id"))).where("iri IS NOT NULL")


def _shared_top(shared: DataFrame) -> DataFrame:
    """Shared declarations that come from the file itself, with part for doc_id."""
    return shared.where("NOT implicit").withColumnRenamed("doc_id", "part")


def _met(many: DataFrame, few: DataFrame, key: str, spread: str) -> DataFrame:
    """many and few joined by a key of few values: few stands in copies and many is dealt out over these by another column, so that no task has all rows of
    a key. The result may be far larger than both, so the number of tasks is set."""
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = many.withColumn("copy", F.pmod(F.xxhash64(spread), F.lit(COPIES)))
    right = few.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long"))))
    return left.repartition(tasks, key, "copy").join(right.repartition(tasks, key, "copy").hint("merge"), [key, "copy"]).drop("copy")


def function_iri() -> Column:
    """IRI of the function that a node is in."""
    return F.concat(F.lit("urn:c:fn:"), "doc_id", F.lit("#"), "top_fn")


def parameters(nodes: DataFrame) -> DataFrame:
    """Parameters of each function with its IRI and their own; one without a name is named by its index."""
    name = F.when(F.col("ident") != "", F.col("ident")).otherwise(F.concat(F.lit("arg"), F.col("param").cast("string")))
    return nodes.where("param IS NOT NULL").withColumn("fn_iri", function_iri()).withColumn("iri", F.concat("fn_iri", F.lit("/"), name))


def statement_iri(doc: str, place: str) -> Column:
    return F.concat(F.lit("urn:c:stmt:"), doc, F.lit("#"), place)


def references(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, stmt, stmt_place, top_fn, in_body, pred (refs or calls), ref_id, rk, rn (what is referred to: id, kind, name) (R3, J16). A
    reference inside a callee is no ref; a call's target is found down the callee's first children, and a call that is itself
    in another's callee is not looked at again."""
    own = ("doc_id", "node_id", "stmt", "stmt_place", "top_fn", "in_body")
    calls, refs = F.col("kind") == "CallExpr", F.col("kind") == "DeclRefExpr"
    to = lambda a, b: F.when(calls, F.col(a)).otherwise(F.col(b))
    found = nodes.where((calls & F.col("to_id").isNotNull()) | (refs & F.col("ref_id").isNotNull() & ~F.coalesce("in_callee", F.lit(False))))
    return found.select(*own, F.when(calls, "calls").otherwise("refs").alias("pred"), to("to_id", "ref_id").alias("ref_id"), to("to_kind", "ref_kind").alias("rk"), to("to_name", "ref_name").alias("rn"))


def edges(nodes: DataFrame, strict: bool = True, shared: Shared | None = None) -> DataFrame:
    """doc_id, stmt, stmt_place, pred, iri, at: deduplicated per statement, first place kept (A14, J2). Of shared declarations only
    those that a document refers to meet it."""
    declared = lambda rows: rows.select("doc_id", F.col("id").alias("ref_id"), "iri", "node_id").where("ref_id IS NOT NULL")
    decls = declared(top_level(nodes)).unionByName(declared(parameters(nodes)))
    owned = references(nodes).where("stmt_place IS NOT NULL")
    if strict:
        owned = owned.where("NOT in_body")
    if shared is not None:
        asked = owned.select("doc_id", "ref_id").distinct().join(shared[1], "doc_id")
        decls = decls.unionByName(declared(_named(asked.join(_shared_top(shared[0]).where("id IS NOT NULL").drop("ref_id").withColumnRenamed("id", "ref_id"), ["part", "ref_id"])).withColumnRenamed("ref_id", "id")))
    before = (F.col("d.node_id") <= F.col("r.node_id")) if strict else F.lit(True)
    joined = owned.alias("r").join(decls.alias("d"), (F.col("r.doc_id") == F.col("d.doc_id")) & (F.col("r.ref_id") == F.col("d.ref_id")) & before, "left")
    bare = F.lit(None).cast("string")
    if not strict:
        bare = F.when((F.col("rn") != "") & F.col("rk").isin("FunctionDecl", "TypedefDecl", "VarDecl"), F.concat(F.lit("urn:c:"), F.create_map(*[F.lit(x) for p in DECLARATIONS.items() for x in p])[F.col("rk")], F.lit(":"), F.col("rn")))
    iri = F.coalesce(F.col("d.iri"), bare, F.concat(F.lit("urn:c:unknown#"), F.col("r.ref_id")))
    # An id that is declared again takes its last declaration, as a map would.
    last = joined.groupBy(F.col("r.doc_id").alias("doc_id"), F.col("r.stmt").alias("stmt"), F.col("r.stmt_place").alias("stmt_place"), F.col("r.pred").alias("pred"), F.col("r.node_id").alias("at")).agg(F.max_by(iri, F.coalesce(F.col("d.node_id"), F.lit(-1))).alias("iri"))
    return last.groupBy("doc_id", "stmt", "stmt_place", "pred", "iri").agg(F.min("at").alias("at"))


def across_units(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that a unit couldn't resolve but by a bare name, with every declaration of that kind and name in other units
    (J3): doc_id, stmt, pred, iri, to_doc, to_iri. found are edges with strict=False, or their numbers n by doc_id, pred and iri, which
    then stands for stmt."""
    declared = top_level(nodes).select(F.col("doc_id").alias("to_doc"), F.col("iri").alias("to_iri"), F.concat(F.lit("urn:c:"), F.element_at(F.split("iri", ":"), 3), F.lit(":"), "ident").alias("iri"))
    return found.where(~F.col("iri").contains("#")).join(declared, "iri").where("doc_id <> to_doc").select("doc_id", "n" if "n" in found.columns else "stmt", "pred", "iri", "to_doc", "to_iri")


def link_counts(found: DataFrame, nodes: DataFrame, shared: Shared | None = None) -> DataFrame:
    """doc_id, to_doc, pred, n: across_units counted. found are edges with strict=False, as numbers n by doc_id, pred and iri. Units that
    declare the same of the names that many units declare are a class: edges are summed by class, and only the sums are opened into units, a row a result.
    Names of few units are met one by one; a unit that is met so gets both sums and is left out when its class is opened."""
    bare = written(found.where(~F.col("iri").contains("#")), "bare")
    names = bare.select("iri").distinct()
    to_name = F.concat(F.lit("urn:c:"), F.element_at(F.split("iri", ":"), 3), F.lit(":"), "ident").alias("iri")
    declared = top_level(nodes).select(F.col("doc_id").alias("to_doc"), to_name).join(names, "iri", "left_semi")
    if shared is not None:
        asked = _named(_shared_top(shared[0]).withColumn("doc_id", F.lit(""))).select("part", to_name).join(names, "iri", "left_semi")
        declared = declared.unionByName(_met(shared[1], asked, "part", "doc_id").select(F.col("doc_id").alias("to_doc"), "iri"))
    declared = written(declared.groupBy("to_doc", "iri").agg(F.count("*").alias("times")), "declared")
    many = declared.groupBy("iri").agg(F.count("*").alias("units")).where(F.col("units") >= MANY).select("iri")
    of_unit = declared.join(many, "iri", "left_semi").groupBy("to_doc").agg(F.sort_array(F.collect_list(F.struct("iri", "times"))).alias("names"))
    classes = of_unit.groupBy("names").agg(F.min("to_doc").alias("class"), F.count("*").alias("units"))
    units = written(of_unit.join(classes, "names").select("to_doc", "class", "units", F.when(F.col("to_doc") == F.col("class"), F.col("names")).alias("names")), "classes")

    key = ["doc_id", "pred", "class"]
    sums = written(bare.join(units.where("names IS NOT NULL").select("class", F.inline("names")), "iri").groupBy(*key).agg(F.sum(F.col("n") * F.col("times")).alias("of_class")), "sums")
    ones = bare.join(declared.join(many, "iri", "left_anti"), "iri").where("doc_id <> to_doc").groupBy("doc_id", "to_doc", "pred").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    ones = written(ones.join(units.select("to_doc", "class"), "to_doc", "left").join(sums, key, "left"), "ones")
    left_out = ones.where("of_class IS NOT NULL").groupBy(*key).agg(F.collect_list("to_doc").alias("met"))
    opened = units.groupBy("class", F.pmod(F.xxhash64("to_doc"), F.ceil(F.col("units") / OPENED)).alias("chunk")).agg(F.collect_list("to_doc").alias("to_docs"))
    rest = F.when(F.col("met").isNull(), F.col("to_docs")).otherwise(F.array_except("to_docs", "met"))
    rows = _met(sums.join(left_out, key, "left"), opened.drop("chunk"), "class", "doc_id").select("doc_id", F.explode(rest).alias("to_doc"), "pred", F.col("of_class").alias("n")).where("doc_id <> to_doc")
    return rows.unionByName(ones.select("doc_id", "to_doc", "pred", (F.col("n") + F.coalesce("of_class", F.lit(0))).alias("n")))


def triples(nodes: DataFrame, strict: bool = True, shared: Shared | None = None) -> DataFrame:
    """Every emitter's triples (R5, R2, T5); o_kind is iri, class, string or integer. nodes is read several times: hand in
    a table that is written, not one that walks the documents each time. Facts of shared declarations are made once a part and
    then given to each document with its own iri."""
    top, params = top_level(nodes), parameters(nodes)
    above = F.coalesce(statement_iri("doc_id", "stmt_place"), function_iri())
    placed = nodes.where("place IS NOT NULL").withColumn("iri", statement_iri("doc_id", "place")).withColumn("parent_iri", above)

    def make(rows: DataFrame, *facts: tuple[str, Column, str], own: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """One pass over rows: each of its facts (predicate, object, kind of object) and its place, as far as known."""
        place = [("line", F.col("start_line"), "integer"), ("column", F.col("start_col"), "integer"), ("offset", F.col("start_offset"), "integer"), ("endLine", F.col("end_line"), "integer"), ("endColumn", F.col("end_col"), "integer"), ("clangNodeId", F.col("id"), "string")]
        listed = F.array(*(F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind")) for s, p, o, kind in [*facts, *((F.col("iri"), *x) for x in place)]))
        return rows.select(*own, F.explode(listed).alias("t"), F.col("node_id").alias("at")).select(*own, "t.*", "at").where("o IS NOT NULL")

    iri, name, type = F.col("iri"), F.nullif(F.col("ident"), F.lit("")), F.nullif(F.col("type"), F.lit(""))
    record = F.when(F.col("kind") == "RecordDecl", F.when(F.col("tag") == "union", F.lit("UnionDecl")).otherwise(F.lit("StructDecl"))).otherwise(F.col("kind"))
    declaration = (iri, "a", record, "class"), (iri, "name", F.col("ident"), "string"), (iri, "qualType", type, "string")
    out = [
        make(top, *declaration),
        make(params, (iri, "a", F.lit("ParmVarDecl"), "class"), (F.col("fn_iri"), "hasParam", iri, "iri"), (iri, "paramIndex", F.col("param"), "integer"), (iri, "name", name, "string"), (iri, "qualType", type, "string")),
        make(placed, (iri, "a", F.col("kind"), "class"), (F.col("parent_iri"), "hasChild", iri, "iri")),
    ]
    out.append(edges(nodes, strict, shared).select("doc_id", statement_iri("doc_id", "stmt_place").alias("s"), F.col("pred").alias("p"), F.col("iri").alias("o"), F.lit("iri").alias("o_kind"), "at"))
    if shared is not None:
        facts = make(_named(_shared_top(shared[0]).withColumn("doc_id", F.lit(MARK))), *declaration, own=("part",))
        at = F.instr("s", MARK)
        cut = facts.select("part", F.substring("s", F.lit(1), at - 1).alias("start"), F.substring("s", at + len(MARK), F.length("s")).alias("end"), "p", "o", "o_kind", "at")
        out.append(_met(shared[1], cut, "part", "doc_id").select("doc_id", F.concat("start", "doc_id", "end").alias("s"), "p", "o", "o_kind", "at"))
    return reduce(DataFrame.unionByName, out)


def turtle(rows: DataFrame, prefix: str) -> DataFrame:
    """One line a triple (K2); an IRI with an angle bracket is an error."""
    bad = F.col("s").rlike("[<>]") | ((F.col("o_kind") == "iri") & F.col("o").rlike("[<>]"))
    quoted = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'))
    o = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).when(F.col("o_kind") == "class", F.concat(F.lit("c:"), "o")).when(F.col("o_kind") == "integer", F.concat(quoted, F.lit("^^xsd:integer"))).otherwise(quoted)
    p = F.when(F.col("p") == "a", F.lit("a")).otherwise(F.concat(F.lit("c:"), "p"))
    line = F.concat(F.lit("<"), "s", F.lit("> "), p, F.lit(" "), o, F.lit(" ."))
    return rows.select("doc_id", "at", F.when(bad, F.raise_error(F.concat(F.lit("angle bracket in "), "s")).cast("string")).otherwise(line).alias("value"))


def top_level_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    rows = nation.select(F.concat(F.lit("urn:nation:"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("name").alias("p"), escaped(F.col("n_name")).alias("o")).unionByName(
        customer.select(F.concat(F.lit("urn:customer:"), F.col("c_custkey").cast("string")).alias("s"), F.inline(F.array(F.struct(F.lit("name").alias("p"), escaped(F.col("c_name")).alias("o")), F.struct(F.lit("memberOf").alias("p"), F.concat(F.lit("urn:nation:"), F.col("c_nationkey").cast("string")).alias("o")))))
    )
    return rows.where("o IS NOT NULL")


QUERIES = {f.__name__: f for f in (top_level_triples,)}
ORACLE_SQL = {
    "top_level_triples": """SELECT 'urn:nation:' || n_nationkey AS s, 'name' AS p, n_name AS o FROM nation UNION ALL SELECT 'urn:customer:' || c_custkey, 'name', c_name FROM customer
        UNION ALL SELECT 'urn:customer:' || c_custkey, 'memberOf', 'urn:nation:' || c_nationkey FROM customer""",
}
