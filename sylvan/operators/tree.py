"""The node table of any tree, and queries over it.

Every tree source (compiler JSON, page markup) becomes rows of NODES. One walk per document, in the task
that holds it, gives the pre-order id, parent, ordinal, depth and subtree size; with these the
relational queries need no recursion: a subtree is the id range [node_id, node_id + size), children
share a parent, siblings follow by ordinal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..session import ship
from ..work import written

#: ref_id, ref_kind and ref_name: what a reference node refers to; id: the source's own node id. shape: 64 bits of the kinds and the
#: order of all nodes from here down, equal for subtrees of one structure. Compiler trees also have the scopes around a
#: node: the file's own function it is in (top_fn), the statement it is in (stmt, with its place; in_body: a block right in a
#: declaration of the file), and whether it is in the callee of a call; a call that is not has what it refers to first,
#: down its first children, as to_*. A statement of a function has its own place, a parameter its index.
NODES = (
    "doc_id string, node_id long, parent long, ord long, depth long, size long, n_children long, path array<int>, kind string, ident string, type string, "
    "start_line long, start_col long, end_line long, end_col long, start_offset long, id string, ref_id string, ref_kind string, ref_name string, tag string, implicit boolean, "
    "shape long, stmt long, stmt_place string, place string, top_fn string, param long, in_body boolean, in_callee boolean, to_id string, to_kind string, to_name string"
)
_NAMES = [c.split()[0] for c in NODES.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_SCHEMA = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in NODES.split(", ")])
_EMPTY = dict.fromkeys(_NAMES) | {"n_children": 0, "size": 1, "implicit": False}
#: The columns that queries over functions' structures read, and their rows' kind.
STRUCTURE = ("doc_id", "node_id", "kind", "ident", "size", "shape")
FUNCTIONS = ("FunctionDecl",)
ROOT = ""
#: The columns that only the scopes around a node give.
SCOPES = ("stmt", "stmt_place", "place", "top_fn", "param", "in_body", "in_callee", "to_id", "to_kind", "to_name")
#: Kinds of declarations that documents may share.
SHARED = ("EnumDecl", "RecordDecl", "TypedefDecl", "VarDecl")
#: Statement kinds with a node of their own.
STATEMENTS = (
    "BreakStmt", "CaseStmt", "CompoundStmt", "ContinueStmt", "DeclStmt", "DefaultStmt", "DoStmt", "ForStmt",
    "GotoStmt", "IfStmt", "LabelStmt", "NullStmt", "ReturnStmt", "SwitchStmt", "WhileStmt",
)
_STATEMENTS = frozenset(STATEMENTS)
#: Elements without an end tag; elements that pages often leave open.
LEAF_TAGS = ("br", "hr", "img", "input", "link", "meta")
LOOSE_TAGS = ("b", "p")
_SKIPPED = re.compile(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<![dD][^>]*>")
_TAG = re.compile(r"<(/?[a-zA-Z][a-zA-Z0-9]*)")


class _Rows:
    """Rows of one document in pre-order; close() fills in what is known when a node ends. before: so many nodes that stand
    between the root and the rest are not among the rows, but count."""

    def __init__(self, doc_id: str, before: int = 0):
        self.doc_id, self.rows, self.open, self.tops, self.shapes = doc_id, [], [], 0, [bytearray()]
        self.before = before
        self.leaves: dict[str, int] = {}

    def node(self, **values) -> dict:
        up = self.open[-1] if self.open else None
        row = _EMPTY.copy()
        row.update(values)
        row["doc_id"], row["node_id"], row["depth"] = self.doc_id, len(self.rows) + self.before if self.rows else 0, len(self.open)
        if up:
            row["parent"], row["ord"] = up["node_id"], up["n_children"]
            row["path"] = [*up["path"], row["ord"]]
            up["n_children"] += 1
        else:
            row["ord"] = self.tops
            row["path"] = [self.tops]
            if not self.rows:
                row["n_children"] = self.before
            self.tops += 1
        shape = self.leaves.get(row["kind"])
        if shape is None:
            shape = self.leaves[row["kind"]] = self._shape(row["kind"], b"")
        row["shape"] = shape
        self.rows.append(row)
        self.shapes[-1] += shape.to_bytes(8, "little", signed=True)
        return row

    @staticmethod
    def _shape(kind: str, below: bytes) -> int:
        return int.from_bytes(blake2b(kind.encode("utf-8", "surrogatepass") + b"\0" + below, digest_size=8).digest(), "little", signed=True)

    def enter(self, **values) -> dict:
        self.open.append(self.node(**values))
        self.shapes.append(bytearray())
        return self.open[-1]

    def leave(self) -> None:
        row, below = self.open.pop(), self.shapes.pop()
        row["size"] = len(self.rows) + self.before - row["node_id"]
        if below:
            row["shape"] = self._shape(row["kind"], below)
            self.shapes[-1][-8:] = row["shape"].to_bytes(8, "little", signed=True)


def page_rows(doc_id: str, html: str | None) -> list[dict]:
    """Elements of a page. An end tag ends the innermost open element that isn't loose, whichever it names, and the loose
    ones in it. Among the loose ones right at the end, an end tag ends those up to its own, if there is one, and a
    paragraph's start ends an open paragraph."""
    out = _Rows(doc_id)

    def leave_loose(name: str | None) -> None:
        run = 0
        while run < len(out.open) and out.open[-1 - run]["kind"] in LOOSE_TAGS:
            run += 1
            if out.open[-run]["kind"] == name:
                break
        if name is None or run and out.open[-run]["kind"] == name:
            for _ in range(run):
                out.leave()

    for tag in _TAG.findall(_SKIPPED.sub("", html or "")):
        name = tag.lower().lstrip("/")
        if name in LOOSE_TAGS:
            if tag[0] == "/" or name == "p":
                leave_loose(name)
            if tag[0] != "/":
                out.enter(kind=name, ident="", type="")
        elif name in LEAF_TAGS:
            if tag[0] != "/":
                out.node(kind=name, ident="", type="")
        elif tag[0] != "/":
            out.enter(kind=name, ident="", type="")
        else:
            leave_loose(None)
            if out.open:
                out.leave()
    while out.open:
        out.leave()
    return out.rows


def _map(value) -> dict:
    return value if isinstance(value, dict) else {}


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value)


class _Scopes:
    """The scopes of a compiler tree's nodes, from those of the node above."""

    def __init__(self):
        self.calls: list[dict | None] = [None]  # for each open node the call whose target its first children lead to
        self.params = [0]  # and its parameters so far
        self.placeless = 0

    def enter(self, row: dict, up: dict | None) -> None:
        if up is not None:
            kind, above = row["kind"], up["kind"]
            if above in _STATEMENTS:
                row["stmt"], row["stmt_place"], row["in_body"] = up["node_id"], up["place"], up["depth"] == 2 and above == "CompoundStmt"
            else:
                row["stmt"], row["stmt_place"], row["in_body"] = up["stmt"], up["stmt_place"], up["in_body"]
            row["in_callee"] = bool(up["in_callee"]) or (above == "CallExpr" and row["ord"] == 0)
            row["top_fn"] = up["top_fn"] if up["depth"] else row["ident"] or None if kind == "FunctionDecl" and not row["implicit"] else None
            if row["top_fn"] is not None:
                if kind in _STATEMENTS:
                    row["place"] = self.place(row)
                elif kind == "ParmVarDecl" and row["depth"] == 2:
                    row["param"] = self.params[-1]
                    self.params[-1] += 1
        self.calls.append(self.first_call(row, up))
        self.params.append(0)

    def leave(self) -> None:
        self.calls.pop()
        self.params.pop()

    def place(self, row: dict) -> str:
        """The span of a statement, or its number among those without one."""
        if row["start_line"] is None or row["start_col"] is None:
            self.placeless += 1
            return f"node-{self.placeless}:{row['kind']}"
        end = row["start_line"] if row["end_line"] is None else row["end_line"]
        return f"L{row['start_line']}C{row['start_col']}-L{end}C{row['end_col']}:{row['kind']}"

    def first_call(self, row: dict, up: dict | None) -> dict | None:
        """The call whose target may be at or below a node: one whose first children alone lead there. The target is noted in its row."""
        call = self.calls[-1]
        if up is None or row["ord"]:
            call = None
        elif up["kind"] == "CallExpr" and not up["in_callee"]:
            call = up
        if call is not None and call["to_id"] is None and row["kind"] == "DeclRefExpr" and row["ref_id"] is not None:
            call.update(to_id=row["ref_id"], to_kind=row["ref_kind"], to_name=row["ref_name"])
        return call


def ast_rows(doc_id: str, source: str | None, prune: bool = True, before: int = 0) -> list[dict] | None:
    """Nodes of a compiler's JSON document; None if it can't be read. A node is from a header if either place says so (F1), and with
    it implicit, as one made by the compiler is. With prune a node from a header or made
    by the compiler goes with its whole subtree, and ordinals count what stays. So many shared nodes (shared_nodes) stand before the
    document's own; the root has no shape then."""
    try:
        root = json.loads(source or "")
    except ValueError:
        return None
    if not isinstance(root, dict):
        return None
    out = _Rows(doc_id, before)
    scopes = _Scopes()
    steps: list[tuple[bool, dict | None]] = [(True, root)]
    while steps:  # an explicit stack: documents may be deeper than Python's own
        entering, node = steps.pop()
        if not entering:
            out.leave()
            scopes.leave()
            continue
        span = _map(node.get("range"))
        begin = _map(span.get("begin"))
        implicit = bool(_map(node.get("loc")).get("includedFrom") or begin.get("includedFrom") or node.get("isImplicit"))
        if prune and implicit:
            continue
        end, ref = _map(span.get("end")), _map(node.get("referencedDecl"))
        up = out.open[-1] if out.open else None
        row = out.enter(
            kind=_text(node.get("kind")) or "<unknown>", ident=_text(node.get("name")) or _text(ref.get("name")) or "", type=_text(_map(node.get("type")).get("qualType")) or "",
            start_line=begin.get("line"), start_col=begin.get("col"), end_line=end.get("line"), end_col=end.get("col"), start_offset=begin.get("offset"),
            id=_text(node.get("id")), ref_id=_text(ref.get("id")), ref_kind=_text(ref.get("kind")), ref_name=_text(ref.get("name")), tag=_text(node.get("tagUsed")), implicit=implicit,
        )
        scopes.enter(row, up)
        steps.append((False, None))
        inner = node.get("inner")
        steps += [(True, child) for child in reversed(inner if isinstance(inner, list) else []) if isinstance(child, dict)]
    if before and out.rows:
        out.rows[0]["shape"] = None
    return out.rows


_NO_SCOPES = dict.fromkeys(SCOPES)
_NOTHING: dict = {}
#: Digests of small structures by kind and children, as most recur; cleared when full.
_digests: dict[tuple[str, bytes], bytes] = {}


def _digest(kind: str, below: bytes) -> bytes:
    found = _digests.get((kind, below))
    if found is None:
        found = blake2b(kind.encode("utf-8", "surrogatepass") + b"\0" + below, digest_size=8).digest()
        if len(below) <= 64:
            if len(_digests) >= 50_000:
                _digests.clear()
            _digests[kind, below] = found
    return found


def asked_rows(doc_id: str, source: str | None, prune: bool, before: int, columns: tuple[str, ...], kinds: tuple[str, ...] = ()) -> list[dict]:
    """What ast_rows gives, but only nodes of these kinds (ROOT: the root, whatever its kind), if any, and at least these columns but path, which
    isn't found here. One loop: only what is asked for is found."""
    try:
        root = json.loads(source or "")
    except ValueError:
        return []
    if not isinstance(root, dict):
        return []
    shaped, typed, called = "shape" in columns, "type" in columns, "in_callee" in columns
    referred = any(c in columns for c in ("ref_id", "ref_kind", "ref_name"))
    scopes = _Scopes() if any(c in columns for c in SCOPES if c != "in_callee") else None
    placed = scopes is not None or any(c in columns for c in ("start_line", "start_col", "end_line", "end_col", "start_offset"))
    kept, n = [], 0
    todo, up, below, call, stack = iter((root,)), None, bytearray(), None, []
    while True:
        node = next(todo, None)
        if node is None:
            if up is None:
                break
            up["size"] = n - up["node_id"]
            if shaped:
                digest = _digest(up["kind"], bytes(below))
                up["shape"] = int.from_bytes(digest, "little", signed=True)
            todo, up, below, call = stack.pop()
            if shaped:
                below += digest
            continue
        get = node.get
        span = _map(get("range")) if "range" in node else _NOTHING
        begin = _map(span.get("begin")) if span else _NOTHING
        implicit = bool(("loc" in node and _map(get("loc")).get("includedFrom")) or begin.get("includedFrom") or get("isImplicit"))
        if prune and implicit:
            continue
        ref = _map(get("referencedDecl")) if "referencedDecl" in node else _NOTHING
        kind = _text(get("kind")) or "<unknown>"
        row = {
            "doc_id": doc_id, "node_id": n, "depth": len(stack), "kind": kind, "ident": _text(get("name")) or _text(ref.get("name")) or "", "size": 1, "n_children": 0, "implicit": implicit,
            "id": _text(get("id")), "tag": _text(get("tagUsed")), "ord": 0,
        }
        if typed:
            row["type"] = _text(_map(get("type")).get("qualType")) or ""
        if placed:
            end = _map(span.get("end"))
            row["start_line"], row["start_col"], row["end_line"], row["end_col"], row["start_offset"] = begin.get("line"), begin.get("col"), end.get("line"), end.get("col"), begin.get("offset")
        if scopes or referred:
            row["ref_id"], row["ref_kind"], row["ref_name"] = _text(ref.get("id")), _text(ref.get("kind")), _text(ref.get("name"))
        if up is not None:
            row["parent"], row["ord"] = up["node_id"], up["n_children"]
            up["n_children"] += 1
        else:
            row["n_children"] = before
        first = None
        if up is None:
            row.update(_NO_SCOPES)
        elif scopes:  # as _Scopes.enter; what is not set is null
            above = up["kind"]
            if above in _STATEMENTS:
                row["stmt"], row["stmt_place"], row["in_body"] = up["node_id"], up["place"], up["depth"] == 2 and above == "CompoundStmt"
            else:
                row["stmt"], row["stmt_place"], row["in_body"] = up["stmt"], up["stmt_place"], up["in_body"]
            within = bool(up["in_callee"])
            row["in_callee"] = within or (above == "CallExpr" and row["ord"] == 0)
            top = row["top_fn"] = up["top_fn"] if up["depth"] else row["ident"] or None if kind == "FunctionDecl" and not implicit else None
            if kind in _STATEMENTS:
                row["place"] = None if top is None else scopes.place(row)
            elif kind == "CallExpr":
                row["to_id"] = None
            elif kind == "ParmVarDecl" and row["depth"] == 2 and top is not None:
                row["param"] = up["params"] = up.get("params", -1) + 1
            if row["ord"] == 0:
                first = up if above == "CallExpr" and not within else call
                if first is not None and first["to_id"] is None and kind == "DeclRefExpr" and row["ref_id"] is not None:
                    first.update(to_id=row["ref_id"], to_kind=row["ref_kind"], to_name=row["ref_name"])
        elif called:
            row["in_callee"] = bool(up["in_callee"]) or (up["kind"] == "CallExpr" and row["ord"] == 0)
        if not kinds or kind in kinds or (up is None and ROOT in kinds):
            kept.append(row)
        n += 1 if n else 1 + before
        inner = get("inner")
        inner = [x for x in inner if isinstance(x, dict)] if isinstance(inner, list) else None
        if inner or up is None:
            stack.append((todo, up, below, call))
            todo, up, below, call = iter(inner or ()), row, bytearray(), first
            continue
        if shaped:
            digest = _digest(kind, b"")
            row["shape"] = int.from_bytes(digest, "little", signed=True)
            below += digest
    if before and kept and kept[0]["node_id"] == 0:
        kept[0]["shape"] = None
    return kept


def walk(docs: DataFrame, rows_of: Callable[..., list[dict] | None], columns: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> DataFrame:
    """NODES of docs (doc_id, source): one walk a document; a document that can't be read gives no rows. One document at a
    time is held as rows; Arrow batches end at a number of bytes, which Spark sets, and come out in column form. With columns or
    kinds only these columns, or nodes of these kinds, leave the walk, which is over whole documents still. Where docs have a column before,
    it is given to rows_of too."""
    ship(docs.sparkSession)
    schema = pa.schema([_SCHEMA.field(c) for c in columns or _NAMES])
    declared = ", ".join(c for c in NODES.split(", ") if c.split()[0] in (columns or _NAMES))
    if columns:
        declared = ", ".join(sorted(declared.split(", "), key=lambda c: columns.index(c.split()[0])))

    given = ["before"] if "before" in docs.columns else []

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = rows_of(*(batch.column(c)[i].as_py() for c in range(batch.num_columns))) or []
                if kinds:
                    rows = [r for r in rows if r["kind"] in kinds or (r["node_id"] == 0 and ROOT in kinds)]
                for lo in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 20_000], schema=schema)

    return docs.select(F.col("doc_id").cast("string"), "source", *given).mapInArrow(nodes, declared)


def ast_nodes(docs: DataFrame, prune: bool = True, columns: tuple[str, ...] = (), kinds: tuple[str, ...] = ()) -> DataFrame:
    """With columns or kinds only these columns, or nodes of these kinds (ROOT: the root, whatever its kind)."""
    if not columns or "path" in columns:
        return walk(docs, lambda d, s, before=0: ast_rows(d, s, prune, before), columns, kinds)
    return walk(docs, lambda d, s, before=0: asked_rows(d, s, prune, before, columns, kinds), columns, kinds)


def shared_nodes(shared: DataFrame, prune: bool = True) -> DataFrame:
    """NODES of declarations that many documents share (part, source): they are walked once a part, and part stands for doc_id. A
    source is a unit with only such declarations right below its root, which is left out; they stand before a
    document's own. They must be leaves and no functions, so that no scope, place or reference is theirs; others are an error."""
    found = ast_nodes(shared.select(F.col("part").alias("doc_id"), "source"), prune)
    leaf = (F.col("depth") == 1) & (F.col("n_children") == 0) & F.col("kind").isin(*SHARED)
    root = (F.col("depth") == 0) & (F.col("kind") == "TranslationUnitDecl")
    return found.where(F.when(leaf, True).when(root, False).otherwise(F.raise_error(F.concat(F.lit("can't be shared: "), "kind")).cast("boolean")))


def after_shared(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """docs (doc_id, source, part) with the number of nodes that shared_nodes gives their part, for ast_nodes; one row a part is broadcast."""
    counted = shared.groupBy(F.col("doc_id").alias("part")).agg(F.count("*").alias("before"))
    return docs.join(F.broadcast(counted), "part", "left").select("doc_id", "source", F.coalesce("before", F.lit(0)).alias("before"))


def page_nodes(pages: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """NODES of pages, with page_id as a number; with columns only these and page_id leave the walk."""
    return walk(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("source")), page_rows, ("doc_id", *columns) if columns else ()).withColumn("page_id", F.col("doc_id").cast("long")).drop("doc_id")


def links(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """next_sibling and first_child of every node (W2); null where there is none."""
    sibling = F.lead("node_id").over(Window.partitionBy(doc, "parent").orderBy("ord"))
    return nodes.withColumn("next_sibling", F.when(F.col("parent").isNotNull(), sibling)).withColumn("first_child", F.when(F.col("n_children") > 0, F.col("node_id") + 1))


def children(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each parent with its children by ordinal."""
    return nodes.where("parent is not null").select(doc, F.col("parent").alias("node_id"), "ord", F.col("node_id").alias("child"), F.col("kind").alias("child_kind"))


def find_function(nodes: DataFrame, name: str) -> DataFrame:
    """The first function declaration of that name (J8): by document, then node; both absences are errors."""
    known = nodes.agg(F.max((F.col("ident") == name).cast("int")).alias("known"), F.min(F.when((F.col("kind") == "FunctionDecl") & (F.col("ident") == name), F.struct("doc_id", "node_id"))).alias("at"))
    return known.select(
        F.when(F.coalesce("known", F.lit(0)) == 0, F.raise_error(F.lit(f"no identifier {name}")).cast("struct<doc_id:string,node_id:long>")).when(F.col("at").isNull(), F.raise_error(F.lit(f"{name} is no function")).cast("struct<doc_id:string,node_id:long>")).otherwise(F.col("at")).alias("at")
    ).select("at.*")


def fold_up(nodes: DataFrame, value: Callable[[Column], Column], doc: str = "doc_id") -> DataFrame:
    """doc, node_id, value of the nodes without a parent (U3, U4): a node's value is made of its own columns and of its children's values,
    an array in their order, empty for a leaf. Levels are folded deepest first, each written; a round reads two levels."""
    height = nodes.agg(F.max("depth")).head()[0]
    below, kept = None, nodes.columns
    for depth in range(-1 if height is None else height, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            kind = level.select(value(F.array()).alias("v")).schema["v"].dataType
            empty = F.array().cast(ArrayType(kind))
            level = level.withColumn("_values", empty)
        else:
            met = below.groupBy(doc, F.col("parent").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("_values"))
            level = level.join(met, [doc, "node_id"], "left").select(*kept, F.coalesce("_values", empty).alias("_values"))
        below = written(level.select(doc, "node_id", "parent", "ord", value(F.col("_values")).alias("value")), "fold")
    return nodes.limit(0).select(doc, "node_id", value(F.array()).alias("value")) if below is None else below.select(doc, "node_id", "value")


def render(nodes: DataFrame, templates: dict[str, tuple[str, str, str]], default: tuple[str, str, str], doc: str = "doc_id") -> DataFrame:
    """doc, node_id, value: the text of each tree, by a table of what stands before, between and after the children of a kind; {} in the first is
    the node's identifier, or its kind where it has none."""
    table = nodes.sparkSession.createDataFrame([(k, *v) for k, v in templates.items()], "kind string, _before string, _between string, _after string")
    found = nodes.join(table, "kind", "left")
    part = lambda c, i: F.coalesce(F.col(c), F.lit(default[i]))
    name = F.coalesce(F.nullif(F.col("ident"), F.lit("")), F.col("kind"))
    between = lambda x, i: F.when(i == 0, x).otherwise(F.concat(part("_between", 1), x))

    def text(values: Column) -> Column:
        return F.concat(F.replace(part("_before", 0), F.lit("{}"), name), F.array_join(F.transform(values.cast("array<string>"), between), ""), part("_after", 2))

    return fold_up(found, text, doc)


def function_classes(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, ident, size, class_doc, class_fn, n of every named function: the first function, by document and node, of
    all with its structure, and how many there are (K13, J8). Structures meet by the walk's hash of all kinds below."""
    own = nodes.where("kind = 'FunctionDecl' AND ident <> ''").select("doc_id", "node_id", "ident", "size", "shape")
    found = own.groupBy("shape", "size").agg(F.min(F.struct("doc_id", "node_id", "ident")).alias("first"), F.count("*").alias("n"))
    return own.join(found.hint("merge"), ["shape", "size"]).select("doc_id", "node_id", "ident", "size", F.col("first.doc_id").alias("class_doc"), F.col("first.ident").alias("class_fn"), "n")


def structure_suite(left: DataFrame, right: DataFrame, wanted: DataFrame, same: Callable[[Column, Column], Column] = lambda a, b: (a["shape"] == b["shape"]) & (a["size"] == b["size"])) -> DataFrame:
    """name, passed, reason for each name wanted (K13): whether the first function of that name, by document and node, has one structure
    on both sides. same is the strategy (U6): of two structs (doc_id, node_id, shape, size) whether they pass."""
    names = wanted.select("name").distinct()
    first = lambda nodes, side: nodes.where("kind = 'FunctionDecl'").join(names.hint("merge"), F.col("ident") == F.col("name")).groupBy("name").agg(F.min(F.struct("doc_id", "node_id", "shape", "size")).alias(side))
    both = names.join(first(left, "l").hint("merge"), "name", "left").join(first(right, "r").hint("merge"), "name", "left")
    reason = F.when(F.col("l").isNull(), "missing on the left").when(F.col("r").isNull(), "missing on the right").when(~same(F.col("l"), F.col("r")), "structures differ")
    return both.select("name", reason.isNull().alias("passed"), reason.alias("reason"))


def subtree(nodes: DataFrame, roots: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Every node below or at each root (R4): an equi-join on the document and an id range, by key at every size."""
    r = roots.select(F.col(doc).alias("d"), F.col("node_id").alias("root"), F.col("size").alias("root_size"))
    return nodes.join(r.hint("merge"), (F.col(doc) == F.col("d")) & (F.col("node_id") >= F.col("root")) & (F.col("node_id") < F.col("root") + F.col("root_size"))).drop("d", "root_size")


def subtree_leaves(nodes: DataFrame, roots: DataFrame, doc: str = "doc_id", value: str = "ident") -> DataFrame:
    """Distinct values below each root with the id where each first stands (R4); empty ones don't count."""
    return subtree(nodes, roots, doc).where(F.col(value) != "").groupBy(doc, "root", value).agg(F.min("node_id").alias("first"))


def subtree_summary(nodes: DataFrame, roots: DataFrame, doc: str = "doc_id", most: int = 16) -> DataFrame:
    """The first labels below each root in pre-order, with an ellipsis if there are more (O4, P26). Node ids
    are dense, so the limit is an id range and no sort of whole subtrees."""
    near = subtree(nodes, roots.withColumn("size", F.least("size", F.lit(most))), doc)
    label = F.when(F.col("ident") != "", F.concat("kind", F.lit("("), "ident", F.lit(")"))).otherwise(F.col("kind"))
    found = near.groupBy(doc, "root").agg(F.sort_array(F.collect_list(F.struct("node_id", label.alias("label")))).alias("l"))
    total = roots.select(doc, F.col("node_id").alias("root"), F.col("size").alias("total"))
    return found.join(total.hint("merge"), [doc, "root"]).select(doc, "root", F.concat(F.array_join(F.col("l.label"), " > "), F.when(F.col("total") > most, " > ...").otherwise("")).alias("summary"))


def node_export(nodes: DataFrame) -> DataFrame:
    """The stored form of P3: -1 for no link, 0 for an unknown place, depth and columns at their caps, end line from start line."""
    line = lambda c: F.nullif(F.col(c), F.lit(0))
    return links(nodes).select(
        "doc_id", "node_id", "kind", "ident", "type",
        *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("parent", "first_child", "next_sibling")),
        F.least("depth", F.lit(255)).cast("short").alias("depth"),
        F.coalesce("start_line", F.lit(0)).alias("start_line"), F.coalesce(line("end_line"), line("start_line"), F.lit(0)).alias("end_line"),
        *(F.least(F.coalesce(c, F.lit(0)), F.lit(65535)).cast("int").alias(c) for c in ("start_col", "end_col")),
    )


# --- queries ---------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")


def _page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What subtrees are told by, written: it is read on both sides of a join."""
    return written(page_nodes(_pages(spark, sf_dir)).select("page_id", "node_id", "depth", "size", "kind", "ident"), "pages")


def tag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep each page's elements are, and how many there are of each depth at most."""
    nodes = page_nodes(_pages(spark, sf_dir))
    return nodes.groupBy("page_id").agg(F.max("depth").alias("max_depth"), F.sum("depth").alias("depths"), F.count("*").alias("n_nodes"), F.sum("n_children").alias("n_children"))


def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(page_nodes(_pages(spark, sf_dir)), "page_id").select("page_id", "node_id", "kind", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), F.coalesce("next_sibling", F.lit(-1)).alias("next_sibling"))


def leaves_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _page_table(spark, sf_dir)
    found = subtree_leaves(nodes, nodes.where("depth = 1"), "page_id", "kind")
    return found.select("page_id", "root", "kind", F.col("first").alias("first_node"))


def summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _page_table(spark, sf_dir)
    return subtree_summary(nodes, nodes.where("depth <= 1"), "page_id")


# Elements as intervals of tag places: structural ones by a running depth, paragraphs and bold text by what ends them.
_NODES = r"""
t AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<![dD][^>]*>', '', 'g'), '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1) AS ts FROM pages),
u AS (SELECT page_id, lower(unnest(ts)) AS t, generate_subscripts(ts, 1) AS pos FROM t),
k AS (SELECT *, ltrim(t, '/') AS kind, CASE WHEN ltrim(t, '/') IN ('br','hr','img','input','link','meta') THEN 0 WHEN t LIKE '/%' THEN -1 ELSE 1 END AS step FROM u),
s AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS after FROM k WHERE kind NOT IN ('b', 'p')),
iv AS (SELECT page_id, pos, kind, coalesce((SELECT min(x.pos) FROM s x WHERE x.page_id = a.page_id AND x.pos > a.pos AND x.after < a.after), 1000000000) AS e FROM s a WHERE step = 1),
l0 AS (SELECT *, coalesce((SELECT max(x.pos) FROM iv x WHERE x.page_id = l.page_id AND x.pos < l.pos AND x.e > l.pos), -1) AS encl FROM k l WHERE kind IN ('b', 'p')),
l1 AS (SELECT l0.*, coalesce(iv.e, 1000000000) AS outer_e FROM l0 LEFT JOIN iv ON iv.page_id = l0.page_id AND iv.pos = encl),
p AS (SELECT page_id, pos, kind, encl, least(outer_e, coalesce((SELECT min(x.pos) FROM l0 x WHERE x.page_id = l.page_id AND x.encl = l.encl AND x.pos > l.pos AND x.kind = 'p'), 1000000000)) AS e FROM l1 l WHERE t = 'p'),
b AS (SELECT page_id, pos, kind, least(outer_e, coalesce((SELECT min(x.pos) FROM l0 x WHERE x.page_id = l.page_id AND x.encl = l.encl AND x.pos > l.pos AND x.t = '/b'), 1000000000),
        coalesce((SELECT max(p.e) FROM p WHERE p.page_id = l.page_id AND p.encl = l.encl AND p.pos < l.pos AND p.e > l.pos), 1000000000)) AS e FROM l1 l WHERE t = 'b'),
n0 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS node_id FROM (SELECT page_id, pos, kind, e FROM iv UNION ALL SELECT page_id, pos, kind, e FROM p UNION ALL SELECT page_id, pos, kind, e FROM b
        UNION ALL SELECT page_id, pos, kind, pos FROM k WHERE step = 0 AND t NOT LIKE '/%')),
n1 AS (SELECT a.*, (SELECT max(x.node_id) FROM n0 x WHERE x.page_id = a.page_id AND x.pos < a.pos AND x.e > a.pos) AS parent, (SELECT count(*) FROM n0 x WHERE x.page_id = a.page_id AND x.pos < a.pos AND x.e > a.pos) AS depth,
        1 + (SELECT count(*) FROM n0 x WHERE x.page_id = a.page_id AND x.pos > a.pos AND x.pos < a.e) AS size FROM n0 a),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, parent ORDER BY node_id) - 1 AS ord, count(*) FILTER (WHERE parent IS NOT NULL) OVER (PARTITION BY page_id, parent) AS siblings FROM n1)"""
QUERIES = {"tag_depth": tag_depth, "tree_links": tree_links, "subtree_leaves": leaves_query, "subtree_summary": summary_query}
ORACLE_SQL = {
    "tag_depth": f"WITH {_NODES} SELECT page_id, max(depth)::BIGINT AS max_depth, sum(depth)::BIGINT AS depths, count(*) AS n_nodes, count(parent) AS n_children FROM n GROUP BY page_id",
    "tree_links": f"""WITH {_NODES} SELECT page_id, node_id::BIGINT AS node_id, kind, depth::BIGINT AS depth, coalesce(parent, -1)::BIGINT AS parent,
        coalesce(CASE WHEN parent IS NOT NULL THEN lead(node_id) OVER (PARTITION BY page_id, parent ORDER BY node_id) END, -1)::BIGINT AS next_sibling FROM n""",
    "subtree_leaves": f"WITH {_NODES} SELECT a.page_id, a.node_id::BIGINT AS root, b.kind, min(b.node_id)::BIGINT AS first_node FROM n a JOIN n b ON a.page_id = b.page_id AND b.node_id >= a.node_id AND b.node_id < a.node_id + a.size WHERE a.depth = 1 GROUP BY 1, 2, 3",
    "subtree_summary": f"""WITH {_NODES} SELECT a.page_id, a.node_id::BIGINT AS root, string_agg(b.kind, ' > ' ORDER BY b.node_id) || CASE WHEN any_value(a.size) > 16 THEN ' > ...' ELSE '' END AS summary
        FROM n a JOIN n b ON a.page_id = b.page_id AND b.node_id >= a.node_id AND b.node_id < a.node_id + least(a.size, 16) WHERE a.depth <= 1 GROUP BY 1, 2""",
}
