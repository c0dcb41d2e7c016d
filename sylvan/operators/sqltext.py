"""SQL files as trees: statements, bracketed groups and tokens as rows of NODES.

One walk a file, in the task that holds it, as for every other tree: strings, quoted names, dollar quotes and nested
comments are told apart there, which needs the file in order; everything after that is relational. Meaning is not
analysed: expressions stay flat rows of tokens. What a file gets wrong becomes an error node, and the file goes on
with the next statement.

A dialect is a set of token patterns and whether comments nest; ``DIALECTS`` may be given further ones.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .tree import _NAMES, _SCHEMA, NODES, _Rows


@dataclass(frozen=True)
class Dialect:
    """tokens: named patterns, tried in order; nested: whether comments nest."""

    tokens: tuple[tuple[str, str], ...]
    nested: bool

    @cached_property
    def pattern(self) -> re.Pattern:
        return re.compile("|".join(f"(?P<{k}>{p})" for k, p in self.tokens), re.S)


_FIRST = (("space", r"\s+"),)
_THEN = (("line", r"--[^\n]*"), ("block", r"/\*"))
_LAST = (("number", r"\d[\w.]*|\.\d\w*"), ("open", r"\("), ("close", r"\)"), ("end", r";"), ("op", r"."))
# Most tokens are words, so they come early; a letter before a quote is the quote's.
DIALECTS = {
    "postgres": Dialect((*_FIRST, ("word", r"(?!(?:[eEnNbBxX]|[uU]&)['\"])[^\W\d][\w$]*"), *_THEN, ("dollar", r"\$(?:[^\W\d]\w*)?\$"), ("string", r"[eE]'(?:[^'\\]|\\.|'')*+'|(?:[nNbBxX]|[uU]&)?'(?:[^']|'')*+'"), ("name", r'(?:[uU]&)?"(?:[^"]|"")*+"'), ("unclosed", r"(?:[eEnNbBxX]|[uU]&)?['\"].*"), *_LAST), True),
    "sqlite": Dialect((*_FIRST, ("word", r"(?![xX]['\"`\[])[^\W\d][\w$]*"), *_THEN, ("string", r"[xX]?'(?:[^']|'')*+'"), ("name", r'"(?:[^"]|"")*+"|`(?:[^`]|``)*+`|\[[^\]]*\]'), ("unclosed", r"[xX]?['\"`\[].*"), *_LAST), False),
}
#: Words that headers are told by: a quoted name like one of them keeps its quotes.
KEYWORDS = frozenset("as cascade concurrently exists if not on only rename restrict schema set to".split())
#: Words that the name of another object follows.
_BEFORE_NAMES = frozenset(("from", "join", "references", "on"))
#: What may not be whole or not be one match -> the error if it is not closed.
_CUT = {"line": "", "block": "a comment is open", "dollar": "a dollar quote is open", "unclosed": "a quote is open"}
_PLAIN, _DOT = re.compile("[a-z_][a-z0-9_$]*"), re.compile(r" ?\. ?")


def canonical(name: str) -> str:
    """A name as it is written where it needs no quotes, else in quotes: equal for equal objects."""
    return name if _PLAIN.fullmatch(name) and name not in KEYWORDS else '"' + name.replace('"', '""') + '"'


def unquoted(text: str) -> str:
    text = text[2:] if text[:2] in ("U&", "u&") else text
    mark = "]" if text[0] == "[" else text[0]
    return text[1:-1] if mark == "]" else text[1:-1].replace(mark * 2, mark)


def _comment_end(sql: str, at: int, nested: bool) -> int:
    """Where the comment that begins at a place ends, or -1."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(sql, at):
        depth += 1 if m[0] == "/*" and (nested or not depth) else -1 if m[0] == "*/" else 0
        if not depth:
            return m.end()
    return -1


class _File:
    """The nodes of one file in pre-order, a list for each thing noted; other columns are made of these when asked for. A statement has
    its text (comments become a space) as ident, its head as type and the names after from, join, references and on, in JSON,
    as ref_name. Without what is below statements only these and the file are noted, and their ids and sizes mean nothing."""

    def __init__(self, doc_id: str, sql: str, rules: Dialect, below: bool = True):
        self.doc_id, self.sql = doc_id, sql
        self.closed: dict[int, tuple[int, str]] = {}  # statement -> its last place and its names
        self.kind, self.ident, self.type, self.at, self.parent, self.depth = map(list, zip(*self._walk(rules, below)))

    def _walk(self, rules: Dialect, below: bool) -> list[tuple]:
        """kind, ident, type, place, parent, depth of each node."""
        sql = self.sql
        rows: list[tuple] = [("file", "", "", 0, None, 0)]
        texts, head, names = [], [], []
        before = ""  # the last word, or the part of a name that a dot follows
        since = at = 0  # from where the text is not in texts yet
        statement, groups = 0, []  # the statement that is open, or 0, and the groups that are open in it
        up, deep = 0, 1  # the node that is open and the depth below it

        def error(message: str, at: int) -> None:
            if below:
                rows.append(("error", message, "", at, up, deep))
            head.append("<error>")

        def end(at: int) -> None:
            if groups:
                error("a bracket is open", at)
            text = "".join((*texts, sql[since:at])).strip(" \t\n\r\x0b\x0c")
            rows[statement] = ("statement", text, _DOT.sub(".", " ".join(head)), rows[statement][3], 0, 1)
            self.closed[statement] = max(at - 1, 0), json.dumps(names) if names else "[]"

        while at < len(sql):
            for m in rules.pattern.finditer(sql, at):
                kind = m.lastgroup
                if kind == "space":
                    continue
                at = m.start()
                if kind == "end":
                    if statement:
                        end(at)
                    statement, up, deep, before, since = 0, 0, 1, "", m.end()
                    groups.clear(), texts.clear(), head.clear(), names.clear()
                    continue
                plain = kind not in _CUT
                closed = stop = -1  # where to go on, if it is not where the match ends
                if not plain and kind != "unclosed":
                    closed = stop = m.end()
                    if kind == "block":
                        closed = _comment_end(sql, at, rules.nested)
                    elif kind == "dollar":
                        closed = sql.find(m[0], stop)
                        closed = closed if closed < 0 else closed + stop - at
                if not statement and (plain or closed < 0 or kind == "dollar"):
                    statement = up = len(rows)
                    deep = 2
                    rows.append(("statement", "", "", at, 0, 1))
                if plain:
                    text = value = shown = m[0]
                    if kind == "word":
                        value = shown = text.lower()
                        if not value.isascii():
                            shown = canonical(value)
                    elif kind == "close":
                        if not groups:
                            error("a bracket is closed that is not open", at)
                            continue
                        up = groups.pop()
                        deep -= 1
                        continue
                    elif kind == "name":
                        value = unquoted(text)
                        shown = canonical(value)
                else:
                    if closed < 0:
                        error(_CUT[kind], at)
                        closed = m.end() if kind == "unclosed" else len(sql)
                    if kind == "line" or kind == "block":
                        texts += sql[since:at], " "
                        since = closed
                        if closed == stop:
                            continue
                        at = closed
                        break
                    kind, text = "string", sql[at:closed]
                    value = shown = text
                if not groups:
                    head.append("()" if kind == "open" else "''" if kind == "string" else shown)
                if kind == "open":
                    groups.append(up)
                    if below:
                        up = len(rows)
                        rows.append(("group", "", "", at, groups[-1], deep))
                    deep += 1
                elif below:
                    rows.append((kind, value, shown, at, up, deep))
                if kind == "word" or kind == "name":
                    if before in _BEFORE_NAMES and shown not in ("only", "lateral", "select"):
                        names.append(shown)
                        before = "name"
                    elif before == "name." and names:
                        names[-1] += "." + shown
                        before = "name"
                    elif kind == "name":
                        before = ""
                    elif shown != "only" and shown != "lateral":
                        before = shown
                elif before == "name" and text == "." and kind == "op":
                    before = "name."
                else:
                    before = ""
                if closed != stop:
                    at = closed
                    break
            else:
                break
        if statement:
            end(len(sql))
        return rows

    @cached_property
    def ord(self) -> list[int]:
        count, found = [0] * len(self.kind), [0]
        for up in self.parent[1:]:
            found.append(count[up])
            count[up] += 1
        return found

    @cached_property
    def n_children(self) -> list[int]:
        found = [0] * len(self.kind)
        for up in self.parent[1:]:
            found[up] += 1
        return found

    @cached_property
    def size(self) -> list[int]:
        found = [1] * len(self.kind)
        for n in range(len(found) - 1, 0, -1):
            found[self.parent[n]] += found[n]
        return found

    def places(self, name: str) -> list[int | None]:
        """start_line, start_col, end_line or end_col: lines and columns count from 1; the file has none, an end only statements."""
        lines = [m.end() for m in re.finditer("\n", self.sql)]
        ats = [None, *self.at[1:]] if name.startswith("start") else [self.closed[n][0] if n in self.closed else None for n in range(len(self.kind))]
        if name.endswith("line"):
            return [None if at is None else bisect_right(lines, at) + 1 for at in ats]
        starts = [0, *lines]
        return [None if at is None else at - starts[bisect_right(lines, at)] + 1 for at in ats]

    def paths(self) -> list[list[int]]:
        found = [[0]]
        for up, place in zip(self.parent[1:], self.ord[1:]):
            found.append([*found[up], place])
        return found

    def shapes(self) -> list[int]:
        found = [0] * len(self.kind)
        children = [[] for _ in self.kind]
        for n, up in enumerate(self.parent[1:], 1):
            children[up].append(n)
        for n in range(len(self.kind) - 1, -1, -1):
            found[n] = _Rows._shape(self.kind[n], b"".join(found[c].to_bytes(8, "little", signed=True) for c in children[n]))
        return found

    def column(self, name: str) -> list:
        count = len(self.kind)
        if name in ("kind", "ident", "type", "parent", "ord", "depth", "size", "n_children"):
            return getattr(self, name)
        if name in ("start_line", "start_col", "end_line", "end_col"):
            return self.places(name)
        made = {
            "doc_id": lambda: [self.doc_id] * count, "node_id": lambda: list(range(count)), "path": self.paths, "shape": self.shapes, "start_offset": lambda: [None, *self.at[1:]],
            "ref_name": lambda: [self.closed[n][1] if n in self.closed else None for n in range(count)], "implicit": lambda: [False] * count,
        }
        return made[name]() if name in made else [None] * count


def sql_nodes(sources: DataFrame, kind: str | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """NODES of sources (path, sql, dialect), doc_id being the path, with dialect: one walk a file, by the rules of its dialect.
    Sources of another dialect give no rows. With a kind only nodes of that kind leave the walk, with columns only these and dialect,
    and what is not asked for is not made. One file at a time is held as lists; small ones leave together."""
    ship(sources.sparkSession)
    dialects, asked = dict(DIALECTS), tuple(columns or _NAMES)
    below = kind != "statement" or bool({"node_id", "size", "n_children", "shape"}.intersection(asked))
    types = {c.split()[0]: c.split()[1] for c in NODES.split(", ")}
    schema = pa.schema([*(_SCHEMA.field(c) for c in asked), ("dialect", pa.string())])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in schema]

        def batches_of(most: int) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(held[0]), most):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + most], t) for c, t in zip(held, schema.types)], schema=schema)
            for c in held:
                c.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, sql, dialect = (batch.column(c)[i].as_py() for c in range(3))
                file = _File(doc_id, sql or "", dialects[dialect], below)
                chosen = None if kind is None else [n for n, k in enumerate(file.kind) if k == kind]
                for c, name in zip(held, asked):
                    values = file.column(name)
                    c += values if chosen is None else [values[n] for n in chosen]
                held[-1] += [dialect] * (len(file.kind) if chosen is None else len(chosen))
                if len(held[-1]) >= 5_000:
                    yield from batches_of(20_000)
        yield from batches_of(20_000)

    known = sources.where(F.col("dialect").isin(*dialects)).select(F.col("path").cast("string").alias("doc_id"), "sql", "dialect")
    return known.mapInArrow(nodes, ", ".join([*(f"{c} {types[c]}" for c in asked), "dialect string"]))


def diagnostics(nodes: DataFrame) -> DataFrame:
    """path, line, col, message of what files get wrong."""
    return nodes.where("kind = 'error'").select(F.col("doc_id").alias("path"), F.col("start_line").alias("line"), F.col("start_col").alias("col"), F.col("ident").alias("message"))
