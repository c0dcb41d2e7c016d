"""Protobuf messages as trees and back (S19, U8, U9), by a schema that is a parameter.

A message becomes rows of NODES: a node for each field in its order, kind being its type, type its name and ident a
scalar's text; a nested message has its fields below. What the schema doesn't know stays, as its bytes, and what can't be
read is an error node with the rest of its message. The way back is a fold from the leaves: a node's bytes are its tag
and length and the bytes of its children.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tree import _Rows, fold_up, walk

#: Message -> field number -> (name, type); a type that is no key and none of these is an enumeration, which is a number.
SCALARS = ("bool", "bytes", "double", "fixed32", "fixed64", "float", "int32", "int64", "sint32", "sint64", "string", "uint32", "uint64")
#: Messages in messages; what is deeper stays as bytes.
DEEPEST = 100
Schema = dict[str, dict[int, tuple[str, str]]]
#: The messages of a package manifest.
MANIFEST: Schema = {
    "Manifest": {1: ("identity", "Identity"), 2: ("units", "Unit"), 3: ("deps", "string")},
    "Identity": {1: ("name", "string"), 2: ("version", "string"), 3: ("revision", "string")},
    "Unit": {2: ("renders", "Render")},
    "Render": {1: ("language", "Language"), 2: ("out_path", "string"), 3: ("source", "string")},
}


def _varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    value = shift = 0
    while at < end and shift < 70:
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return value & (1 << 64) - 1, at
    raise ValueError("a number is cut off")


def _scalar(kind: str, wire: int, value: int | bytes) -> str:
    """A scalar's text; ValueError if its wire type is another."""
    if kind in ("string", "bytes"):
        if wire != 2:
            raise ValueError("wire type")
        return value.decode("utf-8") if kind == "string" else value.hex()
    if kind in ("double", "float", "fixed32", "fixed64"):
        if wire != (5 if kind in ("float", "fixed32") else 1):
            raise ValueError("wire type")
        return str(struct.unpack({"double": "<d", "float": "<f", "fixed32": "<I", "fixed64": "<Q"}[kind], value)[0])
    if wire:
        raise ValueError("wire type")
    if kind in ("sint32", "sint64"):
        return str(value >> 1 ^ -(value & 1))
    return str(value - (1 << 64) if kind in ("int32", "int64") and value >> 63 else value)


def message_rows(doc_id: str, data: bytes | None, schema: Schema, root: str) -> list[dict]:
    out, data = _Rows(doc_id), bytes(data or b"")

    def fields(kind: str, at: int, end: int, depth: int) -> None:
        while at < end:
            start = at
            try:
                key, at = _varint(data, at, end)
                number, wire = key >> 3, key & 7
                if wire == 0:
                    value, at = _varint(data, at, end)
                elif wire in (1, 2, 5):
                    size = 8 if wire == 1 else 4 if wire == 5 else None
                    if size is None:
                        size, at = _varint(data, at, end)
                    if at + size > end:
                        raise ValueError("a field is cut off")
                    value, at = data[at : at + size], at + size
                else:
                    raise ValueError(f"wire type {wire}")
            except ValueError as e:
                out.node(kind="error", ident=data[start:end].hex(), type=str(e), start_offset=start)
                return
            name, type_ = schema[kind].get(number, (str(number), ""))
            if type_ in schema and wire == 2 and depth < DEEPEST:
                out.enter(kind=type_, ident="", type=name, start_offset=start)
                fields(type_, at - len(value), at, depth + 1)
                out.leave()
                continue
            try:
                if not type_ or type_ in schema:
                    raise ValueError
                out.node(kind=type_, ident=_scalar(type_, wire, value), type=name, start_offset=start)
            except ValueError:
                out.node(kind="unknown", ident=data[start:at].hex(), type=str(number), start_offset=start)

    out.enter(kind=root, ident="", type="", start_offset=0)
    fields(root, 0, len(data), 1)
    out.leave()
    return out.rows


def message_nodes(rows: DataFrame, schema: Schema, root: str) -> DataFrame:
    """NODES of messages (doc_id, source: binary)."""
    return walk(rows, lambda k, data: message_rows(k, data, schema, root))


def _number(n: Column) -> Column:
    """A varint of a number below 2^63: seven bits a byte, the last without the high bit."""
    more = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(F.conv(n.cast("string"), 10, 2)) - 1) / 7)).cast("int"))
    return F.aggregate(more, F.unhex(F.lit("")), lambda a, i: F.concat(a, F.unhex(F.lpad(F.hex(F.call_function("shiftrightunsigned", n, (i * 7).cast("int")).bitwiseAND(F.lit(127)) + F.when(i == F.size(more) - 1, 0).otherwise(128)), 2, "0"))))


def encoded(nodes: DataFrame, schema: Schema) -> DataFrame:
    """doc_id, message: the bytes of each tree that message_nodes or a query made. Numbers of all kinds but fixed, floating and
    zigzag ones, which are an error."""
    number = {f"{m}.{name}": n for m, fields in schema.items() for n, (name, _) in fields.items()}
    numbers = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    up = nodes.select("doc_id", F.col("node_id").alias("parent"), F.col("kind").alias("_message"))
    rows = nodes.join(up, ["doc_id", "parent"], "left").withColumn("_number", numbers[F.concat_ws(".", "_message", "type")].cast("long"))
    kind, ident = F.col("kind"), F.col("ident")
    nothing = F.unhex(F.lit(""))

    def framed(body: Column) -> Column:
        return F.concat(_number(F.col("_number") * 8 + 2), _number(F.octet_length(body).cast("long")), body)

    def value(children: Column) -> Column:
        inner = F.aggregate(children.cast("array<binary>"), nothing, lambda a, x: F.concat(a, x))
        whole = F.when(F.col("parent").isNull(), inner).otherwise(framed(inner))
        bad = F.raise_error(F.concat(F.lit("no way to write "), kind)).cast("binary")
        return (
            F.when(kind.isin(*schema), whole)
            .when(kind.isin("unknown", "error"), F.unhex(ident))
            .when(kind == "string", framed(ident.cast("binary")))
            .when(kind == "bytes", framed(F.unhex(ident)))
            .when(kind.isin("double", "fixed32", "fixed64", "float", "sint32", "sint64"), bad)
            .otherwise(F.concat(_number(F.col("_number") * 8), _number(ident.cast("long"))))
        )

    return fold_up(rows, value).select("doc_id", F.col("value").alias("message"))


def diagnostics(nodes: DataFrame) -> DataFrame:
    """doc_id, ok, diagnostics (JSON of place and message) of every message: what a codec answers beside its module."""
    found = F.collect_list(F.when(F.col("kind") == "error", F.struct(F.col("start_offset").alias("offset"), F.col("type").alias("message"))))
    return nodes.groupBy("doc_id").agg(F.sort_array(found).alias("d")).select("doc_id", (F.size("d") == 0).alias("ok"), F.to_json("d").alias("diagnostics"))

