"""Token-ID output as length-delimited binary records with a separate offset index.

Record: payload length (unsigned 64-bit), masked checksum of those 8 bytes (unsigned 32-bit), payload,
masked checksum of the payload, one line feed. Payload: has_id (1 byte), id width in bytes (1), two
zero bytes, token count (unsigned 32-bit), doc_id (signed 64-bit), then the ids. All little-endian.
The checksum is CRC-32, masked by rotating it right by 15 bits and adding 0xA282EAD8.

Files are written by Spark's own text writer (the record's last byte is its line end), so the commit
protocol drops what lost executors left, and any store that Spark writes to will do. Documents are
range-partitioned and sorted by doc_id (null first; rows with equal ids by text): file k holds the
documents before those of file k+1. The index has a row per record: part, record, doc_id, offset,
length, n_tokens; it is made from the files that were committed, so it can't name records that a lost executor left.
A null text is empty and still gets its end token; no rows give no files. Repeated rows are records of their own. A very
long text is one record; a file is read whole and must stay under 2 GB, which the number of ranges sees to. Only doc_id
and text are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, work_path
from .word_tokens import word_encoder

_HEAD = struct.Struct("<QI")
_META = struct.Struct("<BBHIq")
_CRC = struct.Struct("<I")
#: Bytes of text in a range of doc_ids, about: a file has no more of them.
RANGE_BYTES = 128 << 20
INDEX_SCHEMA = "part long, record long, doc_id long, offset long, length long, n_tokens long"


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record without its line feed; ids: unsigned 32-bit, little-endian."""
    body = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = _META.pack(doc_id is not None, width, 0, len(ids) // 4, doc_id or 0) + body
    length = len(payload).to_bytes(8, "little")
    return length + _CRC.pack(masked(length)) + payload + _CRC.pack(masked(payload))


def records(data: bytes | memoryview, offset: int = 0, verify: bool = True) -> Iterator[tuple[int, int, int | None, bytes]]:
    """(offset, length with framing, doc_id, ids as unsigned 32-bit) of each record from offset on."""
    view = memoryview(data)
    while offset < len(view):
        size, crc = _HEAD.unpack_from(view, offset)
        if verify and masked(view[offset : offset + 8]) != crc:
            raise ValueError(f"record at {offset}: wrong length checksum")
        start, end = offset + 12, offset + 12 + size
        if end + 5 > len(view):
            raise ValueError(f"record at {offset}: cut off")
        if verify and masked(view[start:end]) != _CRC.unpack_from(view, end)[0]:
            raise ValueError(f"record at {offset}: wrong checksum")
        has_id, width, _, count, doc_id = _META.unpack_from(view, start)
        body = view[start + _META.size : end]
        if len(body) != width * count:
            raise ValueError(f"record at {offset}: {len(body)} bytes for {count} ids")
        ids = bytes(body) if width == 4 else np.frombuffer(body, "<u2").astype("<u4").tobytes()
        yield offset, end + 5 - offset, doc_id if has_id else None, ids
        offset = end + 5


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encodes and writes docs in ascending order of doc_id to path/data and the index to path/index."""
    spark = docs.sparkSession
    small_batches(spark)
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_encoder(vocabulary) as encoder:
            width = 2 if max(encoder.ids, end_id or 0) <= 1 << 16 else 4
            for batch in batches:
                ids = encoder.encode_batch(batch.column(1).to_pylist())
                out = [frame(k, x + tail, width) for k, x in zip(batch.column(0).to_pylist(), ids)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("t"))
    # Spark's own estimate, from the files' sizes, times what texts are compressed by; counted only where it has none.
    size = 4 * int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > 1 << 60:
        size = rows.agg(F.sum(F.octet_length("t"))).head()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # A hash of the text splits rows of one id, or of none, as well.
    (
        rows.repartitionByRange(ranges, F.col("k").asc_nulls_first(), F.xxhash64("t"))
        .sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"), "t")
        .mapInArrow(frames, "value binary")
        .select(F.col("value").cast("string"))
        .write.option("lineSep", "\n")
        .text(f"{path}/data")
    )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in _files(batches):
            rows = [(part, n, k, at, size, len(ids) // 4) for n, (at, size, k, ids) in enumerate(records(data, verify=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    _contents(spark, path).mapInArrow(entries, INDEX_SCHEMA).write.parquet(f"{path}/index")


def _contents(spark: SparkSession, path: str) -> DataFrame:
    part = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").where("length > 0").select(part.alias("part"), "content")


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, memoryview]]:
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield part, memoryview(data.as_buffer())


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """part, record, doc_id, ids (array) of every record, checksums verified."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in _files(batches):
            for n, (_, _, k, ids) in enumerate(records(data)):
                yield pa.RecordBatch.from_pylist([{"part": part, "record": n, "doc_id": k, "ids": np.frombuffer(ids, "<u4")}], schema=pa.schema([("part", pa.int64()), ("record", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return _contents(spark, path).mapInArrow(rows, "part long, record long, doc_id long, ids array<long>")


def read_chosen(spark: SparkSession, path: str, chosen: DataFrame) -> DataFrame:
    """The records of the index rows in chosen, in any order: each file's rows seek by their offsets."""
    wanted = chosen.groupBy("part").agg(F.collect_list(F.struct("offset", "record")).alias("wanted"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, want in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                for w in want:
                    _, _, k, ids = next(records(memoryview(data.as_buffer()), w["offset"]))
                    yield pa.RecordBatch.from_pylist([{"part": part, "record": w["record"], "doc_id": k, "ids": np.frombuffer(ids, "<u4")}], schema=pa.schema([("part", pa.int64()), ("record", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return _contents(spark, path).join(wanted, "part").select("part", "content", "wanted").mapInArrow(rows, "part long, record long, doc_id long, ids array<long>")


def record_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens, ids_crc32, part, record: read back from the files."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in _files(batches):
            before, rows = 0, []
            for n, (_, _, k, ids) in enumerate(records(data)):
                rows.append((part, n, k, before, len(ids) // 4, zlib.crc32(ids)))
                before += len(ids) // 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["part", "record", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = _contents(spark, path).mapInArrow(digests, "part long, record long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    # A row per file: the window sees file totals only, never documents.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = read_index(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total")).select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    return found.join(files, "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "part", "record")


def digest_query(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes docs in the file format to a fresh folder and reads them back."""
    spark = docs.sparkSession
    path = work_path(spark, "records")
    write_records(docs, path, vocabulary, end_id)
    return record_digests(spark, path)
