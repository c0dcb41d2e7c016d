"""Data sources for files of other tools: raw node arrays (K1, S7) and one artifact a row (K4).

Tasks write and read the files themselves, so nothing passes through the driver but a count from each task. What they
write is the same however often a task runs, and gets its name or its manifest only when the job commits: a task that
failed or ran twice leaves no trace. Both need a folder that all executors see; single files go by any file system
that pyarrow knows, raw arrays, which many tasks write at their places in one file, by a mounted one.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship
from ..work import written


#: Array -> stored type.
ARRAYS = {
    "kind": "u2", "parent": "i4", "first_child": "i4", "next_sibling": "i4", "depth": "u1", "start_line": "u4", "start_col": "u2",
    "end_line": "u4", "end_col": "u2", "ident_idx": "u4", "type_idx": "u4", "tu_idx": "u2",
}


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(_local(uri)))


@dataclass
class Written(WriterCommitMessage):
    count: int = 0
    first: int = 0


# --- raw arrays ---------------------------------------------------------------------------------------


class ArraysWriter(DataSourceArrowWriter):
    """Each value goes to its place: node_id times the width of its array. A task has a range of node ids, in order; the ranges together
    are 0, 1, 2 ... without a gap, or the job fails."""

    def __init__(self, folder: str, names: list[str], vocabularies: dict[str, list[str]], types: dict[str, str] = ARRAYS):
        self.folder, self.names, self.vocabularies, self.types = folder, names, vocabularies, types
        self.mark = uuid.uuid4().hex[:8]
        os.makedirs(folder, exist_ok=True)

    def _file(self, name: str, done: bool) -> str:
        return f"{self.folder}/{name}.{self.types[name]}" if done else f"{self.folder}/.{name}.{self.mark}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files = {n: os.open(self._file(n, False), os.O_WRONLY | os.O_CREAT, 0o644) for n in self.names}
        out = Written()
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                ids = batch.column("node_id").to_numpy()
                first = int(ids[0])
                if out.count == 0:
                    out.first = first
                if first != out.first + out.count or (np.diff(ids) != 1).any() or first < 0:
                    raise ValueError(f"node ids have a gap or stand twice near {first}")
                for name, file in files.items():
                    values, kind = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64), self.types[name]
                    small = values.astype(f"<{kind}")
                    if (small.astype(np.int64) != values).any():
                        raise OverflowError(f"{name} does not fit {kind}")
                    os.pwrite(file, small.tobytes(), first * small.itemsize)
                out.count += len(ids)
        finally:
            for file in files.values():
                os.fsync(file)
                os.close(file)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        count = 0
        for m in sorted((m for m in messages if m and m.count), key=lambda m: m.first):
            if m.first != count:
                self.abort(messages)
                raise ValueError(f"node ids have a gap or stand twice near {min(count, m.first)}")
            count += m.count
        for name in self.names:
            if not count:
                open(self._file(name, False), "wb").close()
            os.replace(self._file(name, False), self._file(name, True))
        for name, values in self.vocabularies.items():
            with open(f"{self.folder}/{name}.json", "w", encoding="utf-8") as f:
                json.dump(values, f)
        width = sum(int(self.types[n][1]) for n in self.names)
        manifest = {
            "version": 1, "num_nodes": count, "total_node_bytes": count * width, "bytes_per_node": width if count else 0,
            "arrays": {n: {"file": f"{n}.{self.types[n]}", "dtype": self.types[n], "length": count, "bytes": count * int(self.types[n][1])} for n in self.names},
            "vocab_files": {n: f"{n}.json" for n in self.vocabularies},
        }
        with open(f"{self.folder}/.manifest.{self.mark}", "w", encoding="utf-8") as f:
            json.dump(manifest, f)
        os.replace(f"{self.folder}/.manifest.{self.mark}", f"{self.folder}/manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        for name in self.names:
            if os.path.exists(self._file(name, False)):
                os.remove(self._file(name, False))


@dataclass
class Range(InputPartition):
    lo: int
    hi: int


class ArraysReader(DataSourceReader):
    """Ranges of the node ids from first up to end, all chosen arrays of a range in one task. Nothing outside is read. Stored types
    are the manifest's, where there is one."""

    def __init__(self, folder: str, names: list[str], each: int, first: int, end: int):
        self.folder, self.names, self.each, self.lo, self.hi = folder, names, each, first, end
        self.types = ARRAYS | self._stored()

    def _stored(self) -> dict[str, str]:
        store, folder = _opened(self.folder)
        if store.get_file_info(f"{folder}/manifest.json").type != fs.FileType.File:
            return {}
        with store.open_input_stream(f"{folder}/manifest.json") as f:
            return {n: a["dtype"] for n, a in json.loads(f.read())["arrays"].items()}

    def partitions(self) -> list[Range]:
        store, folder = _opened(self.folder)
        size = {n: store.get_file_info(f"{folder}/{n}.{self.types[n]}").size for n in self.names}
        lengths = {n: (s or 0) // int(self.types[n][1]) for n, s in size.items()}
        if len(set(lengths.values())) > 1 or any((s or 0) % int(self.types[n][1]) for n, s in size.items()):
            raise ValueError(f"arrays differ in length: {lengths}")
        hi = min(self.hi, next(iter(lengths.values())))
        return [Range(lo, min(lo + self.each, hi)) for lo in range(self.lo, hi, self.each)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, folder = _opened(self.folder)
        files = {n: store.open_input_file(f"{folder}/{n}.{self.types[n]}") for n in self.names}
        for lo in range(partition.lo, partition.hi, 100_000):
            n = min(100_000, partition.hi - lo)
            columns = [pa.array(np.arange(lo, lo + n))]
            for name, file in files.items():
                kind = np.dtype(f"<{self.types[name]}")
                columns.append(pa.array(np.frombuffer(file.read_at(n * kind.itemsize, lo * kind.itemsize), kind).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["node_id", *self.names])


class Arrays(DataSource):
    """format("node_arrays"), options path, arrays (comma-joined), vocabularies and types (JSON, for writing), rows (a task's),
    first and end (node ids, for reading)."""

    @classmethod
    def name(cls) -> str:
        return "node_arrays"

    @property
    def names(self) -> list[str]:
        found = [n for n in self.options.get("arrays", "").split(",") if n] or list(ARRAYS)
        if unknown := set(found) - set(ARRAYS):
            raise ValueError(f"no such array: {', '.join(sorted(unknown))}")
        return found

    def schema(self) -> str:
        return ", ".join(f"{c} long" for c in ("node_id", *self.names))

    def reader(self, schema: StructType) -> ArraysReader:
        return ArraysReader(self.options["path"], self.names, int(self.options.get("rows", 4_000_000)), int(self.options.get("first", 0)), int(self.options.get("end", 1 << 62)))

    def writer(self, schema: StructType, overwrite: bool) -> ArraysWriter:
        return ArraysWriter(_local(self.options["path"]), self.names, json.loads(self.options.get("vocabularies", "{}")), ARRAYS | json.loads(self.options.get("types", "{}")))


def wider(**greatest: int) -> dict[str, str]:
    """The types of arrays whose greatest value does not fit the stored one: of the same sort, as wide as needed."""
    found = {}
    for name, most in greatest.items():
        kind, wide = ARRAYS[name][0], int(ARRAYS[name][1])
        while most > np.iinfo(f"{kind}{wide}").max:
            wide *= 2
            found[name] = f"{kind}{wide}"
    return found


def write_arrays(table: DataFrame, vocabularies: dict[str, list[str]], folder: str, types: dict[str, str] | None = None) -> None:
    """The raw export (K1): an array a file in node order, vocabularies and manifest, in a folder that all executors see. Ranges of
    nodes are written side by side; a hole or a double in the node ids is an error, and nothing is left then. types are stored types other than the format's own, as
    wider gives them; the manifest names each array's."""
    spark = table.sparkSession
    ship(spark)
    spark.dataSource.register(Arrays)
    rows = table.select(F.col("node_id").cast("long"), *(F.col(n).cast("long") for n in ARRAYS))
    rows.repartitionByRange("node_id").sortWithinPartitions("node_id").write.format("node_arrays").mode("append").option("vocabularies", json.dumps(vocabularies)).option("types", json.dumps(types or {})).save(folder)


def load_tensor(spark: SparkSession, folder: str, names: tuple[str, ...] = ("kind", "first_child", "next_sibling", "ident_idx", "type_idx"), rows: int = 4_000_000, first: int = 0, end: int = 1 << 62) -> DataFrame:
    """node_id and the chosen arrays as columns (S7), of the nodes from first up to end, read in ranges of so many; arrays of
    different length are an error."""
    ship(spark)
    spark.dataSource.register(Arrays)
    return spark.read.format("node_arrays").option("arrays", ",".join(names)).option("rows", rows).option("first", first).option("end", end).load(folder)


# --- one file a row -----------------------------------------------------------------------------------


class FilesWriter(DataSourceArrowWriter):
    """A row's file is written beside its place and then moved there: no reader sees half of one."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _opened(self.root)
        out, made = Written(), set()
        for batch in iterator:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
                parts = (path or "").split("/")
                if not path or path.startswith("/") or ".." in parts or parts[-1] in ("", "."):
                    raise ValueError(f"not a path below the root: {path}")
                folder = "/".join([root, *parts[:-1]])
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                beside = f"{folder}/.{parts[-1]}.{uuid.uuid4().hex[:8]}"
                with store.open_output_stream(beside) as f:
                    f.write(value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value or b"")
                store.move(beside, f"{folder}/{parts[-1]}")
                out.count += 1
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _opened(self.root)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_SUCCESS") as f:
            f.write(str(sum(m.count for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that are there are whole; without the mark of success the run isn't."""


class Files(DataSource):
    """format("mirrored_files"): rows (path, value) as files below the path given, each at its own relative path."""

    @classmethod
    def name(cls) -> str:
        return "mirrored_files"

    def schema(self) -> str:
        return "path string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def _parts(spark: SparkSession) -> int:
    """So many tasks for rows that each stand for a file: they are small, and a small shuffle would be read by one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_files(rows: DataFrame, root: str) -> None:
    """K4: a file for each row (path, value) at its relative path below root, and a file _SUCCESS with their number. Of rows with one path
    the greatest value stays."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Files)
    rows.repartition(_parts(spark), "path").groupBy("path").agg(F.max("value").alias("value")).write.format("mirrored_files").mode("append").save(root)


_ESCAPED = re.compile(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7F]""")


def _hidden(name: str) -> bool:
    """As Spark's own readers see it."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def read_files(spark: SparkSession, root: str, glob: str, missing: bool = False) -> DataFrame:
    """(path, text) of all files below root whose name fits the glob (* and ?), whole; path is a URI as in input_file_name. With missing, files that
    have gone since they were listed give no rows, else they are an error. Folders are listed by tasks, a level a round, and
    files dealt to tasks by path: the driver sees neither names nor one task for every few files. It needs a file system
    that pyarrow knows; others are left to Spark's reader, which lists on the driver."""
    own = "://" not in root or root.startswith("file:")
    try:
        store, top = (fs.LocalFileSystem(), os.path.abspath(_local(root))) if own else _opened(root)
    except (pa.ArrowException, OSError):
        store = None
    if own and not root.startswith("file:") and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:").startswith("file:"):
        store = None
    if store is None or re.search(r"[\[\]{}\\]", glob):
        rows = spark.read.option("ignoreMissingFiles", missing).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
        return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    there = store.get_file_info(top).type
    if there == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    ship(spark)
    before = "file://" if own else root[: len(root.rstrip("/")) - len(top.rstrip("/"))]
    opened = fs.LocalFileSystem if own else lambda: _opened(root)[0]
    parts = _parts(spark)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                here = opened().get_file_info(fs.FileSelector(folder))
                for lo in range(0, len(here), 10_000):
                    some = [i for i in here[lo : lo + 10_000] if not _hidden(i.base_name) and (i.type == fs.FileType.Directory or fnmatchcase(i.base_name, glob))]
                    yield pa.RecordBatch.from_arrays([pa.array([i.path for i in some], pa.string()), pa.array([i.type == fs.FileType.Directory for i in some], pa.bool_())], ["at", "folder"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = opened()
        paths, values, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], ["path", "value"])

        for batch in batches:
            for at in batch.column(0).to_pylist():
                try:
                    with store.open_input_stream(at) as f:
                        values.append(f.read())
                except FileNotFoundError:
                    if missing:
                        continue
                    raise
                paths.append(before + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", at))
                held += len(values[-1])
                if len(paths) >= 2_000 or held >= 8_000_000:
                    yield out()
                    paths, values, held = [], [], 0
        yield out()

    if there == fs.FileType.File:
        files = spark.createDataFrame([(top,)] if fnmatchcase(top.rsplit("/", 1)[-1], glob) else [], "at string")
    else:
        found, folders = [], spark.createDataFrame([(top,)], "at string")
        while True:
            level = written(folders.repartition(parts, "at").mapInArrow(listed, "at string, folder boolean"), "listing")
            found.append(level.where("NOT folder").select("at"))
            folders = level.where("folder").select("at")
            if folders.isEmpty():
                break
        files = reduce(DataFrame.unionByName, found)
    return files.repartition(parts, "at").mapInArrow(read, "path string, value binary").select("path", F.col("value").cast("string").alias("text"))
