"""The shared work folder: where lineage is cut and intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset a temporary one per application serves local sessions;
    on a cluster, whose executors don't see it, that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors see")
        if context.applicationId not in _own_roots:
            _own_roots[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='sylvan-')}"
        root = _own_roots[context.applicationId]
    return root.rstrip("/")


_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; every call gives another one."""
    path = f"{checkpoint_root(spark)}/sylvan/{name}-{uuid.uuid4().hex[:12]}"
    if (paths := _recorded.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that work_path gives inside."""
    token = _recorded.set([])
    try:
        yield _recorded.get()
    finally:
        _recorded.reset(token)


def cleared(spark: SparkSession, paths: list[str], read: DataFrame) -> list[str]:
    """Deletes the tables at paths but those that a frame still reads; gives the latter."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = read.inputFiles()
    kept = []
    for path in paths:
        at = hadoop(path)
        below = at.toUri().getRawPath() + "/"
        if any(below in f for f in files):
            kept.append(path)
        else:
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return kept


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes the frame to the shared folder and reads it back. The table stays until the folder is
    cleared, as results that refer to it may still be read."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
