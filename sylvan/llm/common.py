"""Shared helpers: input tables, the shared work folder and bounded Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..work import work_path, written

__all__ = ["documents", "give_back", "small_batches", "steady_memory", "whole_text", "work_path", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """For Python operators: the package on the executors, and Arrow batches that end at so many rows or bytes, as
    one text may have many megabytes. It sets two settings of the session that only Arrow functions read."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def whole_text(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


@contextmanager
def steady_memory(arrays: bool = False):
    """For tasks with large caches and no pandas: the cycle collector, which would walk the caches again and again,
    rests until the task ends. What makes cycles there collects by itself. Then freed memory goes back to the
    system, as the worker lives on and its neighbours need it. With arrays, that of large arrays goes back at once."""
    was = gc.isenabled()
    gc.disable()
    if arrays:
        with suppress(OSError, AttributeError):  # M_MMAP_THRESHOLD, which else grows with what is freed
            ctypes.CDLL(None).mallopt(-3, 4 << 20)
    try:
        yield
    finally:
        if was:
            gc.enable()
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
