"""Sessions, and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(name: str = "sylvan", cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from the launcher."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python functions load there by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    with tempfile.NamedTemporaryFile(prefix="sylvan-", suffix=".zip", delete=False) as out:
        with zipfile.ZipFile(out, "w") as pack:
            for p in sorted(top.rglob("*.py")):
                pack.write(p, os.path.join(top.name, p.relative_to(top)))
    context.addPyFile(out.name)
    _shipped.add(context.applicationId)
