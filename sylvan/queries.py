"""Registry of the engine's queries and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .corpora import artifacts, codecs, pages, programs, sqlfiles, units
from .operators import bindings, closure, compdb, ddl, dictionary, graph, jobs, lockstep, relational, text, textir, tree
from .streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (lockstep, tree, text, dictionary, textir, bindings, graph, closure, ddl, compdb, jobs, relational, units, programs, sqlfiles, pages, artifacts, codecs, events):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
FLAGSHIP = QUERIES["lockstep_diff"]
