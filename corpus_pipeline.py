"""The corpus pipeline: five stages over documents, each reading what the one before kept.

Every stage but the last returns the columns of documents. ``run`` writes each stage as Parquet to the
shared folder and rereads it for the next. Language ID, secret spans, chunk boundaries and packing can't
be put in SQL, so there is no ORACLE_SQL; tests compare with a brute-force version.

Tables that a stage makes for its own use are deleted when a later stage begins on documents that don't read them,
as they are of no use once the stage's result is written. Nulls, empty and very long texts, ties, repeated rows
and columns of any name: as in the operators. Null and empty texts go in the first stage, as they are in no
language; rows with one doc_id count as one document in the second; an empty table stays empty throughout.
"""

from __future__ import annotations

import threading
import uuid
from contextvars import ContextVar
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import chunk_dedup, language_id, ngram_join, packing, secret_scan
from sylvan.llm.common import documents, written
from sylvan.work import cleared, recorded

#: Tables of stages, by run. Each call of run() is one; stages that are called by themselves belong together if they are called in
#: one thread for one sf_dir.
_left: dict[tuple, list[str]] = {}
_run: ContextVar[str | None] = ContextVar("run", default=None)


def clearing(run, keep: bool = False):
    """A stage that begins by deleting what earlier ones left. With keep its own tables stay: its result reads them."""

    @wraps(run)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, _run.get() or (threading.get_ident(), sf_dir))
        kept = cleared(spark, _left.pop(key, []), docs)
        with recorded() as made:
            out = run(spark, docs, sf_dir)
        if not keep:
            _left[key] = [*kept, *made]
        return out

    return begun


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunk_dedup.without_repeats(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(name, clearing(run, keep=run is packed)) for name, run in (("language_id", language), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("secret_scans", secrets), ("packing", packed))]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = _run.set(uuid.uuid4().hex)
    try:
        docs = documents(spark, sf_dir)
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _run.reset(token)
