"""Secret scans with an incremental blob ledger.

Every version of a text is a blob named by the SHA-256 of its bytes. The ledger is a Parquet table of
(blob, rule version, findings) in a folder of its own; a scan appends the pairs it lacks and never
scans a pair twice, so a later run over a history that mostly repeats reads only new blobs. Findings
are joined back to every path (document, version) of the blob.

Base kinds, leftmost and non-overlapping within a kind, in code points with an exclusive end:
assign, access, hex. Kinds that the method adds: jwt, private_key, forge (tokens of code forges).
A null text is the empty blob: no findings. Rows with equal ids each keep their own row, and rows with equal
texts share one scan. A very long text is scanned whole, in one call each kind. An empty table leaves
the ledger as it is. Two runs that append at once may both write a blob: its findings are equal and count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, steady_memory, work_path

RULE_VERSION = "2"
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("jwt", "private_key", "forge")
ORDER = {kind: n for n, kind in enumerate((*BASE_KINDS, *ADDED_KINDS))}
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_KEY = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?")
_FORGE = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEDGER = "blob binary, rule_version string, findings array<struct<kind:string,start:int,end:int>>"
_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) sorted by start, then kind as listed."""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text)]
    if "-----BEGIN" in text:
        out += [("private_key", *m.span()) for m in _KEY.finditer(text)]
    if "gh" in text or "glpat" in text:
        out += [("forge", *m.span()) for m in _FORGE.finditer(text)]
    return sorted(out, key=lambda x: (x[1], ORDER[x[0]]))


def blob_id(text: str = "text"):
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; empty before the first scan."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def scan_unseen(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION, text: str = "text") -> None:
    """Scans the blobs of versions that the ledger lacks for this rule version and appends them.

    Copies of a blob first collapse within their input task, then meet by blob: what is shuffled is
    each task's distinct unseen texts.
    """
    spark = versions.sparkSession
    small_batches(spark)
    blobs = versions.select(blob_id(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob").distinct()
    known = not seen.isEmpty()
    if known:
        blobs = blobs.join(seen, "blob", "left_anti")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            passed: set[bytes] = set()
            for batch in batches:
                keep = []
                for blob in batch.column(0).to_pylist():
                    keep.append(blob not in passed)
                    if len(passed) < 200_000:  # only a filter: what gets by is collapsed after the shuffle
                        passed.add(blob)
                yield batch.filter(pa.array(keep, pa.bool_()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with steady_memory():
            last = None
            for batch in batches:
                ids, found = [], []
                for blob, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if blob != last:
                        ids.append(blob)
                        found.append([{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t.as_py())])
                    last = blob
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([rule_version] * len(ids), pa.string()), pa.array(found, _FINDINGS)], ["blob", "rule_version", "findings"])

    (blobs.mapInArrow(once, "blob binary, t string").repartition("blob").sortWithinPartitions("blob").mapInArrow(scan, LEDGER).write.mode("append").parquet(ledger))


def joined(paths: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """paths (with a column blob) and the findings of each one's blob."""
    found = read_ledger(paths.sparkSession, ledger).where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).groupBy("blob").agg(F.first("findings").alias("findings"))
    return paths.join(found, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<kind:string,start:int,end:int>>")))


def _listed(findings):
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest_query(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, blob of every document."""
    spark = docs.sparkSession
    ledger = ledger or work_path(spark, "ledger")
    scan_unseen(docs, ledger)
    paths = docs.select(F.col("doc_id").cast("long"), blob_id().alias("blob"))
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return joined(paths, ledger).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("findings")).alias("spans"),
        (F.size("findings") - F.size(base)).cast("long").alias("n_added"),
        F.lower(F.hex("blob")).alias("blob"),
    )


def without_spans(text: str, spans: list[dict], mark: str) -> str:
    """The text with every span replaced by mark, overlapping ones as one."""
    out, at, end = [], 0, -1
    for s in sorted(spans, key=lambda s: s["start"]):
        if s["start"] >= end:
            out += [text[at : s["start"]], mark]
        end = at = max(end, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[secret]") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by mark; n_chars follows, all other columns stay,
    whatever their names."""
    ledger = ledger or work_path(docs.sparkSession, "ledger")
    scan_unseen(docs, ledger)
    found = joined(docs.select(F.struct("*").alias("row"), blob_id().alias("blob")), ledger)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else without_spans(t, s, mark) for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    # Only texts with findings are sent to Python.
    hit = F.size("findings") > 0
    changed = found.select("row", hit.alias("hit"), cut(F.when(hit, F.col("row")["text"]), F.when(hit, F.col("findings"))).alias("made"))
    new = {"text": F.when(F.col("hit"), F.col("made")).otherwise(F.col("row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("made").cast("long")).otherwise(F.col("row")["n_chars"])
    return changed.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base result straight from the definitions, for tests."""
    rules = [
        ("assign", r"(?:(?i:(?a:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    spans = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, rule, keep) in enumerate(rules) for m in re.finditer(rule, text or "") if keep(m)]
    counts = [sum(s[1] == n for s in spans) for n in range(3)]
    return (*counts, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest())
