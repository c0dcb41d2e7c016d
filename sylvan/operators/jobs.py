"""Job queues, manifests and reports."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Language -> number.
LANGUAGES = {"UNSPECIFIED": 0, "TYPESCRIPT": 1, "PYTHON": 2, "RUST": 3, "LEAN": 4, "SQL": 5, "JAVA": 6}
QUEUE = "cluster string, canonical_fn string, canonical_rs string, out_dir string, seq int, fn string, sibling_rs string, overrides_toml string, n int, defaults map<string,string>"
#: Tools that a queue's defaults may leave out.
DEFAULT_TOOLS = {"c_cluster_diff": "translated/pipeline/target/release/c_cluster_diff", "c_to_rust_bindings": "translated/pipeline/target/release/c_to_rust_bindings"}


def _queue_rows(toml: str, root: str | None) -> list[tuple]:
    found = tomllib.loads(toml)
    at = lambda p: p if root is None or p.startswith("/") else f"{root.rstrip('/')}/{p}"
    defaults = {k: at(v) for k, v in (DEFAULT_TOOLS | {"tensor": "", "engine": ""} | found.get("defaults", {})).items()}
    return [
        (c["name"], c["canonical_fn"], at(c["canonical_rs"]), at(c["out_dir"]), seq, m["fn"], at(m["sibling_rs"]), at(m["overrides_toml"]), n, defaults)
        for seq, c in enumerate(found.get("cluster", []))
        for n, m in enumerate(c.get("member", []))
    ]


def load_queue(spark: SparkSession, toml: str, root: str | None = None) -> DataFrame:
    """A row per cluster and member, in order, with the queue's defaults (S9, J15). With a root, relative paths are below
    it. The file is configuration, read on the driver."""
    return spark.createDataFrame(_queue_rows(toml, root), QUEUE)


def load_queues(files: DataFrame, root: str | None = None) -> DataFrame:
    """The rows of many queue files (path, text), read where they are, with path; error (with null members) where one can't be read."""
    ship(files.sparkSession)
    schema = f"path string, {QUEUE}, error string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.string()] * 5 + [pa.int32()] + [pa.string()] * 3 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()]
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out += [(path, *r, None) for r in _queue_rows(text or "", root)]
                except (tomllib.TOMLDecodeError, KeyError, AttributeError, TypeError) as e:
                    out.append((path, *[None] * 10, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], k) for c, k in zip(columns, kinds)], names)

    return files.select("path", "text").mapInArrow(rows, schema)


def load_tables(spark: SparkSession, toml: str, names: tuple[str, ...]) -> DataFrame:
    """(table, k, v) of string tables in a TOML text; absent ones are empty."""
    found = tomllib.loads(toml)
    return spark.createDataFrame([(t, k, str(v)) for t in names for k, v in found.get(t, {}).items()], "`table` string, k string, v string")


def load_tables_of(files: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """path, table, k, v of the string tables in many TOML files (path, text), read where they are; a file that can't be read gives none."""
    ship(files.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                out += [(path, t, k, str(v)) for t in names for k, v in found.get(t, {}).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out) if out else [[]] * 4)], ["path", "table", "k", "v"])

    return files.select("path", "text").mapInArrow(rows, "path string, `table` string, k string, v string")


def only_cluster(queue: DataFrame, name: str) -> DataFrame:
    """One cluster's rows (F9); an unknown name is an error."""
    known = queue.agg(F.coalesce(F.max((F.col("cluster") == name).cast("int")), F.lit(0)).alias("known"))
    checked = known.select(F.when(F.col("known") == 1, F.lit(name)).otherwise(F.raise_error(F.lit(f"no cluster {name}")).cast("string")).alias("cluster"))
    return queue.join(checked, "cluster")


def with_missing(jobs: DataFrame, files: DataFrame, inputs: list[str]) -> DataFrame:
    """Adds status and reason: SKIP and the inputs that files (path) lacks, else READY."""
    needed = jobs.select("cluster", "fn", F.explode(F.array(*inputs)).alias("path"))
    gone = needed.join(files.select("path"), "path", "left_anti").groupBy("cluster", "fn").agg(F.array_join(F.sort_array(F.collect_set("path")), ", ").alias("gone"))
    return jobs.join(gone, ["cluster", "fn"], "left").withColumn("status", F.when(F.col("gone").isNotNull(), "SKIP").otherwise("READY")).withColumn("reason", F.when(F.col("gone").isNotNull(), F.concat(F.lit("missing: "), "gone"))).drop("gone")


def outcome(codes: Column, out_there: Column) -> Column:
    """PASS if all step codes are 0 and the output is there, else FAIL."""
    return F.when(F.forall(codes, lambda c: c == 0) & out_there, "PASS").otherwise("FAIL")


def until_first_failure(results: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows up to each group's first FAIL (O7): the least failing place is a grouped minimum, so no group is sorted in one task."""
    first = results.where("status = 'FAIL'").groupBy(*by).agg(F.min(F.struct(*order)).alias("stop"))
    return results.join(first, by, "left").where(F.col("stop").isNull() | (F.struct(*order) <= F.col("stop"))).drop("stop")


def dry_run(queue: DataFrame) -> DataFrame:
    """The planned jobs, none run."""
    return queue.withColumn("status", F.lit("DRY"))


def rollup(results: DataFrame) -> DataFrame:
    """Totals by status, in its order (A5, O3)."""
    return results.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def verdict(results: DataFrame) -> DataFrame:
    """Whether all passed, with counts (A13, K12); SKIP is no success."""
    return results.agg(F.count_if(F.col("status") == "FAIL").alias("n_failed"), F.coalesce(F.bool_and(F.col("status") == "PASS"), F.lit(True)).alias("all_passed"))


def status_line(results: DataFrame) -> DataFrame:
    """Fixed-width lines."""
    return results.select("cluster", "fn", F.concat(F.rpad("status", 5, " "), F.rpad("cluster", 24, " "), F.rpad("fn", 40, " "), F.coalesce("reason", F.lit(""))).alias("line"))


def tail_lines(text: Column, n: int = 8) -> Column:
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")


def tail_chars(text: Column, n: int = 800) -> Column:
    """The last so many characters."""
    return F.substring(text, -n, n)


def render_spec(spec: Column) -> Column:
    """LANG:OUT_PATH:FILE cut at the first two colons."""
    parts = F.split(spec, ":", 3)
    return F.struct(F.upper(F.get(parts, F.lit(0))).alias("language"), F.get(parts, F.lit(1)).alias("out_path"), F.get(parts, F.lit(2)).alias("file"))


def language_number(name: Column) -> Column:
    """An unknown language is an error."""
    known = F.create_map(*[F.lit(x) for p in LANGUAGES.items() for x in p])
    return F.coalesce(known[F.upper(name)], F.raise_error(F.concat(F.lit("unknown language "), name)).cast("int"))


def manifests(renders: DataFrame, package: str = "package") -> DataFrame:
    """One row a package with a unit per render (J14, A15, K8). renders: package, languages, out_paths, sources: three
    lists of one length, or it is an error."""
    same = (F.size("languages") == F.size("out_paths")) & (F.size("languages") == F.size("sources"))
    zipped = F.when(same, F.arrays_zip("languages", "out_paths", "sources")).otherwise(F.raise_error(F.lit("lists differ in length")).cast("array<struct<languages:string,out_paths:string,sources:string>>"))
    rows = renders.select(package, F.posexplode(zipped).alias("pos", "r")).select(package, "pos", language_number(F.col("r.languages")).alias("language"), F.col("r.out_paths").alias("out_path"), F.col("r.sources").alias("source"))
    unit = F.struct("pos", F.struct("language", "out_path", "source").alias("render"))
    return rows.groupBy(package).agg(F.transform(F.sort_array(F.collect_list(unit)), lambda u: u["render"]).alias("units"))


def rendered(specs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds source to specs (with file) from files (path, text) (S16); no file or more than one of a path is an error (F16)."""
    found = files.groupBy(F.col("path").alias("file")).agg(F.count("*").alias("_n"), F.min("text").alias("_text"))
    met = specs.join(found, "file", "left")
    source = F.when(F.col("_n") == 1, F.coalesce("_text", F.lit(""))).otherwise(F.raise_error(F.concat(F.lit("not exactly one file: "), "file")).cast("string"))
    return met.withColumn("source", source).drop("_n", "_text")


def _once(value: Column, use) -> Column:
    """use(value), with value made once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _varint(n: Column) -> Column:
    """A protobuf varint of a number below 2^35."""
    size = F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)
    byte = lambda i: F.floor(n / F.pow(F.lit(128.0), i)).cast("long").bitwiseAND(F.lit(127)) + F.when(i < size - 1, 128).otherwise(0)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), ""))


def _field(number: int, value: Column) -> Column:
    """A length-delimited field."""
    tag = F.unhex(F.lit(f"{number << 3 | 2:02X}"))
    return _once(value.cast("binary"), lambda data: F.concat(tag, _varint(F.octet_length(data).cast("long")), data))


def manifest_bytes(packed: DataFrame, name: Column, version: str = "0.0.0", revision: str = "", deps: tuple[str, ...] = ()) -> DataFrame:
    """Adds manifest, the protobuf bytes of each package's units (K8): identity, units with one render each, dependencies."""
    text = lambda number, c: F.when(F.coalesce(c, F.lit("")) == "", F.unhex(F.lit(""))).otherwise(_field(number, c))
    identity = F.concat(text(1, name), text(2, F.lit(version)), text(3, F.lit(revision)))
    language = lambda u: F.when(u["language"] == 0, F.unhex(F.lit(""))).otherwise(F.concat(F.unhex(F.lit("08")), _varint(u["language"].cast("long"))))
    unit = lambda u: _field(2, _field(2, F.concat(language(u), text(2, u["out_path"]), text(3, u["source"]))))
    units = F.aggregate(F.transform("units", unit), F.unhex(F.lit("")), lambda a, u: F.concat(a, u))
    return packed.withColumn("manifest", F.concat(_field(1, identity), units, *(_field(3, F.lit(d)) for d in deps)))


def main_program(specs: DataFrame) -> DataFrame:
    """The one-line program that prints a rendered spec (K10). specs: module, symbol, render_fn."""
    return specs.select("*", F.format_string("import %s\ndef main : IO Unit := IO.print (%s %s.%s)\n", "module", "render_fn", "module", "symbol").alias("program"))


def emitted(specs: DataFrame, renderers: dict[str, str]) -> DataFrame:
    """The program of each spec (module, symbol, target) by its target's render function (U3, U4); a target without one is an error."""
    known = F.create_map(*[F.lit(x) for pair in renderers.items() for x in pair])[F.col("target")]
    return main_program(specs.withColumn("render_fn", F.coalesce(known, F.raise_error(F.concat(F.lit("no render function for "), "target")).cast("string"))))


def stop_on_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "FAIL").otherwise("PASS").alias("status"))
    return until_first_failure(events, ["user_id"], ["ts", "event_id"]).groupBy("user_id").agg(F.count("*").alias("n_run"), F.max((F.col("status") == "FAIL").cast("int")).cast("long").alias("failed"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"), F.lit(-1)).alias("k"), F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.name", "string"), F.lit("")).alias("name"))


def progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th row of a user's events and the last."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    w = Window.partitionBy("user_id")
    numbered = events.withColumn("rn", F.row_number().over(w.orderBy("event_id"))).withColumn("n", F.count("*").over(w))
    return numbered.where("rn % 50 = 0 OR rn = n").select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


QUERIES = {f.__name__: f for f in (stop_on_first, json_props, progress_rows)}
ORACLE_SQL = {
    "stop_on_first": """WITH e AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
        SELECT user_id, count(*) AS n_run, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed FROM e WHERE before = 0 GROUP BY 1""",
    "json_props": "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.name'), '') AS name FROM events",
    "progress_rows": "SELECT user_id, event_id, rn::BIGINT AS rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn % 50 = 0 OR rn = n",
}
