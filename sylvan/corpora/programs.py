"""Text IR, compile databases, SQL sources and job queues made of the plain tables, with queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bindings, compdb, ddl, jobs, textir
from ..work import work_path, written
from .units import UNIT, _listed, _text


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names)


# --- text IR: a function a customer, a line an order ------------------------------------------------


def ir_files(spark: SparkSession, sf_dir: str, thin: bool = False) -> DataFrame:
    """path, text: 20 customers a file. thin: only every third order, other return and argument types for some."""
    customer, orders = _tables(spark, sf_dir, "customer", "orders")
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    if thin:
        orders = orders.where(o % 3 == 0)
    line = F.when(F.col("o_orderstatus") == "F", _text("  %o", o, " = add i32 1, 2 ; a note:")).when(F.col("o_orderstatus") == "O", _text("bb", o, ":    ; preds")).otherwise("; nothing")
    bodies = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(o.alias("k"), line.alias("t")))), lambda x: F.concat(x["t"], F.lit("\n"))), "").alias("body"))
    args = F.when(k % 7 == 0, "").when(k % 5 == 0, "ptr noundef byval(%struct.t) align 4 %p, { i32, i32 } captures(address(x)) %q").otherwise(F.when((k % 4 == 0) & F.lit(thin), "i64 noundef %x, ptr align 8 %y").otherwise("i32 noundef %x, ptr align 8 %y"))
    ends = F.when(k % 13 == 0, "").otherwise("}\n")
    returns = F.when(k % 2 == 0, "void").otherwise(F.when((k % 9 == 0) & F.lit(thin), "i64").otherwise("i32"))
    fn = _text("define dso_local ", returns, ' @"f', k, '"(', args, ") #0 {\n", F.coalesce("body", F.lit("")), "  ret\n", ends)
    files = _listed(customer.join(bodies, F.col("o_custkey") == k, "left").withColumn("unit", F.floor(k / UNIT)), "unit", "c_custkey", fn, "t")
    return files.select(_text("d", F.col("unit"), ".ll").alias("path"), F.replace("t", F.lit(",define"), F.lit("define")).alias("text"))


def ir_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, A4, F14, W4, P15-P17."""
    return textir.functions(ir_files(spark, sf_dir)).select("path", "name", "return_type", F.array_join("arg_types", "|").alias("arg_types"), "n_basic_blocks", "n_instructions")


def ir_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's function on both sides; one symbol is renamed on the right first."""
    customer = _tables(spark, sf_dir, "customer")[0]
    left, right = textir.functions(ir_files(spark, sf_dir)), textir.functions(ir_files(spark, sf_dir, True)).where("name <> 'f3'")
    wanted = customer.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("name"))
    return textir.compare(wanted, left, textir.renamed(right, {"f1": "f3"}), 2.0, 2.0).select("name", F.array_join("issues", "; ").alias("issues"), "passed")


def ir_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of the widest symbol, and the run's verdict with counts."""
    customer = _tables(spark, sf_dir, "customer")[0]
    sides = textir.functions(ir_files(spark, sf_dir)), textir.functions(ir_files(spark, sf_dir, True))
    return textir.report(textir.compare(customer.select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("name")), *sides), verbose=True)


_IR = f"""k AS (SELECT c_custkey AS k, c_custkey // {UNIT} AS u FROM customer),
s AS (SELECT k.k, u, thin, CASE WHEN k % 2 = 0 THEN 'void' WHEN thin AND k % 9 = 0 THEN 'i64' ELSE 'i32' END AS ret,
        CASE WHEN k % 7 = 0 THEN []::VARCHAR[] WHEN k % 5 = 0 THEN ['ptr', '{{ i32, i32 }}'] WHEN thin AND k % 4 = 0 THEN ['i64', 'ptr'] ELSE ['i32', 'ptr'] END AS args,
        1 + count(*) FILTER (WHERE o_orderstatus = 'O' AND (NOT thin OR o_orderkey % 3 = 0)) AS blocks, 1 + count(*) FILTER (WHERE o_orderstatus = 'F' AND (NOT thin OR o_orderkey % 3 = 0)) AS instrs
      FROM k CROSS JOIN (VALUES (false), (true)) t(thin) LEFT JOIN orders ON o_custkey = k.k WHERE k.k % 13 <> 0 GROUP BY ALL)"""


def _within(a: str, b: str, tolerance: float) -> str:
    return f"greatest({a}, {b}) / least({a}, {b}) <= {tolerance}"


def _issues(l: str, r: str, tolerance_i: float, tolerance_b: float) -> str:
    return f"""CASE WHEN {l}.k IS NULL AND {r}.k IS NULL THEN ['missing on the left', 'missing on the right'] WHEN {l}.k IS NULL THEN ['missing on the left'] WHEN {r}.k IS NULL THEN ['missing on the right']
        ELSE list_filter(list_concat([CASE WHEN {l}.ret <> {r}.ret THEN 'return types differ' END, CASE WHEN len({l}.args) <> len({r}.args) THEN 'argument counts differ' END],
          CASE WHEN len({l}.args) = len({r}.args) THEN [CASE WHEN {l}.args[1] <> {r}.args[1] THEN 'argument 0: ' || {l}.args[1] || ', ' || {r}.args[1] END, CASE WHEN {l}.args[2] <> {r}.args[2] THEN 'argument 1: ' || {l}.args[2] || ', ' || {r}.args[2] END] END,
          [CASE WHEN NOT {_within(f"{l}.instrs", f"{r}.instrs", tolerance_i)} THEN 'instruction counts too far apart' END, CASE WHEN NOT {_within(f"{l}.blocks", f"{r}.blocks", tolerance_b)} THEN 'block counts too far apart' END]), lambda x: x IS NOT NULL) END"""


# --- compile databases: an entry a part -------------------------------------------------------------


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with argument lists and command lines, relative and absolute files, flags of every kind."""
    k = F.col("p_partkey")
    file = F.when(k % 5 == 0, _text("/abs/p", k, ".c")).otherwise(_text("sub/../p", k, ".c"))
    flags = F.array(F.lit("cc"), F.lit("-O2"), _text("-DX=", k % 3), F.lit("-I"), F.lit("gone"), F.lit("-include"), F.lit("a b.h"), F.lit("-Iinc"), F.lit("-Wall"), F.when(k % 2 == 0, "-std=c11").otherwise("-stdx"), F.lit("-isystem"), F.lit("@SYS@/usr"), F.lit("-fno-common"), F.lit("-m64"), F.lit("-c"), file)
    line = F.array_join(F.transform(flags, lambda t: F.when(t.contains(" "), F.concat(F.lit("'"), t, F.lit("'"))).otherwise(t)), "  ")
    return _tables(spark, sf_dir, "part")[0].select(file.alias("file"), F.when(k % 3 == 0, "/w/./x").otherwise("rel").alias("directory"), F.when(k % 4 != 0, flags).alias("arguments"), F.when(k % 4 == 0, line).alias("command"))


def build_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a value for the sentinel, and without one, which drops its flag."""
    out = None
    for mode, value, copts in (("ast", "/sys", ("-w",)), ("llvm", None, ())):
        rows = compdb.commands(entries(spark, sf_dir), mode, ["*p*1.c", "/abs/*"], {"@SYS@": value}, copts).select(F.lit(mode).alias("mode"), "source", compdb.quoted(F.col("cmd")).alias("cmd"), "out")
        out = rows if out is None else out.unionByName(rows)
    return out


def run_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that don't exist fail, the rest are listed; every one has its macro file."""
    k = F.col("p_partkey")
    rows = compdb.commands(entries(spark, sf_dir), "ast")
    there = _tables(spark, sf_dir, "part")[0].where(k % 6 != 1).select(F.when(k % 5 == 0, _text("/abs/p", k, ".c")).when(k % 3 == 0, _text("/w/x/p", k, ".c")).otherwise(_text("rel/p", k, ".c")).alias("path"), F.when(k % 2 == 0, "int M1;\nM1 M2").otherwise("m1").alias("text"))
    results = compdb.with_sources(rows, there.select("path")).select("source", "out", "error")
    facts = "failed array<struct<source:string,error:string>>, ok array<struct<source:string,ast_json:string>>, stats struct<total:long,succeeded:long,failed:long>"
    manifest = compdb.run_manifest(results, "ast", "db.json", "/").select(F.from_json("manifest", facts).alias("f"))
    sidecars = compdb.macro_files(results, there.withColumnRenamed("path", "source"), ["M1", "M2"])
    counted = sidecars.agg(F.count("*").alias("n_files"), F.count_if(F.col("value").contains('"M1":[{"line":1},{"line":2}]')).alias("n_hits"), F.count_if(F.col("value").contains('"hits":{}')).alias("n_without"))
    return manifest.select("f.stats.*", F.size("f.ok").cast("long").alias("n_ok"), F.col("f.failed")[0]["source"].alias("first_failed"), F.col("f.failed")[0]["error"].alias("error"), F.col("f.ok")[0]["ast_json"].alias("first_out")).join(counted, F.lit(True))


def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's manifest written as lines and read back."""
    k = F.col("p_partkey")
    there = _tables(spark, sf_dir, "part")[0].where(k % 6 != 1).select(F.when(k % 5 == 0, _text("/abs/p", k, ".c")).when(k % 3 == 0, _text("/w/x/p", k, ".c")).otherwise(_text("rel/p", k, ".c")).alias("path"))
    results = compdb.with_sources(compdb.commands(entries(spark, sf_dir), "ast"), there).select("source", "out", "error")
    path = work_path(spark, "manifest")
    compdb.write_manifest(compdb.manifest_lines(results, "ast", "db.json", "/"), path)
    return compdb.read_manifest(spark, path)


_ENTRIES = """e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN '/abs/p' || p_partkey || '.c' WHEN p_partkey % 3 = 0 THEN '/w/x/p' || p_partkey || '.c' ELSE 'rel/p' || p_partkey || '.c' END AS source FROM part)"""


# --- SQL sources: a file each ten parts ---------------------------------------------------------------


def sql_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, sql, dialect: objects defined, replaced and dropped in path order, with comment marks and semicolons in literals."""
    k = F.col("p_partkey")
    table = _text("CREATE TABLE IF NOT EXISTS s.\"T", k % 97, "\" (a text DEFAULT 'x--y;/*', b int", k, "); -- c; d\n")
    function = _text("/* ; */ create or replace function f", k % 31, "() returns int as $q$ select ", k, "; $q$;\n")
    quoted = F.when(k % 8 == 0, '"').otherwise("")  # without quotes it is another object
    drop = F.when(k % 4 == 0, _text("drop table if exists s.", quoted, "T", k % 97, quoted, " ;")).otherwise("select 1;")
    rows = _tables(spark, sf_dir, "part")[0].withColumn("file", F.floor(k / 10))
    files = rows.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), F.concat(table, function, drop).alias("t")))), lambda x: x["t"]), "\n").alias("sql"))
    once = files.select(F.concat(F.lit("m/"), F.lpad(F.col("file").cast("string"), 8, "0"), F.lit(".sql")).alias("path"), "sql", F.lit("postgres").alias("dialect"))
    return once.unionByName(once.where("path LIKE '%5.sql'"))  # a file reached twice


def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of every file, with what each defines."""
    sources = sql_files(spark, sf_dir)
    return ddl.parsed(ddl.statements(sources.join(ddl.one_dialect(sources), "dialect"))).select("path", F.col("seq").cast("long").alias("seq"), "action", "kind", "name", "statement")


def sql_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands at the end, in each output format."""
    found = written(ddl.catalog(ddl.statements(sql_files(spark, sf_dir))), "catalog")
    out = None
    for kind in ("json", "ttl", "lean"):
        rows = ddl.snapshot(found, kind).select(F.lit(kind).alias("format"), "kind", "name", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def schema_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all files that a target reaches through its dependencies, each file once a target."""
    sources = sql_files(spark, sf_dir).select("path", "sql", "dialect")
    deps = _tables(spark, sf_dir, "nation")[0].select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("dst"))
    owned = sources.distinct().withColumn("target", F.concat(F.lit("n"), F.pmod(F.regexp_extract("path", r"(\d+)", 1).cast("long"), F.lit(25)).cast("string")))
    found = ddl.aspect(deps, owned, {"postgres": "pg"})
    return found.groupBy("src").agg(F.count("*").alias("n_statements"), F.count_distinct("path").alias("n_files"), F.count_if(F.col("toolchain") == "pg").alias("n_parsed"))


_SQL_ROWS = """p AS (SELECT p_partkey AS k, 'm/' || lpad((p_partkey // 10)::VARCHAR, 8, '0') || '.sql' AS path, 3 * (row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) - 1) AS pos FROM part),
st AS (SELECT path, pos AS seq, 'create' AS action, 'table' AS kind, 's."T' || k % 97 || '"' AS name, 'CREATE TABLE IF NOT EXISTS s."T' || k % 97 || '" (a text DEFAULT ''x--y;/*'', b int' || k || ')' AS statement FROM p
  UNION ALL SELECT path, pos + 1, 'create', 'function', 'f' || k % 31, 'create or replace function f' || k % 31 || '() returns int as $q$ select ' || k || '; $q$' FROM p
  UNION ALL SELECT path, pos + 2, CASE WHEN k % 4 = 0 THEN 'drop' END, CASE WHEN k % 4 = 0 THEN 'table' END, CASE WHEN k % 8 = 0 THEN 's."T' || k % 97 || '"' WHEN k % 4 = 0 THEN 's.t' || k % 97 END, CASE WHEN k % 8 = 0 THEN 'drop table if exists s."T' || k % 97 || '"' WHEN k % 4 = 0 THEN 'drop table if exists s.T' || k % 97 ELSE 'select 1' END FROM p)"""
_SQL_CATALOG = f"""{_SQL_ROWS}, c AS (SELECT * FROM st WHERE action IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY path DESC, seq DESC) = 1)"""


# --- jobs: an event a job -----------------------------------------------------------------------------

def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, fn, status, reason of every event as a job: inputs that are missing skip it, codes and outputs decide."""
    events = _tables(spark, sf_dir, "events")[0].select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("cluster"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("fn"), "ts", "event_type", "value", "event_id", "user_id")
    rows = events.withColumn("a", F.concat(F.lit("in/"), (F.col("event_id") % 50).cast("string"))).withColumn("b", F.concat(F.lit("in/"), (F.col("event_id") % 7 + 100).cast("string")))
    files = spark.range(160).where("id % 10 <> 3").select(F.concat(F.lit("in/"), F.col("id").cast("string")).alias("path"))
    ready = jobs.with_missing(rows, files, ["a", "b"])
    codes = F.array(F.lit(0), F.when(F.col("event_type") == "error", 1).otherwise(0))
    return ready.withColumn("status", F.when(F.col("status") == "SKIP", "SKIP").otherwise(jobs.outcome(codes, F.col("event_id") % 20 != 0)))


def job_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of each cluster up to its first failure, in lines; totals and verdict of the run."""
    run = jobs.until_first_failure(job_results(spark, sf_dir), ["cluster"], ["ts", "event_id"])
    totals = jobs.rollup(run).select(F.col("status").alias("line"), "n")
    verdict = jobs.verdict(run).select(F.concat(F.lit("passed: "), F.col("all_passed").cast("string")).alias("line"), F.col("n_failed").alias("n"))
    return jobs.status_line(run).groupBy("line").agg(F.count("*").alias("n")).unionByName(totals).unionByName(verdict)


def job_one_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned jobs of one cluster, not run."""
    return jobs.dry_run(jobs.only_cluster(job_results(spark, sf_dir), "u1")).select("cluster", "fn", "status")


def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue file a supplier, its clusters' members in order, with paths below a root and the queue's defaults; some
    files can't be read."""
    k = F.col("s_suppkey")
    member = lambda i: _text('{fn = "g', k, f'_{i}", sibling_rs = "', "/abs/" if i == 1 else "", f'g{i}.rs", overrides_toml = "o', k, '.toml"}')
    members = F.array_join(F.slice(F.array(*(member(i) for i in range(3))), F.lit(1), (k % 4).cast("int")), ", ")
    defaults = F.when(k % 2 == 0, _text('[defaults]\ntensor = "t', k, '"\nengine = "/e"\n')).otherwise("")
    cluster = lambda c: _text(f'[[cluster]]\nname = "{c}', k, '"\ncanonical_fn = "f"\ncanonical_rs = "a.rs"\nout_dir = "/out"\nmember = [', members, "]\n")
    text = F.when(k % 10 == 7, "[[cluster]]\nname = ").when(k % 10 == 9, '[[cluster]]\nmember = [{fn = "x"}]').otherwise(F.concat(defaults, cluster("a"), cluster("b")))
    rows = jobs.load_queues(_tables(spark, sf_dir, "supplier")[0].select(_text("q", k, ".toml").alias("path"), text.alias("text")), "/repo")
    return rows.select("path", "cluster", F.col("seq").cast("long").alias("seq"), F.col("n").cast("long").alias("n"), "fn", "sibling_rs", "canonical_rs", "overrides_toml", "out_dir", F.col("defaults")["tensor"].alias("tensor"), F.col("defaults")["engine"].alias("engine"), F.split("error", ":")[0].alias("error"))


def override_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String tables of many TOML files; numbers become text, absent tables and files that can't be read give nothing."""
    k = F.col("s_suppkey")
    text = F.when(k % 11 == 5, "[idents").otherwise(F.concat(_text('[idents]\nA', k, ' = "x', k, '"\n"b c" = ', k, "\n"), F.when(k % 3 == 0, _text('[types]\nt = "u', k, '"\n')).otherwise("")))
    files = _tables(spark, sf_dir, "supplier")[0].select(_text("o", k, ".toml").alias("path"), text.alias("text"))
    return jobs.load_tables_of(files, ("idents", "types", "other"))


def job_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines and the last characters of every document."""
    docs = _tables(spark, sf_dir, "documents")[0]
    return docs.select("doc_id", F.sha2(jobs.tail_lines(F.col("text")), 256).alias("lines"), F.sha2(jobs.tail_chars(F.col("text")), 256).alias("chars"))


def packed_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package a conversation, a rendered file a turn; the manifest's bytes."""
    turns = _tables(spark, sf_dir, "conversations")[0]
    name = F.concat_ws("/", F.lit("f"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    spec = F.concat(F.when(F.col("role") == "user", "python").otherwise("lean"), F.lit(":o/"), F.col("turn").cast("string"), F.lit(":"), name)
    specs = turns.select("conv_id", "turn", jobs.render_spec(spec).alias("r")).select(F.col("conv_id").alias("package"), "turn", "r.*")
    sources = jobs.rendered(specs, turns.select(name.alias("path"), F.concat_ws(":", "role", F.length("text").cast("string")).alias("text")))
    one = lambda c: F.transform(F.col("l"), lambda x: x[c])
    lists = sources.groupBy("package").agg(F.sort_array(F.collect_list(F.struct("turn", "language", "out_path", "source"))).alias("l")).select("package", one("language").alias("languages"), one("out_path").alias("out_paths"), one("source").alias("sources"))
    packed = jobs.manifest_bytes(jobs.manifests(lists), F.concat(F.lit("c"), F.col("package").cast("string")), "1", "r", ("dep",))
    return packed.select(F.col("package").alias("conv_id"), F.lower(F.hex("manifest")).alias("manifest"))


def main_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program a nation and target, by the target's render function; an unknown target has none."""
    nation = _tables(spark, sf_dir, "nation")[0].select(F.concat(F.lit("M.N"), F.col("n_nationkey").cast("string")).alias("module"), F.lit("spec").alias("symbol"), F.when(F.col("n_nationkey") % 2 == 0, "python").otherwise("rust").alias("target"))
    return jobs.emitted(nation, {"python": "Py.render", "rust": "Rs.render"}).select("module", "target", "program")


def derived_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and types of parts, with overrides; pairs that neither side knows are left out."""
    part = _tables(spark, sf_dir, "part")[0]
    k = F.col("p_partkey").cast("string")
    idents = part.select(F.concat(F.lit("pg_f"), k).alias("canonical"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("PG_M"), k)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("low_"), k)).otherwise(F.concat(F.lit("pg_f"), k)).alias("sibling"))
    types = part.select(F.concat(F.lit("const pg_a_b"), k, F.lit(" *")).alias("canonical"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("volatile uint8_"), k, F.lit("[4]"))).when(F.col("p_partkey") % 5 == 0, F.lit("int (*)(void)")).otherwise(F.lit("const size_t")).alias("sibling"))
    overrides = {"ident_overrides": {"low_1": "ONE", "low_4": ""}, "type_overrides": {"pg_a_b1": "First"}, "extra_bindings": {"x": "y", "z": "z"}}
    return bindings.derive(idents, types, overrides)


def checked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers and orders taken where both sides know their values, and those left out."""
    customer, orders = _tables(spark, sf_dir, "customer", "orders")
    pairs = orders.select(F.col("o_custkey").cast("string").alias("k"), F.col("o_orderkey").cast("string").alias("v"))
    taken, ignored = bindings.valid_pairs(pairs, customer.where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("value")), orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("value")))
    return taken.withColumn("accepted", F.lit(True)).unionByName(ignored.withColumn("accepted", F.lit(False)))


_HEX = lambda x: f"lower(hex(encode({x})))"
_VARINT = lambda n: f"CASE WHEN {n} < 128 THEN printf('%02x', {n}) ELSE printf('%02x%02x', {n} % 128 + 128, {n} // 128) END"
_FIELD = lambda tag, x: f"'{tag}' || ({_VARINT(f'(length({x}) // 2)')}) || {x}"
_COMMAND = "CASE mode WHEN 'ast' THEN 'clang -Xclang -ast-dump=json -fsyntax-only' ELSE 'clang -S -emit-llvm -o -' END || ' -DX=' || k % 3 || ' -I -include ''a b.h'' -Iinc' || CASE WHEN k % 2 = 0 THEN ' -std=c11' ELSE '' END || ' -isystem' || CASE mode WHEN 'ast' THEN ' /sys/usr' ELSE '' END || ' -fno-common -m64' || CASE mode WHEN 'ast' THEN ' -w ' ELSE ' ' END || source"
_JOBS = """j AS (SELECT 'u' || user_id AS cluster, 'e' || event_id AS fn, ts, event_id, CASE WHEN event_id % 10 = 3 OR event_id % 7 = 3 THEN 'SKIP' WHEN event_type = 'error' OR event_id % 20 = 0 THEN 'FAIL' ELSE 'PASS' END AS status,
    'missing: ' || concat_ws(', ', CASE WHEN event_id % 7 = 3 THEN 'in/103' END, CASE WHEN event_id % 10 = 3 THEN 'in/' || event_id % 50 END) AS reason FROM events),
r AS (SELECT * FROM (SELECT *, coalesce(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) OVER (PARTITION BY cluster ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j) WHERE before = 0)"""

QUERIES = {f.__name__: f for f in (ir_functions, ir_comparison, ir_report, build_commands, run_outcome, manifest_rows, sql_statements, sql_catalog, schema_aspect, job_report, job_one_cluster, job_queue, override_tables, job_tails, packed_manifests, main_programs, derived_bindings, checked_pairs)}
ORACLE_SQL = {
    "ir_functions": f"WITH {_IR} SELECT 'd' || u || '.ll' AS path, 'f' || k AS name, ret AS return_type, array_to_string(args, '|') AS arg_types, blocks AS n_basic_blocks, instrs AS n_instructions FROM s WHERE NOT thin",
    "ir_comparison": f"""WITH {_IR}, l AS (SELECT * FROM s WHERE NOT thin), r AS (SELECT * REPLACE (CASE WHEN k = 1 THEN 3 ELSE k END AS k) FROM s WHERE thin AND k <> 3),
        i AS (SELECT k.k, {_issues("l", "r", 2.0, 2.0)} AS issues FROM k LEFT JOIN l ON l.k = k.k LEFT JOIN r ON r.k = k.k) SELECT 'f' || k AS name, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS passed FROM i""",
    "ir_report": f"""WITH {_IR}, l AS (SELECT * FROM s WHERE NOT thin), r AS (SELECT * FROM s WHERE thin),
        i AS (SELECT k.k, len({_issues("l", "r", 8.0, 5.0)}) AS n FROM k LEFT JOIN l ON l.k = k.k LEFT JOIN r ON r.k = k.k),
        t AS (SELECT max(length('f' || k))::BIGINT AS width, count(*) AS n_symbols, count(*) FILTER (WHERE n > 0) AS n_failed, sum(n)::BIGINT AS n_issues FROM i)
        SELECT *, (n_failed > 0)::BIGINT AS exit_code, CASE WHEN n_failed > 0 THEN n_failed || '/' || n_symbols || ' symbols failed' ELSE 'all ' || n_symbols || ' symbols passed' END AS line FROM t""",
    "build_commands": f"WITH {_ENTRIES} SELECT mode, source, {_COMMAND} AS cmd, ltrim(source, '/') || CASE mode WHEN 'ast' THEN '.ast.json' ELSE '.ll' END AS out FROM e, (VALUES ('ast'), ('llvm')) t(mode) WHERE k % 10 = 1 OR k % 5 = 0",
    "run_outcome": f"""WITH {_ENTRIES} SELECT count(*) AS total, count(*) FILTER (WHERE k % 6 <> 1) AS succeeded, count(*) FILTER (WHERE k % 6 = 1) AS failed, count(*) FILTER (WHERE k % 6 <> 1) AS n_ok, min(source) FILTER (WHERE k % 6 = 1) AS first_failed,
        'source file not found: ' || min(source) FILTER (WHERE k % 6 = 1) AS error, ltrim(min(source) FILTER (WHERE k % 6 <> 1), '/') || '.ast.json' AS first_out, count(*) AS n_files, count(*) FILTER (WHERE k % 6 <> 1 AND k % 2 = 0) AS n_hits, count(*) FILTER (WHERE k % 6 = 1 OR k % 2 = 1) AS n_without FROM e""",
    "manifest_rows": f"WITH {_ENTRIES} SELECT source, ltrim(source, '/') || '.ast.json' AS out, NULL::VARCHAR AS error FROM e WHERE k % 6 <> 1 UNION ALL SELECT source, NULL, 'source file not found: ' || source FROM e WHERE k % 6 = 1",
    "sql_statements": f"WITH {_SQL_ROWS} SELECT path, seq::BIGINT AS seq, action, kind, name, statement FROM st",
    "sql_catalog": f"""WITH {_SQL_CATALOG}, q AS (SELECT kind, name, replace(statement, '"', '\\"') AS d, replace(name, '"', '\\"') AS e FROM c WHERE action = 'create')
        SELECT 'json' AS format, kind, name, '{{"kind":"' || kind || '","name":"' || e || '","definition":"' || d || '"}}' AS value FROM q
        UNION ALL SELECT 'ttl', kind, name, '<urn:sql:' || kind || ':' || replace(name, '"', '%22') || '> c:definition "' || d || '" .' FROM q UNION ALL SELECT 'lean', kind, name, '  ("' || kind || '", "' || e || '", "' || d || '"),' FROM q""",
    "schema_aspect": """WITH f AS (SELECT p_partkey // 10 AS f, 'n' || (p_partkey // 10) % 25 AS t, 3 * count(*) AS n FROM part GROUP BY ALL),
        r AS (SELECT 'n' || n_nationkey AS src, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation)
        SELECT src, sum(n)::BIGINT AS n_statements, count(*) AS n_files, sum(n)::BIGINT AS n_parsed FROM r JOIN f USING (t) GROUP BY src""",
    "job_report": f"""WITH {_JOBS} SELECT rpad(status, 5, ' ') || rpad(cluster, 24, ' ') || rpad(fn, 40, ' ') || CASE WHEN status = 'SKIP' THEN reason ELSE '' END AS line, count(*) AS n FROM r GROUP BY 1
        UNION ALL SELECT status, count(*) FROM r GROUP BY 1 UNION ALL SELECT 'passed: ' || bool_and(status = 'PASS'), count(*) FILTER (WHERE status = 'FAIL') FROM r""",
    "job_one_cluster": f"WITH {_JOBS} SELECT cluster, fn, 'DRY' AS status FROM j WHERE cluster = 'u1'",
    "job_queue": """WITH q AS (SELECT s_suppkey AS k, 'q' || s_suppkey || '.toml' AS path FROM supplier)
        SELECT path, c || k AS cluster, CASE c WHEN 'a' THEN 0 ELSE 1 END::BIGINT AS seq, i::BIGINT AS n, 'g' || k || '_' || i AS fn, CASE WHEN i = 1 THEN '/abs/g1.rs' ELSE '/repo/g' || i || '.rs' END AS sibling_rs, '/repo/a.rs' AS canonical_rs,
          '/repo/o' || k || '.toml' AS overrides_toml, '/out' AS out_dir, CASE WHEN k % 2 = 0 THEN '/repo/t' || k ELSE '/repo/' END AS tensor, CASE WHEN k % 2 = 0 THEN '/e' ELSE '/repo/' END AS engine, NULL::VARCHAR AS error
        FROM q, (VALUES ('a'), ('b')) t(c), range(3) r(i) WHERE i < k % 4 AND k % 10 NOT IN (7, 9)
        UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE k % 10 WHEN 7 THEN 'TOMLDecodeError' ELSE 'KeyError' END FROM q WHERE k % 10 IN (7, 9)""",
    "override_tables": """WITH q AS (SELECT s_suppkey AS k, 'o' || s_suppkey || '.toml' AS path FROM supplier WHERE s_suppkey % 11 <> 5)
        SELECT path, 'idents' AS "table", 'A' || k AS k, 'x' || k AS v FROM q UNION ALL SELECT path, 'idents', 'b c', k::VARCHAR FROM q UNION ALL SELECT path, 'types', 't', 'u' || k FROM q WHERE k % 3 = 0""",
    "job_tails": "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[-8:], chr(10))) AS lines, sha256(right(text, 800)) AS chars FROM documents",
    "packed_manifests": f"""WITH t AS (SELECT conv_id, turn, '08' || CASE WHEN role = 'user' THEN '02' ELSE '04' END AS l, {_HEX("'o/' || turn")} AS o, {_HEX("role || coalesce(':' || length(text), '')")} AS s FROM conversations),
        a AS (SELECT conv_id, turn, l || {_FIELD("12", "o")} || {_FIELD("1a", "s")} AS r FROM t), b AS (SELECT conv_id, turn, {_FIELD("12", "r")} AS u FROM a), c AS (SELECT conv_id, string_agg({_FIELD("12", "u")}, '' ORDER BY turn) AS us FROM b GROUP BY 1),
        d AS (SELECT *, {_HEX("'c' || conv_id")} AS n FROM c), e AS (SELECT *, {_FIELD("0a", "n")} || '1201311a0172' AS i FROM d)
        SELECT conv_id, {_FIELD("0a", "i")} || us || '1a03646570' AS manifest FROM e""",
    "main_programs": """SELECT 'M.N' || n_nationkey AS module, CASE WHEN n_nationkey % 2 = 0 THEN 'python' ELSE 'rust' END AS target,
        'import M.N' || n_nationkey || chr(10) || 'def main : IO Unit := IO.print (' || CASE WHEN n_nationkey % 2 = 0 THEN 'Py' ELSE 'Rs' END || '.render M.N' || n_nationkey || '.spec)' || chr(10) AS program FROM nation""",
    "derived_bindings": """SELECT 'pg_f' || p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'PG_M' || p_partkey WHEN p_partkey = 1 THEN 'ONE' ELSE 'LOW_' || p_partkey END AS v FROM part WHERE p_partkey % 3 <> 2
        UNION ALL SELECT CASE WHEN p_partkey = 1 THEN 'First' ELSE 'AB' || p_partkey END, CASE WHEN p_partkey % 2 = 0 THEN 'uint8_' || p_partkey ELSE 'usize' END FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 <> 0 UNION ALL SELECT 'x', 'y'""",
    "checked_pairs": "SELECT o_custkey::VARCHAR AS k, o_orderkey::VARCHAR AS v, o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS accepted FROM orders",
}
