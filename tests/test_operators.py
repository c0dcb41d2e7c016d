import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sylvan.operators import bindings, closure, compdb, ddl, dictionary, jobs, text, textir
from sylvan.sources import exchange, readers, writers
from sylvan.streaming import events


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr).head()[0]


def test_flags(spark):
    cases = {
        "-I dir -O2 -Iinc": ["-I", "-Iinc"],  # the separate argument of -I goes
        "-isystem sys -pthread -Wall": ["-isystem", "sys", "-pthread"],
        "-DX=1 -target": ["-DX=1", "-target"],
        "-include": [],
        "": [],
    }
    for given, kept in cases.items():
        assert one(spark, compdb.kept_flags(F.split("x", " ")), x=given) == kept


def test_argv_and_commands(spark):
    rows = spark.createDataFrame([("a.c", "src", None, "cc -DA='b c' -I x a.c"), ("/abs/b.c", None, ["cc", "-m32"], None)], "file string, directory string, arguments array<string>, command string")
    got = {r["source"]: (r["flags"], r["cmd"][-1], r["out"]) for r in compdb.commands(rows, "ast").collect()}
    assert got == {"src/a.c": (["-DA=b c", "-I"], "src/a.c", "src/a.c.ast.json"), "/abs/b.c": (["-m32"], "/abs/b.c", "abs/b.c.ast.json")}
    with pytest.raises((PySparkException, Py4JJavaError)):
        compdb.argv(spark.createDataFrame([("a.c", None, None, None)], "file string, directory string, arguments array<string>, command string")).collect()
    assert [r["source"] for r in compdb.commands(rows, "llvm", ["*.c"]).collect()] and compdb.commands(rows, "ast", ["a?c"]).count() == 1
    assert one(spark, compdb.substituted(F.array(F.lit("-I@R/x"), F.lit("-I@N")), {"@R": "/r", "@N": None})) == ["-I/r/x"]
    assert one(spark, compdb.quoted(F.array(F.lit("a"), F.lit("b 'c")))) == "a 'b '\"'\"'c'"


def test_macro_hits(spark):
    files = spark.createDataFrame([("a", "PG_TRY x PG_TRY\nmy_PG_TRY\nPG_TRY2 éPG_TRY\nPG_TRY"), ("b", None)], "source string, text string")
    got = {r["source"]: r["hits"] for r in compdb.macro_hits(files, ["PG_TRY", "NONE"]).collect()}
    assert [h["line"] for h in got["a"]["PG_TRY"]] == [1, 4] and got["b"] == {}


def test_run_manifest(spark):
    rows = spark.createDataFrame([("a", "a.json", None), ("b", None, "bad")], "source string, out string, error string")
    import json

    got = json.loads(compdb.run_manifest(rows, "ast", "c.json", "/r").head()[0])
    assert got["stats"] == {"total": 2, "succeeded": 1, "failed": 1} and got["ok"] == [{"source": "a", "ast_json": "a.json"}] and got["failed"] == [{"source": "b", "error": "bad"}]


IR = """; comment
define dso_local i32 @f(i32 noundef %0, { i32, ptr } %p, ptr captures(address, read(x)) align 8 %q) #0 {
entry: ; first
  %1 = add i32 %0, 1

  switch i32 %1, label %a [
    i32 0, label %b
  ]
a:
  ret i32 %1
}
define void @"g"() {
  ret void
}
define void @"g"() {
  call void @h()
  ret void
}
define void @open() {
  ret void
"""


def test_functions_of_text_ir(spark):
    got = {r["name"]: r for r in textir.functions(spark.createDataFrame([("x.ll", IR)], "path string, text string")).collect()}
    assert set(got) == {"f", "g"}
    assert (got["f"]["return_type"], got["f"]["arg_types"], got["f"]["n_basic_blocks"], got["f"]["n_instructions"]) == ("i32", ["i32", "{ i32, ptr }", "ptr"], 3, 5)
    assert (got["g"]["n_instructions"], got["g"]["n_basic_blocks"], got["g"]["arg_types"]) == (2, 1, [])


def test_gate(spark):
    side = lambda *rows: spark.createDataFrame(rows, "name string, return_type string, arg_types array<string>, n_basic_blocks long, n_instructions long")
    left = side(("f", "i32", ["i32", "ptr"], 1, 10), ("g", "void", [], 1, 0), ("h", "void", ["ptr"], 1, 1))
    right = textir.renamed(side(("f2", "i32", ["i64", "ptr"], 1, 81), ("g", "void", [], 1, 0), ("h", "i1", [], 1, 1)), {"f2": "f"})
    want = spark.createDataFrame([("f",), ("g",), ("h",), ("z",)], "name string")
    got = {r["name"]: (r["passed"], r["issues"]) for r in textir.compare(want, left, right).collect()}
    assert got["g"] == (True, [])
    assert got["f"] == (False, ["argument 0: i32, i64", "instruction counts too far apart"])
    assert got["h"] == (False, ["return types differ", "argument counts differ"])
    assert got["z"] == (False, ["missing on the left", "missing on the right"])
    assert [one(spark, textir.within(F.lit(a), F.lit(b), 8.0)) for a, b in ((0, 0), (0, 1), (1, 8), (1, 9))] == [True, False, True, False]
    assert {r["name"] for r in textir.renamed(left, {"f": "g"}).collect()} == {"g", "h"} and {r["name"] for r in textir.renamed(left, {"no": "g"}).collect()} == {"f", "g", "h"}


def test_naming(spark):
    types = {"pg_sha256_ctx *": "Sha256Ctx", "const uint32[8]": "u32", "volatile size_t": "usize", "Foo": "Foo"}
    for given, name in types.items():
        assert one(spark, bindings.type_name(F.col("x")), x=given) == name
    for given, name in {"block_len": "BLOCK_LEN", "pg_do_it": "pg_do_it", "PG_MAX": "PG_MAX", "plain": "plain", "Mixed_x": "Mixed_x"}.items():
        assert one(spark, bindings.ident_name(F.col("x")), x=given) == name


def test_binding_conflicts_and_overrides(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "canonical string, sibling string")
    none = spark.createDataFrame([], "canonical string, sibling string")
    got = bindings.derive(rows(("a_b", "c_d"), ("a_b", "c_d"), ("same_x", "same_x"), ("o_o", "p_p")), rows(("int (*)(int)", "x"), ("T *", "U")), {"ident_overrides": {"o_o": "", "p_p": "Q"}, "type_overrides": {"T": ""}, "extra_bindings": {"e": "f"}})
    assert {tuple(r) for r in got.collect()} == {("A_B", "C_D"), ("O_O", "Q"), ("", "U"), ("e", "f")}
    with pytest.raises((PySparkException, Py4JJavaError)):
        bindings.derive(rows(("a_b", "c_d"), ("a_b", "e_f")), none).collect()
    pairs = spark.createDataFrame([("a", "x"), ("b", "x")], "k string, v string")
    ok, bad = bindings.valid_pairs(pairs, spark.createDataFrame([("a",)], "value string"), spark.createDataFrame([("x",)], "value string"))
    assert ok.collect() == [("a", "x")] and bad.collect() == [("b", "x")]


def test_catalog_fold(spark):
    rows = [
        ("02.sql", "CREATE TABLE t (a int, b text DEFAULT ';'); DROP TYPE mood;", "postgres"),
        ("01.sql", "-- c;\nCREATE SCHEMA s; CREATE TYPE mood AS ENUM ('a'); CREATE TABLE t (a int); CREATE DOMAIN d AS int;", "postgres"),
        ("03.sql", "CREATE OR REPLACE FUNCTION f() RETURNS int AS $$ SELECT 1; $$ LANGUAGE sql; SELECT 1", "postgres"),
        ("01.sql", "CREATE SCHEMA twice", "postgres"),
    ]
    src = spark.createDataFrame(rows[:3], "path string, sql string, dialect string")
    got = {(r["kind"], r["name"]): r["definition"] for r in ddl.catalog(ddl.statements(src)).collect()}
    assert set(got) == {("schema", "s"), ("domain", "d"), ("table", "t"), ("function", "f")}
    assert got["table", "t"] == "CREATE TABLE t (a int, b text DEFAULT ';')" and "SELECT 1;" in got["function", "f"]
    assert ddl.snapshot(ddl.catalog(ddl.statements(src)), "ttl").count() == 4
    assert ddl.one_dialect(src).head()[0] == "postgres" and ddl.one_dialect(src.limit(0)).head()[0] == "postgres"
    with pytest.raises((PySparkException, Py4JJavaError)):
        ddl.one_dialect(src.unionByName(src.withColumn("dialect", F.lit("sqlite")))).collect()


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    assert {tuple(r) for r in closure.closure(e).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}
    assert {r["dst"] for r in closure.reachable(spark.createDataFrame([(4,)], "src long"), e).collect()} == {4}


def test_jobs(spark):
    queue = jobs.load_queue(spark, '[[cluster]]\nname="c"\ncanonical_fn="f"\ncanonical_rs="f.rs"\nout_dir="o"\n[[cluster.member]]\nfn="g"\nsibling_rs="g.rs"\noverrides_toml="g.toml"\n')
    files = spark.createDataFrame([("f.rs",), ("g.rs",)], "path string")
    got = jobs.with_missing(queue, files, ["canonical_rs", "sibling_rs", "overrides_toml"]).head()
    assert (got["status"], got["reason"]) == ("SKIP", "missing: g.toml")
    assert jobs.only_cluster(queue, "c").count() == 1
    with pytest.raises((PySparkException, Py4JJavaError)):
        jobs.only_cluster(queue, "none").collect()
    done = spark.createDataFrame([("c", "a", 1, "PASS"), ("c", "b", 2, "SKIP"), ("c", "d", 3, "FAIL"), ("c", "e", 4, "PASS")], "cluster string, fn string, seq int, status string")
    assert [r["fn"] for r in jobs.until_first_failure(done, ["cluster"], ["seq"]).orderBy("seq").collect()] == ["a", "b", "d"]
    assert jobs.verdict(done).head() == (1, False) and jobs.verdict(done.where("status = 'SKIP'")).head() == (0, False)
    assert one(spark, jobs.tail_lines(F.lit("1\n2\n3"), 2)) == "2\n3"


def test_manifests(spark):
    rows = spark.createDataFrame([("p", ["rust", "sql"], ["a", "b"], ["x", "y"])], "package string, languages array<string>, out_paths array<string>, sources array<string>")
    assert [tuple(u) for u in jobs.manifests(rows).head()["units"]] == [(3, "a", "x"), (5, "b", "y")]
    for bad in ([("p", ["rust"], ["a", "b"], ["x"])], [("p", ["cobol"], ["a"], ["x"])]):
        with pytest.raises((PySparkException, Py4JJavaError)):
            jobs.manifests(spark.createDataFrame(bad, rows.schema)).collect()
    assert tuple(one(spark, jobs.render_spec(F.lit("rust:out/a.rs:dir:x")))) == ("RUST", "out/a.rs", "dir:x")


def test_vocabulary_and_encoding(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, ""), (5, None)], "at int, v string")
    vocab = dictionary.vocabulary(rows, "v", "at")
    assert sorted(tuple(r) for r in vocab.collect()) == [("a", 2), ("b", 1)]
    assert [r["i"] for r in dictionary.encode(rows, "v", vocab, "i").orderBy("at").collect()] == [1, 2, 1, 0, 0]


def test_whole_words(spark):
    got = [one(spark, text.whole_word(F.lit(x), "ab")) for x in ("ab", "xab", "ab_", "éab", "(ab)", "a.b")]
    assert got == [True, False, False, False, True, False]


def test_raw_arrays_round_trip(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("node_id"), *(F.lit(-1 if k == "i4" else 3).alias(n) for n, k in readers.ARRAYS.items()))
    exchange.write_arrays(rows, {"kinds": ["", "x"]}, str(tmp_path))
    made = json.loads((tmp_path / "manifest.json").read_text())
    assert made["num_nodes"] == 5 and made["bytes_per_node"] == 37
    assert exchange.load_tensor(spark, f"file://{tmp_path}", ("kind", "parent")).orderBy("node_id").collect() == [(i, 3, -1) for i in range(5)]
    assert readers.load_vocabulary(spark, f"file://{tmp_path}", "kinds").collect() == [(0, ""), (1, "x")]
    (tmp_path / "depth.u1").write_bytes(b"\x01")
    with pytest.raises((PySparkException, Py4JJavaError)):
        exchange.load_tensor(spark, f"file://{tmp_path}", ("kind", "depth")).collect()


def test_raw_arrays_by_ranges(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).select(F.col("id").alias("node_id"), *((F.col("id") % 100).alias(n) for n in readers.ARRAYS)).orderBy(F.rand(1))
    exchange.write_arrays(rows, {}, str(tmp_path / "a"))
    read = exchange.load_tensor(spark, str(tmp_path / "a"), ("kind", "end_line", "parent"), rows=64)
    assert read.rdd.getNumPartitions() == 16
    assert sorted(map(tuple, read.collect())) == [(i, i % 100, i % 100, i % 100) for i in range(1000)]
    part = exchange.load_tensor(spark, str(tmp_path / "a"), ("kind",), rows=64, first=130, end=190)
    assert sorted(r["node_id"] for r in part.collect()) == list(range(130, 190)) and part.rdd.getNumPartitions() == 1
    exchange.write_arrays(rows.limit(0), {}, str(tmp_path / "none"))
    assert exchange.load_tensor(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("wrong", ["node_id + 1", "if(node_id = 7, 8, node_id)", "node_id - 3"])
def test_raw_arrays_leave_nothing_behind(spark, tmp_path, wrong):
    rows = spark.range(20).select(F.col("id").alias("node_id"), *(F.lit(3).alias(n) for n in readers.ARRAYS))
    with pytest.raises(Exception):
        exchange.write_arrays(rows.withColumn("node_id", F.expr(wrong)), {}, str(tmp_path))
    with pytest.raises(Exception):
        exchange.write_arrays(rows.withColumn("depth", F.lit(256)), {}, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


def test_files_by_row(spark, tmp_path):
    rows = [("a/b/c.txt", "one\n"), ("a/d.txt", ""), ("top.txt", "é"), ("top.txt", "a"), ("n.txt", None)]
    exchange.write_files(spark.createDataFrame(rows, "path string, value string").repartition(3), f"file://{tmp_path}/out")
    got = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert got == {"a/b/c.txt": "one\n", "a/d.txt": "", "top.txt": "é", "n.txt": "", "_SUCCESS": "4"}
    for path in ("/x", "../x", "a/../../x", "a/", "", None):
        with pytest.raises(Exception):
            exchange.write_files(spark.createDataFrame([(path, "v")], "path string, value string"), f"{tmp_path}/bad")
    assert not (tmp_path / "bad" / "_SUCCESS").exists() and not (tmp_path / "x").exists()


def test_a_task_that_fails_leaves_no_trace(tmp_path):
    """A task that wrote half its rows and fails, then runs again: as if it had run once."""
    import pyarrow as pa

    batch = lambda ids: pa.RecordBatch.from_pydict({"node_id": ids, **{n: [k % 50 for k in ids] for n in readers.ARRAYS}})

    def broken():
        yield batch([0, 1, 2])
        raise RuntimeError("executor lost")

    w = exchange.ArraysWriter(str(tmp_path / "x"), list(readers.ARRAYS), {})
    with pytest.raises(RuntimeError):
        w.write(broken())
    done = [w.write(iter([batch([3]), batch([]), batch([4, 5])])), w.write(iter([batch([0, 1, 2])])), w.write(iter([batch([6, 7, 8, 9])])), None]
    with pytest.raises(ValueError):
        exchange.ArraysWriter(str(tmp_path / "y"), list(readers.ARRAYS), {}).commit(done[:1])
    w.commit(done)
    assert (tmp_path / "x" / "parent.i4").read_bytes() == b"".join(k.to_bytes(4, "little") for k in range(10))
    assert sorted(p.name for p in (tmp_path / "x").iterdir()) == sorted([*(f"{n}.{k}" for n, k in readers.ARRAYS.items()), "manifest.json"])

    f = exchange.FilesWriter(str(tmp_path / "f"))
    rows = pa.RecordBatch.from_pydict({"path": ["a/1", "a/2"], "value": ["x", "y"]})
    f.write(iter([rows]))
    f.commit([f.write(iter([rows])), None])
    assert sorted(str(p.relative_to(tmp_path / "f")) for p in (tmp_path / "f").rglob("*") if p.is_file()) == ["_SUCCESS", "a/1", "a/2"]


def test_manifest_documents(spark, tmp_path):
    (tmp_path / "a.c.json").write_text('{"kind": "X"}')
    (tmp_path / "b.c.json").write_text("{bad")
    m = tmp_path / "m"
    m.mkdir()
    (m / "run.json").write_text('{"ok": [{"source": "a.c", "ast_json": "out/a.c.json"}, {"source": "b.c", "ast_json": "b.c.json"}, {"source": "c.c", "ast_json": "c.c.json"}]}')
    good, bad = readers.manifest_documents(spark, f"file://{m}/run.json", f"file://{tmp_path}")
    assert [r["doc_id"] for r in good.collect()] == ["a.c"] and {r["doc_id"] for r in bad.collect()} == {"b.c", "c.c"}


def test_toml_bindings(spark):
    pairs = spark.createDataFrame([("b", 'x"y'), ("a", "z")], "k string, v string")
    pairs = pairs.select(F.lit('f"1').alias("canonical_fn"), F.lit("g").alias("sibling_fn"), "k", "v")
    made = writers.bindings_toml(pairs).head()["value"]
    assert made.startswith('canonical_fn = "f\\"1"\nsibling_fn = "g"\n\n') and made.endswith('[bindings]\n"a" = "z"\n"b" = "x\\"y"\n')


def test_stream_counts_equal_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/in")
    stream = events.windowed_counts(events.distinct_events(events.event_stream(spark, f"{tmp_path}/in", 1), "60 days"), late=None)
    events.run_once(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    # Windows that the watermark has not passed stay open; closed ones equal the batch result.
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.schema("start timestamp_ntz, event_type string, n long").parquet(f"{tmp_path}/out").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in batch.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n").collect()}
    assert got.items() <= want.items()


def test_manifest_files_of_one_name(spark, tmp_path):
    for d in "ab":
        (tmp_path / d).mkdir()
        (tmp_path / d / "u.c.json").write_text(f'{{"kind": "{d}"}}')
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "run.json").write_text('{"ok": [{"source": "a/u.c", "ast_json": "out/a/u.c.json"}, {"source": "b/u.c", "ast_json": "b/u.c.json"}, {"source": "c/u.c", "ast_json": "c/u.c.json"}]}')
    good, bad = readers.manifest_documents(spark, f"file://{tmp_path}/m/run.json", f"file://{tmp_path}")
    assert {tuple(r) for r in good.collect()} == {("a/u.c", '{"kind": "a"}'), ("b/u.c", '{"kind": "b"}')} and [r["doc_id"] for r in bad.collect()] == ["c/u.c"]


def test_statements_keep_literals(spark):
    sql = "CREATE TABLE t (a text DEFAULT 'x--y', b int); -- gone; \ncreate function f() as $a$ -- kept; /* $a$; /* ; */ DROP TABLE \"u;v\"; select 'it''s; /*'"
    got = [r["statement"] for r in ddl.statements(spark.createDataFrame([("p", sql, "postgres"), ("p", sql, "postgres")], "path string, sql string, dialect string")).orderBy("seq").collect()]
    assert got == ["CREATE TABLE t (a text DEFAULT 'x--y', b int)", "create function f() as $a$ -- kept; /* $a$", 'DROP TABLE "u;v"', "select 'it''s; /*'"]


def test_database_must_be_an_array(spark, tmp_path):
    (tmp_path / "ok.json").write_text('[{"file": "a.c", "arguments": ["cc", "-m64"]}, {"file": "b.c", "command": "cc b.c"}]')
    (tmp_path / "bad.json").write_text('{"file": "a.c"}')
    assert [r["file"] for r in compdb.read_entries(spark, f"file://{tmp_path}/ok.json").collect()] == ["a.c", "b.c"]
    with pytest.raises(Exception, match="no array"):
        compdb.read_entries(spark, f"file://{tmp_path}/bad.json").collect()


def test_renders_need_exactly_one_file(spark):
    specs = spark.createDataFrame([("PYTHON", "o", "f")], "language string, out_path string, file string")
    one = spark.createDataFrame([("f", "text")], "path string, text string")
    assert jobs.rendered(specs, one).head()["source"] == "text"
    for files in (one.unionByName(one), one.where("path <> 'f'")):
        with pytest.raises(Exception, match="exactly one file"):
            jobs.rendered(specs, files).collect()


def test_manifest_bytes_of_long_sources(spark):
    row = jobs.manifests(spark.createDataFrame([("p", ["python", "sql"], ["a", "b"], ["x" * 300, ""])], "package string, languages array<string>, out_paths array<string>, sources array<string>"))
    got = bytes(jobs.manifest_bytes(row, F.lit("pkg"), deps=("d",)).head()["manifest"])
    first = b"\x08\x02\x12\x01a\x1a\xac\x02" + b"x" * 300
    assert got == b"\x0a\x0c\x0a\x03pkg\x12\x050.0.0" + b"\x12\xb7\x02\x12\xb4\x02" + first + b"\x12\x07\x12\x05\x08\x05\x12\x01b" + b"\x1a\x01d"


def test_capabilities_and_toolchains(spark):
    rows = {tuple(r) for r in readers.capabilities(spark, {"sql": ("Parse",)}).collect()}
    assert rows == {("sql", "Parse"), ("sql", "Health"), ("sql", "Capabilities")}
    frame = spark.createDataFrame([("sql",), ("x",)], "d string")
    assert [r[0] for r in frame.select(ddl.toolchain(F.col("d"), {"sql": "t"})).collect()] == ["t", "x"]
    with pytest.raises(Exception, match="no toolchain"):
        frame.select(ddl.toolchain(F.col("d"), {"sql": "t"}, strict=True)).collect()


def test_loose_elements_of_a_page():
    from sylvan.operators.tree import page_rows

    got = [(r["kind"], r["depth"], r["size"]) for r in page_rows("1", "<div><p><b>x<br><p>y</p></b></div><b><p></b><p><div></p><p></div>")]
    assert got == [("div", 0, 5), ("p", 1, 3), ("b", 2, 2), ("br", 3, 1), ("p", 1, 1), ("b", 0, 2), ("p", 1, 1), ("p", 0, 3), ("div", 1, 2), ("p", 2, 1)]
    assert len(page_rows("1", "<br>" * 50_000)) == 50_000


def _sql(spark, *files, dialect="postgres"):
    return spark.createDataFrame([(p, t, dialect) for p, t in files], "path string, sql string, dialect string")


def test_names_and_quotes_of_sql(spark):
    sql = """CREATE TABLE "my table" (a int DEFAULT E'it\\'s; z'); CREATE TABLE "my other" (b int);
    CREATE TABLE "A" (x int); create table a (y int); /* a /* b */ ; c */ create unlogged table u (z int);
    create view V as select * from "my table" m join "my other" o on m.a = o.b; create unique index I on a (y);
    create table "if" (q int); create table "a.b" (q int); create materialized view s.m as select 1"""
    got = {(r["kind"], r["name"]) for r in ddl.catalog(ddl.statements(_sql(spark, ("p", sql)))).collect()}
    assert got == {("table", '"my table"'), ("table", '"my other"'), ("table", '"A"'), ("table", "a"), ("table", "u"), ("view", "v"), ("index", "i"), ("table", '"if"'), ("table", '"a.b"'), ("view", "s.m")}


def test_a_broken_statement_keeps_its_text_and_the_rest_goes_on(spark):
    from sylvan.operators import sqltext

    src = _sql(spark, ("p", "create table a (x int;\ncreate table b (x int); )\n; select 'open"))
    assert [(r["action"], r["statement"]) for r in ddl.parsed(ddl.statements(src)).orderBy("seq").collect()] == [(None, "create table a (x int"), ("create", "create table b (x int)"), (None, ")"), (None, "select 'open")]
    assert [(r["line"], r["col"], r["message"]) for r in sqltext.diagnostics(sqltext.sql_nodes(src)).orderBy("line", "col").collect()] == [(1, 22, "a bracket is open"), (2, 25, "a bracket is closed that is not open"), (3, 10, "a quote is open")]


def test_sqlite_tokens(spark):
    src = _sql(spark, ("p", "create table `a``b` (x); create table [c d] (y); /* no /* nesting */ create table e (z text default 'x''y')"), dialect="sqlite")
    assert {r["name"] for r in ddl.catalog(ddl.statements(src)).collect()} == {'"a`b"', '"c d"', "e"}
    assert ddl.statements(_sql(spark, ("p", "select 1"), dialect="unknown")).count() == 0


def test_renames_moves_and_drops_with_dependents(spark):
    files = (
        ("1.sql", "create schema s; create schema t; create table s.a (x int); create table s.b (y int); create index ia on s.a (x); create view v as select * from s.a; create view w as select * from v"),
        ("2.sql", "alter table s.a rename to c; alter table s.c set schema t; alter table t.c rename to d; create table s.a (new int)"),
        ("3.sql", "create view only_b as select * from s.b; drop table s.b cascade; create table s.e (z int); create table f (z int); create index fi on f (z); drop table f"),
        ("4.sql", "alter table nothing rename to something; drop table if exists s.gone; create function t.g(int) returns int as $$ select 1 $$; alter function t.g(int) rename to h"),
    )
    stmts = ddl.statements(_sql(spark, *files))
    got = {(r["kind"], r["name"]): (r["path"], r["seq"]) for r in ddl.catalog(stmts).collect()}
    assert got == {("schema", "s"): ("1.sql", 0), ("schema", "t"): ("1.sql", 1), ("table", "t.d"): ("1.sql", 2), ("index", "ia"): ("1.sql", 4), ("view", "v"): ("1.sql", 5), ("view", "w"): ("1.sql", 6), ("table", "s.a"): ("2.sql", 3), ("table", "s.e"): ("3.sql", 2), ("function", "t.h"): ("4.sql", 2)}
    assert {(r["action"], r["name"]) for r in ddl.missed(stmts).collect()} == {("rename", "nothing"), ("drop", "s.gone")}
    # The table that the views name goes under its new name, and they with it; so does a schema's content.
    more = ddl.statements(_sql(spark, *files, ("5.sql", "drop table t.d cascade; drop schema s cascade; create table s.z (k int)")))
    assert {(r["kind"], r["name"]) for r in ddl.catalog(more).collect()} == {("schema", "t"), ("table", "s.z"), ("function", "t.h")}
    assert ddl.catalog(more, fold=lambda s: ddl.parsed(s).where("kind = 'schema' AND action = 'create'").select("kind", "name", F.col("statement").alias("definition"), "path", "seq")).count() == 2


def test_a_long_chain_of_renames(spark):
    sql = "create table n0 (x int);" + "".join(f"alter table n{k} rename to n{k + 1};" for k in range(100))
    got = ddl.catalog(ddl.statements(_sql(spark, ("p", sql)))).collect()
    assert [(r["name"], r["definition"]) for r in got] == [("n100", "create table n0 (x int)")]
    back = ddl.catalog(ddl.statements(_sql(spark, ("p", "create table a (x int); alter table a rename to b; alter table b rename to a; alter table a rename to b; drop table b")))).count()
    assert back == 0


def test_levels_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "a"), ("a", "b")], "src string, dst string")
    assert {tuple(r) for r in closure.levels(e).collect()} == {("d", 0), ("b", 1), ("c", 1), ("a", 2), ("x", 3)}
    values = spark.createDataFrame([("d", "pg"), ("c", "lite"), ("c", "pg"), ("lone", "pg")], "node string, value string")
    assert {r["node"]: r["values"] for r in closure.along(e, values).collect()} == {"d": ["pg"], "b": ["pg"], "c": ["lite", "pg"], "a": ["lite", "pg"], "x": ["lite", "pg"], "lone": ["pg"]}
    assert closure.levels(e.limit(0)).count() == 0 and closure.along(e.limit(0), values).count() == 3
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")
    assert closure.levels(chain).where("node = 0").head()["level"] == 40
    with pytest.raises(ValueError, match="b, d$"):
        closure.levels(e.unionByName(spark.createDataFrame([("d", "b"), ("y", "x")], "src string, dst string")))


def test_whole_files_are_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    assert [r["text"] for r in readers.text_files(spark, f"file://{tmp_path}", "*.txt").collect()] == ["one\ntwo\n"]


def test_functions_of_one_structure(spark):
    from sylvan.operators import tree

    fn = lambda name, *kinds: {"kind": "FunctionDecl", "name": name, "inner": [{"kind": k, "name": name, "inner": [{"kind": "Leaf"}]} for k in kinds]}
    units = [("d1", {"kind": "U", "inner": [fn("f", "A", "B"), fn("g", "B", "A"), fn("h")]}), ("d0", {"kind": "U", "inner": [fn("k", "A", "B"), fn("", "A", "B")]})]
    nodes = tree.ast_nodes(spark.createDataFrame([(d, json.dumps(u)) for d, u in units], "doc_id string, source string"))
    assert {(r["ident"], r["class_doc"], r["class_fn"], r["n"]) for r in tree.function_classes(nodes).collect()} == {("f", "d0", "k", 2), ("k", "d0", "k", 2), ("g", "d1", "g", 1), ("h", "d1", "h", 1)}


def test_messages_read_and_written(spark):
    from sylvan.sources import messages

    schema = {"A": {1: ("n", "int64"), 2: ("s", "string"), 3: ("b", "B"), 4: ("z", "sint32"), 5: ("f", "bool"), 6: ("raw", "bytes"), 7: ("d", "double")}, "B": {1: ("b", "B"), 2: ("e", "Kind")}}
    cases = {
        "plain": ("08960112026869 2801 3202c3ff", [("int64", "n", "150"), ("string", "s", "hi"), ("bool", "f", "1"), ("bytes", "raw", "c3ff")]),
        "negative": ("08ffffffffffffffffff01", [("int64", "n", "-1")]),
        "nested": ("1a060a0410021003", [("B", "b", ""), ("B", "b", ""), ("Kind", "e", "2"), ("Kind", "e", "3")]),
        "zigzag": ("2003", [("sint32", "z", "-2")]),
        "double": ("39000000000000f83f", [("double", "d", "1.5")]),
        "unknown": ("1201ff 7a0161 0a0161", [("unknown", "2", "1201ff"), ("unknown", "15", "7a0161"), ("unknown", "1", "0a0161")]),
        "cut": ("0801 1a0510ff", [("int64", "n", "1"), ("error", "a field is cut off", "1a0510ff")]),
        "group": ("0801 0b", [("int64", "n", "1"), ("error", "wire type 3", "0b")]),
        "empty": ("", []),
    }
    rows = [(k, bytes.fromhex(v.replace(" ", ""))) for k, (v, _) in cases.items()] + [("none", None)]
    nodes = messages.message_nodes(spark.createDataFrame(rows, "doc_id string, source binary"), schema, "A").persist()
    got = {}
    for r in nodes.orderBy("doc_id", "node_id").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["type"], r["ident"]))
    assert got == {k: [("A", "", ""), *v] for k, (_, v) in cases.items()} | {"none": [("A", "", "")]}
    assert {r["doc_id"]: r["ok"] for r in messages.diagnostics(nodes).collect()} == {k: k not in ("cut", "group") for k in got}
    back = {r["doc_id"]: bytes(r["message"]) for r in messages.encoded(nodes.where("doc_id NOT IN ('zigzag', 'double', 'negative')"), schema).collect()}
    assert back == {k: v or b"" for k, v in rows if k not in ("zigzag", "double", "negative")}
    big = spark.createDataFrame([(k, 1 << k) for k in (0, 6, 7, 13, 14, 34, 35, 62)] + [(99, 0), (98, 127), (97, (1 << 63) - 1)], "k long, n long")
    for r in big.select("k", "n", messages._number(F.col("n")).alias("b")).collect():
        assert messages._varint(bytes(r["b"]), 0, len(r["b"])) == (r["n"], len(r["b"]))


def test_deep_messages_end(spark):
    from sylvan.sources import messages

    data = b""
    for _ in range(300):
        n, size = len(data), b""
        while n > 127:
            size += bytes([n & 127 | 128])
            n >>= 7
        data = b"\x0a" + size + bytes([n]) + data
    rows = messages.message_rows("d", data, {"B": {1: ("b", "B")}}, "B")
    assert max(r["depth"] for r in rows) == messages.DEEPEST and rows[-1]["kind"] == "unknown"


def test_trees_as_text(spark):
    from sylvan.operators import tree

    docs = [("d", json.dumps({"kind": "fn", "name": "f", "inner": [{"kind": "ret", "inner": [{"kind": "int", "name": "1"}]}, {"kind": "nop"}]})), ("e", json.dumps({"kind": "nop"}))]
    nodes = tree.ast_nodes(spark.createDataFrame(docs, "doc_id string, source string"))
    rust = {"fn": ("fn {}() { ", "; ", " }"), "ret": ("return ", "", ""), "nop": ("()", "", "")}
    assert {tuple(r) for r in tree.render(nodes, rust, ("{}", "", "")).select("doc_id", "value").collect()} == {("d", "fn f() { return 1; () }"), ("e", "()")}
    assert tree.render(nodes.limit(0), rust, ("{}", "", "")).count() == 0


def test_renames_in_order(spark):
    def plain(there, names):
        m = {k: k for k in there}
        for old, new in names.items():
            if old in m:
                was = m.pop(old)
                m.pop(new, None)
                m[new] = was
        return sorted((k, v) for k, v in m.items())

    for names in ({"a": "b"}, {"a": "b", "b": "c"}, {"x": "a"}, {"a": "x", "b": "a", "x": "b"}, {"a": "a"}, {"c": "b", "b": "d", "q": "d"}, {}):
        side = spark.createDataFrame([(k, k) for k in "abcde"], "name string, was string")
        assert sorted(tuple(r) for r in textir.renamed(side, names).collect()) == plain("abcde", names), names
    assert textir.renamed(spark.createDataFrame([("z", "z")], "name string, was string"), {"a": "b"}).collect() == [("z", "z")]


def test_arguments_of_any_text(spark):
    assert one(spark, textir.split_arguments(F.lit("i32 \u0001 %a, {i8, [2 x i8]} %b,ptr byval({i8, i8}) %c"))) == ["i32 \u0001 %a", "{i8, [2 x i8]} %b", "ptr byval({i8, i8}) %c"]
    assert one(spark, textir.split_arguments(F.lit("a,,b"))) == ["a", "", "b"] and one(spark, textir.split_arguments(F.lit(" "))) == []
    deep = "x(" * 100 + ")" * 100
    assert one(spark, textir.normal_type(F.lit(f"ptr {deep} noundef %v"))) == "ptr"


def test_a_stream_of_jobs_closes_what_is_idle(spark, tmp_path):
    from datetime import datetime, timedelta

    day = datetime(2024, 1, 1)
    jobs = lambda *rows: spark.createDataFrame([(c, i, day + timedelta(hours=h), s) for c, i, h, s in rows], "cluster string, event_id long, at timestamp, status string").write.mode("append").parquet(f"{tmp_path}/in")
    parts = (
        [("a", 1, 0, "PASS"), ("a", 2, 1, "FAIL"), ("a", 3, 2, "PASS"), ("b", 4, 1, "PASS")],
        [("b", 5, 0, "FAIL"), ("b", 6, 3, "PASS"), ("c", 7, 24 * 30, "PASS")],  # 5 comes after 4 was judged; c moves the watermark on
        [("c", 8, 24 * 30 + 1, "PASS")],
        [("a", 9, 24 * 30 + 2, "PASS"), ("a", 10, 5, "PASS")],  # a is new again; 10 is behind the watermark
    )
    for part in parts:
        jobs(*part)
        stream = spark.readStream.schema("cluster string, event_id long, at timestamp, status string").parquet(f"{tmp_path}/in")
        events.run_once(events.until_first_failure(stream, late="1 day", idle="7 days"), f"{tmp_path}/out", f"{tmp_path}/state", by=("verdict",))
    got = {(r["cluster"], r["event_id"]): (r["verdict"], r["n"]) for r in spark.read.schema(events.JUDGED).parquet(f"{tmp_path}/out").collect()}
    want = {("a", 1): ("run", 1), ("a", 2): ("run", 2), ("a", 3): ("stopped", 2), ("b", 4): ("run", 1), ("b", 5): ("late", 1), ("b", 6): ("run", 2), ("c", 7): ("run", 1), ("c", 8): ("run", 2), ("a", None): ("closed", 2), ("b", None): ("closed", 2), ("a", 9): ("run", 1)}
    assert {k: v for k, v in got.items() if k in want} == want and set(got) - set(want) <= {("a", 10)}
    assert (tmp_path / "out" / "verdict=late").exists()


def test_a_manifest_in_lines_is_the_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k:03}", f"o{k}", "gone" if k % 4 == 0 else None) for k in range(60)], "source string, out string, error string")
    for some in (rows, rows.where("error IS NULL"), rows.where("error IS NOT NULL"), rows.limit(0)):
        lines = compdb.manifest_lines(some, "llvm", "db", "/r")
        whole = json.loads("\n".join(r["value"] for r in lines.orderBy("section", "source").collect()))
        assert whole == json.loads(compdb.run_manifest(some, "llvm", "db", "/r").head()[0])
    compdb.write_manifest(compdb.manifest_lines(rows, "llvm", "db", "/r"), f"file://{tmp_path}/m")
    text = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert json.loads(text) == json.loads(compdb.run_manifest(rows, "llvm", "db", "/r").head()[0])
    assert sorted((r["source"], r["error"]) for r in compdb.read_manifest(spark, f"file://{tmp_path}/m").collect()) == sorted((r["source"], r["error"]) for r in rows.collect())
