"""Text IR: function records from lines, and the two-sided gate.

Files are split to lines and numbered; running counts of starts and ends over a file's lines tell which
function a line is in, so counting is one window and one grouped count, with no row-wise code.
Only the argument list needs a scan by bracket depth; that is one fold over its characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Argument attributes without parentheses.
BARE_ATTRIBUTES = (
    "allocalign", "allocptr", "byval", "captures", "dead_on_unwind", "immarg", "inalloca", "inreg", "noalias", "nocapture", "nofree", "nonnull", "norecurse",
    "noundef", "preallocated", "readonly", "returned", "signext", "sret", "swifterror", "swiftself", "willreturn", "writable", "writeonly", "zeroext",
)
_DEFINE = r'^define\s.*?(\S+)\s+@([A-Za-z0-9_$."]+)\s*\('


def argument_text(rest: Column) -> Column:
    """What stands in the parentheses that open just before rest."""
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    step = lambda a, c: F.when(a["depth"] == 0, a).otherwise(F.struct((a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"), (a["n"] + 1).alias("n")))
    end = F.aggregate(F.split(rest, ""), start, step)
    return F.substring(rest, F.lit(1), F.greatest(end["n"] - F.when(end["depth"] == 0, 1).otherwise(0), F.lit(0)))


def split_arguments(args: Column) -> Column:
    """Cuts at commas outside any brackets (P16); no arguments, no parts."""
    chars = F.transform(F.split(args, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    none = F.array().cast("array<int>")
    step = lambda a, x: F.struct(
        (a["depth"] + F.when(x["c"].isin("(", "[", "{"), 1).when(x["c"].isin(")", "]", "}"), -1).otherwise(0)).alias("depth"),
        F.concat(a["cuts"], F.when((x["c"] == ",") & (a["depth"] == 0), F.array(x["i"])).otherwise(none)).alias("cuts"),
    )
    cuts = F.aggregate(chars, F.struct(F.lit(0).alias("depth"), none.alias("cuts")), step)["cuts"]
    ends = F.concat(cuts, F.array(F.length(args)))
    part = lambda end, k: F.trim(F.substring(args, F.when(k == 0, 1).otherwise(F.get(cuts, k - 1) + 2), end - F.when(k == 0, 0).otherwise(F.get(cuts, k - 1) + 1)))
    return F.when(F.trim(args) == "", F.array().cast("array<string>")).otherwise(F.transform(ends, part))


#: An innermost attribute with parentheses, a value name, an alignment.
_ATTRIBUTE, _VALUE, _ALIGN = r"\b\w+\([^()]*\)", r"%[A-Za-z0-9_.]+", r"\balign\s+\d+\b"


def normal_type(arg: Column) -> Column:
    """An argument's type without attributes and value name (P15). Innermost attributes go first, again and again until
    none is left: each time takes a bracket, so there are no more times than brackets."""
    times = F.sequence(F.lit(0), F.regexp_count(arg, F.lit(r"\(")))
    stripped = F.aggregate(times, arg, lambda a, _: F.when(a.rlike(_ATTRIBUTE), F.regexp_replace(a, _ATTRIBUTE, "")).otherwise(a))
    named = F.regexp_replace(F.regexp_replace(stripped, _VALUE, ""), _ALIGN, "")
    return F.array_join(F.filter(F.split(F.trim(named), r"\s+"), lambda w: (w != "") & ~w.isin(*BARE_ATTRIBUTES)), " ")


def functions(files: DataFrame) -> DataFrame:
    """path, name, return_type, arg_types, n_basic_blocks, n_instructions, raw_signature.

    The entry block counts and so does each label. Any other line that isn't blank or a comment is an instruction. Of
    equal names in a file the last one stays; a function without its closing brace is left out.
    """
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", ";.*$", ""))
    is_def = F.col("raw").rlike(_DEFINE)
    order = Window.partitionBy("path").orderBy("pos")
    lines = lines.select("path", "pos", "raw", line.alias("line"), is_def.alias("is_def"))
    so_far = lines.withColumn("fn", F.sum(F.col("is_def").cast("int")).over(order)).where("fn > 0")
    closed = F.sum(F.when((F.col("line") == "}") & ~F.col("is_def"), 1).otherwise(0)).over(Window.partitionBy("path", "fn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    inside = so_far.withColumn("closed", F.coalesce(closed, F.lit(0))).where("closed = 0")
    body = ~F.col("is_def") & (F.col("line") != "}") & (F.col("line") != "")
    counted = inside.groupBy("path", "fn").agg(
        F.max(F.when(F.col("is_def"), F.col("raw"))).alias("raw_signature"),
        F.count_if((F.col("line") == "}") & ~F.col("is_def")).alias("ends"),
        (1 + F.count_if(body & F.col("line").endswith(":"))).alias("n_basic_blocks"),
        F.count_if(body & ~F.col("line").endswith(":")).alias("n_instructions"),
    )
    sig = F.col("raw_signature")
    rest = F.regexp_replace(sig, _DEFINE, "")
    found = counted.where("ends > 0").select(
        "path", "fn", F.regexp_replace(F.regexp_extract(sig, _DEFINE, 2), '"', "").alias("name"), F.regexp_extract(sig, _DEFINE, 1).alias("return_type"),
        F.transform(split_arguments(argument_text(rest)), lambda a: normal_type(a)).alias("arg_types"), "n_basic_blocks", "n_instructions", "raw_signature",
    )
    last = found.groupBy("path", "name").agg(F.max("fn").alias("fn"))
    return found.join(last, ["path", "name", "fn"], "left_semi").drop("fn")


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Both zero, or neither and the larger at most tolerance times the smaller."""
    return F.when((a == 0) & (b == 0), True).when((a == 0) | (b == 0), False).otherwise(F.greatest(a, b) / F.least(a, b) <= tolerance)


def renamed(side: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames symbols in the order given; one that takes an existing name replaces it, if what it renames is there.

    The order matters only among the names that the list has. Which of them are there is one small row; the list, followed
    over it, gives what each of them ends as, and one join applies that."""
    if not names:
        return side
    listed = sorted({*names, *names.values()})
    there = side.where(F.col("name").isin(listed)).agg(F.collect_set("name").alias("n"))
    steps = F.array(*(F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in names.items()))

    def follow(m: Column, r: Column) -> Column:
        kept = F.map_filter(m, lambda k, _: (k != r["old"]) & (k != r["new"]))
        return F.when(F.map_contains_key(m, r["old"]), F.map_concat(kept, F.map_from_arrays(F.array(r["new"]), F.array(F.element_at(m, r["old"]))))).otherwise(m)

    ends = there.select(F.explode(F.aggregate(steps, F.map_from_arrays("n", "n"), follow)).alias("_new", "_was"))
    met = side.join(ends, F.col("name") == F.col("_was"), "left")
    return met.where(F.col("_was").isNotNull() | ~F.col("name").isin(listed)).withColumn("name", F.coalesce("_new", "name")).drop("_new", "_was")


def compare(wanted: DataFrame, left: DataFrame, right: DataFrame, instructions: float = 8.0, blocks: float = 5.0) -> DataFrame:
    """name, issues, passed for each wanted name (J4, J11, A13). Differing argument counts hide argument types."""
    cols = ["return_type", "arg_types", "n_basic_blocks", "n_instructions"]
    one = lambda d, p: d.select("name", F.lit(True).alias(f"{p}_there"), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    both = wanted.select("name").join(one(left, "l"), "name", "left").join(one(right, "r"), "name", "left")
    l_args, r_args = F.col("l_arg_types"), F.col("r_arg_types")
    pairs = F.arrays_zip(l_args.alias("l"), r_args.alias("r"))
    args = F.filter(F.transform(pairs, lambda p, i: F.when(p["l"] != p["r"], F.format_string("argument %d: %s, %s", i, p["l"], p["r"]))), lambda x: x.isNotNull())
    missing = F.array(F.when(F.col("l_there").isNull(), F.lit("missing on the left")), F.when(F.col("r_there").isNull(), F.lit("missing on the right")))
    found = F.concat(
        F.array(F.when(F.col("l_return_type") != F.col("r_return_type"), F.lit("return types differ")), F.when(F.size(l_args) != F.size(r_args), F.lit("argument counts differ"))),
        F.when(F.size(l_args) == F.size(r_args), args).otherwise(F.array().cast("array<string>")),
        F.array(
            F.when(~within(F.col("l_n_instructions"), F.col("r_n_instructions"), instructions), F.lit("instruction counts too far apart")),
            F.when(~within(F.col("l_n_basic_blocks"), F.col("r_n_basic_blocks"), blocks), F.lit("block counts too far apart")),
        ),
    )
    issues = F.filter(F.when(F.col("l_there") & F.col("r_there"), found).otherwise(missing), lambda x: x.isNotNull())
    return both.select("name", issues.alias("issues")).withColumn("passed", F.size("issues") == 0)


def report(compared: DataFrame, verbose: bool = False) -> DataFrame:
    """One row (K12, A11): width of the widest symbol, symbols and failures, exit code, the closing line; with verbose
    also how many issues there are."""
    n, failed = F.count("*"), F.count_if(~F.col("passed"))
    rows = compared.agg(F.coalesce(F.max(F.length("name")), F.lit(0)).cast("long").alias("width"), n.alias("n_symbols"), failed.alias("n_failed"), F.coalesce(F.sum(F.size("issues")), F.lit(0)).alias("n_issues"))
    line = F.when(F.col("n_failed") > 0, F.format_string("%d/%d symbols failed", "n_failed", "n_symbols")).otherwise(F.format_string("all %d symbols passed", "n_symbols"))
    return rows.select("width", "n_symbols", "n_failed", (F.col("n_failed") > 0).cast("long").alias("exit_code"), line.alias("line"), *(["n_issues"] if verbose else []))


def equivalence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = lambda flag, c: rows.where(F.col("l_returnflag") == flag).groupBy("l_suppkey").agg(F.count("*").alias(c))
    both = one("A", "a").join(one("R", "r"), "l_suppkey", "full")
    a, r = F.coalesce("a", F.lit(0)), F.coalesce("r", F.lit(0))
    return both.select("l_suppkey", a.alias("a"), r.alias("r"), within(a, r, 1.25).alias("passed"))


QUERIES = {f.__name__: f for f in (equivalence_gate,)}
ORACLE_SQL = {
    "equivalence_gate": """WITH a AS (SELECT l_suppkey, count(*) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_suppkey, count(*) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
        b AS (SELECT l_suppkey, coalesce(a, 0) AS a, coalesce(r, 0) AS r FROM a FULL JOIN r USING (l_suppkey))
        SELECT *, CASE WHEN a = 0 AND r = 0 THEN true WHEN a = 0 OR r = 0 THEN false ELSE greatest(a, r) / least(a, r) <= 1.25 END AS passed FROM b""",
}
