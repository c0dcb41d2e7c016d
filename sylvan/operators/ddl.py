"""SQL sources, statements and the ordered catalog fold.

Statements come in path order, then place in the file. The fold follows every object through its names: a definition
opens a name, a drop closes it, a rename or a move to another schema closes one and opens another. What a statement
finds under a name is the last event on that name before it, by a window over the events of the name; what a renamed
object was first is found by following its renames, twice as far each round. Views depend on what they name, indexes on
their table: a drop takes a table's indexes with it, and with CASCADE all that depends on it, or all in a schema. A file
reached twice is folded once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.exchange import read_files
from ..work import written
from .closure import reachable
from .sqltext import DIALECTS, sql_nodes

KINDS = ("schema", "domain", "type", "table", "function", "view", "index", "sequence")
_KIND = "(" + "|".join(KINDS) + ")"
_PART = r'(?:[a-z_][a-z0-9_$]*|"(?:[^"]|"")+")'
_NAME = rf"(?!(?:on|if|only) ){_PART}(?:\.{_PART})*"
_CREATE = rf"^create (?:or replace )?(?:(?:global|local|temp|temporary|unlogged|materialized|recursive|unique|virtual|foreign) )*{_KIND} (?:concurrently )?(?:if not exists )?({_NAME})"
_DROP = rf"^drop (?:(?:materialized|foreign) )?{_KIND} (?:concurrently )?(?:if exists )?({_NAME}(?: \(\))?(?: , {_NAME}(?: \(\))?)*)(?: (cascade|restrict))?$"
_ALTER = rf"^alter (?:(?:materialized|foreign) )?{_KIND} (?:if exists )?(?:only )?({_NAME})(?: \(\))?"
_RENAME, _MOVE = rf"{_ALTER} rename to ({_PART})$", rf"{_ALTER} set schema ({_PART})$"


def sql_sources(spark: SparkSession, path: str, dialect: str = "postgres") -> DataFrame:
    """(path, sql, dialect) of every .sql file below path."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect}")
    return read_files(spark, path, "*.sql").select("path", F.col("text").alias("sql"), F.lit(dialect).alias("dialect"))


def one_dialect(sources: DataFrame) -> DataFrame:
    """One row with the dialect; more than one is an error, none means postgres."""
    found = sources.agg(F.sort_array(F.collect_set("dialect")).alias("d"))
    return found.select(F.when(F.size("d") > 1, F.raise_error(F.concat(F.lit("mixed dialects: "), F.array_join("d", ","))).cast("string")).otherwise(F.coalesce(F.get("d", F.lit(0)), F.lit("postgres"))).alias("dialect"))


def statements(sources: DataFrame) -> DataFrame:
    """path, dialect, seq, statement, head, refs: split at semicolons outside quotes, dollar quotes and comments (S13). Comments
    become a space, and only they: literals stay as they are. head: the tokens outside brackets, names in one form; refs: names
    after from, join, references and on. A path given more than once counts once (its least text)."""
    # So many partitions at least: a small shuffle would be read by one task, and the walk is dear.
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = sources.repartition(parts, "path").groupBy("path").agg(F.min(F.struct("sql", "dialect")).alias("s")).select("path", "s.*")
    found = sql_nodes(once, "statement", ("doc_id", "ord", "ident", "type", "ref_name")).where("ident <> ''")
    return found.select(F.col("doc_id").alias("path"), "dialect", F.col("ord").alias("seq"), F.col("ident").alias("statement"), F.col("type").alias("head"), F.from_json("ref_name", "array<string>").alias("refs"))


def _renamed(name: Column, part: Column, schema: bool) -> Column:
    """A name with another last part, or another schema."""
    last = F.regexp_extract(name, rf"({_PART})$", 1)
    return F.concat(part, F.lit("."), last) if schema else F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(last)), part)


def parsed(stmts: DataFrame) -> DataFrame:
    """Adds action (create, drop, rename, move), kind, name (the first), names, new_name and cascade. What is none of these has
    a null action and keeps its text (U9), as does a statement with an error in it."""
    h = F.col("head")
    forms = {"create": ("create", _CREATE), "drop": ("drop", _DROP), "rename": ("alter", _RENAME), "move": ("alter", _MOVE)}
    group = lambda k, i: F.regexp_extract(h, forms[k][1], i)
    # Each step reads what the one before found, so a pattern is tried once a statement, and only on its own word.
    fits = lambda k: h.startswith(f"{forms[k][0]} ") & ~h.contains("<error>") & (group(k, 1) != "")
    found = stmts.withColumn("action", F.coalesce(*(F.when(fits(k), F.lit(k)) for k in forms)))
    pick = lambda i: F.coalesce(*(F.when(F.col("action") == k, group(k, i)) for k in forms))
    found = found.withColumn("kind", pick(1)).withColumn("names", F.regexp_extract_all(pick(2), F.lit(rf"({_PART}(?:\.{_PART})*)"), F.lit(1)))
    name, is_ = F.get("names", F.lit(0)), lambda k: F.col("action") == k
    new = F.when(is_("rename"), _renamed(name, group("rename", 3), False)).when(is_("move"), _renamed(name, group("move", 3), True))
    return found.withColumn("name", name).withColumn("new_name", new).withColumn("cascade", F.coalesce(is_("drop"), F.lit(False)) & (group("drop", 3) == "cascade"))


def timeline(stmts: DataFrame) -> DataFrame:
    """kind, name, at (path, seq, n), op (open, close, use), action, cascade, by: the events on every name in its order, with
    last: the event before (use events aside), null for none. A name's events meet in one window, which spills."""
    return _timeline(parsed(stmts))


def _timeline(read: DataFrame) -> DataFrame:
    """The timeline of statements that are parsed; they are read more than once."""
    rows = read.where("action IS NOT NULL").select("*", F.posexplode("names").alias("n", "object"))
    at = F.struct("path", "seq", F.col("n").alias("n")).alias("at")
    event = lambda kind, name, op: F.struct(kind.alias("kind"), name.alias("name"), F.lit(op).alias("op"))
    kind, name = F.col("kind"), F.col("object")
    owned = F.when((F.col("action") == "create") & F.col("kind").isin("view", "index"), F.col("refs")).otherwise(F.array().cast("array<string>"))
    uses = F.flatten(F.transform(owned, lambda r: F.array(*(event(F.lit(k), r, "use") for k in ("table", "view")))))
    listed = F.when(F.col("action") == "create", F.concat(F.array(event(kind, name, "open")), uses)).when(F.col("action") == "drop", F.array(event(kind, name, "close"))).otherwise(F.array(event(kind, name, "close"), event(kind, F.col("new_name"), "open")))
    events = rows.select(at, "action", "cascade", kind.alias("of"), F.explode(listed).alias("e")).select("e.*", "at", "action", "cascade", "of")
    # A schema dropped with all in it closes every name in it.
    gone = events.where("op = 'close' AND kind = 'schema' AND cascade").select(F.col("name").alias("schema"), "at", "action", "cascade", "of")
    inside = events.where("op = 'open' AND kind <> 'schema'").select("kind", "name", F.regexp_extract("name", rf"^({_PART})\.", 1).alias("schema")).where("schema <> ''").distinct()
    events = events.unionByName(inside.join(gone, "schema").select("kind", "name", F.lit("close").alias("op"), "at", "action", "cascade", "of"))
    before = Window.partitionBy("kind", "name").orderBy("at", "op").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("last", F.last(F.when(F.col("op") != "use", F.struct("op", "at", "action")), ignorenulls=True).over(before))


def origins(events: DataFrame, rounds: int = 64) -> DataFrame:
    """at, root: every event that opens a name, with the definition that its object began as; no row for a rename of nothing."""
    opened = events.where("op = 'open'").select("at", "action")
    # A rename is one event on the old name, where what it found stands, and one on the new.
    moved = events.where("op = 'close' AND action IN ('rename', 'move') AND last.op = 'open'").select("at", F.col("last.at").alias("to"))
    steps = written(opened.where("action = 'create'").select("at", F.col("at").alias("to"), F.lit(True).alias("done")).unionByName(moved.withColumn("done", F.lit(False))), "renames")
    for _ in range(rounds):
        if steps.where("NOT done").isEmpty():
            return steps.select("at", F.col("to").alias("root"))
        further = steps.select(F.col("at").alias("to"), F.col("to").alias("next"), F.col("done").alias("end"))
        steps = written(steps.where("done").unionByName(steps.where("NOT done").join(further, "to").select("at", F.col("next").alias("to"), F.col("end").alias("done"))), "renames")
    raise RuntimeError("the renames did not settle")


def catalog(stmts: DataFrame, fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """kind, name, definition, path, seq of each object that stands at the end (A12), under its last name, with the statement that
    defined it. fold takes the place of this one (U2): it is given the statements and returns these columns."""
    if fold is not None:
        return fold(stmts)
    stmts = written(parsed(stmts), "statements")  # files are walked and statements parsed once
    events = written(_timeline(stmts), "events")
    roots = origins(events)
    last = events.where("op <> 'use'").groupBy("kind", "name").agg(F.max_by(F.struct("op", "at"), F.struct("at", "op")).alias("last"))
    standing = last.where("last.op = 'open'").select("kind", "name", F.col("last.at").alias("at")).join(roots, "at").select("kind", "name", "root")
    # Who depends on whom, by what they began as; index to table goes with every drop, the rest with CASCADE.
    needs = events.where("op = 'use' AND last.op = 'open'").select(F.col("at").alias("dependent"), F.col("of"), F.col("last.at").alias("at")).join(roots, "at").select(F.col("root").alias("src"), F.col("dependent").alias("dst"), "of")
    dropped = events.where("op = 'close' AND action = 'drop' AND last.op = 'open'").select(F.col("last.at").alias("at"), "cascade").join(roots, "at").select(F.col("root").alias("src"), "cascade")
    follows = needs.join(dropped.where("NOT cascade").select("src").distinct(), "src", "left_semi").where("of = 'index'").select("dst")
    lost = follows.unionByName(reachable(dropped.where("cascade").select("src"), needs.select("src", "dst").distinct()).select("dst")).distinct()
    found = standing.join(lost.withColumnRenamed("dst", "root"), "root", "left_anti")
    defined = stmts.select(F.col("path").alias("p"), F.col("seq").alias("s"), F.col("statement").alias("definition"))
    return found.join(defined, (F.col("root.path") == F.col("p")) & (F.col("root.seq") == F.col("s"))).select("kind", "name", "definition", F.col("p").alias("path"), F.col("s").alias("seq"))


def missed(stmts: DataFrame) -> DataFrame:
    """path, seq, action, kind, name of drops and renames that found nothing under their name."""
    return timeline(stmts).where("op = 'close' AND of = kind AND (last IS NULL OR last.op <> 'open')").select("at.path", "at.seq", "action", "kind", "name")


def snapshot(objects: DataFrame, output_format: str = "json") -> DataFrame:
    """One line an object (K9), in name order when written by a sorted sink: JSON, Turtle, or a row of a Lean list of triples."""
    if output_format == "json":
        return objects.select("kind", "name", F.to_json(F.struct("kind", "name", "definition")).alias("value"))
    if output_format == "lean":
        text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
        return objects.select("kind", "name", F.concat(F.lit("  ("), text(F.col("kind")), F.lit(", "), text(F.col("name")), F.lit(", "), text(F.col("definition")), F.lit("),")).alias("value"))
    if output_format == "ttl":
        from .graph import escaped

        iri = F.col("name")
        for mark in ("%", '"', " ", "<", ">"):
            iri = F.replace(iri, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
        return objects.select("kind", "name", F.concat(F.lit("<urn:sql:"), "kind", F.lit(":"), iri, F.lit('> c:definition "'), escaped(F.col("definition")), F.lit('" .')).alias("value"))
    raise ValueError(f"unknown format {output_format}")


def ast_suffix(parser_format: Column) -> Column:
    return F.when(parser_format == "pg_query", ".pgpb").otherwise(".ast")


def toolchain(dialect: Column, known: dict[str, str], strict: bool = False) -> Column:
    """The tool of a dialect or language (J13). One that isn't known passes through as it is, or with strict is an error."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")
    return F.coalesce(table[dialect], F.raise_error(F.concat(F.lit("no toolchain for "), dialect)).cast("string") if strict else dialect)


def aspect(deps: DataFrame, owned: DataFrame, toolchains: dict[str, str]) -> DataFrame:
    """src, path, dialect, seq, statement, toolchain of every target (S14, U5): statements of the files (target, path, sql,
    dialect) that it and all it depends on (deps: src, dst) own, each file once a target; a dialect without a toolchain gives none."""
    roots = deps.select("src").unionByName(deps.select(F.col("dst").alias("src"))).unionByName(owned.select(F.col("target").alias("src"))).distinct()
    files = reachable(roots, deps).join(owned.select(F.col("target").alias("dst"), "path"), "dst").select("src", "path").distinct()
    parsed_once = statements(owned.where(F.col("dialect").isin(*toolchains)) if toolchains else owned.where(F.lit(False)))
    return files.join(parsed_once, "path").withColumn("toolchain", toolchain(F.col("dialect"), toolchains))


def path_ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


QUERIES = {f.__name__: f for f in (path_ordered_fold,)}
ORACLE_SQL = {
    "path_ordered_fold": "SELECT user_id, arg_max(event_type, row(ts, event_id)) AS last_type, arg_max(value, row(ts, event_id)) AS last_value FROM events GROUP BY 1",
}
