"""Transitive closures and chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..work import work_path, written


def _followed(start: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """start (src, dst) and all that edges lead to from there. Each round follows only the pairs found in the one before,
    and writes what is new to the shared folder."""
    edges = written(edges.select(F.col("src").alias("dst"), F.col("dst").alias("to")).distinct(), "edges")
    known = new = written(start.select("src", "dst").distinct(), "pairs")
    for _ in range(rounds):
        if new.isEmpty():
            return known
        step = new.join(edges, "dst").select("src", F.col("to").alias("dst")).distinct()
        new = written(step.join(known, ["src", "dst"], "left_anti"), "pairs")
        known = known.unionByName(new)
    raise RuntimeError("the closure did not settle")


def closure(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """All (src, dst) with a path of one edge or more; cycles are fine (R6). As many rounds as the longest way has edges."""
    return _followed(edges, edges, rounds)


def reachable(roots: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Each root (src) with itself and all it depends on, once each (T1): only what roots lead to is ever made."""
    return _followed(roots.select("src", F.col("src").alias("dst")), edges, rounds)


def levels(edges: DataFrame) -> DataFrame:
    """node, level of a graph (src depends on dst): 0 without dependencies, else one more than the highest of them.

    Nodes hold how many dependencies are unplaced; each round places those with none left and counts down for who depends on them,
    so an edge is read once and no pair of distant nodes is ever made. What stays are cycles and what depends on them:
    an error that names members of cycles.
    """
    spark = edges.sparkSession
    edges = written(edges.select("src", "dst").distinct(), "edges")
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    needs = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("left"))
    state = nodes.join(needs, "node", "left").withColumn("left", F.coalesce("left", F.lit(0).cast("long")))
    paths, schema, level = [], state.schema, 0
    while True:
        paths.append(work_path(spark, "levels"))
        state.write.parquet(paths[-1])
        state = spark.read.schema(schema).parquet(paths[-1])
        ready, rest = state.where("left = 0"), state.where("left > 0")
        if rest.isEmpty():
            break
        if ready.isEmpty():
            raise ValueError(f"dependencies go round: {', '.join(map(str, _round(edges, rest)))}")
        met = edges.join(ready.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("met"))
        state = rest.join(met, "node", "left").select("node", (F.col("left") - F.coalesce("met", F.lit(0).cast("long"))).alias("left"))
    placed = [spark.read.schema(schema).parquet(p).where("left = 0").select("node", F.lit(k).cast("long").alias("level")) for k, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, placed)


def _round(edges: DataFrame, left: DataFrame, most: int = 20) -> list:
    """Some members of cycles among nodes that all depend on others of them: those that they lead back to themselves."""
    among = edges.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi")
    # What nothing else depends on is no part of a cycle; it goes, again and again.
    while True:
        kept = written(among.join(among.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "cycles")
        if kept.count() == among.count():
            break
        among = kept
    return [r["src"] for r in closure(kept).where("src = dst").select("src").orderBy("src").limit(most).collect()]


def along(edges: DataFrame, values: DataFrame) -> DataFrame:
    """node, values: the distinct values (node, value) of a node and all it depends on, for values of a small domain, as dialects or
    toolchains: handed up level by level, each edge once (S14, U5, F15)."""
    spark = edges.sparkSession
    placed = written(levels(edges), "placed")
    own = values.groupBy("node").agg(F.collect_set("value").alias("own"))
    rows = written(placed.join(own, "node", "left").withColumn("own", F.coalesce("own", F.array().cast(own.schema["own"].dataType))), "own")
    top = rows.agg(F.max("level")).head()[0]
    done, schema, paths = None, None, []
    for level in range(0 if top is None else top + 1):
        now = rows.where(F.col("level") == level).select("node", "own")
        if paths:
            done = spark.read.schema(schema).parquet(*paths)
            below = edges.distinct().join(now.select(F.col("node").alias("src")), "src", "left_semi").join(done.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.array_distinct(F.flatten(F.collect_set("own"))).alias("below"))
            now = now.join(below, "node", "left").select("node", F.sort_array(F.array_union("own", F.coalesce("below", F.col("own")))).alias("own"))
        else:
            now = now.withColumn("own", F.sort_array("own"))
        schema = now.schema
        paths.append(work_path(spark, "along"))
        now.write.parquet(paths[-1])
    lone = values.join(placed, "node", "left_anti").groupBy("node").agg(F.sort_array(F.collect_set("value")).alias("values"))
    return lone if not paths else spark.read.schema(schema).parquet(*paths).withColumnRenamed("own", "values").unionByName(lone)


def closure_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions to what they hold, down to customers and suppliers, counted by kind."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edges = (
        t("nation").select(key("region", "n_regionkey").alias("src"), key("nation", "n_nationkey").alias("dst"))
        .unionByName(t("customer").select(key("nation", "c_nationkey").alias("src"), key("customer", "c_custkey").alias("dst")))
        .unionByName(t("supplier").select(key("nation", "s_nationkey").alias("src"), key("supplier", "s_suppkey").alias("dst")))
    )
    return reachable(t("region").select(key("region", "r_regionkey").alias("src")), edges).where("src <> dst").groupBy("src", F.substring_index("dst", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def turn_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16-like: from each conversation's first turn on to the last turn reached without a gap."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return turns.withColumn("place", place).where("turn = place").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("steps"))


QUERIES = {"closure_geo": closure_geo, "turn_chain": turn_chain}
ORACLE_SQL = {
    "closure_geo": """WITH RECURSIVE e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
        UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier),
        c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
        SELECT src, split_part(dst, ':', 1) AS kind, count(*) AS n FROM c WHERE src LIKE 'region:%' GROUP BY 1, 2""",
    "turn_chain": """WITH RECURSIVE r AS (SELECT conv_id, turn FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
        SELECT conv_id, max(turn) AS last_turn, count(*) AS steps FROM r GROUP BY conv_id""",
}
