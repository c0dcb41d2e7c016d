"""Relational operations over the bundled tables. An extension: none of these has a counterpart to match.

Joins by range and as-of work on buckets: a row meets only rows of its own and the neighbouring bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), cents("l_extendedprice").alias("sum_price_cents"), F.count("*").alias("n"))


def equi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue in cents by nation: customer, orders and nation."""
    c, o, n = (_t(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))


def semi_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    on = F.col("c_custkey") == F.col("o_custkey")
    out = [c.join(o, on, how).groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("side", F.lit(how)) for how in ("left_semi", "left_anti")]
    return out[0].unionByName(out[1])


def range_join(spark: SparkSession, sf_dir: str, width: int = 20) -> DataFrame:
    """Customers with how many suppliers hold a balance within width of theirs in the same nation."""
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    bucket = lambda x: F.floor(x / width)
    left = c.select("c_custkey", "c_nationkey", "c_acctbal", F.explode(F.array(*(bucket(F.col("c_acctbal")) + d for d in (-1, 0, 1)))).alias("b"))
    right = s.select("s_nationkey", "s_acctbal", bucket(F.col("s_acctbal")).alias("b"))
    hit = left.alias("l").join(right.alias("r"), (F.col("l.b") == F.col("r.b")) & (F.col("c_nationkey") == F.col("s_nationkey")) & (F.abs(F.col("c_acctbal") - F.col("s_acctbal")) <= width))
    return hit.groupBy("c_custkey").agg(F.count("*").alias("n_near"))


def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the user's latest click or view before it: union both sides, carry the last one forward."""
    e = _t(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("event_type").isin("click", "view"), F.col("event_id")), ignorenulls=True).over(w)
    return e.where(F.col("event_type").isin("click", "view", "error")).withColumn("prev_event", before).where("event_type = 'error'").select("event_id", F.coalesce("prev_event", F.lit(-1)).alias("prev_event"))


def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations in one region, the first before the second by name."""
    a, b = (_t(spark, sf_dir, "nation").alias(x) for x in "ab")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_name") < F.col("b.n_name"))).select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


def rollup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def cube_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"))


def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", F.row_number().over(w).cast("long").alias("rn"), F.ntile(4).over(w).cast("long").alias("quarter"), F.coalesce(F.lag("c_custkey").over(w), F.lit(-1)).alias("prev"), F.count("*").over(w.rowsBetween(-2, 2)).alias("frame"))


def top_per_group(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The k largest orders of each customer; Spark limits groups in the map tasks."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


def top_k(spark: SparkSession, sf_dir: str, k: int = 25) -> DataFrame:
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(k).select("o_orderkey", "o_totalprice")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    even = c.where("k % 2 = 0")
    parts = {"intersect": even.intersect(o), "except": c.exceptAll(o.distinct()), "union": even.union(o.where("k % 3 = 0")).distinct()}
    out = [d.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total")).withColumn("op", F.lit(n)) for n, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sessions, cut where nothing happens for six hours or more."""
    e = _t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *(F.coalesce(c, F.lit(0)).alias(f"n_{c.lower()}") for c in ("F", "O", "P")))


QUERIES = {f.__name__: f for f in (pricing_summary, equi_join, semi_anti_join, range_join, asof_join, theta_join, rollup_sets, cube_sets, window_ranks, top_per_group, top_k, set_operations, tumbling_windows, session_windows, pivot_status)}
ORACLE_SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity::BIGINT)::BIGINT AS sum_qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sum_price_cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "equi_join": "SELECT n_name, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "semi_anti_join": """SELECT c_mktsegment, count(*) AS n, 'left_semi' AS side FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY 1
        UNION ALL SELECT c_mktsegment, count(*), 'left_anti' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY 1""",
    "range_join": "SELECT c_custkey, count(*) AS n_near FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 20 GROUP BY 1",
    "asof_join": """SELECT event_id, coalesce((SELECT arg_max(b.event_id, row(b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type IN ('click', 'view') AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id))), -1)::BIGINT AS prev_event
        FROM events a WHERE event_type = 'error'""",
    "theta_join": "SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name",
    "rollup_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "window_ranks": """SELECT c_custkey, row_number() OVER w AS rn, ntile(4) OVER w AS quarter, coalesce(lag(c_custkey) OVER w, -1) AS prev, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS frame
        FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)""",
    "top_per_group": "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "set_operations": """WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k FROM orders)
        SELECT count(*) AS n, coalesce(sum(k), 0)::BIGINT AS total, 'intersect' AS op FROM (SELECT k FROM c WHERE k % 2 = 0 INTERSECT SELECT k FROM o)
        UNION ALL SELECT count(*), coalesce(sum(k), 0)::BIGINT, 'except' FROM (SELECT k FROM c EXCEPT SELECT k FROM o)
        UNION ALL SELECT count(*), coalesce(sum(k), 0)::BIGINT, 'union' FROM (SELECT k FROM c WHERE k % 2 = 0 UNION SELECT k FROM o WHERE k % 3 = 0)""",
    "tumbling_windows": "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "session_windows": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "pivot_status": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1",
}
