"""Streams over event files. An extension: windowed counts with a watermark, a deduplicated replay, and jobs up to each
cluster's first failure with state that survives a restart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship
from ..work import work_path

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "6 hours", late: str | None = "10 minutes") -> DataFrame:
    """Counts per window and type; rows later than the watermark are dropped, so state stays bounded. late=None
    keeps the watermark that the stream has."""
    found = (events.withWatermark("at", late) if late else events).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", by: tuple[str, ...] = ()) -> None:
    """Reads all there is in bounded batches and ends; a restart goes on from the checkpoint."""
    out = stream.writeStream.partitionBy(*by) if by else stream.writeStream
    out.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


JUDGED = "cluster string, event_id long, at timestamp, status string, n long, verdict string"


def until_first_failure(jobs: DataFrame, late: str = "10 minutes", idle: str = "7 days") -> DataFrame:
    """Jobs (cluster, event_id, at, status) as they come, with a verdict (O7): run up to and with a cluster's first FAIL, stopped
    after it, late if a later job of the cluster was judged in an earlier batch; n counts the jobs that ran. In a batch
    a cluster's jobs go by time, then id. The state is three values a cluster. A cluster without jobs for so long, by event
    time, is closed: a row without an id says how many ran, and its state goes. What the watermark has passed is late,
    too, and never reaches the state."""
    ship(jobs.sparkSession)
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["cluster", "event_id", "at", "status", "n", "verdict"]
        n, stopped, last, last_id = state.get if state.exists else (0, False, None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], None, pd.Timestamp(last, unit="us"), None, n, "closed")], columns=columns).astype({"event_id": "Int64"})
            return
        # Plain arrays: groups are many and small, and a frame's own sort and copies cost more than their rows.
        ids, ats, statuses = (np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*((b["event_id"].to_numpy(), b["at"].to_numpy(), b["status"].to_numpy()) for b in batches)))
        order = np.lexsort((ids, ats))
        ids, ats, statuses = ids[order], ats[order], statuses[order]
        ns, verdicts = [], []
        before, before_id = last, last_id
        for event_id, place, status in zip(ids.tolist(), (ats.astype("datetime64[ns]").astype("int64") // 1000).tolist(), statuses.tolist()):
            if before is not None and (place, event_id) < (before, before_id):
                ns.append(n)
                verdicts.append("late")
                continue
            n += not stopped
            ns.append(n)
            verdicts.append("stopped" if stopped else "run")
            stopped = stopped or status == "FAIL"
            last, last_id = place, int(event_id)
        state.update((n, stopped, last, last_id))
        due = last // 1000 + wait
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame({"cluster": key[0], "event_id": ids, "at": ats, "status": statuses, "n": ns, "verdict": verdicts}, columns=columns, copy=False)

    rows = jobs.withWatermark("at", late).select("cluster", "event_id", "at", "status")
    return rows.groupBy("cluster").applyInPandasWithState(judge, JUDGED, "n long, stopped boolean, last long, last_id long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as jobs that come in four parts, by time; some of the first two come with the last. The stream is started anew for
    each part and goes on from its checkpoint; late ones are in a folder of their own."""
    source, path, state = (work_path(spark, name) for name in ("jobs", "judged", "judged-state"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lo, hi = events.agg(F.min(micros("ts")), F.max(micros("ts"))).head()
    part = F.floor(4 * (micros("ts") - lo) / (hi - lo + 1))
    parts = events.withColumn("part", F.when((F.col("event_id") % 37 == 0) & (part < 2), 3).otherwise(part))
    for k in range(4):
        parts.where(F.col("part") == k).drop("part").write.mode("append").parquet(source)
        jobs = event_stream(spark, source, 1000).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("cluster"), "event_id", "at", F.when((F.col("event_type") == "error") | (F.col("event_id") % 20 == 0), "FAIL").otherwise("PASS").alias("status"))
        run_once(until_first_failure(jobs, late="1000 days", idle="3000 days"), path, state, by=("verdict",))
    return spark.read.schema(JUDGED).parquet(path).select("cluster", "event_id", "status", "n", "verdict")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream, each id once, counted in windows of six hours; those that the watermark has closed."""
    source, path, state = (work_path(spark, name) for name in ("events", "stream", "stream-state"))
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(source)  # a stream reads folders
    run_once(windowed_counts(distinct_events(event_stream(spark, source, 1000)), late=None), path, state)
    return spark.read.schema("start timestamp_ntz, event_type string, n long").parquet(path)


QUERIES = {"stream_windows": stream_windows, "stream_failures": stream_failures}
ORACLE_SQL = {
    "stream_failures": """WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
        e AS (SELECT 'u' || user_id AS cluster, event_id, ts, CASE WHEN event_type = 'error' OR event_id % 20 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, floor(4 * (epoch_us(ts) - lo) / (hi - lo + 1)) AS part FROM events, b),
        h AS (SELECT *, event_id % 37 = 0 AND part < 2 AS held FROM e),
        m AS (SELECT *, held AND row(ts, event_id) < max(CASE WHEN NOT held AND part < 3 THEN row(ts, event_id) END) OVER (PARTITION BY cluster) AS late FROM h),
        l AS (SELECT *, coalesce(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) OVER w, 0) AS failed FROM m WHERE NOT coalesce(late, false) WINDOW w AS (PARTITION BY cluster ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        r AS (SELECT cluster, event_id, status, sum(CASE WHEN failed = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY cluster ORDER BY ts, event_id)::BIGINT AS n, CASE WHEN failed = 0 THEN 'run' ELSE 'stopped' END AS verdict FROM l),
        ran AS (SELECT cluster, sum(CASE WHEN failed = 0 AND part < 3 AND NOT held THEN 1 ELSE 0 END)::BIGINT AS n FROM l GROUP BY 1)
        SELECT * FROM r UNION ALL SELECT cluster, event_id, status, ran.n, 'late' FROM m LEFT JOIN ran USING (cluster) WHERE late""",
    "stream_windows": """WITH e AS (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start FROM events)
        SELECT start, event_type, count(*) AS n FROM e WHERE start + INTERVAL '6 hours' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes' GROUP BY 1, 2""",
}
