"""Polling, change feeds and stateful streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.mutations import last_of, upsert
from cairn.registry import query
from cairn.sources.views import Graph


def poll(spark: SparkSession, landing: str, schema: str, processed: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], key: str = "video_id", dry_run: bool = False):
    """Handle what is new in a landing folder once and mark successes only.

    A micro-batch is compared with the processed table (anti-join); process returns its rows
    with a boolean ok. Successes are appended after they were handled, so failures are new again
    for the next batch that lists them, and a batch that is replayed finds its rows marked.
    """

    def batch(rows: DataFrame, _: int) -> None:
        done = _table(spark, processed, f"{key} string")
        new = rows.dropDuplicates([key]).join(done, key, "left_anti")
        if dry_run:
            return
        process(new).filter("ok").select(key).write.mode("append").parquet(processed)

    source = spark.readStream.schema(schema).json(landing)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def sync(spark: SparkSession, feed: DataFrame, root: str, checkpoint: str, key: list[str], order: list[str]):
    """Keep a keyed table in step with a change feed: each batch makes the next version of it.

    feed: key, order, op (added, updated, deleted) and values. A version is written under its
    batch number and overwritten if the batch is replayed, so a restart changes nothing.
    """

    def batch(rows: DataFrame, n: int) -> None:
        values = [c for c in rows.columns if c not in (*order, "op")]
        last = last_of(rows, key, order)
        before = [v for v in _versions(spark, root) if v < n]
        old = spark.read.parquet(f"{root}/v={max(before)}") if before else rows.select(*values).limit(0)
        kept = old.join(last.filter("op = 'deleted'").select(*key), key, "left_anti")
        new = upsert(kept, last.filter("op <> 'deleted'").select(*values), key).select(*values)
        new.write.mode("overwrite").parquet(f"{root}/v={n}")

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, root: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]


def latest_state(events: DataFrame, key: str = "entity", delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """The last status of each key by window; late events within the delay still count. Batch or streaming."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    last = F.max_by("status", F.struct("ts", "event_id"))
    return rows.groupBy(F.window("ts", window).alias("w"), key).agg(last.alias("state"), F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "entity") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key; the state of old keys is dropped after the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


@query("stream_daily_state", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, entity, arg_max(status, event_id) AS state, count(*) AS n FROM work_event GROUP BY 1, 2""")
def stream_daily_state(g: Graph) -> DataFrame:
    """The last status of each entity and day."""
    return latest_state(g.work_event()).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "entity", "state", "n")


@query("stream_hourly_counts", "SELECT date_trunc('hour', ts) AS hour, status, count(*) AS n FROM work_event GROUP BY 1, 2")
def stream_hourly_counts(g: Graph) -> DataFrame:
    w = F.window("ts", "1 hour")
    out = g.work_event().groupBy(w.alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "status", "n")


@query("stream_sessions", """SELECT entity, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT entity, s, count(*) AS n FROM (SELECT entity, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, event_id) AS s FROM (
  SELECT entity, ts, event_id, coalesce(ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS gap FROM work_event)) GROUP BY 1, 2) GROUP BY 1""")
def stream_sessions(g: Graph) -> DataFrame:
    return sessions(g.work_event()).groupBy("entity").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("stream_durations", """SELECT entity, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM work_event GROUP BY entity""")
def stream_durations(g: Graph) -> DataFrame:
    second = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    return g.work_event().groupBy("entity").agg((second(F.max("ts")) - second(F.min("ts"))).alias("seconds"))
