"""The work queue as a live stream: a state machine for each entry, with timers for deferred ones.

The state of an entry does not depend on the order in which its events arrive, so late events that the
watermark still lets through give what queue_states gives over all of them at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from cairn.operators import rules
from cairn.operators.queue import _STATES, STATUS, queue_events
from cairn.registry import query
from cairn.sources.scratch import fresh_root
from cairn.sources.views import Graph

EVENTS = "entity string, seq long, kind string, level int, score double, ts timestamp"
ENTRIES = "entity string, status string, level int, sort_key int, checks int, added long, due boolean"
COLUMNS = [f.split()[0] for f in ENTRIES.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Levels that checks have; what an entry was escalated to counts for them alone.
LEVELS = sorted({c[2] for c in rules.CHECKS})
#: What is held of an entry: its add, its last transition (due_at: of a deferral whose timer is still to fire), its
#: last level, and the last escalation to each level. One row an entry, whatever the number of its events.
FIELDS = ["added long", "first int", "score double", "last long", "kind string", "due_at long", "leveled long", "level int", *[f"up{k} long" for k in LEVELS]]
NAMES = [f.split()[0] for f in FIELDS]
HELD = f"entries array<struct<entity: string, {', '.join(f.replace(' ', ': ') for f in FIELDS)}>>"
#: Groups that entries are dealt to; a group's entries are read and written together, at most once a batch.
SHARDS = 1024


def _entry(entity: str, held: dict, due: bool) -> tuple:
    seq, level = held["added"], held["first"]
    status = STATUS.get(held["kind"], "pending") if held["last"] is not None and held["last"] > seq else "pending"
    if held["leveled"] is not None and held["leveled"] > seq:
        level = held["level"]
    up = {k for k in LEVELS if held[f"up{k}"] is not None and held[f"up{k}"] > seq}
    checks = sum(c[2] <= held["first"] or c[2] in up for c in rules.CHECKS)
    return entity, status, level, level * 1000 + math.floor(held["score"] * 100), checks, seq, due


def _deferred(held: dict) -> bool:
    return held["due_at"] is not None and held["added"] is not None and held["last"] > held["added"]


def _fold(held: dict, seq: int, kind: str, level: int | None, score: float, ms: int, wait_ms: int) -> None:
    """One event into what is held of its entry; the order of events does not count."""
    later = lambda name: held[name] is None or seq > held[name]
    if kind == "add":
        if held["added"] is None or seq < held["added"]:
            held |= {"added": seq, "first": level, "score": score}
        return
    if later("last"):
        held |= {"last": seq, "kind": kind, "due_at": ms + wait_ms if kind == "defer" else None}
    if level is not None:
        if later("leveled"):
            held |= {"leveled": seq, "level": level}
        if kind == "escalate" and level in LEVELS and later(f"up{level}"):
            held[f"up{level}"] = seq


def queue_shard(wait_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state machines of a shard's entries. A deferral sets a timer; an entry that is still deferred when it fires
    comes out once more as due.

    A call costs far more than an event, so entries are not called for one by one. The shard's one timer is
    that of the entry that is due first.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {r[0]: dict(zip(NAMES, r[1:], strict=True)) for r in (state.get[0] if state.exists else [])}
        changed = {}
        if not state.hasTimedOut:
            for batch in batches:
                levels = [None if pd.isna(x) else int(x) for x in batch["level"].tolist()]
                for entity, seq, kind, level, score, ms in zip(batch["entity"].tolist(), batch["seq"].tolist(), batch["kind"].tolist(), levels, batch["score"].tolist(), batch["ms"].tolist(), strict=True):
                    held = kept.get(entity)
                    if held is None:
                        held = kept[entity] = dict.fromkeys(NAMES)
                    _fold(held, seq, kind, level, score, ms, wait_ms)
                    changed[entity] = held
        out = [_entry(e, held, False) for e, held in changed.items() if held["added"] is not None]
        now, following = state.getCurrentWatermarkMs(), None
        for e, held in kept.items():
            if held["due_at"] is None:
                continue
            if held["due_at"] > now:
                following = held["due_at"] if following is None else min(following, held["due_at"])
                continue
            if _deferred(held):
                out.append(_entry(e, held, True))
            held["due_at"] = None  # its timer has fired
        state.update(([(e, *held.values()) for e, held in kept.items()],))
        if following is not None:
            state.setTimeoutTimestamp(following)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    return run


def queue_stream(events: DataFrame, delay: str = "1 hour", wait: pd.Timedelta = pd.Timedelta(days=1), shards: int = SHARDS) -> DataFrame:
    """Entries as they change, from a stream of events (entity, seq, kind, level, score, ts).

    An entry comes out after each batch that had events of it, and once more with due = true when it
    has been deferred for the time to wait and nothing followed. Events later than delay are dropped.
    Entries are dealt to shards (their number stays with a checkpoint); a batch reads and writes the shards
    that it has events of, so shards are to be many enough for one to be small.
    """
    rows = events.select("entity", "seq", "kind", "level", "score", "ts", F.unix_millis("ts").alias("ms"), F.pmod(F.xxhash64("entity"), F.lit(shards)).alias("shard")).withWatermark("ts", delay).groupBy("shard")
    return rows.applyInPandasWithState(queue_shard(int(wait.total_seconds() * 1000)), ENTRIES, HELD, "update", "EventTimeTimeout")


def keep_entries(entries: DataFrame, root: str, checkpoint: str):
    """Write each batch of changed entries under its number; a batch that is replayed overwrites its own."""

    def batch(rows: DataFrame, n: int) -> None:
        rows.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{root}/b={n}")

    spark = entries.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)  # read when the query starts
    try:
        return entries.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def kept_entries(spark: SparkSession, root: str) -> DataFrame:
    """The last that came out of each entry."""
    rows = spark.read.schema(f"{ENTRIES}, batch long").parquet(f"{root}/b=*")
    last = rows.groupBy("entity").agg(F.max_by(F.struct("status", "level", "sort_key", "checks", "added"), F.struct("batch", "due")).alias("x"), F.max("due").alias("due"))
    return last.select("entity", "x.*", "due")


@query("stream_queue_entries", f", {_STATES} SELECT * FROM states")
def stream_queue_entries(g: Graph) -> DataFrame:
    """The events table as a stream through the state machine: the same entries as queue_entries."""
    root = fresh_root(g.spark, "queue")
    raw = g.table("events")
    stream = g.spark.readStream.schema(raw.schema).parquet(f"{g.sf_dir}/events.parquet*")
    events = queue_events(stream.select("event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"), "value"))
    keep_entries(queue_stream(events), f"{root}/entries", f"{root}/checkpoint").awaitTermination()
    return kept_entries(g.spark, f"{root}/entries").drop("due")
