"""The queue's state machine as a stream against the batch states of the same events."""

import json
import os
import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from cairn.operators.queue import queue_states
from cairn.streaming.queue_stream import EVENTS, keep_entries, kept_entries, queue_stream

START = datetime(2026, 1, 1)
KINDS = ["add", "take", "defer", "escalate", "complete", "fail"]


def event(entity, seq, kind, level=None, score=0.5, minutes=0):
    return {"entity": entity, "seq": seq, "kind": kind, "level": level, "score": score, "ts": (START + timedelta(minutes=minutes)).isoformat()}


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(folder / name, (1_700_000_000 + int(name[0]),) * 2)  # files are read in this order


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    keep_entries(queue_stream(stream, **options), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    return {r.entity: tuple(r)[1:] for r in kept_entries(spark, str(tmp_path / "out")).collect()}


def test_order_of_arrival_does_not_count(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for seq in range(400):
        kind = rng.choice(KINDS)
        level = rng.randint(2, 4) if kind == "add" else rng.randint(1, 5) if kind in ("defer", "escalate") else None
        rows.append(event(f"e{rng.randrange(40)}", seq, kind, level, rng.random(), seq / 10))
    want = {r.entity: tuple(r)[1:] for r in queue_states(spark.createDataFrame([(r["entity"], r["seq"], r["kind"], r["level"], r["score"]) for r in rows], "entity string, seq long, kind string, level int, score double")).collect()}
    rng.shuffle(rows)  # all within the hour that the watermark waits
    for k in range(4):
        land(tmp_path / "in", f"{k}.json", rows[k * 100 : (k + 1) * 100])
        if k == 1:
            run(spark, tmp_path)  # the stream is stopped here and started again from its checkpoint
    got = run(spark, tmp_path)
    assert {e: x[:-1] for e, x in got.items()} == want and len(want) >= 30


def test_deferred_entries_come_due_and_late_events_go(spark, tmp_path):
    day = 24 * 60
    land(tmp_path / "in", "0.json", [event("a", 1, "add", 3), event("a", 2, "defer", 5, minutes=5), event("b", 3, "add", 3), event("b", 4, "defer", 4, minutes=6), event("c", 5, "add", 2, minutes=7)])
    assert run(spark, tmp_path) == {"a": ("pending", 5, 5050, 7, 1, False), "b": ("pending", 4, 4050, 7, 3, False), "c": ("pending", 2, 2050, 4, 5, False)}
    land(tmp_path / "in", "1.json", [event("b", 6, "take", minutes=60), event("c", 7, "escalate", 1, minutes=3 * day)])
    land(tmp_path / "in", "2.json", [event("c", 8, "complete", minutes=3 * day + 1)])
    land(tmp_path / "in", "3.json", [event("a", 9, "complete", minutes=10)])  # days late
    got = run(spark, tmp_path, wait=pd.Timedelta(days=1))
    assert got == {"a": ("pending", 5, 5050, 7, 1, True), "b": ("in_progress", 4, 4050, 7, 3, False), "c": ("completed", 1, 1050, 4, 5, False)}


def test_a_second_add_is_ignored(spark):
    rows = [("a", 1, "add", 3, 0.25), ("a", 2, "complete", None, 0.9), ("a", 3, "add", 2, 0.1), ("b", 4, "defer", 5, 0.1), ("b", 5, "add", 2, 0.2)]
    out = queue_states(spark.createDataFrame(rows, "entity string, seq long, kind string, level int, score double")).orderBy("entity")
    assert [tuple(r) for r in out.select("entity", "status", "level", "sort_key", "checks", "added").collect()] == [("a", "completed", 3, 3025, 7, 1), ("b", "pending", 2, 2020, 4, 5)]
    assert out.filter(F.col("level").isNull()).isEmpty()


def test_entries_of_a_shard_are_worked_on_together(spark, tmp_path):
    day = 24 * 60
    land(tmp_path / "in", "0.json", [event(f"e{k}", k, "add", 3, minutes=k) for k in range(50)] + [event(f"e{k}", 100 + k, "defer", 5, minutes=k) for k in range(0, 50, 2)])
    land(tmp_path / "in", "1.json", [event("z", 200, "add", 2, minutes=day + 80), event("e4", 201, "take", minutes=70)])  # e0 to e20 are due then, not e22
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    running = keep_entries(queue_stream(stream, shards=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    running.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in running.recentProgress) == 1
    got = {r.entity: r for r in kept_entries(spark, str(tmp_path / "out")).collect()}
    assert len(got) == 51 and got["e4"].status == "in_progress"
    assert {e for e, r in got.items() if r.due} == {f"e{k}" for k in range(0, 21, 2) if k != 4}
