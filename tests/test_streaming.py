"""Polling with processed state, change-feed versions and late events."""

import json

from pyspark.sql import functions as F

from cairn.streaming import polling

VIDEO = "video_id string, title string"


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_only_successes_are_marked(spark, tmp_path):
    seen = []

    def process(new):
        seen.append(sorted(r.video_id for r in new.collect()))
        return new.withColumn("ok", F.col("video_id") != "v3")

    args = (spark, str(tmp_path / "in"), VIDEO, str(tmp_path / "done"), str(tmp_path / "cp"), process)
    land(tmp_path / "in", "a.json", [{"video_id": "v1"}, {"video_id": "v2"}, {"video_id": "v3"}, {"video_id": "v1"}])
    polling.poll(*args).awaitTermination()
    land(tmp_path / "in", "b.json", [{"video_id": "v1"}, {"video_id": "v3"}, {"video_id": "v4"}])
    polling.poll(*args).awaitTermination()
    assert seen == [["v1", "v2", "v3"], ["v3", "v4"]]
    assert sorted(r.video_id for r in spark.read.parquet(str(tmp_path / "done")).collect()) == ["v1", "v2", "v4"]


def test_a_feed_makes_versions(spark, tmp_path):
    schema = "id string, name string, seq int, op string"
    feed = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    go = lambda: polling.sync(spark, feed(), str(tmp_path / "t"), str(tmp_path / "cp"), ["id"], ["seq"]).awaitTermination()
    land(tmp_path / "in", "a.json", [{"id": "1", "name": "a", "seq": 1, "op": "added"}, {"id": "2", "name": "b", "seq": 2, "op": "added"}])
    go()
    land(tmp_path / "in", "b.json", [{"id": "1", "name": "c", "seq": 3, "op": "updated"}, {"id": "2", "seq": 4, "op": "deleted"}, {"id": "3", "name": "d", "seq": 5, "op": "added"}])
    go()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t/v=1")).collect()) == [("1", "c"), ("3", "d")]


def test_repeats_are_dropped_in_a_stream(spark, tmp_path):
    schema = "event_id long, ts timestamp"
    land(tmp_path / "in", "a.json", [{"event_id": 1, "ts": "2026-01-01T00:00:00"}, {"event_id": 1, "ts": "2026-01-01T00:01:00"}, {"event_id": 2, "ts": "2026-01-01T00:02:00"}])
    out = polling.first_seen(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("first_seen_t").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select event_id from first_seen_t order by 1").collect() == [(1,), (2,)]
