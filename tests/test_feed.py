"""A change feed by token: incremental runs, replays, restarts and a cleared token."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.streaming import feed


def payload(token, **products):
    return (token, json.dumps({"products": products, "next_sync_token": token}))


def product(i, name, brand="Zed", **more):
    return {"id": str(i), "name": name, "brand_name": brand, **more}


def land(spark, path, *payloads):
    feed.land(spark.createDataFrame(list(payloads), "token string, payload string"), path)


def docs(mirror):
    return {r.doc_id: (r.name, r.category, r.token) for r in mirror.documents().collect()}


@pytest.fixture
def mirror(spark, tmp_path):
    return feed.Mirror(spark, str(tmp_path / "feed"), str(tmp_path / "mirror"))


def test_only_what_is_behind_the_token_is_applied(spark, mirror):
    assert mirror.saved_token() is None
    land(spark, mirror.feed, payload("2026-01-01", added=[product(1, "Mug"), product(2, "Pot", category="a"), product(2, "Pot", category="b")]))
    assert mirror.sync() == {"written": 2, "deleted": 0, "sync_type": "full", "sync_token": "2026-01-01"}
    assert docs(mirror) == {"zed/mug": ("Mug", "", "2026-01-01"), "zed/pot": ("Pot", "b", "2026-01-01")}
    # the token's folder is read once; later tokens come as one batch, deletes count last within a payload
    land(spark, mirror.feed, payload("2026-01-02", deleted=[product(1, "Mug")], updated=[product(2, "POT", "zed", category="c")], added=[product(1, "mug")]), payload("2026-01-03", added=[product(3, "Cup", None)]))
    assert mirror.sync() == {"written": 2, "deleted": 1, "sync_type": "incremental", "sync_token": "2026-01-03"}
    assert docs(mirror) == {"zed/pot": ("POT", "c", "2026-01-02"), "unknown/cup": ("Cup", "", "2026-01-03")}
    assert mirror.sync() == {"written": 0, "deleted": 0, "sync_type": "incremental", "sync_token": "2026-01-03"}
    since = feed.changes(feed.read_feed(spark, mirror.feed, "2026-01-01"))
    assert sorted((r.op, r.doc_id) for r in since.collect()) == [("added", "unknown/cup"), ("added", "zed/mug"), ("deleted", "zed/mug"), ("updated", "zed/pot")]
    assert feed.read_feed(spark, mirror.feed, "2026-01-03").count() == 0


def test_a_replayed_batch_changes_nothing(spark, mirror, tmp_path):
    land(spark, mirror.feed, payload("1", added=[product(1, "Mug")]))
    mirror.sync()
    land(spark, mirror.feed, payload("2", updated=[product(1, "Mug", category="x")]))
    mirror.sync()
    before = docs(mirror)
    commits = tmp_path / "mirror/state/epoch=000000/commits"
    for f in commits.glob("*1*"):  # as if the driver had died between the write and the commit
        f.unlink()
    for f in commits.glob(".1*"):
        f.unlink()
    assert mirror.saved_token() == "1"
    mirror.sync()
    assert docs(mirror) == before and mirror.saved_token() == "2"
    assert len(list((tmp_path / "mirror/documents").glob("v=*"))) == 2


def test_a_failed_batch_is_done_again(spark, mirror, monkeypatch):
    land(spark, mirror.feed, payload("1", added=[product(1, "Mug")]))
    with monkeypatch.context() as m:
        m.setattr(feed, "changes", lambda lines: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            mirror.sync()
    assert mirror.saved_token() is None and mirror.documents() is None
    assert mirror.sync()["written"] == 1


def test_a_cleared_token_reads_all_again(spark, mirror):
    land(spark, mirror.feed, payload("1", added=[product(1, "Mug")]), payload("2", added=[product(2, "Pot")], deleted=[product(1, "Mug")]))
    mirror.sync()
    assert mirror.sync(full=True) == {"written": 1, "deleted": 1, "sync_type": "full", "sync_token": "2"}
    assert list(docs(mirror)) == ["zed/pot"]
    mirror.clear_token()
    assert mirror.saved_token() is None and list(docs(mirror)) == ["zed/pot"]


def test_lines_that_are_no_payload_and_brands(spark, mirror):
    brand = json.dumps({"brands": {"added": [{"id": "b", "name": "O'Hara & Co", "country": "SE", "product_count": 3}]}, "products": None})
    land(spark, mirror.feed, ("1", brand), ("1", "not json"), ("1", "{}"), ("1", "[]"))
    assert mirror.sync()["written"] == 1
    assert [tuple(r) for r in mirror.documents().select("entity", "doc_id", "country", "website", "product_count").collect()] == [("brands", "ohara-co", "SE", "", 3)]


def test_no_feed_folder(spark, tmp_path):
    assert feed.read_feed(spark, str(tmp_path / "none")).filter(F.col("token") != "").count() == 0
