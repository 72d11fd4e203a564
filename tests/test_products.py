"""Corrections, listed names and processed state against plain versions and golden values."""

import re

from pyspark.sql import functions as F

from cairn.functions import products, text
from cairn.operators import landed, mutations, rules, upserts
from cairn.sources import files


def _corrected(value):
    for wrong, right in rules.TRANSCRIPTION_ERRORS.items():
        low, w, r = value.lower(), wrong.lower(), right.lower()
        word = re.search(rf"\b{re.escape(wrong)}\b", value, re.IGNORECASE)
        if r in low or w not in low or not (word or low.startswith(w)):
            continue
        rest = value[len(wrong) :]
        if not word and rest[:1].isalpha() and r in rest.lower():
            continue
        fixed = re.sub(re.escape(wrong), right, value, count=1, flags=re.IGNORECASE)
        bare = re.sub("[^a-z0-9]", "", fixed.lower())
        if fixed == value or fixed.lower().count(r) > 1 or re.search(r"(.{2,7})\1", bare) or abs(len(fixed) - len(value)) > len(right) + 5:
            continue
        return fixed, 0.95 if w == low else 0.90 if word else 0.75
    return None


def test_corrections(spark):
    values = [*rules.TRANSCRIPTION_ERRORS, *rules.TRANSCRIPTION_ERRORS.values(), "Durst X-Mid", "Durstin tent", "Zpacked", "the X Mid", "x mid X Mid", "Gossamer", "Gossamer Gear", "gossamer tent",
              "My Neo Air pad", "Arkose", "Thermarest Thermarest", "", "Hyper Lite", "hyper lite mountain gear"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.correction(F.col("v")).alias("c")).collect()
    assert {r.v: tuple(r.c) if r.c else None for r in rows} == {v: _corrected(v) for v in values}


def test_listed_names(spark):
    page = "\n".join(["# Tent One $300", "**Tent One** ($300)", "Add to cart $5", "[ Quilt Two ](https://x/products/2) and [Home](/home)", "[abc](x/product/1)", "* [Pad] $20.00", "menu [Pack Nine](a/product/9)", "[Stove $9](b/product/7)"])
    df = spark.createDataFrame([(page,), (None,), ("",)], "p string").select(products.listed_names(F.col("p")).alias("n"))
    got = [r.n for r in df.collect()]
    assert got == [["Tent One", "Quilt Two", "Stove", "Stove $9"], None, []]


def test_state_and_log(spark, tmp_path):
    ids = spark.createDataFrame([("b",), ("a",), ("b",)], "video_id string")
    files.write_state(ids, str(tmp_path / "state"), "2026-02-07")
    assert [r.video_id for r in files.read_state(spark, str(tmp_path / "state")).orderBy("video_id").collect()] == ["a", "b"]
    assert spark.read.json(str(tmp_path / "state/summary")).first().total_processed == 2
    old = tmp_path / "old.json"
    old.write_text('{"video_ids": ["x", "y"], "last_check": "2026-01-01", "total_processed": 2}')
    assert {r.video_id for r in files.state_file(spark, str(old)).collect()} == {"x", "y"}
    log = spark.createDataFrame([("1", "e", "c", "flagged", 2)], "entry_id string, entity_id string, check_id string, decision string, priority int")
    files.append_log(log, str(tmp_path / "log"))
    files.append_log(log, str(tmp_path / "log"))
    assert files.log_file(spark, str(tmp_path / "log")).count() == 2


def test_sync_token(spark):
    feed = spark.createDataFrame([('{"brands":{"added":[{"name":"A"}],"updated":[],"deleted":["B"]},"next_sync_token":"t2"}',), ('{"brands":{"added":[{"name":"C"}]},"next_sync_token":"t1"}',), ("no json",)], "payload string")
    assert sorted((r.op, r.name, r.token) for r in files.changes_since(feed, "t1").collect()) == [("added", "A", "t2"), ("deleted", "B", "t2")]


def test_upsert_twice_is_once(spark):
    items = spark.createDataFrame([("a", "x", 1, "c", "t0", None)], "name string, brand string, weight_grams int, category string, created_at string, updated_at string")
    brands, edges = spark.createDataFrame([("x",)], "name string"), spark.createDataFrame([], "src_id string, rel_type string, dst_id string")
    new = spark.createDataFrame([("a", "x", None, "d"), ("b", "y", 2, "e")], "name string, brand string, weight_grams int, category string")
    one = upserts.merge_items(items, brands, edges, new, F.lit("t1"))
    two = upserts.merge_items(one[0].drop("action"), one[1], one[2], new, F.lit("t1"))
    rows = sorted(tuple(r) for r in two[0].select("name", "weight_grams", "category", "created_at", "updated_at").collect())
    assert rows == [("a", 1, "c", "t0", "t1"), ("b", 2, "e", "t1", "t1")]
    assert sorted(r.name for r in two[1].collect()) == ["x", "y"] and two[2].count() == 2
    assert mutations.last_of(new, ["brand"], ["name"]).count() == 2


def test_crawl_takes_no_more_than_its_limits(spark):
    html = lambda *to: "".join(f'<a href="/{t}">t</a>' for t in to)
    pages = spark.createDataFrame([("h", "/c1", html("p1", "p2", "p3")), ("h", "/c2", html("p3", "p4")), ("h", "/c3", html("p9"))], "host string, path string, html string")
    got = sorted(tuple(r) for r in landed.category_products(pages, 2, 3).collect())
    assert got == [("h", "h/c1", "h/p1"), ("h", "h/c1", "h/p2"), ("h", "h/c1", "h/p3")]


def test_a_page_is_read_once_for_its_names(spark):
    from pyspark.sql import functions as F

    from cairn.functions.products import listed_names

    assert str(listed_names(F.col("page"))).count("regexp_extract_all") == 1
