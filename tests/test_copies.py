"""Copies of names, categories and addresses: work that follows the rows, not the square of what is equal."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from cairn.operators import fixes, rich_save, upserts
from cairn.sources import files

EDGE = "src_id long, src_label string, rel_type string, dst_id long, dst_label string"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(True)
    return out.getvalue().split("== Physical Plan ==")[1]


def test_tips_of_a_category_are_counted_not_written_out(spark):
    n = 3000  # n items of one category and n fixes of it: nine million links
    items = spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") % 2 == 0, "Cups").otherwise("cups").alias("category"))
    tips = spark.createDataFrame([(0, 5), (1, 5), (9999, 5), (3, 6)], "src_id long, dst_id long")
    asked = spark.range(n).select(F.col("id").alias("entity_id"), F.lit("CUPS").alias("value")).unionByName(spark.createDataFrame([(7, ""), (8, "none"), (n + 1, "cups")], "entity_id long, value string"))
    out = fixes.tips_by_category(spark.range(n).toDF("node_id"), items, tips, asked)
    got = {r.entity_id: (r.tips, r.new_tips) for r in out.collect()}
    assert len(got) == n and got[5] == (n, n - 2) and got[6] == (n, n - 1) and got[7] == (n, n)
    small = items.filter("node_id < 12")
    edges = tips.select("src_id", F.lit("Item").alias("src_label"), F.lit("HAS_TIP").alias("rel_type"), "dst_id", F.lit("Insight").alias("dst_label"))
    after = fixes.linked_by_category(spark.range(n).toDF("node_id"), small, edges, asked.filter("entity_id < 10"))
    linked = {r.dst_id: r.n for r in after.filter("src_id < 12 AND dst_id < 10").groupBy("dst_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert linked == {r.entity_id: r.tips for r in fixes.tips_by_category(spark.range(n).toDF("node_id"), small, tips, asked.filter("entity_id < 10")).collect()}


def test_repeated_insights_meet_their_products_once(spark):
    products = spark.range(4000).select(F.col("id").alias("node_id"), F.lit("Item").alias("label"), F.lit("Mug").alias("name"))
    asked = spark.range(4000).select(F.substring(F.concat(F.lit("s"), "id"), 1, 1).alias("summary"), F.concat(F.lit("Mu"), F.substring(F.concat(F.lit("g"), "id"), 1, 1)).alias("name"))
    edges = spark.createDataFrame([(1, "Item", "HAS_TIP", "s")], "src_id long, src_label string, rel_type string, summary string")
    made = rich_save._linked(edges, asked, products, ["name"], "HAS_TIP")
    text = plan(made)
    assert made.count() == 4000
    join = text.index("Join")
    assert text.count("keys=[summary") >= 1 and text.index("keys=[summary", join) > join  # asked is made distinct below the join


def test_an_entry_is_of_one_page(spark):
    class Pages:
        def page(self):
            return spark.createDataFrame([(1, "u"), (3, "u"), (4, "u"), (5, "u"), (7, None), (9, None)], "page_id long, url string")

    assert sorted(r.page_id for r in files.files_cache_misses(Pages()).collect()) == [3, 5, 9]


def test_links_of_a_category_are_not_exchanged(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, None), (5, "z")], "src_id long, _category string")
    tips = spark.createDataFrame([(10, "a"), (11, "a"), (11, "a"), (12, "b"), (13, None)], "dst_id long, _category string")
    out = upserts.category_links(items, tips)
    assert sorted((r.src_id, r.dst_id) for r in out.collect()) == [(1, 10), (1, 11), (2, 10), (2, 11), (3, 12)]
    assert "Exchange" not in plan(out).split("Join")[0] and "Aggregate" not in plan(out).split("Join")[0]


def test_links_of_a_category_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(upserts, "CELL", 8)
    items = spark.range(100).select(F.col("id").alias("src_id"), F.when(F.col("id") < 90, "a").otherwise("b").alias("_category"))
    tips = spark.range(41).select(F.col("id").alias("dst_id"), F.when(F.col("id") < 40, "a").otherwise("c").alias("_category"))
    out = upserts.category_links(items, tips)
    got = out.select("src_id", "dst_id", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.src_id, r.dst_id) for r in got) == [(i, t) for i in range(90) for t in range(40)]
    assert len({r.task for r in got}) > 20  # of 12 * 5 parts; small tables are not made one task, however many links they make


def test_relationships_of_an_extraction_are_not_exchanged_after_the_join(spark):
    names = [f.strip().split()[0] for f in rich_save.EXTRACTED.split(", ")]
    row = {"name": "Mug", "brand": "Zed", "source_url": "https://a", "use_cases": ["Hiking"] * 2, "insights": ["x" * 500, "y"]}
    rows = spark.createDataFrame([tuple(row.get(n) for n in names)] * 3, rich_save.EXTRACTED)
    items = spark.range(50).select(F.col("id").alias("node_id"), F.lit("Mug").alias("name"), F.lit("Zed").alias("brand"))
    out = rich_save.rich_edges(items, rows, lambda c: F.md5(c.cast("binary")))
    assert out.count() == out.distinct().count() == 150
    assert {len(r.dst_key) for r in out.collect()} == {32}
    above = plan(out).split("Join")[0]
    assert "Exchange" not in above and "Aggregate" not in above
