"""Typed upserts: items with their brands, insights, sources and terms, links that make their ends, manual fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.mutations import _UP, _catalogue, _changes, last_of, link, upsert
from cairn.registry import query
from cairn.sources.views import Graph

NOW, BEFORE = "2026-02-01 00:00:00", "2026-01-01 00:00:00"
#: Kinds of an opinion.
OPINIONS = ["tip", "warning", "experience", "pro", "con"]


def stamp(done: DataFrame, now) -> DataFrame:
    """created_at of rows that a change made, updated_at of those that it changed."""
    return done.withColumn("created_at", F.when(F.col("action") == "created", now).otherwise(F.col("created_at"))).withColumn(
        "updated_at", F.when(F.col("action") == "updated", now).otherwise(F.col("updated_at"))
    )


def ensured(nodes: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """nodes with one more row for each name that none of them has."""
    more = names.select(name).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct().join(nodes.select(name), name, "left_anti")
    return nodes.unionByName(more, allowMissingColumns=True)


def merge_items(items: DataFrame, brands: DataFrame, edges: DataFrame, changes: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, brands and MANUFACTURES_ITEM edges (by brand and item name) after changes by (name, brand).

    None never overwrites; the category is set on creation only. The brand of every changed item
    is there afterwards, and so is its edge.
    """
    done = stamp(upsert(items, changes, ["name", "brand"], only_on_create=["category"]), now)
    made = changes.select(F.col("brand").alias("src_id"), F.lit("MANUFACTURES_ITEM").alias("rel_type"), F.col("name").alias("dst_id"))
    return done, ensured(brands, changes.select(F.col("brand").alias("name"))), link(edges, made)


def _dated(g: Graph) -> DataFrame:
    return _catalogue(g).withColumn("created_at", F.lit(BEFORE)).withColumn("updated_at", F.lit(None).cast("string"))


@query("mut_merge_items", f""", {_UP} SELECT coalesce(o.name, n.name) AS name, coalesce(o.brand, n.brand) AS brand, coalesce(n.weight_grams, o.weight_grams) AS weight_grams,
  CASE WHEN o.name IS NOT NULL THEN o.category ELSE n.category END AS category, CASE WHEN o.name IS NULL THEN '{NOW}' ELSE '{BEFORE}' END AS created_at,
  CASE WHEN o.name IS NOT NULL AND n.name IS NOT NULL THEN '{NOW}' END AS updated_at FROM old o FULL JOIN new n ON o.name = n.name AND o.brand = n.brand""")
def mut_merge_items(g: Graph) -> DataFrame:
    """Items after a batch of changes, with the times that it sets."""
    return merge_items(_dated(g), g.brand().select("name"), _no_edges(g), _changes(g), F.lit(NOW))[0].drop("action")


@query("mut_merge_item_brands", f""", {_UP} SELECT name, count(*) AS n FROM (SELECT name FROM brand UNION ALL SELECT DISTINCT brand FROM new WHERE brand NOT IN (SELECT name FROM brand)) GROUP BY name""")
def mut_merge_item_brands(g: Graph) -> DataFrame:
    brands = merge_items(_dated(g), g.brand().select("name"), _no_edges(g), _changes(g), F.lit(NOW))[1]
    return brands.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("mut_merge_item_edges", f""", {_UP} SELECT DISTINCT brand AS src_id, 'MANUFACTURES_ITEM' AS rel_type, name AS dst_id FROM (SELECT brand, name FROM old WHERE name > 'm' UNION ALL SELECT brand, name FROM new)""")
def mut_merge_item_edges(g: Graph) -> DataFrame:
    edges = _catalogue(g).filter("name > 'm'").select(F.col("brand").alias("src_id"), F.lit("MANUFACTURES_ITEM").alias("rel_type"), F.col("name").alias("dst_id"))
    return merge_items(_dated(g), g.brand().select("name"), edges, _changes(g), F.lit(NOW))[2]


def _no_edges(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([], "src_id string, rel_type string, dst_id string")


def _notes(g: Graph, cond: str) -> DataFrame:
    rows = g.work_event().filter(cond).select(F.concat(F.lit("note of "), F.col("entity").cast("string")).alias("summary"), F.concat_ws(" ", "status", F.col("event_id").cast("string")).alias("content"),
                                              F.col("status").alias("category"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("o"), F.col("event_id").cast("string"))).alias("source_url"), "event_id")
    return last_of(rows, ["summary"], ["event_id"]).drop("event_id")


_NOTES = """notes AS (SELECT event_id, 'note of ' || entity AS summary, status || ' ' || event_id AS content, status AS category, CASE WHEN event_id % 3 <> 0 THEN 'o' || event_id END AS source_url FROM work_event),
  was AS (SELECT * EXCLUDE (r, event_id) FROM (SELECT *, row_number() OVER (PARTITION BY summary ORDER BY event_id DESC) AS r FROM notes WHERE event_id % 2 = 0) WHERE r = 1),
  came AS (SELECT * EXCLUDE (r, event_id) FROM (SELECT *, row_number() OVER (PARTITION BY summary ORDER BY event_id DESC) AS r FROM notes WHERE event_id % 5 = 0) WHERE r = 1)"""


@query("mut_insights_on_create", f", {_NOTES} SELECT coalesce(a.summary, b.summary) AS summary, CASE WHEN a.summary IS NULL THEN b.content ELSE a.content END AS content, coalesce(b.category, a.category) AS category, a.summary IS NULL AS created FROM was a FULL JOIN came b ON a.summary = b.summary")
def mut_insights_on_create(g: Graph) -> DataFrame:
    """Insights by summary, first form: the content is set on creation only."""
    done = upsert(_notes(g, "event_id % 2 = 0").drop("source_url"), _notes(g, "event_id % 5 = 0").drop("source_url"), ["summary"], only_on_create=["content"])
    return done.select("summary", "content", "category", (F.col("action") == "created").alias("created"))


@query("mut_insights_overwrite", f", {_NOTES} SELECT coalesce(a.summary, b.summary) AS summary, coalesce(b.content, a.content) AS content, coalesce(b.source_url, a.source_url) AS source_url FROM was a FULL JOIN came b ON a.summary = b.summary")
def mut_insights_overwrite(g: Graph) -> DataFrame:
    """Insights by summary, second form: new content counts, a missing source keeps the old one."""
    return upsert(_notes(g, "event_id % 2 = 0"), _notes(g, "event_id % 5 = 0"), ["summary"]).select("summary", "content", "source_url")


@query("mut_upsert_sources", """SELECT url, CASE WHEN node_id % 3 = 0 THEN 'again' ELSE title END AS title, CASE WHEN node_id % 3 = 0 THEN items_found + 1 ELSE items_found END AS items_found FROM source
  UNION ALL SELECT 'n' || node_id, 'again', items_found + 1 FROM source WHERE node_id % 7 = 0""")
def mut_upsert_sources(g: Graph) -> DataFrame:
    """Sources by address: ones that are known are processed again, others are new."""
    old, k = g.source().select("url", "title", "items_found"), F.col("node_id")
    again = g.source().filter(k % 3 == 0).select("url", F.lit("again").alias("title"), (F.col("items_found") + 1).alias("items_found"))
    new = g.source().filter(k % 7 == 0).select(F.concat(F.lit("n"), k.cast("string")).alias("url"), F.lit("again").alias("title"), (F.col("items_found") + 1).alias("items_found"))
    return upsert(old, again.unionByName(new), ["url"]).drop("action")


@query("mut_upsert_terms", """SELECT term, CASE WHEN node_id % 2 = 0 THEN 'second ' || term ELSE definition END AS definition, CASE WHEN node_id % 4 = 0 THEN 'new' ELSE category END AS category FROM term
  UNION ALL SELECT 'NEW ' || term, 'second ' || term, NULL FROM term WHERE node_id % 5 = 0""")
def mut_upsert_terms(g: Graph) -> DataFrame:
    """Glossary terms by name from an import in which the last row of a name counts."""
    k, t = F.col("node_id"), g.term()
    first = t.select("term", F.lit("first").alias("definition"), F.lit(None).cast("string").alias("category"), F.lit(1).alias("row")).filter(k % 2 == 0)
    second = t.filter(k % 2 == 0).select("term", F.concat(F.lit("second "), "term").alias("definition"), F.when(k % 4 == 0, "new").alias("category"), F.lit(2).alias("row"))
    more = t.filter(k % 5 == 0).select(F.concat(F.lit("NEW "), "term").alias("term"), F.concat(F.lit("second "), "term").alias("definition"), F.lit(None).cast("string").alias("category"), F.lit(1).alias("row"))
    batch = last_of(first.unionByName(second).unionByName(more), ["term"], ["row"]).drop("row")
    return upsert(t.select("term", "definition", "category"), batch, ["term"]).drop("action")


@query("mut_link_new_sources", """SELECT url, count(*) AS items, bool_or(made) AS made FROM (SELECT s.url, s.src_id, x.url IS NULL AS made FROM (SELECT DISTINCT CASE WHEN dst_id % 10 = 0 THEN 'm' ELSE 'o' END || dst_id AS url, src_id FROM e_extracted_from WHERE src_id % 4 = 0) s
  LEFT JOIN source x ON x.url = s.url) GROUP BY url""")
def mut_link_new_sources(g: Graph) -> DataFrame:
    """Links from items to sources by address; a source that is not there is made."""
    to = F.concat(F.when(F.col("dst_id") % 10 == 0, "m").otherwise("o"), F.col("dst_id").cast("string"))
    new = g.edge("EXTRACTED_FROM").filter("src_id % 4 = 0").select(F.col("src_id"), F.lit("EXTRACTED_FROM").alias("rel_type"), to.alias("dst_id"))
    empty = g.spark.createDataFrame([], "src_id long, rel_type string, dst_id string")
    ends = ensured(g.source().select("url", F.lit(True).alias("was")), new.select(F.col("dst_id").alias("url")), "url")
    linked = link(empty, new).withColumnRenamed("dst_id", "url").join(ends, "url")
    return linked.groupBy("url").agg(F.count(F.lit(1)).alias("items"), F.bool_or(F.col("was").isNull()).alias("made"))


@query("mut_comparisons_by_type", """SELECT DISTINCT src_id, 'COMPARED_TO' AS rel_type, dst_id, kind FROM (SELECT src_id, dst_id, CASE WHEN src_id % 2 = 0 THEN 'weight' ELSE 'price' END AS kind FROM e_compared_to
  UNION ALL SELECT src_id, dst_id, 'weight' FROM e_compared_to)""")
def mut_comparisons_by_type(g: Graph) -> DataFrame:
    """Comparison links, of which one pair of items may have one of each kind."""
    kind = F.when(F.col("src_id") % 2 == 0, "weight").otherwise("price")
    old = g.edge("COMPARED_TO").select("src_id", "rel_type", "dst_id", kind.alias("kind"))
    return link(old, old.withColumn("kind", F.lit("weight")), ["src_id", "rel_type", "dst_id", "kind"])


def append_opinions(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All opinions after an append, and the rows it rejected for their kind or for want of content."""
    ok = F.col("kind").isin(*OPINIONS) & (F.coalesce("content", F.lit("")) != "")
    return old.unionByName(new.filter(ok)), new.filter(~ok | ok.isNull())


@query("mut_append_valid_opinions", """, o AS (SELECT event_id, entity, CASE status WHEN 'view' THEN 'tip' WHEN 'click' THEN 'pro' WHEN 'purchase' THEN 'con' ELSE status END AS kind, CASE WHEN event_id % 7 <> 0 THEN status END AS content FROM work_event)
  SELECT event_id, entity, kind, kept FROM (SELECT *, event_id % 2 = 0 OR (kind IN ('tip', 'warning', 'experience', 'pro', 'con') AND coalesce(content, '') <> '') AS kept FROM o)""")
def mut_append_valid_opinions(g: Graph) -> DataFrame:
    """Opinions after an append of valid ones; rejected rows are told apart."""
    status = F.col("status")
    kind = F.when(status == "view", "tip").when(status == "click", "pro").when(status == "purchase", "con").otherwise(status)
    rows = g.work_event().select("event_id", "entity", kind.alias("kind"), F.when(F.col("event_id") % 7 != 0, status).alias("content"))
    kept, rejected = append_opinions(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 <> 0"))
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.withColumn("kept", F.lit(False))).drop("content")


def set_range(items: DataFrame, changes: DataFrame, cols: list[str]) -> DataFrame:
    """Partial ranges by node_id: a bound that is not given stays; a change without any bound does nothing."""
    given = changes.filter(F.coalesce(*cols).isNotNull())
    return upsert(items, given, ["node_id"]).filter("action <> 'created'")


@query("mut_temperature_range", """SELECT node_id, CASE WHEN node_id % 2 = 0 AND node_id % 3 <> 0 THEN -5 ELSE CAST(weight_grams AS INTEGER) // 10 - 30 END AS min_c, CASE WHEN node_id % 2 = 0 AND node_id % 5 <> 0 THEN 20 END AS max_c,
  node_id % 2 = 0 AND (node_id % 3 <> 0 OR node_id % 5 <> 0) AS changed FROM item""")
def mut_temperature_range(g: Graph) -> DataFrame:
    k = F.col("node_id")
    old = g.item().select("node_id", (F.col("weight_grams").cast("int") / 10 - 30).cast("int").alias("min_c"), F.lit(None).cast("int").alias("max_c"))
    new = g.item().filter(k % 2 == 0).select("node_id", F.when(k % 3 != 0, -5).alias("min_c"), F.when(k % 5 != 0, 20).alias("max_c"))
    return set_range(old, new, ["min_c", "max_c"]).select("node_id", "min_c", "max_c", (F.col("action") == "updated").alias("changed"))


#: Items and tips of one category that one part has of either, about.
CELL = 1024


def category_links(items: DataFrame, tips: DataFrame) -> DataFrame:
    """src_id, rel_type, dst_id: each item (src_id, _category) with each tip (dst_id, _category) of its category.

    Items and tips are made distinct before they meet, so no link comes twice and none is exchanged. Both are dealt to parts of
    CELL, and each part of the items meets each part of the tips, which is one list, in one of as many tasks as there are
    such pairs: what is shuffled is a CELL-th of the links, and a task makes CELL times CELL of them or few times as many.
    """
    items, tips = items.filter("_category IS NOT NULL").distinct(), tips.filter("_category IS NOT NULL").distinct()
    parts = lambda df, c: df.groupBy("_category").agg(F.ceil(F.count(F.lit(1)) / CELL).alias(c))
    sizes = parts(tips, "_tips").join(parts(items, "_items"), "_category")
    number = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    tasks = max(sizes.agg(F.sum(F.col("_tips") * F.col("_items"))).first()[0] or 0, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = lambda df: df.repartition(tasks, "_category", "_i", "_t")  # noqa: E731  few rows are many links: a given number is not made smaller
    lists = tips.join(F.broadcast(sizes), "_category").withColumn("_t", number("dst_id", "_tips")).groupBy("_category", "_items", "_t").agg(F.collect_list("dst_id").alias("_list"))  # CELL, about
    one = items.join(F.broadcast(sizes), "_category").select("src_id", "_category", number("src_id", "_items").alias("_i"), every("_tips").alias("_t"))  # as many as there are categories
    two = lists.select("_category", "_t", "_list", every("_items").alias("_i"))
    pairs = spread(one).join(spread(two).hint("shuffle_hash"), ["_category", "_i", "_t"])
    return pairs.select("src_id", F.lit("HAS_TIP").alias("rel_type"), F.explode("_list").alias("dst_id"))


@query("mut_insight_category_links", """SELECT DISTINCT i.node_id AS src_id, 'HAS_TIP' AS rel_type, t.node_id AS dst_id FROM item i JOIN (SELECT node_id, CASE WHEN node_id % 2 = 0 THEN 'economy' ELSE 'promo' END AS category FROM insight WHERE node_id % 50 = 0) t
  ON lower(i.category) = t.category""")
def mut_insight_category_links(g: Graph) -> DataFrame:
    """An insight of a category becomes a tip of each item of it."""
    tip = g.insight().filter("node_id % 50 = 0").select(F.col("node_id").alias("dst_id"), F.when(F.col("node_id") % 2 == 0, "economy").otherwise("promo").alias("_category"))
    items = g.item().select(F.col("node_id").alias("src_id"), F.lower("category").alias("_category"))
    return category_links(items, tip)


#: Manual fixes: kind -> the column that it sets. Keys are names, so all items of a name change.
FIXES = {"assign_brand": "brand", "add_image": "image_url", "set_category": "category", "set_weight": "weight_grams", "set_price": "price_usd"}


def apply_fixes(items: DataFrame, fixes: DataFrame) -> DataFrame:
    """items after fixes (name, kind, value as text, seq): of one kind and name the last counts, empty values do nothing."""
    given = last_of(fixes.filter(F.coalesce("value", F.lit("")) != ""), ["name", "kind"], ["seq"])
    wide = given.groupBy("name").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"_f_{c}") for k, c in FIXES.items()])
    kinds = dict(items.dtypes)
    new = {c: F.coalesce(F.col(f"_f_{c}").try_cast(kinds[c]), F.col(c)) for c in FIXES.values()}
    return items.join(wide, "name", "left").withColumns(new).select(*items.columns)


@query("mut_manual_fixes", """, fixed AS (SELECT name, max(node_id) AS k FROM item WHERE node_id % 3 = 0 GROUP BY name) SELECT i.node_id, i.name, CASE WHEN k % 2 = 0 THEN 'Fixed' ELSE brand END AS brand,
  CASE WHEN k IS NOT NULL THEN 'cat ' || k ELSE category END AS category, CASE WHEN k % 5 = 0 THEN 1234 ELSE weight_grams END AS weight_grams FROM item i LEFT JOIN fixed f ON f.name = i.name""")
def mut_manual_fixes(g: Graph) -> DataFrame:
    """Brand, category and weight set by hand, by name; numbers that are none change nothing."""
    k = F.col("node_id")
    each = F.explode(F.array(
        F.struct(F.lit("assign_brand").alias("kind"), F.when(k % 2 == 0, "Fixed").otherwise("").alias("value")), F.struct(F.lit("set_category").alias("kind"), F.concat(F.lit("cat "), k.cast("string")).alias("value")),
        F.struct(F.lit("set_weight").alias("kind"), F.when(k % 5 == 0, "1234").otherwise("heavy").alias("value")),
    ))
    last = g.item().filter(k % 3 == 0).groupBy("name").agg(F.max("node_id").alias("node_id"))
    fixes = last.select("name", each.alias("x"), k.alias("seq")).select("name", "x.kind", "x.value", "seq")
    return apply_fixes(g.item(), fixes).select("node_id", "name", "brand", "category", "weight_grams")
