"""The 28 preset queries by name. Limits are part of a preset: it shows the first rows of an order.

Orders end with a key, so every preset is one defined result. NULL sorts as the largest value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import branch_counts, missing, present, undirected, without
from cairn.operators.queue import FIXABLE
from cairn.registry import ORACLE_SQL, QUERIES, query
from cairn.sources.views import Graph


def _up(*names: str) -> list:
    return [F.col(n).asc_nulls_last() for n in names]


def _down(n: str):
    return F.col(n).desc_nulls_first()


_ITEM = "SELECT name, brand, category, node_id FROM item WHERE {} ORDER BY name NULLS LAST, node_id LIMIT 50"


def _items(g: Graph, cond, *columns: str) -> DataFrame:
    return g.item().filter(cond).select("name", "brand", *columns, "node_id").orderBy(*_up("name", "node_id")).limit(50)


@query("preset_no_brand", """SELECT name, brand AS brand_text, category, node_id FROM item WHERE node_id NOT IN (SELECT src_id FROM e_produced_by)
  AND node_id NOT IN (SELECT dst_id FROM e_manufactures_item) ORDER BY name NULLS LAST, node_id LIMIT 50""")
def no_brand(g: Graph) -> DataFrame:
    left = without(without(g.item(), g.edge("PRODUCED_BY")), g.edge("MANUFACTURES_ITEM"), outgoing=False)
    return left.select("name", F.col("brand").alias("brand_text"), "category", "node_id").orderBy(*_up("name", "node_id")).limit(50)


@query("preset_no_images", _ITEM.format("image_url IS NULL OR image_url = ''"))
def no_images(g: Graph) -> DataFrame:
    return _items(g, missing("image_url"), "category")


@query("preset_no_weight", _ITEM.format("weight_grams IS NULL"))
def no_weight(g: Graph) -> DataFrame:
    return _items(g, F.col("weight_grams").isNull(), "category")


@query("preset_no_price", _ITEM.format("price_usd IS NULL"))
def no_price(g: Graph) -> DataFrame:
    return _items(g, F.col("price_usd").isNull(), "category")


@query("preset_no_category", _ITEM.replace(", category", "").format("category IS NULL OR category = '' OR category = 'unknown'"))
def no_category(g: Graph) -> DataFrame:
    return _items(g, missing("category", "unknown"))


@query("preset_duplicates", """SELECT i.name, cnt AS duplicate_count, node_id, brand, category, weight_grams, price_usd, image_url, product_url, description
  FROM item i JOIN (SELECT name, count(*) AS cnt FROM item GROUP BY name HAVING count(*) > 1) d ON i.name = d.name
  ORDER BY i.name, node_id LIMIT 100""")
def duplicates(g: Graph) -> DataFrame:
    """Exact duplicate names: counts by partial sums, then joined back, so no name is gathered."""
    more = g.item().groupBy("name").agg(F.count(F.lit(1)).alias("duplicate_count")).filter("duplicate_count > 1")
    return g.item().join(more, "name").select(
        "name", "duplicate_count", "node_id", "brand", "category", "weight_grams", "price_usd", "image_url", "product_url", "description"
    ).orderBy("name", "node_id").limit(100)


@query("preset_orphan_families", """SELECT name AS family_name, brand, description, node_id FROM family WHERE node_id NOT IN (SELECT src_id FROM e_has_variant)
  AND node_id NOT IN (SELECT dst_id FROM e_variant_of) ORDER BY name, node_id LIMIT 50""")
def orphan_families(g: Graph) -> DataFrame:
    left = without(without(g.family(), g.edge("HAS_VARIANT")), g.edge("VARIANT_OF"), outgoing=False)
    return left.select(F.col("name").alias("family_name"), "brand", "description", "node_id").orderBy("family_name", "node_id").limit(50)


@query("preset_families_with_items", """SELECT f.node_id, f.name AS family, f.brand, count(m.id) AS item_count,
  coalesce(array_to_string(list(i.name ORDER BY i.name, m.id)[:5], '; '), '') AS sample_items
  FROM family f LEFT JOIN (SELECT src_id AS fid, dst_id AS id FROM e_has_variant UNION ALL SELECT dst_id, src_id FROM e_variant_of) m ON m.fid = f.node_id
  LEFT JOIN item i ON i.node_id = m.id GROUP BY 1, 2, 3 ORDER BY item_count DESC, family, f.node_id LIMIT 50""")
def families_with_items(g: Graph) -> DataFrame:
    """Both directions' lists together; an item found by both counts twice, as lists are added.

    Families are counted and cut to the fifty shown first; names are looked up for those alone.
    """
    one = g.edge("HAS_VARIANT").select(F.col("src_id").alias("fid"), F.col("dst_id").alias("id"))
    both = one.unionByName(g.edge("VARIANT_OF").select(F.col("dst_id").alias("fid"), F.col("src_id").alias("id")))
    counts = both.groupBy("fid").agg(F.count(F.lit(1)).alias("item_count"))
    out = g.family().join(counts, F.col("node_id") == F.col("fid"), "left")
    shown = out.select("node_id", F.col("name").alias("family"), "brand", F.coalesce("item_count", F.lit(0)).alias("item_count"))
    order = [F.desc("item_count"), "family", "node_id"]
    shown = shown.orderBy(*order).limit(50)
    members = both.join(shown.select(F.col("node_id").alias("fid")), "fid", "left_semi").join(g.item().select(F.col("node_id").alias("id"), "name"), "id")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("fid").orderBy("name", "id"))).filter("r <= 5")
    samples = first.groupBy("fid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), "; ").alias("sample_items"))
    full = shown.join(samples, F.col("node_id") == F.col("fid"), "left").select(*shown.columns, F.coalesce("sample_items", F.lit("")).alias("sample_items"))
    return full.orderBy(*order)


@query("preset_families_by_brand", """SELECT f.node_id, f.name AS family, coalesce(b.name, f.brand) AS brand, f.category FROM family f
  LEFT JOIN e_family_produced_by e ON e.src_id = f.node_id LEFT JOIN brand b ON b.node_id = e.dst_id ORDER BY brand NULLS LAST, family, f.node_id LIMIT 100""")
def families_by_brand(g: Graph) -> DataFrame:
    named = g.edge("PRODUCED_BY/Family").join(g.brand().select(F.col("node_id").alias("dst_id"), F.col("name").alias("b")), "dst_id")
    out = g.family().join(named.select(F.col("src_id").alias("node_id"), "b"), "node_id", "left")
    return out.select("node_id", F.col("name").alias("family"), F.coalesce("b", "brand").alias("brand"), "category").orderBy(
        *_up("brand", "family", "node_id")
    ).limit(100)


@query("preset_orphan_insights", """SELECT summary, category, content, node_id FROM insight WHERE node_id NOT IN (SELECT dst_id FROM e_has_tip)
  AND node_id NOT IN (SELECT src_id FROM e_relates_to) ORDER BY category NULLS LAST, summary NULLS LAST, node_id LIMIT 50""")
def orphan_insights(g: Graph) -> DataFrame:
    left = without(without(g.insight(), g.edge("RELATES_TO")), g.edge("HAS_TIP"), outgoing=False)
    return left.select("summary", "category", "content", "node_id").orderBy(*_up("category", "summary", "node_id")).limit(50)


@query("preset_insights_by_category", """SELECT category, count(*) AS count, array_to_string(list(node_id ORDER BY node_id)[:3], ',') AS sample_insights
  FROM insight GROUP BY category ORDER BY count DESC""")
def insights_by_category(g: Graph) -> DataFrame:
    """Counts, and the first three of each category by a top-3 of its own: no list of a whole category."""
    return _counted_with_samples(g.insight().select("category", F.col("node_id").cast("string").alias("x"), "node_id"), "category", 3, "sample_insights", ",", ["node_id"])


def _firsts(df: DataFrame, key: str, k: int, name: str, sep: str, order: list[str]) -> DataFrame:
    """The first k values of x by key. Ranks up to k are cut before the shuffle, so a hot key sends k rows a task."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    top = df.withColumn("_r", rank).filter(F.col("_r") <= k)
    lists = top.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_r", "x"))).alias("_l"))
    return lists.select(key, F.array_join(F.transform("_l", lambda x: x["x"]), sep).alias(name))


def _counted_with_samples(df: DataFrame, key: str, k: int, name: str, sep: str, order: list[str]) -> DataFrame:
    """count and the first k values of x by key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    firsts = _firsts(df, key, k, name, sep, order).withColumnRenamed(key, "_k")
    return counts.join(firsts, F.col(key).eqNullSafe(F.col("_k"))).drop("_k")


@query("preset_insights_for_product", """SELECT i.name AS product, n.summary AS insight, n.category, n.node_id FROM item i JOIN e_has_tip e ON e.src_id = i.node_id
  JOIN insight n ON n.node_id = e.dst_id ORDER BY product NULLS LAST, n.node_id LIMIT 50""")
def insights_for_product(g: Graph) -> DataFrame:
    hop = g.edge("HAS_TIP").select("src_id", F.col("dst_id").alias("node_id")).join(g.insight().select("node_id", "summary", "category"), "node_id")
    named = hop.join(g.item().select(F.col("node_id").alias("src_id"), F.col("name").alias("product")), "src_id")
    return named.select("product", F.col("summary").alias("insight"), "category", "node_id").orderBy(*_up("product", "node_id")).limit(50)


@query("preset_all_glossary", "SELECT term, definition, category FROM term ORDER BY term LIMIT 100")
def all_glossary(g: Graph) -> DataFrame:
    return g.term().select("term", "definition", "category").orderBy("term").limit(100)


@query("preset_orphan_glossary", "SELECT term, definition FROM term WHERE node_id NOT IN (SELECT dst_id FROM e_uses_term) ORDER BY term LIMIT 50")
def orphan_glossary(g: Graph) -> DataFrame:
    return without(g.term(), g.edge("USES_TERM"), outgoing=False).select("term", "definition").orderBy("term").limit(50)


@query("preset_glossary_with_relations", """SELECT t.term, 'USES_TERM' AS relation, 'Item' AS related_type, i.name AS related_name, i.node_id AS related_id FROM term t
  JOIN e_uses_term e ON e.dst_id = t.node_id JOIN item i ON i.node_id = e.src_id ORDER BY t.term, related_id LIMIT 100""")
def glossary_with_relations(g: Graph) -> DataFrame:
    u = undirected(g.edge("USES_TERM")).filter("this_label = 'Term'")
    named = u.join(g.item().select(F.col("node_id").alias("other_id"), "name"), "other_id").join(g.term().select(F.col("node_id").alias("this_id"), "term"), "this_id")
    return named.select(
        "term", F.col("rel_type").alias("relation"), F.col("other_label").alias("related_type"), F.col("name").alias("related_name"), F.col("other_id").alias("related_id")
    ).orderBy("term", "related_id").limit(100)


@query("preset_brands_with_counts", """SELECT b.node_id, b.name AS brand, count(DISTINCT i.dst_id) AS items, count(DISTINCT f.dst_id) AS product_families
  FROM brand b LEFT JOIN e_manufactures_item i ON i.src_id = b.node_id LEFT JOIN e_manufactures f ON f.src_id = b.node_id
  GROUP BY 1, 2 ORDER BY items DESC, brand, b.node_id LIMIT 50""")
def brands_with_counts(g: Graph) -> DataFrame:
    counted = branch_counts(g.brand().select("node_id", F.col("name").alias("brand")), {"items": g.edge("MANUFACTURES_ITEM"), "product_families": g.edge("MANUFACTURES")})
    return counted.orderBy(F.desc("items"), "brand", "node_id").limit(50)


@query("preset_brands_no_products", """SELECT name AS brand, website, country, node_id FROM brand WHERE node_id NOT IN (SELECT src_id FROM e_manufactures_item)
  AND node_id NOT IN (SELECT src_id FROM e_manufactures) ORDER BY name, node_id LIMIT 50""")
def brands_no_products(g: Graph) -> DataFrame:
    left = without(g.brand(), g.edge("MANUFACTURES_ITEM"), g.edge("MANUFACTURES"))
    return left.select(F.col("name").alias("brand"), "website", "country", "node_id").orderBy("brand", "node_id").limit(50)


@query("preset_top_brands", """SELECT b.name AS brand, count(*) AS product_count FROM brand b JOIN e_manufactures_item e ON e.src_id = b.node_id
  GROUP BY 1 ORDER BY product_count DESC, brand LIMIT 20""")
def top_brands(g: Graph) -> DataFrame:
    n = g.edge("MANUFACTURES_ITEM").groupBy(F.col("src_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    named = g.brand().join(n, "node_id").groupBy(F.col("name").alias("brand")).agg(F.sum("n").alias("product_count"))
    return named.orderBy(F.desc("product_count"), "brand").limit(20)


_SOURCES = "SELECT title, url, source_type AS type, processed_at AS processed FROM source ORDER BY processed_at DESC NULLS FIRST, url LIMIT {}"


def _sources(g: Graph, n: int) -> DataFrame:
    return g.source().select("title", "url", F.col("source_type").alias("type"), F.col("processed_at").alias("processed")).orderBy(_down("processed"), "url").limit(n)


@query("preset_all_sources", _SOURCES.format(50))
def all_sources(g: Graph) -> DataFrame:
    return _sources(g, 50)


@query("preset_recent_sources", _SOURCES.format(20))
def recent_sources(g: Graph) -> DataFrame:
    return _sources(g, 20)


@query("preset_top_sources", """SELECT s.url, s.title AS source, s.source_type AS type, count(*) AS items_extracted FROM source s
  JOIN e_extracted_from e ON e.dst_id = s.node_id GROUP BY 1, 2, 3 ORDER BY items_extracted DESC, s.url LIMIT 20""")
def top_sources(g: Graph) -> DataFrame:
    n = g.edge("EXTRACTED_FROM").groupBy(F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("items_extracted"))
    return g.source().join(n, "node_id").select("url", F.col("title").alias("source"), F.col("source_type").alias("type"), "items_extracted").orderBy(
        F.desc("items_extracted"), "url"
    ).limit(20)


@query("preset_with_images", "SELECT name, brand, image_url AS image, node_id FROM item WHERE image_url IS NOT NULL AND image_url <> '' ORDER BY name NULLS LAST, node_id LIMIT 30")
def with_images(g: Graph) -> DataFrame:
    return g.item().filter(present("image_url")).select("name", "brand", F.col("image_url").alias("image"), "node_id").orderBy(*_up("name", "node_id")).limit(30)


_TOP = "SELECT name, brand, {0} AS {1}, category, node_id FROM item WHERE {0} IS NOT NULL {2} ORDER BY {0} {3}, name NULLS LAST, node_id LIMIT 30"


def _top(g: Graph, column: str, name: str, first) -> DataFrame:
    rows = g.item().filter(F.col(column).isNotNull()).select("name", "brand", F.col(column).alias(name), "category", "node_id")
    return rows.orderBy(first(name), *_up("name", "node_id")).limit(30)


@query("preset_heaviest_items", _TOP.format("weight_grams", "weight_g", "", "DESC"))
def heaviest_items(g: Graph) -> DataFrame:
    return _top(g, "weight_grams", "weight_g", F.desc)


@query("preset_lightest_items", _TOP.format("weight_grams", "weight_g", "AND weight_grams > 0", "ASC"))
def lightest_items(g: Graph) -> DataFrame:
    rows = g.item().filter("weight_grams > 0").select("name", "brand", F.col("weight_grams").alias("weight_g"), "category", "node_id")
    return rows.orderBy("weight_g", *_up("name", "node_id")).limit(30)


@query("preset_most_expensive", _TOP.format("price_usd", "price", "", "DESC"))
def most_expensive(g: Graph) -> DataFrame:
    return _top(g, "price_usd", "price", F.desc)


@query("preset_gear_by_category", """SELECT category, count(*) AS count, array_to_string(list(name ORDER BY name, node_id)[:5], '; ') AS sample_items
  FROM item WHERE category IS NOT NULL AND category <> '' GROUP BY category""")
def items_by_category(g: Graph) -> DataFrame:
    rows = g.item().filter(present("category")).select("category", F.col("name").alias("x"), "name", "node_id")
    return _counted_with_samples(rows, "category", 5, "sample_items", "; ", ["name", "node_id"])


@query("preset_products_not_in_families", """SELECT name, brand, category, node_id FROM item WHERE node_id NOT IN (SELECT src_id FROM e_variant_of)
  AND regexp_full_match(name, '.*[0-9]+.*') ORDER BY brand NULLS LAST, name NULLS LAST, node_id LIMIT 100""")
def products_not_in_families(g: Graph) -> DataFrame:
    left = without(g.item().filter(F.col("name").rlike("^.*[0-9]+.*$")), g.edge("VARIANT_OF"))
    return left.select("name", "brand", "category", "node_id").orderBy(*_up("brand", "name", "node_id")).limit(100)


@query("preset_family_candidates", """SELECT brand, count(*) AS product_count,
  array_to_string(list(name || '#' || node_id ORDER BY name, node_id)[:10], '; ') AS sample_products
  FROM item WHERE node_id NOT IN (SELECT src_id FROM e_variant_of) AND regexp_full_match(name, '.*[0-9]+.*')
  GROUP BY brand HAVING count(*) >= 2 ORDER BY product_count DESC, brand NULLS LAST LIMIT 50""")
def family_candidates(g: Graph) -> DataFrame:
    left = without(g.item().filter(F.col("name").rlike("^.*[0-9]+.*$")), g.edge("VARIANT_OF"))
    rows = left.select("brand", F.concat("name", F.lit("#"), F.col("node_id").cast("string")).alias("x"), "name", "node_id")
    counted = _counted_with_samples(rows, "brand", 10, "sample_products", "; ", ["name", "node_id"])
    return counted.withColumnRenamed("count", "product_count").filter("product_count >= 2").orderBy(
        F.desc("product_count"), *_up("brand")
    ).limit(50)


def _fix_rows() -> dict[str, str]:
    """Presets whose rows can be fixed, with what fixes them."""
    return {k: v for k, v in FIXABLE.items() if f"preset_{k}" in ORACLE_SQL}


@query("fix_plan", " UNION ALL ".join(f"SELECT '{k}' AS query_key, '{v}' AS fix_type, count(*) AS to_fix FROM ({ORACLE_SQL[f'preset_{k}']})" for k, v in _fix_rows().items()))
def fix_plan(g: Graph) -> DataFrame:
    """What the presets show that can be fixed, by kind of fix."""
    parts = [QUERIES[f"preset_{k}"](g.spark, g.sf_dir).agg(F.count(F.lit(1)).alias("to_fix")).select(F.lit(k).alias("query_key"), F.lit(v).alias("fix_type"), "to_fix") for k, v in _fix_rows().items()]
    return reduce(DataFrame.unionByName, parts)
