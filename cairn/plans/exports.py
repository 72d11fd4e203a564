"""Exports: brands, products, sparse specs, deletions, the nested catalogue, reports and file sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import slugify
from cairn.operators.graph import without
from cairn.registry import query
from cairn.sources.views import Graph


def sparse(columns: dict[str, Column]) -> Column:
    """A map of the fields that are set; null, '' and 0 are left out."""
    pairs = F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull() & ~v.isin("", "0", "0.0"))


def brand_rows(g: Graph) -> DataFrame:
    """slug, name, country, products of each brand."""
    n = g.edge("MANUFACTURES_ITEM").groupBy(F.col("src_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    b = g.brand().join(n, "node_id", "left")
    return b.select(slugify("name").alias("slug"), "name", F.coalesce("country", F.lit("")).alias("country"), F.coalesce("n", F.lit(0)).alias("products"))


def product_rows(g: Graph) -> DataFrame:
    """Standalone items and families with their variants, one row each.

    Variants are counted and listed by family, which a brand's catalogue bounds.
    """
    alone = without(g.item(), g.edge("VARIANT_OF")).select(
        slugify(F.coalesce("brand", F.lit(""))).alias("brand_slug"), slugify("name").alias("slug"), "node_id", F.lit(False).alias("is_family"), F.lit(0).cast("long").alias("variants")
    )
    n = g.edge("VARIANT_OF").groupBy(F.col("dst_id").alias("node_id")).agg(F.count(F.lit(1)).alias("variants"))
    families = g.family().join(n, "node_id", "left").select(
        slugify("brand").alias("brand_slug"), slugify("name").alias("slug"), "node_id", F.lit(True).alias("is_family"), F.coalesce("variants", F.lit(0)).alias("variants")
    )
    return alone.unionByName(families)


def _slug(c: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[''\"]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


_BRANDS = f"SELECT {_slug('name')} AS slug, name, coalesce(country, '') AS country, coalesce(n, 0) AS products FROM brand LEFT JOIN (SELECT src_id, count(*) AS n FROM e_manufactures_item GROUP BY 1) ON src_id = node_id"
_PRODUCTS = f"""SELECT {_slug("coalesce(brand, '')")} AS brand_slug, {_slug('name')} AS slug, node_id, false AS is_family, CAST(0 AS BIGINT) AS variants FROM item WHERE node_id NOT IN (SELECT src_id FROM e_variant_of)
  UNION ALL SELECT {_slug('brand')}, {_slug('name')}, node_id, true, coalesce(n, 0) FROM family LEFT JOIN (SELECT dst_id, count(*) AS n FROM e_variant_of GROUP BY 1) ON dst_id = node_id"""


@query("export_brands", _BRANDS)
def export_brands(g: Graph) -> DataFrame:
    return brand_rows(g)


@query("export_products", _PRODUCTS)
def export_products(g: Graph) -> DataFrame:
    return product_rows(g)


@query("export_sparse_specs", """SELECT node_id, array_to_string(list_sort(list_filter([CASE WHEN weight_grams <> 0 THEN 'weight_grams=' || weight_grams END, CASE WHEN category <> '' THEN 'category=' || category END,
  CASE WHEN image_url <> '' THEN 'image_url=' || image_url END], lambda x: x IS NOT NULL)), ';') AS specs FROM item""")
def export_sparse_specs(g: Graph) -> DataFrame:
    specs = sparse({"weight_grams": F.col("weight_grams"), "category": F.col("category"), "image_url": F.col("image_url")})
    each = F.transform(F.map_entries(specs), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return g.item().select("node_id", F.array_join(F.sort_array(each), ";").alias("specs"))


@query("export_deleted", """SELECT 'item' AS entity, node_id FROM item WHERE node_id % 31 = 0 UNION ALL SELECT 'brand', node_id FROM brand WHERE node_id % 31 = 0 UNION ALL SELECT 'family', node_id FROM family WHERE node_id % 31 = 0""")
def export_deleted(g: Graph) -> DataFrame:
    """Ids of deleted rows of three labels."""
    gone = lambda df, n: df.filter("node_id % 31 = 0").select(F.lit(n).alias("entity"), "node_id")
    return gone(g.item(), "item").unionByName(gone(g.brand(), "brand")).unionByName(gone(g.family(), "family"))


@query("export_catalogue", f"""SELECT coalesce(b.slug, p.brand_slug) AS slug, coalesce(b.name, 'Unknown') AS name, b.slug IS NULL AS placeholder, coalesce(p.n, 0) AS n, p.first_slug FROM ({_BRANDS}) b
  FULL JOIN (SELECT brand_slug, count(*) AS n, min(slug) AS first_slug FROM ({_PRODUCTS}) GROUP BY 1) p ON p.brand_slug = b.slug""")
def export_catalogue(g: Graph) -> DataFrame:
    """Brands with their products; products of unknown brands get a placeholder brand."""
    p = product_rows(g).groupBy("brand_slug").agg(F.count(F.lit(1)).alias("n"), F.min("slug").alias("first_slug"))
    both = brand_rows(g).select("slug", "name").join(p, F.col("slug") == F.col("brand_slug"), "full")
    return both.select(
        F.coalesce("slug", "brand_slug").alias("slug"), F.coalesce("name", F.lit("Unknown")).alias("name"), F.col("slug").isNull().alias("placeholder"),
        F.coalesce("n", F.lit(0)).alias("n"), "first_slug",
    )


#: Products of a brand in one document, about.
CHUNK = 1000


def catalogue_json(g: Graph) -> DataFrame:
    """slug, part, parts, json: nested documents of a brand, products keyed by slug (of equal slugs the first id).

    A brand of more than CHUNK products comes in several documents of about that many, so no brand
    has to fit a row or a task.
    """
    p = product_rows(g).groupBy("brand_slug", "slug").agg(F.min(F.struct("node_id", "is_family", "variants")).alias("product"))
    parts = p.groupBy("brand_slug").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    dealt = p.join(parts, "brand_slug").withColumn("part", F.pmod(F.xxhash64("slug"), F.col("parts")))
    by_brand = dealt.groupBy("brand_slug", "part", "parts").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("slug", "product")))).alias("products"))
    return by_brand.select(F.col("brand_slug").alias("slug"), "part", "parts", F.to_json(F.struct(F.col("brand_slug").alias("id"), "products")).alias("json"))


@query("export_catalogue_json")
def export_catalogue_json(g: Graph) -> DataFrame:
    return catalogue_json(g)


@query("export_statistics", f"""SELECT (SELECT count(*) FROM brand) AS brands, count(*) AS products, CAST(sum(variants) AS BIGINT) AS variants FROM ({_PRODUCTS})""")
def export_statistics(g: Graph) -> DataFrame:
    p = product_rows(g).agg(F.count(F.lit(1)).alias("products"), F.sum("variants").alias("variants"))
    return g.brand().agg(F.count(F.lit(1)).alias("brands")).crossJoin(p)


@query("export_review_report", """SELECT entity, status, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM work_event GROUP BY 1, 2""")
def export_review_report(g: Graph) -> DataFrame:
    """A review by entity and decision."""
    return g.work_event().groupBy("entity", "status").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("export_notifications", "SELECT event_id, 'failed: ' || entity AS subject FROM work_event WHERE status = 'error'")
def export_notifications(g: Graph) -> DataFrame:
    """Messages as rows; sending them is no part of the engine."""
    return g.work_event().filter("status = 'error'").select("event_id", F.concat(F.lit("failed: "), F.col("entity").cast("string")).alias("subject"))


@query("export_state", "SELECT count(DISTINCT url) AS total_processed, min(url) AS first_id, max(url) AS last_id FROM source WHERE source_type = 'F'")
def export_state(g: Graph) -> DataFrame:
    return g.source().filter("source_type = 'F'").agg(F.countDistinct("url").alias("total_processed"), F.min("url").alias("first_id"), F.max("url").alias("last_id"))
