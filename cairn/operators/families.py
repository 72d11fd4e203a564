"""Product-family detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import variant_of
from cairn.operators.graph import present, without
from cairn.registry import query
from cairn.sources.views import Graph


def family_confidence(n: Column, pattern: Column, any_backpack: Column, one_category: Column) -> Column:
    c = F.lit(0.5) + F.when(n >= 3, 0.2).otherwise(0.0) + F.when(n >= 5, 0.1).otherwise(0.0)
    c = c + F.when(pattern == "version_number", 0.2).when((pattern == "size_number") & any_backpack, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), c + F.when(one_category, 0.1).otherwise(0.0))


def detect_families(items: DataFrame, least: int = 2) -> DataFrame:
    """Groups of items of one brand whose names share a base.

    items: node_id, name, brand, category. All measures are partial aggregates; the pattern is
    that of the first item in name order, and the number of different categories decides
    whether they agree, so no group is gathered.
    """
    named = items.filter(F.col("name").isNotNull() & present("brand")).select("*", variant_of("name").alias("v"))
    named = named.filter("v.pattern <> 'none'")
    full = F.when(present("category"), F.col("category"))
    groups = named.groupBy("brand", F.col("v.base").alias("base")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("v.pattern", F.struct("name", "node_id")).alias("pattern"),
        F.bool_or(F.coalesce(full == "backpack", F.lit(False))).alias("_backpack"),
        (F.min(full).isNotNull() & (F.min(full) == F.max(full))).alias("_one"),
    )
    c = family_confidence(F.col("n"), F.col("pattern"), F.col("_backpack"), F.col("_one"))
    return groups.filter(F.col("n") >= least).select("brand", "base", "n", "pattern", F.round(c, 6).alias("confidence"))


_PARTS = r"""SELECT brand, node_id, name, category, CASE WHEN regexp_matches(trim(name), '^(.+?)\s+(\d{1,2})(\+)?$') THEN 'version_number' ELSE 'size_number' END AS pattern,
  regexp_extract(trim(name), '(?i)^(.+?)\s+(\d+L?)$', 1) AS base FROM item WHERE name IS NOT NULL AND brand IS NOT NULL AND brand <> '' AND regexp_matches(trim(name), '(?i)^(.+?)\s+(\d{1,2}|\d{2,3}L?)$')"""
_FAMILIES = f"""SELECT brand, base, count(*) AS n, arg_min(pattern, name || lpad(CAST(node_id AS VARCHAR), 9, '0')) AS pattern,
  round(least(1.0, 0.5 + CASE WHEN count(*) >= 3 THEN 0.2 ELSE 0.0 END + CASE WHEN count(*) >= 5 THEN 0.1 ELSE 0.0 END
  + CASE WHEN arg_min(pattern, name || lpad(CAST(node_id AS VARCHAR), 9, '0')) = 'version_number' THEN 0.2 ELSE 0.0 END
  + CASE WHEN count(DISTINCT nullif(category, '')) = 1 THEN 0.1 ELSE 0.0 END)::DOUBLE, 6) AS confidence FROM ({_PARTS}) GROUP BY 1, 2 HAVING count(*) >= 2"""


@query("family_detect", _FAMILIES)
def family_detect(g: Graph) -> DataFrame:
    return detect_families(g.item())


@query("family_by_brand", f"SELECT brand, count(*) AS candidates, CAST(sum(n) AS BIGINT) AS items FROM ({_FAMILIES}) GROUP BY brand")
def family_by_brand(g: Graph) -> DataFrame:
    return detect_families(g.item()).groupBy("brand").agg(F.count(F.lit(1)).alias("candidates"), F.sum("n").alias("items"))


@query("family_summary", """SELECT (SELECT count(*) FROM family) AS families, (SELECT count(DISTINCT src_id) FROM e_variant_of) AS in_families,
  (SELECT count(*) FROM item WHERE node_id NOT IN (SELECT src_id FROM e_variant_of)) AS alone, (SELECT count(DISTINCT brand) FROM family) AS brands""")
def family_summary(g: Graph) -> DataFrame:
    """Four one-row aggregates side by side."""
    one = g.family().agg(F.count(F.lit(1)).alias("families"), F.countDistinct("brand").alias("brands"))
    two = g.edge("VARIANT_OF").agg(F.countDistinct("src_id").alias("in_families"))
    three = without(g.item().select("node_id"), g.edge("VARIANT_OF")).agg(F.count(F.lit(1)).alias("alone"))
    return one.crossJoin(two).crossJoin(three)


@query("family_create", f"""SELECT brand, base, src_id, rel_type FROM (SELECT f.brand, f.base, p.node_id AS src_id, 'VARIANT_OF' AS rel_type FROM ({_FAMILIES}) f JOIN ({_PARTS}) p USING (brand, base)
  UNION ALL SELECT f.brand, f.base, p.node_id, 'HAS_VARIANT' FROM ({_FAMILIES}) f JOIN ({_PARTS}) p USING (brand, base))""")
def family_create(g: Graph) -> DataFrame:
    """Edge rows that new families add: two for each variant."""
    found = detect_families(g.item()).select("brand", "base")
    members = g.item().filter(F.col("name").isNotNull() & present("brand")).select("brand", "node_id", variant_of("name").alias("v")).filter("v.pattern <> 'none'")
    members = members.select("brand", F.col("v.base").alias("base"), F.col("node_id").alias("src_id")).join(found, ["brand", "base"])
    return members.select("brand", "base", "src_id", F.explode(F.array(F.lit("VARIANT_OF"), F.lit("HAS_VARIANT"))).alias("rel_type"))
