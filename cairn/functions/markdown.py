"""Markdown and key-value text read into rows and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.aggregates import first_by
from cairn.registry import query
from cairn.sources.views import Graph

#: Where a gear guide's next product starts: a heading, a numbered line or a bold line.
SECTION = r"(?m)(?:^#{1,3}\s+|\n\d+\.\s+|\n\*\*)"


def sections(c: Column) -> Column:
    """Parts of a guide after its first heading."""
    parts = F.split(c, SECTION)
    return F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.trim(x) != "")


def product_fields(c: Column) -> Column:
    """struct(title, price, weight_grams, volume, r_value) of a product's text; the first pattern that fits wins."""
    first = lambda *patterns: F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])
    number = lambda *patterns: first(*patterns).try_cast("double")
    grams = F.coalesce(number(r"(?i)(\d+(?:\.\d+)?)\s*(?:g|grams)\b"), F.bround(number(r"(?i)(\d+(?:\.\d+)?)\s*(?:oz|ounces)\b") * 28.35))
    return F.struct(
        F.trim(first(r"^#*\s*([^\n]+)")).alias("title"), number(r"\$(\d+(?:\.\d{2})?)").alias("price"), grams.cast("int").alias("weight_grams"),
        number(r"(?i)(\d+)\s*(?:L|liters?)\b").alias("volume"), number(r"(?i)R-?value:?\s*(\d+(?:\.\d+)?)").alias("r_value"),
    )


def key_values(c: Column) -> Column:
    """Pairs (k, v) of the lines "key: value"; keys in lower case, of repeated keys the last."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.element_at(F.split(x, ":", 2), 1))).alias("k"), F.trim(F.element_at(F.split(x, ":", 2), 2)).alias("v")))
    return F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))


def names_in(c: Column) -> Column:
    """Link texts of product links, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[([^\]]{3,80})\]\([^)]*/(?:p|product|products)/[^)]*\)"), F.lit(1)))


def _guide(g: Graph) -> DataFrame:
    k = F.col("node_id").cast("string")
    body = F.concat(F.lit(" weighs "), (F.col("node_id") % 90 + 10).cast("string"), F.lit(" oz, costs $"), (F.col("node_id") % 300).cast("string"), F.lit(".50, R-value: 4.2"))
    md = F.concat(F.lit("intro\n## "), "name", F.lit("\n"), body, F.lit("\n1. second item "), k, F.lit("\n[Link "), k, F.lit("](https://x/p/"), k, F.lit(") [no](https://x/about)"))
    return g.item().filter("name IS NOT NULL").select("node_id", "name", md.alias("md"))


@query("md_sections", """SELECT node_id, 0 AS pos, name AS first_line FROM item WHERE name IS NOT NULL UNION ALL SELECT node_id, 1, 'second item ' || node_id FROM item WHERE name IS NOT NULL""")
def md_sections(g: Graph) -> DataFrame:
    parts = _guide(g).select("node_id", F.posexplode(sections(F.col("md"))).alias("pos", "part"))
    return parts.select("node_id", "pos", F.element_at(F.split("part", "\n"), 1).alias("first_line"))


@query("md_product_fields", """SELECT node_id, name AS title, (node_id % 300) + 0.5::DOUBLE AS price, CAST(round_even((node_id % 90 + 10) * 28.35::DOUBLE, 0) AS INTEGER) AS weight_grams, 4.2::DOUBLE AS r_value FROM item WHERE name IS NOT NULL""")
def md_product_fields(g: Graph) -> DataFrame:
    parts = _guide(g).select("node_id", sections(F.col("md"))[0].alias("part")).select("node_id", product_fields(F.col("part")).alias("p"))
    return parts.select("node_id", "p.title", "p.price", "p.weight_grams", "p.r_value")


@query("md_names", "SELECT node_id, 'Link ' || node_id AS names FROM item WHERE name IS NOT NULL")
def md_names(g: Graph) -> DataFrame:
    return _guide(g).select("node_id", F.array_join(names_in(F.col("md")), ";").alias("names"))


@query("md_key_values", """SELECT node_id, 'weight' AS k, (node_id % 50) || ' g' AS v FROM item UNION ALL SELECT node_id, 'colour', 'a: b' FROM item""")
def md_key_values(g: Graph) -> DataFrame:
    t = F.concat(F.lit("Here it is\nWeight: "), (F.col("node_id") % 50).cast("string"), F.lit(" g\n Colour : a: b\n"))
    return g.item().select("node_id", F.explode(key_values(t)).alias("x")).select("node_id", "x.k", "x.v")


@query("json_map_urls", "SELECT node_id, 'https://x/' || node_id AS url FROM item")
def json_map_urls(g: Graph) -> DataFrame:
    """Addresses from results that come in three shapes: a list of strings, of objects, or under a key."""
    u = F.concat(F.lit('"https://x/'), F.col("node_id").cast("string"), F.lit('"'))
    k = F.col("node_id") % 3
    j = F.when(k == 0, F.concat(F.lit("["), u, F.lit("]"))).when(k == 1, F.concat(F.lit('[{"url":'), u, F.lit("}]"))).otherwise(F.concat(F.lit('{"links":['), u, F.lit("]}")))
    at = lambda p: F.get_json_object(j, p)
    return g.item().select("node_id", F.coalesce(at("$.links[0]"), at("$[0].url"), at("$[0]")).alias("url"))


@query("format_labels", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, (event_id // 60) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS clock FROM work_event""")
def format_labels(g: Graph) -> DataFrame:
    n = F.col("event_id")
    return g.work_event().select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.format_string("%d:%02d", F.floor(n / 60), n % 60).alias("clock"))


@query("quality_decisions", """SELECT event_id, CASE WHEN status = 'error' THEN 'needs_review' WHEN value > 20 THEN 'auto_fixed' ELSE 'no_issue' END AS decision FROM work_event""")
def quality_decisions(g: Graph) -> DataFrame:
    """Check results as decisions."""
    d = F.when(F.col("status") == "error", "needs_review").when(F.col("value") > 20, "auto_fixed").otherwise("no_issue")
    return g.work_event().select("event_id", d.alias("decision"))


@query("export_review_markdown", """SELECT entity, string_agg('- ' || status || ' #' || event_id, chr(10) ORDER BY event_id) AS report FROM work_event WHERE status = 'error' GROUP BY entity""")
def export_review_markdown(g: Graph) -> DataFrame:
    """One report an entity: its lines in order. An entity's errors are its own log, which bounds the list."""
    line = F.concat(F.lit("- "), "status", F.lit(" #"), F.col("event_id").cast("string"))
    rows = g.work_event().filter("status = 'error'").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    return rows.select("entity", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("report"))


@query("top_brand_listing", """SELECT brand, name, node_id FROM (SELECT *, dense_rank() OVER (ORDER BY brand) AS b, row_number() OVER (PARTITION BY brand ORDER BY name, node_id) AS r FROM item WHERE brand IS NOT NULL) WHERE b <= 10 AND r <= 5""")
def top_brand_listing(g: Graph) -> DataFrame:
    """The first five items of the first ten brands; the brands come from a top-k of their own."""
    brands = g.item().filter("brand IS NOT NULL").select("brand").distinct().orderBy("brand").limit(10)
    rows = g.item().filter("brand IS NOT NULL").select("brand", "name", "node_id").join(brands, "brand", "left_semi")
    r = F.row_number().over(Window.partitionBy("brand").orderBy("name", "node_id"))
    return rows.withColumn("r", r).filter("r <= 5").drop("r")


@query("win_best_extraction", """SELECT entity, event_id FROM (SELECT entity, event_id, row_number() OVER (PARTITION BY entity ORDER BY value DESC, event_id) AS r FROM work_event) WHERE r = 1""")
def win_best_extraction(g: Graph) -> DataFrame:
    """Of several extractions the one with most; of ties the first."""
    return first_by(g.work_event().select("entity", "event_id", "value"), ["entity"], [F.desc("value"), "event_id"]).select("entity", "event_id")
