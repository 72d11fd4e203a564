"""Evidence from search results that are landed as a table, and what it says about items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import units
from cairn.operators.aggregates import first_by
from cairn.registry import query
from cairn.sources.views import Graph

#: Gear words of a snippet, and domains that are trusted.
GEAR_WORDS = ["gear", "outdoor", "bolt", "ring", "widget"]
TRUSTED = ["example.com"]


def search_results(g: Graph) -> DataFrame:
    """node_id, pos, title, snippet, link: results that a search for each item gave."""
    k = F.col("node_id")
    pos = F.explode(F.sequence(F.lit(1), F.lit(3)))
    rows = g.item().filter("name IS NOT NULL").select("node_id", "name", "brand", pos.alias("pos"))
    return rows.select(
        "node_id", "name", "brand", "pos", F.concat_ws(" ", F.when(F.col("pos") != 2, F.col("name")), F.lit("| shop")).alias("title"),
        F.concat_ws(" ", F.when((k + F.col("pos")) % 2 == 0, F.col("brand")), F.lit("outdoor weighs"), (k % 90 + 20).cast("string"), F.lit("g for $"), ((k + F.col("pos")) % 300).cast("string")).alias("snippet"),
        F.concat(F.lit("https://"), F.when(k % 3 == 0, "shop.example.com").otherwise("other.example.org"), F.lit("/"), F.col("pos").cast("string")).alias("link"),
    )


_RESULTS = """SELECT node_id, name, brand, pos, CASE WHEN pos <> 2 THEN name || ' | shop' ELSE '| shop' END AS title,
  CASE WHEN (node_id + pos) % 2 = 0 AND brand IS NOT NULL THEN brand || ' ' ELSE '' END || 'outdoor weighs ' || (node_id % 90 + 20) || ' g for $ ' || ((node_id + pos) % 300) AS snippet,
  'https://' || CASE WHEN node_id % 3 = 0 THEN 'shop.example.com' ELSE 'other.example.org' END || '/' || pos AS link FROM item, (SELECT unnest([1, 2, 3]) AS pos) WHERE name IS NOT NULL"""


@query("research_best_result", f"""SELECT node_id, pos, round(conf, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY conf DESC, pos) AS r FROM (
  SELECT node_id, pos, least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN contains(lower(title), lower(name)) THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN contains(lower(snippet), lower(brand)) THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN contains(link, 'example.com') THEN 0.2::DOUBLE ELSE 0 END) AS conf FROM ({_RESULTS}))) WHERE r = 1""")
def research_best_result(g: Graph) -> DataFrame:
    """The result with the most evidence for each item; of ties the first."""
    has = lambda a, b: F.coalesce(F.contains(F.lower(a), F.lower(b)), F.lit(False))
    trusted = F.contains("link", F.lit(TRUSTED[0]))
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    conf = F.least(F.lit(1.0), F.lit(0.3) + one(has("title", "name"), 0.3) + one(has("snippet", "brand"), 0.2) + one(trusted, 0.2))
    best = first_by(search_results(g).select("node_id", "pos", conf.alias("confidence")), ["node_id"], [F.desc("confidence"), "pos"])
    return best.select("node_id", "pos", F.round("confidence", 6).alias("confidence"))


@query("research_brand_tiers", f"""SELECT node_id, CASE WHEN c >= 0.7 THEN 'valid' WHEN c >= 0.4 THEN 'uncertain' ELSE 'invalid' END AS verdict, round(CASE WHEN c >= 0.4 THEN c ELSE 1 - c END, 6) AS confidence FROM (
  SELECT node_id, least(0.95::DOUBLE, sum(CASE WHEN contains(lower(title || ' ' || snippet), lower(brand)) THEN 15 ELSE 0 END + CASE WHEN contains(lower(snippet), 'outdoor') THEN 10 ELSE 0 END) / 100.0::DOUBLE) AS c FROM ({_RESULTS}) GROUP BY node_id)""")
def research_brand_tiers(g: Graph) -> DataFrame:
    """Verdict on a brand from the sum over its results."""
    named = F.coalesce(F.contains(F.lower(F.concat_ws(" ", "title", "snippet")), F.lower("brand")), F.lit(False))
    points = F.when(named, 15).otherwise(0) + F.when(F.contains(F.lower("snippet"), F.lit("outdoor")), 10).otherwise(0)
    c = search_results(g).groupBy("node_id").agg(F.least(F.lit(0.95), F.sum(points) / F.lit(100.0)).alias("c"))
    verdict = F.when(F.col("c") >= 0.7, "valid").when(F.col("c") >= 0.4, "uncertain").otherwise("invalid")
    return c.select("node_id", verdict.alias("verdict"), F.round(F.when(F.col("c") >= 0.4, F.col("c")).otherwise(1 - F.col("c")), 6).alias("confidence"))


@query("research_missing_weight", f"""SELECT r.node_id, avg(w) AS mean, count(*) AS n, least(0.8::DOUBLE, count(*) * 0.2::DOUBLE) AS confidence FROM (
  SELECT node_id, CAST(unnest(regexp_extract_all(snippet, '(\\d+)\\s*g\\b', 1)) AS DOUBLE) AS w FROM ({_RESULTS})) r JOIN item i ON i.node_id = r.node_id WHERE i.weight_grams IS NULL AND w > 10 AND w < 20000 GROUP BY 1""")
def research_missing_weight(g: Graph) -> DataFrame:
    """Mean of the weights that results name for items without one; more of them make it surer."""
    lacking = g.item().filter("weight_grams IS NULL").select("node_id")
    found = search_results(g).join(lacking, "node_id", "left_semi").select("node_id", F.explode(units.weights_in(F.col("snippet"))).alias("w"))
    n = F.count(F.lit(1))
    return found.groupBy("node_id").agg(F.avg("w").alias("mean"), n.alias("n"), F.least(F.lit(0.8), n * F.lit(0.2)).alias("confidence"))


@query("research_price_range", f"""SELECT node_id, min(p) AS lo, max(p) AS hi, avg(p) AS mean FROM (SELECT node_id, CAST(unnest(regexp_extract_all(snippet, '\\$\\s*(\\d+)', 1)) AS DOUBLE) AS p FROM ({_RESULTS})) GROUP BY node_id""")
def research_price_range(g: Graph) -> DataFrame:
    found = search_results(g).select("node_id", F.explode(units.prices_in(F.col("snippet"))).alias("p"))
    return found.groupBy("node_id").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.avg("p").alias("mean"))


@query("research_specs", f"""SELECT node_id, arg_min(w, pos) AS weight FROM (SELECT node_id, pos, CAST(regexp_extract(snippet, '(\\d+)\\s*g\\b', 1) AS DOUBLE) AS w FROM ({_RESULTS})) GROUP BY node_id""")
def research_specs(g: Graph) -> DataFrame:
    """First hit of each field over an item's results."""
    w = F.regexp_extract("snippet", r"(\d+)\s*g\b", 1).try_cast("double")
    rows = search_results(g).select("node_id", "pos", w.alias("w"))
    return rows.groupBy("node_id").agg(F.min_by("w", "pos").alias("weight"))


@query("research_enrich_gate", f"""SELECT node_id, conf BETWEEN 0.4 AND 0.8 AS enrich, conf > 0.3 AS keep FROM (SELECT node_id, max(0.3::DOUBLE + CASE WHEN contains(lower(title), lower(name)) THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN contains(link, 'example.com') THEN 0.2::DOUBLE ELSE 0 END) AS conf FROM ({_RESULTS}) GROUP BY node_id)""")
def research_enrich_gate(g: Graph) -> DataFrame:
    """Which items a second pass enriches and which are kept at all."""
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    conf = F.lit(0.3) + one(F.contains(F.lower("title"), F.lower("name")), 0.3) + one(F.contains("link", F.lit(TRUSTED[0])), 0.2)
    c = search_results(g).groupBy("node_id").agg(F.max(conf).alias("c"))
    return c.select("node_id", F.col("c").between(0.4, 0.8).alias("enrich"), (F.col("c") > 0.3).alias("keep"))


@query("research_brand_model", r"""SELECT node_id, string_split(n, ' ')[1] AS maker, trim(substr(n, length(string_split(n, ' ')[1]) + 2)) AS model FROM (SELECT node_id, regexp_replace(name, '^\d+x\s+', '') AS n FROM item)""")
def research_brand_model(g: Graph) -> DataFrame:
    """A quantity prefix removed, the first word as maker and the rest as model."""
    rows = g.item().select("node_id", F.regexp_replace("name", r"^\d+x\s+", "").alias("n"))
    first = F.element_at(F.split("n", " "), 1)
    return rows.select("node_id", first.alias("maker"), F.trim(F.substr(F.col("n"), F.length(first) + F.lit(2))).alias("model"))
