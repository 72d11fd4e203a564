"""Crawling over pages that are landed as a table: frontier joins, site maps and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import urls
from cairn.operators.aggregates import first_by
from cairn.registry import query
from cairn.sources.scratch import keeper
from cairn.sources.views import Graph


def links_of(pages: DataFrame) -> DataFrame:
    """src, dst: every link of every page as an absolute address, once each."""
    each = pages.select("host", "path", F.explode(F.array_distinct(urls.links_in(F.col("html")))).alias("href"))
    return each.select(F.concat("host", "path").alias("src"), F.when(F.startswith("href", F.lit("/")), F.concat("host", "href")).otherwise(F.col("href")).alias("dst")).distinct()


def breadth_first(links: DataFrame, seeds: DataFrame, keep, most_depth: int = 20) -> DataFrame:
    """node, depth: nodes within most_depth links of a seed, each at its least depth.

    A round joins the frontier with the links and drops what was visited (anti-join); the
    frontier is a written table, so rounds do not repeat one another's work.
    """
    frontier = keep(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "depth0")
    visited, k = frontier, 0
    while k < most_depth and not frontier.isEmpty():
        k += 1
        step = links.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = keep(step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)), f"depth{k}")
        visited = visited.unionByName(frontier)
    return visited


@query("crawl_links", r"""SELECT DISTINCT host || path AS src, CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS dst FROM (
  SELECT host, path, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM page)""")
def crawl_links(g: Graph) -> DataFrame:
    return links_of(g.page())


@query("crawl_breadth_first", """, l AS (SELECT src_id AS src, dst_id AS dst FROM e_compared_to UNION ALL SELECT src_id, dst_id FROM e_pairs_with),
  d0 AS (SELECT 0 AS node), d1 AS (SELECT DISTINCT dst AS node FROM l WHERE src IN (SELECT node FROM d0)), d2 AS (SELECT DISTINCT dst AS node FROM l WHERE src IN (SELECT node FROM d1)),
  d3 AS (SELECT DISTINCT dst AS node FROM l WHERE src IN (SELECT node FROM d2))
  SELECT node, min(depth) AS depth FROM (SELECT node, 0 AS depth FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3) GROUP BY node""")
def crawl_breadth_first(g: Graph) -> DataFrame:
    """Items within three comparison or pairing links of item 0."""
    both = g.edge("COMPARED_TO").unionByName(g.edge("PAIRS_WITH")).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return breadth_first(both, g.item().filter("node_id = 0").select(F.col("node_id").alias("node")), keeper(g.spark), 3)


@query("crawl_two_hop", """SELECT DISTINCT a.src_id AS category_id, b.dst_id AS product_id FROM e_compared_to a JOIN e_pairs_with b ON b.src_id = a.dst_id""")
def crawl_two_hop(g: Graph) -> DataFrame:
    a = g.edge("COMPARED_TO").select(F.col("src_id").alias("category_id"), F.col("dst_id").alias("mid"))
    return a.join(g.edge("PAIRS_WITH").select(F.col("src_id").alias("mid"), F.col("dst_id").alias("product_id")), "mid").select("category_id", "product_id").distinct()


_LINKS = r"""(SELECT page_id, host, href FROM (SELECT page_id, host, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS href FROM page))"""
_SKIP = " OR ".join(f"contains(lower(href), '{s}')" for s in urls.SKIPPED)


@query("crawl_site_map", f"""SELECT host, count(DISTINCT href) AS links, count(DISTINCT CASE WHEN {_SKIP} THEN href END) AS skipped, count(DISTINCT page_id) AS pages FROM {_LINKS} GROUP BY host""")
def crawl_site_map(g: Graph) -> DataFrame:
    """What each site links to, and how much of it a crawl leaves out."""
    each = g.page().select("page_id", "host", F.explode(F.array_distinct(urls.links_in(F.col("html")))).alias("href"))
    return each.groupBy("host").agg(
        F.countDistinct("href").alias("links"), F.countDistinct(F.when(urls.is_skipped(F.col("href")), F.col("href"))).alias("skipped"), F.countDistinct("page_id").alias("pages")
    )


@query("crawl_locale_variants", f"""SELECT norm, arg_min(url, ord) AS url FROM (SELECT norm, url, (CASE WHEN is_locale THEN 1 ELSE 0 END) || url AS ord FROM (
  SELECT url, regexp_replace(lower(path), '{urls.LOCALE}', '/') AS norm, regexp_matches(lower(path), '{urls.LOCALE}') AS is_locale FROM page)) GROUP BY norm""")
def crawl_locale_variants(g: Graph) -> DataFrame:
    """One address for each page without its locale; a plain one is preferred."""
    rows = g.page().select("url", urls.without_locale(F.col("path")).alias("norm"), F.lower("path").rlike(urls.LOCALE).cast("int").alias("is_locale"))
    return first_by(rows, ["norm"], ["is_locale", "url"]).select("norm", "url")


@query("crawl_categories", f"""SELECT href, count(DISTINCT page_id) AS n FROM {_LINKS} GROUP BY href""")
def crawl_categories(g: Graph) -> DataFrame:
    each = g.page().select("page_id", F.explode(F.array_distinct(urls.links_in(F.col("html")))).alias("href"))
    return each.groupBy("href").agg(F.countDistinct("page_id").alias("n"))


#: A site's learned patterns: kind, pattern, confidence, position.
PATTERNS = [("product", r"/p/", 0.8, 0), ("product", r"/[0-9]+", 0.7, 1), ("category", r"^/[a-z]{2}/", 0.65, 2), ("skip", r"/[a-z]*\.$", 0.9, 3)]


def matched_patterns(g: Graph, paths: DataFrame) -> DataFrame:
    """path, kind, pattern: the most confident pattern of each kind that matches; of ties the first."""
    best = None
    for kind, pattern, confidence, position in PATTERNS:
        hit = paths.filter(F.lower("path").rlike(pattern)).select(
            "path", F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern"), F.lit(confidence).alias("confidence"), F.lit(position).alias("position")
        )
        best = hit if best is None else best.unionByName(hit)
    return first_by(best, ["path", "kind"], [F.desc("confidence"), "position"])


@query("crawl_patterns", "SELECT path, kind, arg_min(pattern, position) AS pattern, max(confidence) AS confidence FROM (" + " UNION ALL ".join(
    f"SELECT DISTINCT path, '{k}' AS kind, '{p}' AS pattern, {c}::DOUBLE AS confidence, {n} AS position FROM page WHERE regexp_matches(lower(path), '{p}')" for k, p, c, n in PATTERNS) + ") GROUP BY 1, 2")
def crawl_patterns(g: Graph) -> DataFrame:
    return matched_patterns(g, g.page().select("path").distinct()).select("path", "kind", "pattern", "confidence")


@query("crawl_page_cards", r"""SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM page""")
def crawl_page_cards(g: Graph) -> DataFrame:
    return g.page().select(
        "page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("paragraphs"),
    )


@query("crawl_blocked", "SELECT page_id, length(html) < 500 OR contains(lower(html), 'captcha') OR contains(lower(html), 'access denied') AS blocked FROM page")
def crawl_blocked(g: Graph) -> DataFrame:
    low = F.lower("html")
    return g.page().select("page_id", ((F.length("html") < 500) | F.contains(low, F.lit("captcha")) | F.contains(low, F.lit("access denied"))).alias("blocked"))


@query("crawl_depth_totals", """SELECT host, depth, count(*) AS n FROM (SELECT DISTINCT host, path, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM page) GROUP BY 1, 2""")
def crawl_depth_totals(g: Graph) -> DataFrame:
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("long")
    return g.page().select("host", "path", depth.alias("depth")).distinct().groupBy("host", "depth").agg(F.count(F.lit(1)).alias("n"))
