"""Landed pages, search results, feeds and state: crawls with limits, extraction with captured errors, tiers, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import units, urls
from cairn.functions.text import materials_in
from cairn.operators.aggregates import first_by
from cairn.operators.crawl import links_of
from cairn.operators.duplicates import probe
from cairn.operators.research import _RESULTS, search_results
from cairn.registry import query
from cairn.sources import files
from cairn.sources.scratch import fresh_root
from cairn.sources.views import Graph

#: Categories of a site that a crawl follows, and products that it takes of a site.
CATEGORIES, PRODUCTS = 15, 20
NOW = "2026-02-01 00:00:00"


def ranked(df: DataFrame, key: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def category_products(pages: DataFrame, categories: int = CATEGORIES, products: int = PRODUCTS) -> DataFrame:
    """host, category, product: of each site the pages with most links, and products that they link to.

    A first phase takes up to categories pages of a site, a second one their links until products
    are found; a product counts for the first category that has it.
    """
    links = links_of(pages).withColumn("host", F.regexp_extract("src", "^([^/]+)", 1))
    size = links.groupBy("host", "src").agg(F.count(F.lit(1)).alias("links"))
    chosen = ranked(size, ["host"], [F.desc("links"), "src"], "place").filter(F.col("place") <= categories)
    found = links.join(chosen.select("host", "src", "place"), ["host", "src"])
    once = first_by(found, ["host", "dst"], ["place"])
    taken = ranked(once, ["host"], ["place", "dst"], "n").filter(F.col("n") <= products)
    return taken.select("host", F.col("src").alias("category"), F.col("dst").alias("product"))


_LINKED = r"""lk AS (SELECT DISTINCT regexp_extract(src, '^([^/]+)', 1) AS host, src, dst FROM (SELECT host || path AS src, CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS dst FROM (
  SELECT host, path, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM page)))"""


@query("crawl_category_products", f""", {_LINKED}, c AS (SELECT * FROM (SELECT host, src, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, src) AS place FROM lk GROUP BY host, src) WHERE place <= {CATEGORIES})
  SELECT host, src AS category, dst AS product FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY place, dst) AS n FROM (SELECT *, row_number() OVER (PARTITION BY host, dst ORDER BY place) AS r FROM lk JOIN c USING (host, src)) WHERE r = 1) WHERE n <= {PRODUCTS}""")
def crawl_category_products(g: Graph) -> DataFrame:
    return category_products(g.page())


@query("crawl_collection_cards", r"""SELECT page_id, url, min(name) AS name FROM (SELECT page_id, unnest(CASE WHEN regexp_matches(html, '<article><h1>') THEN [{'url': host || path, 'name': regexp_extract(html, '<article><h1>([^<]*)</h1>', 1)}]
  ELSE list_transform(regexp_extract_all(html, '<a href="[^"]+">[^<]+</a>', 0), lambda x: {'url': host || regexp_extract(x, 'href="([^"]+)"', 1), 'name': regexp_extract(x, '>([^<]+)<', 1)}) END, recursive := true) FROM page) GROUP BY page_id, url""")
def crawl_collection_cards(g: Graph) -> DataFrame:
    """Products of a collection page: its cards, or all its links where it has none; once each address."""
    anchor = F.lit(r'<a href="[^"]+">[^<]+</a>')
    made = lambda u, n: F.struct(F.concat("host", u).alias("url"), n.alias("name"))
    cards = F.array(made(F.col("path"), F.regexp_extract("html", "<article><h1>([^<]*)</h1>", 1)))
    links = F.transform(F.regexp_extract_all("html", anchor, F.lit(0)), lambda x: made(F.regexp_extract(x, 'href="([^"]+)"', 1), F.regexp_extract(x, ">([^<]+)<", 1)))
    each = g.page().select("page_id", F.explode(F.when(F.col("html").rlike("<article><h1>"), cards).otherwise(links)).alias("x"))
    return each.groupBy("page_id", "x.url").agg(F.min("x.name").alias("name"))


@query("win_sample_top_up", """, p AS (SELECT host, path, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth, contains(path, 'a') AS hit FROM (SELECT DISTINCT host, path FROM page)),
  s AS (SELECT *, row_number() OVER (PARTITION BY host, depth ORDER BY md5(path), path) <= 2 AS drawn FROM p)
  SELECT host, path FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY CASE WHEN drawn THEN 0 ELSE 1 END, depth, md5(path), path) AS n FROM s WHERE drawn OR hit) WHERE n <= 5""")
def win_sample_top_up(g: Graph) -> DataFrame:
    """A sample of a site's addresses: two of each depth, filled up to five with those that hold a keyword."""
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    paths = g.page().select("host", "path").distinct().select("host", "path", depth.alias("depth"), F.contains("path", F.lit("a")).alias("hit"))
    some = ranked(paths, ["host", "depth"], [F.md5("path"), F.col("path")], "r").withColumn("drawn", F.col("r") <= 2)
    order = [F.when(F.col("drawn"), 0).otherwise(1), F.col("depth"), F.md5("path"), F.col("path")]
    return ranked(some.filter("drawn OR hit"), ["host"], order, "n").filter("n <= 5").select("host", "path")


@query("research_rows", rf"""SELECT node_id, pos, title, regexp_extract(link, '^https?://([^/]+)', 1) AS origin, substr(snippet, 1, 40) AS snippet, CAST(nullif(regexp_extract(snippet, '(\d+)\s*g\b', 1), '') AS DOUBLE) AS grams,
  CAST(nullif(regexp_extract(snippet, '\$\s*(\d+)', 1), '') AS DOUBLE) AS price FROM ({_RESULTS})""")
def research_rows(g: Graph) -> DataFrame:
    """Title, source, snippet and the first weight and price of each result."""
    s = F.col("snippet")
    return search_results(g).select(
        "node_id", "pos", "title", F.regexp_extract("link", "^https?://([^/]+)", 1).alias("origin"), F.substring(s, 1, 40).alias("snippet"),
        F.get(units.weights_in(s), F.lit(0)).alias("grams"), F.get(units.prices_in(s), F.lit(0)).alias("price"),
    )


@query("research_weight_sources", rf"""SELECT node_id, count(*) AS sources, min(w) AS lo, max(w) AS hi FROM (SELECT node_id, w, row_number() OVER (PARTITION BY node_id ORDER BY pos) AS r FROM (
  SELECT node_id, pos, CAST(nullif(regexp_extract(snippet, '(\d+)\s*g\b', 1), '') AS DOUBLE) + pos AS w FROM ({_RESULTS}) WHERE (node_id + pos) % 4 <> 0)) WHERE r <= 4 GROUP BY node_id HAVING count(*) >= 2""")
def research_weight_sources(g: Graph) -> DataFrame:
    """The first weight that each of up to four results names, for items of which two results name one."""
    w = F.get(units.weights_in(F.col("snippet")), F.lit(0)) + F.col("pos")
    named = search_results(g).filter((F.col("node_id") + F.col("pos")) % 4 != 0).select("node_id", "pos", w.alias("w")).filter("w IS NOT NULL")
    some = ranked(named, ["node_id"], ["pos"], "r").filter("r <= 4").groupBy("node_id")
    return some.agg(F.count(F.lit(1)).alias("sources"), F.min("w").alias("lo"), F.max("w").alias("hi")).filter("sources >= 2")


@query("research_all_specs", rf"""SELECT node_id, arg_min(w, pos) AS grams, arg_min(p, pos) FILTER (p IS NOT NULL) AS price, arg_max(m, pos) FILTER (m IS NOT NULL) AS material FROM (SELECT node_id, pos, CAST(nullif(regexp_extract(snippet, '(\d+)\s*g\b', 1), '') AS DOUBLE) AS w,
  CAST(nullif(regexp_extract(snippet, '\$\s*(\d+)', 1), '') AS DOUBLE) AS p, CASE WHEN (node_id + pos) % 3 = 0 THEN 'nylon' WHEN (node_id + pos) % 3 = 1 THEN 'titanium' END AS m FROM ({_RESULTS})) GROUP BY node_id""")
def research_all_specs(g: Graph) -> DataFrame:
    """The first weight and price over an item's results, and the last material that one names."""
    k = (F.col("node_id") + F.col("pos")) % 3
    body = F.concat_ws(" ", "snippet", F.when(k == 0, "of nylon").when(k == 1, "of titanium"))
    rows = search_results(g).select("node_id", "pos", body.alias("body")).select(
        "node_id", "pos", F.get(units.weights_in(F.col("body")), F.lit(0)).alias("w"), F.get(units.prices_in(F.col("body")), F.lit(0)).alias("p"), F.get(materials_in("body"), F.lit(0)).alias("m")
    )
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    return rows.groupBy("node_id").agg(F.min_by("w", at("w")).alias("grams"), F.min_by("p", at("p")).alias("price"), F.max_by("m", at("m")).alias("material"))


@query("research_batch_extract", r"""SELECT page_id, CASE WHEN error IS NULL THEN title END AS title, error FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN page_id % 7 = 0 THEN 'no page' WHEN regexp_extract(html, '<title>([^<]*)</title>', 1) = '' THEN 'no title' END AS error FROM page)""")
def research_batch_extract(g: Graph) -> DataFrame:
    """One row a page: what was extracted, or why nothing was. A page that cannot be read stops no other."""
    html = F.when(F.col("page_id") % 7 != 0, F.col("html"))
    title = F.nullif(F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit(""))
    error = F.when(html.isNull(), "no page").when(title.isNull(), "no title")
    return g.page().select("page_id", title.alias("title"), error.alias("error"))


@query("files_site_patterns", """SELECT host, min_page % 2 = 1 AS cached FROM (SELECT host, min(page_id) AS min_page FROM page GROUP BY host)""")
def files_site_patterns(g: Graph) -> DataFrame:
    """Sites whose learned patterns are younger than a day; the others are to be analysed again."""
    at = F.when(F.col("k") % 2 == 1, "2026-01-31 12:00:00").otherwise("2026-01-30 12:00:00").cast("timestamp")
    sites = g.page().groupBy("host").agg(F.min("page_id").alias("k"))
    young = files.fresh(sites.select("host", at.alias("created_at")), F.lit(NOW).cast("timestamp"), 24).select("host", F.lit(True).alias("cached"))
    return sites.select("host").join(young, "host", "left").select("host", F.coalesce("cached", F.lit(False)).alias("cached"))


@query("files_sync_since", """SELECT op, count(*) AS n, max('t' || lpad(CAST(node_id AS VARCHAR), 12, '0')) AS token FROM (SELECT node_id, CASE node_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'updated' ELSE 'deleted' END AS op FROM brand WHERE node_id > 3) GROUP BY op""")
def files_sync_since(g: Graph) -> DataFrame:
    """Changes of a feed behind a saved token, and the token to save next."""
    k, name = F.col("node_id"), F.struct("name")
    arr = lambda c, x: F.when(c, F.array(x)).otherwise(F.filter(F.array(x), lambda _: F.lit(False)))
    brands = F.struct(arr(k % 3 == 0, name).alias("added"), arr(k % 3 == 1, name).alias("updated"), arr(k % 3 == 2, F.col("name")).alias("deleted"))
    feed = g.brand().select(F.to_json(F.struct(brands.alias("brands"), F.concat(F.lit("t"), F.lpad(k.cast("string"), 12, "0")).alias("next_sync_token"))).alias("payload"))
    return files.changes_since(feed, "t" + "3".zfill(12)).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.max("token").alias("token"))


@query("files_state_round_trip", "SELECT url FROM source WHERE source_type <> 'F'")
def files_state_round_trip(g: Graph) -> DataFrame:
    """Sources that are new to a state that was written and read again."""
    root = fresh_root(g.spark, "state")
    files.write_state(g.source().filter("source_type = 'F'").select(F.col("url").alias("video_id")), root, NOW)
    return g.source().select("url").join(files.read_state(g.spark, root).select(F.col("video_id").alias("url")), "url", "left_anti")


@query("files_log_round_trip", """SELECT decision, count(*) AS entries, count(DISTINCT entity) AS entities FROM (SELECT entity, status AS decision FROM work_event WHERE event_id % 2 = 0 UNION ALL SELECT entity, status FROM work_event WHERE event_id % 3 = 0) GROUP BY decision""")
def files_log_round_trip(g: Graph) -> DataFrame:
    """A log appended to twice, as one JSON object a line, and read with its schema."""
    root = fresh_root(g.spark, "log")
    for n in (2, 3):
        rows = g.work_event().filter(F.col("event_id") % n == 0)
        files.append_log(rows.select(F.col("event_id").cast("string").alias("entry_id"), F.col("entity").cast("string").alias("entity_id"), F.col("status").alias("decision"), "ts"), root)
    return files.log_file(g.spark, root).groupBy("decision").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("entity_id").alias("entities"))


@query("dup_self_filtered")
def dup_self_filtered(g: Graph) -> DataFrame:
    """Matches of an item but itself, the five best, with what is sure enough to merge."""
    found = probe(g, "red widget", "Brand#17", 75.0)
    other = found.filter(~((F.lower("name") == "red widget") & (F.lower(F.coalesce("brand", F.lit(""))) == "brand#17")))
    return other.orderBy(F.desc("similarity"), "name", "node_id").limit(5).select("node_id", "name", "brand", F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= 90).alias("merge"))


_PRODUCT, _COLLECTION = "|".join(urls.PRODUCT_PATHS), "|".join(urls.COLLECTION_PATHS)
_SKIP = " OR ".join(f"contains(lower(dst), '{x}')" for x in urls.SKIPPED)


@query("url_product_pipeline", f""", {_LINKED} SELECT host, norm, min(dst) AS url, CASE WHEN bool_or(regexp_matches(norm, '{_PRODUCT}')) THEN 'product' WHEN bool_or(regexp_matches(norm, '{_COLLECTION}')) THEN 'collection' ELSE 'other' END AS kind FROM (
  SELECT host, dst, regexp_replace(lower(substr(dst, length(host) + 1)), '{urls.LOCALE}', '/') AS norm FROM lk WHERE starts_with(dst, host) AND NOT ({_SKIP})) GROUP BY host, norm""")
def url_product_pipeline(g: Graph) -> DataFrame:
    """A site's links but those to skip, without their locale, one address each, and what they lead to."""
    links = links_of(g.page()).withColumn("host", F.regexp_extract("src", "^([^/]+)", 1)).select("host", "dst").distinct()
    own = links.filter(F.startswith("dst", F.col("host")) & ~urls.is_skipped(F.col("dst")))
    path = urls.without_locale(F.substr("dst", F.length("host") + F.lit(1)))
    one = own.select("host", path.alias("norm"), "dst").groupBy("host", "norm").agg(F.min("dst").alias("url"))
    kind = F.when(urls.is_product(F.col("norm")), "product").when(urls.is_collection(F.col("norm")), "collection").otherwise("other")
    return one.select("host", "norm", "url", kind.alias("kind"))


@query("top_archive_by_title", "SELECT url, title, processed_at FROM source ORDER BY processed_at DESC NULLS FIRST, node_id LIMIT 100")
def top_archive_by_title(g: Graph) -> DataFrame:
    """The hundred latest sources, sorted by title after the cut."""
    last = g.source().orderBy(F.col("processed_at").desc_nulls_first(), "node_id").limit(100)
    return last.orderBy("title", "url").select("url", "title", "processed_at")


@query("comparison_maps", """SELECT i.node_id, count(DISTINCT o.name || '|' || e.kind) AS others, count(DISTINCT o.name || '|' || e.kind) = 0 AS none FROM item i LEFT JOIN (SELECT src_id, dst_id, CASE WHEN src_id % 2 = 0 THEN 'weight' ELSE 'price' END AS kind FROM e_compared_to) e ON e.src_id = i.node_id
  LEFT JOIN item o ON o.node_id = e.dst_id GROUP BY i.node_id""")
def comparison_maps(g: Graph) -> DataFrame:
    """Comparisons of each item as a list of maps, once each; the map of nulls that an item without any
    has is left out after the list is made."""
    kind = F.when(F.col("src_id") % 2 == 0, "weight").otherwise("price")
    edges = g.edge("COMPARED_TO").select(F.col("src_id").alias("node_id"), "dst_id", kind.alias("kind"))
    names = g.item().select(F.col("node_id").alias("dst_id"), F.col("name").alias("other"))
    both = g.item().select("node_id").join(edges.join(names, "dst_id", "left"), "node_id", "left")
    maps = both.groupBy("node_id").agg(F.collect_set(F.struct("other", "kind")).alias("maps"))
    held = F.filter("maps", lambda m: m["other"].isNotNull())
    return maps.select("node_id", F.size(held).cast("long").alias("others"), (F.size(held) == 0).alias("none"))


@query("text_brand_redundancy", """SELECT node_id, CASE WHEN starts_with(lower(name), lower(brand) || ' ') THEN 'remove' WHEN contains(lower(name), lower(brand)) THEN 'review' ELSE 'keep' END AS advice FROM item WHERE name IS NOT NULL AND brand <> ''""")
def text_brand_redundancy(g: Graph) -> DataFrame:
    """What to do about a brand that its item's name holds."""
    n, b = F.lower("name"), F.lower("brand")
    advice = F.when(F.startswith(n, F.concat(b, F.lit(" "))), "remove").when(F.contains(n, b), "review").otherwise("keep")
    return g.item().filter("name IS NOT NULL AND brand <> ''").select("node_id", advice.alias("advice"))
