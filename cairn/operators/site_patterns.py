"""Learned address patterns of sites as tables: validity, age, the class of each address, and what a discovery does with a site."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.registry import query
from cairn.sources.views import Graph

# Confidence that an analysis and one of its product patterns need, hours that it lasts, addresses that an analysis needs.
SURE_SITE, SURE_PATTERN, HOURS, LEAST_URLS = 0.6, 0.7, 24, 5
PATTERN = "host string, kind string, regex string, confidence double, position int"
MATCH = "hit array<int>"


@lru_cache(maxsize=100_000)
def _compiled(regex: str | None) -> re.Pattern | None:
    try:
        return re.compile(regex, re.IGNORECASE) if regex is not None else None
    except re.error:
        return None


def checked(patterns: DataFrame) -> DataFrame:
    """patterns with valid: whether the expression is one; decided once for each different expression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_compiled(r) is not None for r in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_())], ["regex", "valid"])

    flags = patterns.select("regex").distinct().mapInArrow(run, "regex string, valid boolean")
    return patterns.join(flags.withColumnRenamed("regex", "_r"), F.col("regex").eqNullSafe(F.col("_r")), "left").drop("_r")


def matched(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """host, path, kind, regex, confidence, position of every pattern of a site that is found in a path of it, letters in either case.

    An expression that is none matches nothing. A site's patterns come to its paths as one list.
    """
    lists = checked(patterns).filter("valid").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("position", "kind", "regex", "confidence"))).alias("known"))  # those of one site
    rows = paths.select("host", "path").distinct().join(lists, "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for path, known in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                hits.append([i for i, r in enumerate(known) if path is not None and _compiled(r).search(path)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(hits, pa.list_(pa.int32()))], ["host", "path", "known", "hit"])

    shape = rows.schema["known"].dataType.simpleString()
    slim = rows.withColumn("_regex", F.transform("known", lambda k: k["regex"])).select("host", "path", "known", "_regex")
    found = slim.mapInArrow(run, f"host string, path string, known {shape}, {MATCH}")
    return found.select("host", "path", F.explode(F.transform("hit", lambda i: F.get("known", i))).alias("k")).select("host", "path", "k.kind", "k.regex", "k.confidence", "k.position")


def classified(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """host, path, kind, regex, confidence: skip before product before category, else other; the most confident pattern of the kind, of ties the first."""
    rank = F.when(F.col("kind") == "skip", 0).when(F.col("kind") == "product", 1).when(F.col("kind") == "category", 2)
    hits = matched(paths, patterns).withColumn("_rank", rank).filter("_rank IS NOT NULL")
    best = hits.groupBy("host", "path").agg(F.min_by(F.struct("kind", "regex", "confidence"), F.struct("_rank", -F.col("confidence"), "position")).alias("x"))
    every = paths.select("host", "path").distinct().join(best, ["host", "path"], "left")
    return every.select("host", "path", F.coalesce("x.kind", F.lit("other")).alias("kind"), "x.regex", "x.confidence")


def site_gates(sites: DataFrame, patterns: DataFrame, now: Column, hours: int = HOURS) -> DataFrame:
    """host, valid, expired, best_product, best_category of each analysis (host, overall, created_at).

    An analysis is valid if it is sure enough and has a product pattern that is; it has expired
    after hours. Of patterns that are equally sure the first is best.
    """
    best = lambda kind: F.min_by("regex", F.when(F.col("kind") == kind, F.struct(-F.col("confidence"), "position")))
    of = patterns.groupBy("host").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "product", F.col("confidence"))), F.lit(-1.0)).alias("top"),
        best("product").alias("best_product"), best("category").alias("best_category"),
    )
    age = F.timestamp_diff("SECOND", F.col("created_at"), now) / 3600
    rows = sites.join(of, "host", "left")
    return rows.select("host", F.coalesce((F.col("overall") >= SURE_SITE) & (F.col("top") >= SURE_PATTERN), F.lit(False)).alias("valid"), (age > hours).alias("expired"), "best_product", "best_category")


def discovery(urls: DataFrame, sites: DataFrame, patterns: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """host, plan, urls, products, categories, taken of each site of urls (host, path).

    plan: cached (a fresh valid analysis), analyse (none, or expired), crawl (too few addresses for an
    analysis), low_confidence (an analysis that is not valid; both of the last fall back to a crawl).
    products and categories count the addresses that a cached analysis tells apart; of products at
    most the first most in order are taken, and of sites without any the categories.
    """
    known = urls.select("host", "path").distinct()
    size = known.groupBy("host").agg(F.count(F.lit(1)).alias("urls"))
    gates = size.join(site_gates(sites, patterns, now), "host", "left")
    fresh = F.col("valid").isNotNull() & ~F.col("expired")
    plan = F.when(fresh & F.col("valid"), "cached").when(fresh, "low_confidence").when(F.col("urls") < LEAST_URLS, "crawl").otherwise("analyse")
    planned = gates.select("host", "urls", plan.alias("plan"))
    kinds = classified(known.join(planned.filter("plan = 'cached'").select("host"), "host", "left_semi"), patterns)
    counted = kinds.groupBy("host").agg(F.count_if(F.col("kind") == "product").alias("products"), F.count_if(F.col("kind") == "category").alias("categories"))
    taken = F.when(F.col("products") > 0, F.least("products", F.lit(most)) if most else F.col("products")).otherwise(F.col("categories"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return planned.join(counted, "host", "left").select("host", "plan", "urls", zero("products").alias("products"), zero("categories").alias("categories"), zero(taken).alias("taken"))


def learned(g: Graph) -> tuple[DataFrame, DataFrame, Column]:
    """Analyses of the sites of pages: patterns from the forms of their paths, as sure as they are frequent, and
    when each site was analysed: at the event of its last page's number. The time is that of the last event."""
    page = g.page().select("page_id", "host", "path")
    path = F.col("path")
    kind = F.when(path.rlike(r"/\d+$"), "product").when(path.rlike(r"^/[a-z]{2}/?$"), "category").when(path.rlike(r"[.,&%]"), "skip")
    regex = F.when(path.rlike(r"/\d+$"), F.concat(F.regexp_extract(path, r"^(/[a-z]{2})?", 1), F.lit(r"/[0-9]+$"))).when(path.rlike(r"^/[a-z]{2}/?$"), F.lit("^/[a-z]{2}/?$")).otherwise(F.regexp_extract(path, r"([.,&%].*)$", 1))
    every = page.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("event_id"))
    rows = page.select("host", kind.alias("kind"), regex.alias("regex")).filter("kind IS NOT NULL").groupBy("host", "kind", "regex").agg(F.count(F.lit(1)).alias("c")).join(every, "host")
    place = F.row_number().over(Window.partitionBy("host").orderBy("kind", "regex")).cast("int")  # the patterns of one site
    patterns = rows.select("host", "kind", "regex", F.round(F.lit(0.5) + F.col("c") / F.col("n") / 2, 6).alias("confidence"), place.alias("position"))
    at = g.table("events").select("event_id", "ts")
    overall = rows.groupBy("host").agg((F.sum("c") / F.max("n")).alias("overall"))
    sites = every.join(at, "event_id").join(overall, "host", "left").select("host", F.coalesce("overall", F.lit(0.0)).alias("overall"), F.col("ts").alias("created_at"))
    last = g.table("events").agg(F.max("ts")).first()[0]
    return sites, patterns, F.lit(last)


_LEARNED = r"""pg AS (SELECT page_id, host, path, CASE WHEN regexp_matches(path, '/\d+$') THEN 'product' WHEN regexp_matches(path, '^/[a-z]{2}/?$') THEN 'category' WHEN regexp_matches(path, '[.,&%]') THEN 'skip' END AS kind,
   CASE WHEN regexp_matches(path, '/\d+$') THEN regexp_extract(path, '^(/[a-z]{2})?', 1) || '/[0-9]+$' WHEN regexp_matches(path, '^/[a-z]{2}/?$') THEN '^/[a-z]{2}/?$' ELSE regexp_extract(path, '([.,&%].*)$', 1) END AS regex FROM page),
 ho AS (SELECT host, count(*) AS n, max(page_id) AS event_id FROM pg GROUP BY host),
 pt AS (SELECT host, kind, regex, round(0.5::DOUBLE + c / n::DOUBLE / 2, 6) AS confidence, row_number() OVER (PARTITION BY host ORDER BY kind, regex) AS position FROM (SELECT host, kind, regex, count(*) AS c FROM pg WHERE kind IS NOT NULL GROUP BY ALL) JOIN ho USING (host)),
 st AS (SELECT ho.host, coalesce((SELECT count(*) FROM pg WHERE pg.host = ho.host AND kind IS NOT NULL) / n::DOUBLE, 0) AS overall, ts AS created_at FROM ho JOIN events USING (event_id)),
 gt AS (SELECT st.host, overall >= 0.6 AND coalesce((SELECT max(confidence) FROM pt WHERE pt.host = st.host AND kind = 'product'), -1) >= 0.7 AS valid, date_sub('second', created_at, (SELECT max(ts) FROM events)) / 3600.0 > HOURS AS expired,
   (SELECT arg_min(regex, (-confidence, position)) FROM pt WHERE pt.host = st.host AND kind = 'product') AS best_product, (SELECT arg_min(regex, (-confidence, position)) FROM pt WHERE pt.host = st.host AND kind = 'category') AS best_category FROM st)"""
_HITS = """hits AS (SELECT u.host, u.path, kind, regex, confidence, position, CASE kind WHEN 'skip' THEN 0 WHEN 'product' THEN 1 ELSE 2 END AS k FROM (SELECT DISTINCT host, path FROM page) u JOIN pt ON pt.host = u.host AND regexp_matches(u.path, pt.regex, 'i')),
 cl AS (SELECT u.host, u.path, coalesce(kind, 'other') AS kind, regex, confidence FROM (SELECT DISTINCT host, path FROM page) u LEFT JOIN (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY k, confidence DESC, position) = 1) h ON h.host = u.host AND h.path = u.path)"""
#: Hours that an analysis of these queries lasts: events reach over a month.
_MONTH = 24 * 29


@query("site_gates", f", {_LEARNED.replace('HOURS', str(_MONTH))} SELECT * FROM gt")
def query_gates(g: Graph) -> DataFrame:
    """Which analyses of sites may be used, and their best patterns."""
    sites, patterns, now = learned(g)
    return site_gates(sites, patterns, now, _MONTH)


@query("site_classes", f", {_LEARNED.replace('HOURS', str(_MONTH))}, {_HITS} SELECT host, path, kind, regex, confidence FROM cl")
def site_classes(g: Graph) -> DataFrame:
    """The class of each address by the patterns of its site."""
    return classified(g.page(), learned(g)[1])


@query("site_discovery", f""", {_LEARNED.replace('HOURS', '24')}, {_HITS}, un AS (SELECT host, count(DISTINCT path) AS urls FROM page GROUP BY host),
 pl AS (SELECT un.host, urls, CASE WHEN valid AND NOT expired THEN 'cached' WHEN NOT expired THEN 'low_confidence' WHEN urls < 5 THEN 'crawl' ELSE 'analyse' END AS plan FROM un LEFT JOIN gt USING (host)),
 ct AS (SELECT host, count(*) FILTER (kind = 'product') AS products, count(*) FILTER (kind = 'category') AS categories FROM cl GROUP BY host)
 SELECT host, plan, urls, CASE WHEN plan = 'cached' THEN products ELSE 0 END AS products, CASE WHEN plan = 'cached' THEN categories ELSE 0 END AS categories,
   CASE WHEN plan <> 'cached' THEN 0 WHEN products > 0 THEN least(products, 100) ELSE categories END AS taken FROM pl JOIN ct USING (host)""")
def site_discovery(g: Graph) -> DataFrame:
    """What a discovery does with each site, and how many of its addresses it takes."""
    sites, patterns, now = learned(g)
    return discovery(g.page(), sites, patterns, now)
