"""Aggregations, ranks, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import missing, present
from cairn.registry import query
from cairn.sources.views import Graph


def first_by(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key, the first in the order; ranks above 1 are cut before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


@query("agg_enrichment_stats", """SELECT count(*) AS total, count(*) FILTER (weight_grams IS NOT NULL) AS with_weight, count(*) FILTER (price_usd IS NOT NULL) AS with_price,
  round_even(count(*) FILTER (weight_grams IS NOT NULL) * 100.0::DOUBLE / count(*), 1) AS weight_percent, count(*) - count(*) FILTER (weight_grams IS NOT NULL AND price_usd IS NOT NULL) AS remaining FROM item""")
def enrichment_stats(g: Graph) -> DataFrame:
    """Presence counts and half-even percentages; no rows give no percentage."""
    w, p = F.col("weight_grams").isNotNull(), F.col("price_usd").isNotNull()
    n = F.count(F.lit(1))
    return g.item().agg(
        n.alias("total"), F.count_if(w).alias("with_weight"), F.count_if(p).alias("with_price"),
        F.bround(F.try_divide(F.count_if(w) * F.lit(100.0), n), 1).alias("weight_percent"), (n - F.count_if(w & p)).alias("remaining"),
    )


@query("agg_health_score", """SELECT (count(*) FILTER (brand IS NOT NULL AND brand <> '') * 100.0::DOUBLE / count(*) + count(*) FILTER (weight_grams IS NOT NULL) * 100.0::DOUBLE / count(*)) / 2 AS score FROM item""")
def health_score(g: Graph) -> DataFrame:
    share = lambda c: F.try_divide(F.count_if(c) * F.lit(100.0), F.count(F.lit(1)))
    return g.item().agg(((share(present("brand")) + share(F.col("weight_grams").isNotNull())) / 2).alias("score"))


@query("agg_commonest_casing", """SELECT k, max(struct_pack(n := n, s := spelt)).s AS spelling FROM (SELECT lower(s) AS k, s AS spelt, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 3 = 0 THEN upper(status) ELSE status END AS s FROM work_event) GROUP BY 1, 2) GROUP BY k""")
def commonest_casing(g: Graph) -> DataFrame:
    """The most frequent spelling of each case-folded value; of ties the last in code-point order."""
    s = F.when(F.col("event_id") % 3 == 0, F.upper("status")).otherwise(F.col("status"))
    n = g.work_event().select(s.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.lower("s").alias("k")).agg(F.max_by("s", F.struct("n", "s")).alias("spelling"))


@query("agg_brand_counts", "SELECT brand, count(*) AS n FROM item WHERE brand IS NOT NULL GROUP BY brand")
def brand_counts(g: Graph) -> DataFrame:
    return g.item().filter("brand IS NOT NULL").groupBy("brand").agg(F.count(F.lit(1)).alias("n"))


@query("agg_source_contributions", """SELECT field_name, source_url, count(*) AS n, max(confidence) AS best FROM field_source GROUP BY 1, 2""")
def source_contributions(g: Graph) -> DataFrame:
    return g.field_source().groupBy("field_name", "source_url").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))


@query("agg_logbook_sets", """SELECT status, bucket, count(*) AS n FROM (SELECT status, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS bucket FROM work_event)
  GROUP BY GROUPING SETS ((status), (bucket), ())""")
def logbook_sets(g: Graph) -> DataFrame:
    """Counters by several dimensions in one pass."""
    rows = g.work_event().select("status", F.when(F.col("value") > 10, "high").otherwise("low").alias("bucket"))
    return rows.groupingSets([[F.col("status")], [F.col("bucket")], []], F.col("status"), F.col("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_rates", """SELECT entity, count(*) AS n, coalesce(count(*) FILTER (status = 'purchase') * 1.0::DOUBLE / nullif(count(*) FILTER (status = 'click'), 0), 0) AS rate FROM work_event GROUP BY entity""")
def rates(g: Graph) -> DataFrame:
    hit = lambda s: F.count_if(F.col("status") == s)
    rate = F.coalesce(F.try_divide(hit("purchase") * F.lit(1.0), hit("click")), F.lit(0.0))
    return g.work_event().groupBy("entity").agg(F.count(F.lit(1)).alias("n"), rate.alias("rate"))


@query("agg_usage_cost", """SELECT CAST(sum(credits) AS BIGINT) AS credits, round(sum(credits) * 0.005::DOUBLE, 6) AS cost, round_even(count(*) FILTER (self) * 100.0::DOUBLE / count(*), 1) AS self_percent FROM (
  SELECT CAST(CASE WHEN status = 'view' THEN 1 WHEN status = 'click' THEN 5 ELSE 0 END AS BIGINT) AS credits, status = 'error' AS self FROM work_event)""")
def usage_cost(g: Graph) -> DataFrame:
    credits = F.when(F.col("status") == "view", 1).when(F.col("status") == "click", 5).otherwise(0).cast("long")
    rows = g.work_event().select(credits.alias("credits"), (F.col("status") == "error").alias("self"))
    return rows.agg(
        F.sum("credits").alias("credits"), F.round(F.sum("credits") * F.lit(0.005), 6).alias("cost"),
        F.bround(F.try_divide(F.count_if("self") * F.lit(100.0), F.count(F.lit(1))), 1).alias("self_percent"),
    )


@query("agg_votes", """SELECT entity, max(struct_pack(m := is_maker, n := n, s := status)).s AS winner FROM (
  SELECT entity, status, count(*) AS n, bool_or(status = 'purchase') AS is_maker FROM work_event GROUP BY 1, 2) GROUP BY entity""")
def votes(g: Graph) -> DataFrame:
    """A vote by value: marked values first, then the count."""
    n = g.work_event().groupBy("entity", "status").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("status") == "purchase").alias("m"))
    return n.groupBy("entity").agg(F.max_by("status", F.struct("m", "n", "status")).alias("winner"))


@query("agg_archive_totals", """SELECT CAST(sum(items_found) AS BIGINT) AS items, count(*) AS sources FROM (SELECT items_found FROM source ORDER BY processed_at DESC NULLS FIRST, url LIMIT 100)""")
def archive_totals(g: Graph) -> DataFrame:
    """Totals over the newest 100 sources: the limit is the archive's page."""
    newest = g.source().orderBy(F.col("processed_at").desc_nulls_first(), "url").limit(100)
    return newest.agg(F.sum(F.coalesce("items_found", F.lit(0))).alias("items"), F.count(F.lit(1)).alias("sources"))


@query("agg_value_stats", "SELECT status, avg(value) AS mean, min(value) AS lo, max(value) AS hi, count(*) AS n FROM work_event GROUP BY status")
def value_stats(g: Graph) -> DataFrame:
    return g.work_event().groupBy("status").agg(F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("agg_status_pivot", """SELECT entity, count(*) FILTER (status = 'view') AS "view", count(*) FILTER (status = 'click') AS click, count(*) FILTER (status = 'purchase') AS purchase FROM work_event GROUP BY entity""")
def status_pivot(g: Graph) -> DataFrame:
    out = g.work_event().groupBy("entity").pivot("status", ["view", "click", "purchase"]).count()
    return out.select("entity", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("view", "click", "purchase")])


@query("win_first_wins", """SELECT name, brand, node_id FROM (SELECT name, brand, node_id, row_number() OVER (PARTITION BY name, brand ORDER BY stream, node_id) AS r FROM (
  SELECT *, 1 AS stream FROM item WHERE brand IS NOT NULL UNION ALL SELECT *, 2 FROM item WHERE contains(name, 'ring'))) WHERE r = 1""")
def first_wins(g: Graph) -> DataFrame:
    """Ordered candidate streams: the first stream that yields a (name, brand) keeps it."""
    rows = g.item().select("name", "brand", "node_id")
    streams = rows.filter("brand IS NOT NULL").withColumn("stream", F.lit(1)).unionByName(rows.filter(F.contains("name", F.lit("ring"))).withColumn("stream", F.lit(2)))
    return first_by(streams, ["name", "brand"], ["stream", "node_id"]).select("name", "brand", "node_id")


@query("win_canonical_pick", """SELECT name, node_id, score FROM (SELECT name, node_id, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, node_id) AS r FROM (
  SELECT name, node_id, CASE WHEN brand IS NOT NULL AND brand <> '' THEN 2 ELSE 0 END + CASE WHEN weight_grams IS NOT NULL AND weight_grams <> 0 THEN 1 ELSE 0 END
  + CASE WHEN price_usd IS NOT NULL AND price_usd <> 0 THEN 1 ELSE 0 END + CASE WHEN category IS NOT NULL AND category <> '' THEN 1 ELSE 0 END AS score FROM item)) WHERE r = 1""")
def canonical_pick(g: Graph) -> DataFrame:
    """The most complete item of each name; of ties the first scanned."""
    one = lambda c, w: F.when(c, w).otherwise(0)
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    score = one(present("brand"), 2) + one(filled("weight_grams"), 1) + one(filled("price_usd"), 1) + one(present("category"), 1)
    return first_by(g.item().select("name", "node_id", score.alias("score")), ["name"], [F.desc("score"), "node_id"]).select("name", "node_id", "score")


@query("win_best_by_confidence", """SELECT item_id, field_name, source_url, confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id, field_name ORDER BY confidence DESC, seq, line) AS r FROM field_source) WHERE r = 1""")
def best_by_confidence(g: Graph) -> DataFrame:
    """Best source of each field; a later one wins only if it is strictly better."""
    best = first_by(g.field_source(), ["item_id", "field_name"], [F.desc("confidence"), "seq", "line"])
    return best.select("item_id", "field_name", "source_url", "confidence")


@query("win_per_depth_sample", """SELECT depth, url FROM (SELECT depth, url, row_number() OVER (PARTITION BY depth ORDER BY md5(url), url) AS r FROM (
  SELECT DISTINCT url, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM page)) WHERE r <= 5""")
def per_depth_sample(g: Graph) -> DataFrame:
    """Five addresses of each depth, picked by a hash: the sample is the operator."""
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("long")
    rows = g.page().select("url", depth.alias("depth")).distinct()
    r = F.row_number().over(Window.partitionBy("depth").orderBy(F.md5("url"), "url"))
    return rows.withColumn("r", r).filter("r <= 5").select("depth", "url")


@query("win_ordered_distinct", "SELECT DISTINCT entity, status, min(event_id) OVER (PARTITION BY entity, status) AS first_id FROM work_event")
def ordered_distinct(g: Graph) -> DataFrame:
    return g.work_event().groupBy("entity", "status").agg(F.min("event_id").alias("first_id"))


@query("win_lag_sessions", """SELECT entity, event_id, CAST(coalesce(epoch(date_trunc('second', ts))
  - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY entity ORDER BY ts, event_id))), 0) AS BIGINT) AS gap FROM work_event""")
def lag_sessions(g: Graph) -> DataFrame:
    """Seconds since the entity's last event."""
    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    second = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    gap = second(F.col("ts")) - second(F.lag("ts").over(w))
    return g.work_event().select("entity", "event_id", F.coalesce(gap, F.lit(0)).alias("gap"))


@query("top_enrichment_queue", """SELECT node_id, category, score FROM (SELECT * FROM (SELECT node_id, category,
  (CASE WHEN weight_grams IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN description IS NOT NULL AND description <> '' THEN 2 ELSE 0 END
   + CASE WHEN price_usd IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN product_url IS NOT NULL AND product_url <> '' THEN 1 ELSE 0 END) / 8.0::DOUBLE AS score
  FROM item WHERE brand IS NOT NULL ORDER BY node_id DESC LIMIT 150) WHERE score BETWEEN 0 AND 0.5)
  ORDER BY CASE category WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 100 END, score, node_id LIMIT 50""")
def enrichment_queue(g: Graph) -> DataFrame:
    """The newest 3 x 50 items, those of low completeness among them by category priority, then score."""
    one = lambda c, w: F.when(c, w).otherwise(0)
    score = one(F.col("weight_grams").isNotNull(), 2) + one(present("description"), 2) + one(F.col("price_usd").isNotNull(), 1) + one(present("product_url"), 1)
    newest = g.item().filter("brand IS NOT NULL").select("node_id", "category", (score / F.lit(8.0)).alias("score")).orderBy(F.desc("node_id")).limit(150)
    rank = F.when(F.col("category") == "ECONOMY", 0).when(F.col("category") == "SMALL", 1).otherwise(100)
    return newest.filter("score BETWEEN 0 AND 0.5").orderBy(rank, "score", "node_id").limit(50)


@query("top_recent_tasks", "SELECT event_id, entity, ts FROM work_event WHERE status IN ('purchase', 'error') ORDER BY ts DESC, event_id LIMIT 5")
def recent_tasks(g: Graph) -> DataFrame:
    return g.work_event().filter(F.col("status").isin("purchase", "error")).select("event_id", "entity", "ts").orderBy(F.desc("ts"), "event_id").limit(5)


@query("set_missing_fields", """SELECT node_id, array_to_string(list_filter([CASE WHEN weight_grams IS NULL THEN 'weight_grams' END, CASE WHEN price_usd IS NULL THEN 'price_usd' END,
  CASE WHEN category IS NULL OR category = '' THEN 'category' END], lambda x: x IS NOT NULL), ',') AS missing FROM item""")
def missing_fields(g: Graph) -> DataFrame:
    gone = F.array_compact(F.array(
        F.when(F.col("weight_grams").isNull(), F.lit("weight_grams")), F.when(F.col("price_usd").isNull(), F.lit("price_usd")), F.when(missing("category"), F.lit("category"))
    ))
    return g.item().select("node_id", F.array_join(gone, ",").alias("missing"))


@query("set_union_distinct", "SELECT name AS n FROM item UNION SELECT name FROM brand UNION SELECT name FROM family")
def union_distinct(g: Graph) -> DataFrame:
    return g.item().select(F.col("name").alias("n")).union(g.brand().select("name")).union(g.family().select("name")).distinct()


@query("set_except_intersect", "(SELECT src_id AS id FROM e_variant_of INTERSECT SELECT src_id FROM e_has_tip) EXCEPT SELECT dst_id FROM e_manufactures_item")
def except_intersect(g: Graph) -> DataFrame:
    one = g.edge("VARIANT_OF").select(F.col("src_id").alias("id")).intersect(g.edge("HAS_TIP").select("src_id"))
    return one.subtract(g.edge("MANUFACTURES_ITEM").select("dst_id"))
