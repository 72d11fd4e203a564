"""The work queue of data quality: states from events, checks of items, decisions, applied fixes and the log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.products import checklist
from cairn.operators import rules
from cairn.operators.aggregates import first_by
from cairn.operators.graph import present
from cairn.operators.quality import _FORMS, _HOLDS, _MESSY, _in, invalid_brand_confidence, lookup, messy_brands, scan_redundant_brands
from cairn.operators.research import _RESULTS, search_results
from cairn.registry import query
from cairn.sources.views import Graph

#: The level that an entry is added with, and entries that one batch takes.
ADDED_AT, BATCH = 3, 10
#: What an entry is after its last event; after any other event it is pending.
STATUS = {"take": "in_progress", "complete": "completed", "fail": "failed"}
#: What to do about the rows of a preset.
FIXABLE = {
    "no_brand": "assign_brand", "no_images": "add_image", "orphan_families": "link_to_gear", "orphan_insights": "link_to_gear", "orphan_glossary": "delete_orphan",
    "no_category": "set_category", "no_weight": "set_weight", "no_price": "set_price", "duplicates": "merge_duplicates", "brands_no_products": "delete_orphan",
    "family_candidates": "organize_families",
}


def queue_states(events: DataFrame) -> DataFrame:
    """entity, status, level, sort_key, checks, added: the state of each entry after its events.

    events: entity, seq, kind (add, take, defer, escalate, complete, fail), level, score. An entry
    is there from its first add on; what comes before is ignored, and so is an add of what is
    there. A deferred or escalated entry is pending again. An entry runs the checks up to the
    level it was added with and those of the levels it was escalated to.
    """
    first = events.filter("kind = 'add'").groupBy("entity").agg(F.min("seq").alias("added"))
    seen = events.join(first, "entity").filter("seq = added OR (seq > added AND kind <> 'add')")
    status = reduce(lambda a, k: a.when(F.col("kind") == k, STATUS[k]), STATUS, F).otherwise("pending")
    escalated = F.collect_set(F.when(F.col("kind") == "escalate", F.col("level")))
    states = seen.groupBy("entity", "added").agg(
        F.max_by(status, "seq").alias("status"), F.max_by("level", F.when(F.col("level").isNotNull(), F.col("seq"))).alias("level"),
        F.min_by("score", "seq").alias("score"), F.min_by("level", "seq").alias("first"), escalated.alias("up"),
    )
    n = reduce(lambda a, b: a + b, [F.when((F.lit(c[2]) <= F.col("first")) | F.array_contains("up", c[2]), 1).otherwise(0) for c in rules.CHECKS])
    key = F.col("level") * 1000 + F.floor(F.col("score") * 100).cast("int")
    return states.select("entity", "status", "level", key.cast("int").alias("sort_key"), n.alias("checks"), "added")


def queue_events(work: DataFrame) -> DataFrame:
    """Queue events made of work events; three in a hundred entities of them share one entry a day."""
    s, e = F.col("status"), F.col("event_id")
    kind = F.when(s == "signup", "add").when(s == "view", "defer").when(s == "click", "escalate").when(s == "purchase", "complete").otherwise("fail")
    level = F.when(s == "signup", ADDED_AT).when(s == "view", F.lit(4) + (e % 2)).when(s == "click", F.lit(1) + (e % 2)).cast("int")
    entity = F.concat_ws("-", F.col("entity").cast("string"), (e % 40).cast("string"))
    return work.select(entity.alias("entity"), e.alias("seq"), kind.alias("kind"), level.alias("level"), (F.pmod(e * 7, F.lit(100)) / 100).alias("score"), "ts")


def _events(g: Graph) -> DataFrame:
    return queue_events(g.work_event()).drop("ts")


_COUNT = " + ".join(f"CASE WHEN {c[2]} <= {ADDED_AT} OR list_contains(up, {c[2]}) THEN 1 ELSE 0 END" for c in rules.CHECKS)
_STATES = f"""ev AS (SELECT entity || '-' || (event_id % 40) AS entity, event_id AS seq, CASE status WHEN 'signup' THEN 'add' WHEN 'view' THEN 'defer' WHEN 'click' THEN 'escalate' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind,
  CASE status WHEN 'signup' THEN {ADDED_AT} WHEN 'view' THEN 4 + event_id % 2 WHEN 'click' THEN 1 + event_id % 2 END AS level, (event_id * 7 % 100) / 100.0::DOUBLE AS score FROM work_event),
st AS (SELECT entity, added, CASE arg_max(kind, seq) WHEN 'complete' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'pending' END AS status, arg_max(level, seq) FILTER (level IS NOT NULL) AS level, arg_min(score, seq) AS score,
  list(level) FILTER (kind = 'escalate') AS up FROM ev JOIN (SELECT entity, min(seq) AS added FROM ev WHERE kind = 'add' GROUP BY 1) USING (entity) WHERE seq = added OR (seq > added AND kind <> 'add') GROUP BY 1, 2),
states AS (SELECT entity, status, level, CAST(level * 1000 + floor(score * 100) AS INTEGER) AS sort_key, {_COUNT.replace("list_contains(up", "list_contains(coalesce(up, [])")} AS checks, added FROM st)"""


@query("queue_entries", f", {_STATES} SELECT * FROM states")
def queue_entries(g: Graph) -> DataFrame:
    return queue_states(_events(g))


@query("queue_statistics", f", {_STATES} SELECT status, level, count(*) AS n, CAST(sum(checks) AS BIGINT) AS checks FROM states GROUP BY 1, 2")
def queue_statistics(g: Graph) -> DataFrame:
    return queue_states(_events(g)).groupBy("status", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("checks").alias("checks"))


@query("queue_next_batch", f", {_STATES} SELECT entity, sort_key, added FROM states WHERE status = 'pending' ORDER BY sort_key, added, entity LIMIT {BATCH}")
def queue_next_batch(g: Graph) -> DataFrame:
    """The entries that are taken next: the least key first, of equal keys what was added first."""
    return queue_states(_events(g)).filter("status = 'pending'").orderBy("sort_key", "added", "entity").limit(BATCH).select("entity", "sort_key", "added")


def item_checks(g: Graph) -> DataFrame:
    """node_id, check_id, priority, issue: every check of every item but those on heard names.

    Checks are columns of one row an item; counts and edges that they need are joined once.
    """
    names = g.item().groupBy("name").agg(F.count(F.lit(1)).alias("same_name"))
    brands = g.item().groupBy("brand").agg(F.count(F.lit(1)).alias("of_brand"))
    found = g.edge("EXTRACTED_FROM").select(F.col("src_id").alias("node_id")).distinct().withColumn("found", F.lit(True))
    tips = g.edge("HAS_TIP").select(F.col("src_id").alias("node_id")).distinct().withColumn("tips", F.lit(True))
    items = messy_brands(g).join(names, "name", "left").join(brands, "brand", "left").join(found, "node_id", "left").join(tips, "node_id", "left")
    n, b = F.col("name"), F.col("brand")
    tests = {
        "whitespace_check": (n != F.trim(n)) | F.contains(n, F.lit("  ")),
        "case_check": (F.length(n) > 3) & (n == F.upper(n)) & n.rlike("[A-Z]"),
        "brand_in_name": present("brand") & F.contains(F.lower(n), F.lower(b)),
        "invalid_brand": invalid_brand_confidence(b).isNotNull(),
        "brand_exists": F.coalesce("of_brand", F.lit(0)) == 0,
        "potential_duplicate": F.coalesce("same_name", F.lit(0)) > 1,
        "verify_brand": present("brand") & (F.coalesce("of_brand", F.lit(0)) < 3),
        "missing_weight": F.col("weight_grams").isNull(),
        "missing_price": F.col("price_usd").isNull(),
        "orphaned_node": F.col("found").isNull() & F.col("tips").isNull(),
        "missing_provenance": F.col("found").isNull(),
        "data_completeness": checklist(g.item())["issue"],
        "copyright_concern": F.length(F.coalesce("description", F.lit(""))) > 500,
    }
    level = {c[0]: c[2] for c in rules.CHECKS}
    each = [F.struct(F.lit(k).alias("check_id"), F.lit(level[k]).alias("priority"), F.coalesce(t, F.lit(False)).alias("issue")) for k, t in tests.items()]
    return items.select("node_id", "brand", F.explode(F.array(*each)).alias("c")).select("node_id", "brand", "c.check_id", "c.priority", "c.issue")


_SQL_TESTS = {
    "whitespace_check": "name <> trim(name) OR contains(name, '  ')", "case_check": "length(name) > 3 AND name = upper(name) AND regexp_matches(name, '[A-Z]')",
    "brand_in_name": "brand <> '' AND contains(lower(name), lower(brand))", "invalid_brand": f"low IN {_in(rules.INVALID_BRANDS)} OR {_HOLDS} OR regexp_matches(low, '{rules.BRAND_SIZES}')",
    "brand_exists": "coalesce(of_brand, 0) = 0", "potential_duplicate": "coalesce(same_name, 0) > 1", "verify_brand": "brand <> '' AND coalesce(of_brand, 0) < 3",
    "missing_weight": "weight_grams IS NULL", "missing_price": "price_usd IS NULL", "orphaned_node": "NOT found AND NOT tips", "missing_provenance": "NOT found",
    "data_completeness": "(brand IS NULL OR brand = '' OR name IS NULL OR name = '') OR (weight_grams IS NULL OR weight_grams = 0)::INT + (description IS NULL OR description = '')::INT + (category IS NULL OR category = '')::INT > 1",
    "copyright_concern": "length(coalesce(description, '')) > 500",
}
_LEVEL = {c[0]: c[2] for c in rules.CHECKS}
_CHECKED = f"""checked AS (SELECT node_id, brand, c.check_id AS check_id, c.priority AS priority, c.issue AS issue FROM (SELECT node_id, brand, unnest([{", ".join(f"{{'check_id': '{k}', 'priority': {_LEVEL[k]}, 'issue': coalesce({t}, false)}}" for k, t in _SQL_TESTS.items())}]) AS c FROM (
  SELECT m.node_id, m.name, m.brand, lower(trim(m.brand)) AS low, i.weight_grams, i.price_usd, i.description, i.category, n.c AS same_name, b.c AS of_brand,
    m.node_id IN (SELECT src_id FROM e_extracted_from) AS found, m.node_id IN (SELECT src_id FROM e_has_tip) AS tips
  FROM ({_MESSY}) m JOIN item i USING (node_id) LEFT JOIN (SELECT name, count(*) AS c FROM item GROUP BY name) n ON n.name = m.name LEFT JOIN (SELECT brand, count(*) AS c FROM item GROUP BY brand) b ON b.brand = m.brand)))"""


@query("queue_item_checks", f", {_CHECKED} SELECT node_id, check_id, priority, issue FROM checked")
def queue_item_checks(g: Graph) -> DataFrame:
    return item_checks(g).select("node_id", "check_id", "priority", "issue")


@query("queue_check_load", f""", {_CHECKED} SELECT priority, count(DISTINCT check_id) AS checks, count(*) AS runs, count(*) FILTER (issue) AS issues, count(*) FILTER (issue AND check_id IN {_in([c[0] for c in rules.CHECKS if c[3]])}) AS fixable FROM checked GROUP BY priority""")
def queue_check_load(g: Graph) -> DataFrame:
    """What the checks of each level find, and how much of it can be fixed without asking."""
    fixable = F.col("check_id").isin(*[c[0] for c in rules.CHECKS if c[3]])
    return item_checks(g).groupBy("priority").agg(
        F.countDistinct("check_id").alias("checks"), F.count(F.lit(1)).alias("runs"), F.count_if("issue").alias("issues"), F.count_if(F.col("issue") & fixable).alias("fixable")
    )


def decided(checks: DataFrame) -> DataFrame:
    """decision and action of each check's result: what the first level can fix is fixed, a brand that
    is surely none is cleared, other issues wait for a review, or for research where data are missing."""
    fixable = F.col("check_id").isin(*[c[0] for c in rules.CHECKS if c[2] == 1 and c[3]])
    cleared = (F.col("check_id") == "invalid_brand") & F.lower(F.trim("brand")).isin(*rules.INVALID_BRANDS)
    research = F.col("check_id").isin("missing_weight", "missing_price")
    issue = F.col("issue")
    decision = F.when(~issue, "no_issue").when(fixable | cleared, "auto_fixed").when(research, "deferred").otherwise("flagged_for_review")
    action = F.when(~issue, "none").when(fixable, "update_field").when(cleared, "clear_brand").when(research, "research").otherwise("review")
    return checks.withColumn("decision", decision).withColumn("action", action)


_FIXES_FIRST = _in([c[0] for c in rules.CHECKS if c[2] == 1 and c[3]])
_DECIDED = f"""decided AS (SELECT *, CASE WHEN NOT issue THEN 'no_issue' WHEN first OR cleared THEN 'auto_fixed' WHEN res THEN 'deferred' ELSE 'flagged_for_review' END AS decision,
  CASE WHEN NOT issue THEN 'none' WHEN first THEN 'update_field' WHEN cleared THEN 'clear_brand' WHEN res THEN 'research' ELSE 'review' END AS action FROM (
  SELECT *, check_id IN {_FIXES_FIRST} AS first, check_id = 'invalid_brand' AND coalesce(lower(trim(brand)) IN {_in(rules.INVALID_BRANDS)}, false) AS cleared, check_id IN ('missing_weight', 'missing_price') AS res FROM checked))"""


@query("queue_decisions", f", {_CHECKED}, {_DECIDED} SELECT check_id, decision, action, count(*) AS n FROM decided GROUP BY ALL")
def queue_decisions(g: Graph) -> DataFrame:
    return decided(item_checks(g)).groupBy("check_id", "decision", "action").agg(F.count(F.lit(1)).alias("n"))


def log_entries(g: Graph) -> DataFrame:
    """The log of all decisions but clean ones; every fourth flagged entry was reviewed later."""
    rows = decided(item_checks(g)).filter("issue").select("node_id", "check_id", "decision", F.lit(1).alias("seq"))
    reviewed = rows.filter("decision = 'flagged_for_review' AND node_id % 4 = 0").withColumn("decision", F.lit("approved")).withColumn("seq", F.lit(2))
    return rows.unionByName(reviewed)


@query("log_pending_reviews", f", {_CHECKED}, {_DECIDED} SELECT node_id, count(*) AS pending FROM decided WHERE decision = 'flagged_for_review' AND node_id % 4 <> 0 GROUP BY node_id")
def log_pending_reviews(g: Graph) -> DataFrame:
    """Entries that still wait: of each item and check the latest decision counts."""
    last = first_by(log_entries(g), ["node_id", "check_id"], [F.desc("seq")])
    return last.filter("decision = 'flagged_for_review'").groupBy("node_id").agg(F.count(F.lit(1)).alias("pending"))


@query("log_by_check", f", {_CHECKED}, {_DECIDED} SELECT check_id, count(*) AS entries, count(*) FILTER (decision = 'auto_fixed') AS fixed FROM decided WHERE issue GROUP BY check_id")
def log_by_check(g: Graph) -> DataFrame:
    last = first_by(log_entries(g), ["node_id", "check_id"], [F.desc("seq")])
    return last.groupBy("check_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("decision") == "auto_fixed").alias("fixed"))


def apply_issues(items: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items after the fixes of their issues (entity_id, new_value, confidence: a new name), and the
    corrections as records (node_id, field, old, new). Of several fixes of an item the surest counts."""
    best = first_by(issues.filter("new_value IS NOT NULL"), ["entity_id"], [F.desc("confidence"), "new_value"])
    best = best.select(F.col("entity_id").try_cast("long").alias("node_id"), "new_value")
    both = items.join(best, "node_id", "left")
    changed = both.filter(F.col("new_value").isNotNull() & (F.col("new_value") != F.col("name")))
    records = changed.select("node_id", F.lit("name").alias("field"), F.col("name").alias("old"), F.col("new_value").alias("new"))
    return both.withColumn("name", F.coalesce("new_value", "name")).select(*items.columns), records


@query("fix_applied_items", "SELECT node_id, CASE WHEN brand IS NOT NULL AND starts_with(lower(name), lower(brand) || ' ') THEN trim(substr(name, length(brand) + 2)) ELSE name END AS name FROM item")
def fix_applied_items(g: Graph) -> DataFrame:
    """Items whose names lost their brand, where that is sure enough to do without asking."""
    return apply_issues(g.item().select("node_id", "name"), scan_redundant_brands(g).filter("confidence >= 0.95"))[0]


@query("fix_corrections", "SELECT node_id, 'name' AS field, name AS old, trim(substr(name, length(brand) + 2)) AS new FROM item WHERE brand IS NOT NULL AND starts_with(lower(name), lower(brand) || ' ')")
def fix_corrections(g: Graph) -> DataFrame:
    """What was corrected, for later rules to learn from."""
    return apply_issues(g.item().select("node_id", "name"), scan_redundant_brands(g).filter("confidence >= 0.95"))[1]


def similar_brands(brands: DataFrame, most: int = 5) -> DataFrame:
    """brand, alike: up to most other brands that share a word and hold it or are held by it."""
    words = brands.select("brand", F.explode(F.array_distinct(F.split(F.lower("brand"), " "))).alias("word"))
    pairs = words.join(words.select("word", F.col("brand").alias("alike")), "word").filter("brand <> alike").select("brand", "alike").distinct()
    a, b = F.lower("brand"), F.lower("alike")
    return first_k(pairs.filter(F.contains(a, b) | F.contains(b, a)), "brand", [F.length("alike"), F.col("alike")], most)


def first_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


@query("quality_similar_brands", f""", m AS ({_MESSY}), b AS (SELECT DISTINCT brand FROM m WHERE brand IS NOT NULL UNION SELECT brand || ' Gear' FROM m WHERE brand IS NOT NULL UNION SELECT name FROM brand), w AS (SELECT brand, unnest(list_distinct(string_split(lower(brand), ' '))) AS word FROM b)
  SELECT brand, alike FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY length(alike), alike) AS r FROM (SELECT DISTINCT x.brand, y.brand AS alike FROM w x JOIN w y ON x.word = y.word
    WHERE x.brand <> y.brand AND (contains(lower(x.brand), lower(y.brand)) OR contains(lower(y.brand), lower(x.brand))))) WHERE r <= 5""")
def quality_similar_brands(g: Graph) -> DataFrame:
    """Brands as items, as people lengthen them, and as nodes have them, with those that share a word and hold one another."""
    said = messy_brands(g).select("brand").filter("brand IS NOT NULL").distinct()
    names = said.union(said.select(F.concat("brand", F.lit(" Gear")))).union(g.brand().select("name")).distinct()
    return similar_brands(names)


_BRANDS_OF = f"m AS ({_MESSY}), n AS (SELECT brand, count(*) AS c FROM m WHERE brand IS NOT NULL GROUP BY brand)"


@query("quality_brand_verdicts", f""", {_BRANDS_OF}, w AS (SELECT brand, least(0.95::DOUBLE, sum(CASE WHEN contains(lower(title || ' ' || snippet), lower(brand)) THEN 15 ELSE 0 END + CASE WHEN contains(lower(snippet), 'outdoor') THEN 10 ELSE 0 END) / 100.0::DOUBLE) AS p
  FROM ({_RESULTS}) WHERE brand IS NOT NULL GROUP BY brand)
  SELECT n.brand, CASE WHEN {_FORMS}[lower(n.brand)] <> n.brand THEN 'corrected' WHEN n.c >= 3 THEN 'valid' WHEN p >= 0.7 THEN 'valid' WHEN p >= 0.4 THEN 'uncertain' WHEN p IS NOT NULL THEN 'invalid' ELSE 'uncertain' END AS verdict,
  CASE WHEN {_FORMS}[lower(n.brand)] <> n.brand THEN 'form' WHEN n.c >= 3 THEN 'graph' WHEN p IS NOT NULL THEN 'web' ELSE 'none' END AS tier FROM n LEFT JOIN w ON w.brand = n.brand""")
def quality_brand_verdicts(g: Graph) -> DataFrame:
    """Each brand by the first tier that knows it: its canonical form, the graph, what a search says of it."""
    n = messy_brands(g).filter("brand IS NOT NULL").groupBy("brand").agg(F.count(F.lit(1)).alias("c"))
    named = F.coalesce(F.contains(F.lower(F.concat_ws(" ", "title", "snippet")), F.lower("brand")), F.lit(False))
    points = F.when(named, 15).otherwise(0) + F.when(F.contains(F.lower("snippet"), F.lit("outdoor")), 10).otherwise(0)
    web = search_results(g).filter("brand IS NOT NULL").groupBy("brand").agg(F.least(F.lit(0.95), F.sum(points) / F.lit(100.0)).alias("p"))
    form = F.try_element_at(lookup(rules.CANONICAL_BRANDS), F.lower("brand"))
    corrected, known, p = F.coalesce(form != F.col("brand"), F.lit(False)), F.col("c") >= 3, F.col("p")
    verdict = F.when(corrected, "corrected").when(known | (p >= 0.7), "valid").when(p >= 0.4, "uncertain").when(p.isNotNull(), "invalid").otherwise("uncertain")
    tier = F.when(corrected, "form").when(known, "graph").when(p.isNotNull(), "web").otherwise("none")
    return n.join(web, "brand", "left").select("brand", verdict.alias("verdict"), tier.alias("tier"))
