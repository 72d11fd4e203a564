"""Heard names against what the graph knows: brands and products by tiers, and brands that look alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.aggregates import first_by
from cairn.operators.fuzzy_join import contained, similar, tidy
from cairn.operators.quality import _MESSY, messy_brands
from cairn.operators.research import search_results
from cairn.registry import query
from cairn.sources.scratch import keeper
from cairn.sources.views import Graph

#: Least scores of a product of the line's brand, and of any product.
OWN, ANY = 85.0, 90.0
#: Least scores of a brand that is taken for the heard one, and of one that may be.
SURE, MAYBE = 90.0, 75.0
#: Words of a search result that speak for a brand of gear.
GEAR_TERMS = ["gear", "equipment", "outdoor", "hiking", "backpacking"]
#: Similar brands and sample items that are listed.
LISTED = 5


def validated_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """line, brand, verdict, source, confidence, suggested: each heard product (line, brand) by the tiers of the graph.

    A product of the heard brand with that name is valid; else the most similar product of the
    brand, at a weighted ratio of OWN or more, corrects it; else the most similar of all products at
    ANY or more. Names are compared in lower case with single spaces; of equal scores the first
    name counts. products (node_id, name, brand): those without a name or brand are unknown. A blank
    line is invalid, a line that nothing matches uncertain.

    A tier sees only what those before it left open: no other name is as similar as the name itself, so
    lines that are a product's name meet none, and lines of a known brand meet that brand's names alone first.
    """
    heard = lines.select("line", "brand").distinct().withColumn("t", tidy("line")).withColumn("b", F.lower("brand"))
    named = products.filter("name IS NOT NULL AND brand IS NOT NULL").select(tidy("name").alias("known"), F.lower("brand").alias("b"), "name", "node_id").filter("known <> ''")
    keep = keeper(lines.sparkSession)
    heard, named = keep(heard, "heard"), keep(named.groupBy("known", "b").agg(F.min(F.struct("node_id", "name")).alias("first")), "named")
    own = named.select("known", "b", F.col("first")["name"].alias("suggested"))
    exact = own.select(F.col("known").alias("t"), "b", F.lit(True).alias("exact"))
    asked = keep(heard.filter("t <> ''").select("t", "b").distinct().join(exact, ["t", "b"], "left_anti"), "asked")
    met = similar(asked.filter("b IS NOT NULL").select("b", F.col("t").alias("line")), own.select("b", "known"), OWN, ["b"])
    best_own = first_by(met, ["line", "b"], [F.desc("score"), "known"]).join(own, ["known", "b"])
    best_own = keep(best_own.select(F.col("line").alias("t"), "b", F.col("score").alias("own_score"), F.col("suggested").alias("own_name")), "own")
    left = asked.join(best_own, ["t", "b"], "left_anti").select(F.col("t").alias("line")).distinct()
    known = keep(named.groupBy("known").agg(F.min("first")["name"].alias("suggested")), "known")
    equal = left.join(known.withColumnRenamed("known", "line"), "line").select(F.col("line").alias("t"), F.lit(100.0).alias("any_score"), F.col("suggested").alias("any_name"))
    other = keep(left.join(known.select(F.col("known").alias("line")), "line", "left_anti"), "other")
    near = similar(other, known.select("known"), ANY)
    best_any = first_by(near, ["line"], [F.desc("score"), "known"]).join(known, "known").select(F.col("line").alias("t"), F.col("score").alias("any_score"), F.col("suggested").alias("any_name")).unionByName(equal)
    rows = heard.join(exact, ["t", "b"], "left").join(best_own, ["t", "b"], "left").join(best_any, "t", "left")
    blank, known = F.coalesce(F.col("t"), F.lit("")) == "", F.col("exact").isNotNull()
    fuzzy_own, fuzzy_any = F.col("own_score").isNotNull(), F.col("any_score").isNotNull()
    return rows.select(
        "line", "brand",
        F.when(blank, "invalid").when(known, "valid").when(fuzzy_own | fuzzy_any, "corrected").otherwise("uncertain").alias("verdict"),
        F.when(blank, "none").when(known, "database").when(fuzzy_own | fuzzy_any, "database_fuzzy").otherwise("database").alias("source"),
        F.when(blank, 1.0).when(known, 0.98).when(fuzzy_own, F.col("own_score") / 100).when(fuzzy_any, F.col("any_score") / 100).otherwise(0.3).alias("confidence"),
        F.when(~blank & ~known, F.coalesce("own_name", "any_name")).alias("suggested"),
    )


def web_confidence(results: DataFrame) -> DataFrame:
    """brand, web: how far landed search results (brand, title, snippet, link) speak for a brand, 0.95 at most."""
    low = F.lower("brand")
    has = lambda c, x: F.contains(F.lower(F.coalesce(c, F.lit(""))), x)
    named = has(F.col("title"), low) | has(F.col("snippet"), low)
    address = has(F.col("link"), F.regexp_replace(low, "[^a-z0-9]", ""))
    gear = F.lit(False)
    for term in GEAR_TERMS:
        gear = gear | has(F.col("snippet"), F.lit(term))
    points = F.when(named, 15).otherwise(0) + F.when(address, 20).otherwise(0) + F.when(gear, 10).otherwise(0)
    return results.filter("brand IS NOT NULL").groupBy("brand").agg(F.least(F.sum(points) / 100, F.lit(0.95)).alias("web"))


def validated_brands(brands: DataFrame, known: DataFrame, results: DataFrame) -> DataFrame:
    """brand, verdict, source, confidence, suggested of each heard brand by tiers: the graph, what it is like, the web.

    known (brand): one row an item or brand node; of the forms of a name the most frequent one is
    right, of ties the first. A brand that is like a known one at SURE or more is corrected, at MAYBE or
    more uncertain; beyond that landed search results decide.
    """
    heard = brands.select("brand").distinct().withColumn("t", tidy("brand"))
    forms = known.filter(F.trim("brand") != "").groupBy(tidy("brand").alias("known"), F.trim("brand").alias("form")).agg(F.count(F.lit(1)).alias("n"))
    right = first_by(forms, ["known"], [F.desc("n"), "form"]).select("known", "form")
    near = similar(heard.select(F.col("t").alias("line")).distinct(), right.select("known"), MAYBE)
    best = first_by(near, ["line"], [F.desc("score"), "known"]).join(right.withColumnRenamed("form", "like"), "known").select(F.col("line").alias("t"), "score", "like")
    rows = heard.join(right.withColumnRenamed("known", "t"), "t", "left").join(best, "t", "left").join(web_confidence(results), "brand", "left")
    blank, exact, score, web = F.coalesce("t", F.lit("")) == "", F.col("form").isNotNull(), F.col("score"), F.col("web")
    other = F.col("form") != F.trim("brand")
    fuzzy_hit = score.isNotNull()
    verdict = (
        F.when(blank, "invalid").when(exact & other, "corrected").when(exact, "valid").when(score >= SURE, "corrected").when(fuzzy_hit, "uncertain")
        .when(web >= 0.7, "valid").when(web >= 0.4, "uncertain").when(web.isNotNull(), "invalid").otherwise("uncertain")
    )
    confidence = (
        F.when(blank, 1.0).when(exact, 0.98).when(fuzzy_hit, score / 100).when(web >= 0.4, web).when(web.isNotNull(), 1 - web).otherwise(0.3)
    )
    source = F.when(blank, "none").when(exact, "database").when(fuzzy_hit, "database_fuzzy").when(web.isNotNull(), "web_search").otherwise("none")
    suggested = F.when(blank, None).when(exact & other, F.col("form")).when(~exact & fuzzy_hit, F.col("like"))
    return rows.select("brand", verdict.alias("verdict"), source.alias("source"), F.round(confidence, 6).alias("confidence"), suggested.alias("suggested"))


def brand_presence(brands: DataFrame, items: DataFrame) -> DataFrame:
    """brand, item_count, samples, confidence, alike of each heard brand: its items in either case, and for
    a brand without any the LISTED brands with most items that hold it or are held by it."""
    heard = brands.select("brand").distinct().withColumn("b", F.lower("brand"))
    owned = items.filter("brand IS NOT NULL").select(F.lower("brand").alias("b"), "brand", "name")
    names = owned.filter("name IS NOT NULL").select("b", "name").distinct()
    first = names.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("name"))).filter(F.col("r") <= LISTED)
    samples = first.groupBy("b").agg(F.array_sort(F.collect_list("name")).alias("samples"))
    counts = owned.groupBy("b").agg(F.count(F.lit(1)).alias("item_count"))
    absent = heard.join(counts, "b", "left_anti").filter("b <> ''")
    forms = owned.filter("brand <> ''").groupBy("b", "brand").agg(F.count(F.lit(1)).alias("n"))
    both = contained(absent.select("b").distinct(), forms.select(F.col("b").alias("known")).distinct())
    order = Window.partitionBy("b").orderBy(F.desc("n"), "other")
    ranked = both.join(forms.select(F.col("b").alias("known"), F.col("brand").alias("other"), "n"), "known").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= LISTED)
    alike = ranked.groupBy("b").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"]).alias("alike"))
    rows = heard.join(counts, "b", "left").join(samples, "b", "left").join(alike, "b", "left")
    n = F.coalesce("item_count", F.lit(0))
    empty = F.array().cast("array<string>")
    return rows.select(
        "brand", n.alias("item_count"), F.when(n > 0, F.coalesce("samples", empty)).otherwise(empty).alias("samples"),
        F.when(n > LISTED, 1.0).when(n > 0, 0.8).otherwise(0.7).alias("confidence"), F.coalesce("alike", empty).alias("alike"),
    )


def heard_products(g: Graph) -> DataFrame:
    """Product lines as people say them, made from the names of items: as they are, in capitals, words swapped,
    a letter lost, a word added."""
    n = F.col("name")
    words = F.split(n, " ")
    said = F.array(n, F.upper(n), F.array_join(F.reverse(words), " "), F.concat(F.substring(n, 1, 3), F.substring(n, 5, 1000)), F.concat_ws(" ", n, F.lit("ultra")))
    return g.item().filter("name IS NOT NULL").select(F.element_at(said, (F.pmod(F.crc32(n.cast("binary")), F.lit(5)) + 1).cast("int")).alias("line"), "brand").distinct()


def heard_brands(g: Graph) -> DataFrame:
    """Brands as people say them, made from those of items: in capitals, cut, without signs, with a word added, and some that are none."""
    b = F.col("brand")
    said = F.array(b, F.upper(b), F.expr("left(brand, length(brand) - 1)"), F.regexp_replace(b, "[^A-Za-z0-9 ]", ""), F.concat(b, F.lit(" gear")), F.substring(b, 2, 100))
    return messy_brands(g).filter("brand IS NOT NULL").select("brand").distinct().select(F.explode(said).alias("brand")).distinct()


@query("dup_product_vocabulary")
def dup_product_vocabulary(g: Graph) -> DataFrame:
    """Each heard product against all products: what it means, how sure that is, and by which tier."""
    return validated_products(heard_products(g), g.item()).withColumn("confidence", F.round("confidence", 6))


@query("quality_brand_tiers")
def quality_brand_tiers(g: Graph) -> DataFrame:
    """Each heard brand by the tiers: the graph's brands, those like it, landed search results."""
    known = messy_brands(g).select("brand").filter("brand IS NOT NULL").unionByName(g.brand().select(F.col("name").alias("brand")))
    return validated_brands(heard_brands(g), known.filter(~F.startswith("brand", F.lit("Supplier#"))), search_results(g))


_HEARD = f"""m AS ({_MESSY}), hb AS (SELECT DISTINCT unnest([brand, upper(brand), left(brand, length(brand) - 1), regexp_replace(brand, '[^A-Za-z0-9 ]', '', 'g'), brand || ' gear', substr(brand, 2, 100)]) AS brand FROM m WHERE brand IS NOT NULL),
 cnt AS (SELECT lower(brand) AS b, count(*) AS n FROM m WHERE brand IS NOT NULL GROUP BY 1), frm AS (SELECT lower(brand) AS b, brand AS other, count(*) AS n FROM m WHERE brand <> '' GROUP BY 1, 2)"""


@query("quality_brand_presence", f""", {_HEARD},
 smp AS (SELECT b, list(name ORDER BY name) AS samples FROM (SELECT b, name, row_number() OVER (PARTITION BY b ORDER BY name) AS r FROM (SELECT DISTINCT lower(brand) AS b, name FROM m WHERE brand IS NOT NULL AND name IS NOT NULL)) WHERE r <= 5 GROUP BY b),
 sim AS (SELECT brand, list(other ORDER BY r) AS alike FROM (SELECT hb.brand, other, row_number() OVER (PARTITION BY hb.brand ORDER BY n DESC, other) AS r FROM hb JOIN frm ON contains(b, lower(hb.brand)) OR contains(lower(hb.brand), b)
   WHERE hb.brand <> '' AND lower(hb.brand) NOT IN (SELECT b FROM cnt)) WHERE r <= 5 GROUP BY brand)
 SELECT hb.brand, array_to_string(coalesce(samples, []), '|') AS samples, coalesce(n, 0) AS item_count, CASE WHEN n > 5 THEN 1.0::DOUBLE WHEN n > 0 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence, array_to_string(coalesce(alike, []), '|') AS alike
 FROM hb LEFT JOIN cnt ON cnt.b = lower(hb.brand) LEFT JOIN smp ON smp.b = lower(hb.brand) LEFT JOIN sim ON sim.brand = hb.brand""")
def quality_brand_presence(g: Graph) -> DataFrame:
    out = brand_presence(heard_brands(g), messy_brands(g))
    flat: list[Column] = [F.array_join(c, "|").alias(c) for c in ("samples", "alike")]
    return out.select("brand", "item_count", "confidence", *flat)
