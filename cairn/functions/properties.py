"""Properties without a schema: JSON as variants, keys found in the data, lists of mixed kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.registry import query
from cairn.sources.scratch import keeper
from cairn.sources.views import Graph

# Fields of all items with their weights, and fields of those whose category holds one of some words; the first that fits counts.
CORE = {"weight_grams": 2, "description": 2, "price_usd": 1, "materials": 1, "features": 1, "productUrl": 1}
BY_CATEGORY = [
    (["backpack"], {"volumeLiters": 2}), (["sleeping_bag", "sleeping bag"], {"tempRatingF": 2, "fillPower": 1}), (["sleeping_pad", "sleeping pad"], {"rValue": 2}),
    (["tent"], {"capacityPersons": 2, "waterproofRating": 1}), (["headlamp"], {"lumens": 2, "burnTime": 1}), (["stove"], {"fuelType": 2}), (["filter"], {"filterType": 2, "flowRate": 1}),
]
#: The two spellings of one weight.
WEIGHT_PAIRS = [("weight_grams", "weightGrams"), ("weight_oz", "weightOunces")]


def parsed(df: DataFrame, key: str, bag: str) -> DataFrame:
    """key and v: the bag as a variant, null where it is no JSON."""
    return df.select(key, F.try_parse_json(bag).alias("v"))


def exploded(df: DataFrame, value: str = "v") -> DataFrame:
    """df with pos, key and value of each member of a list or object; scalars have none."""
    rows = df.alias("_rows")
    members = df.sparkSession.tvf.variant_explode(F.col(f"_rows.{value}").outer())
    return rows.lateralJoin(members.select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))


def properties(df: DataFrame, key: str, bag: str) -> DataFrame:
    """key, prop, value, kind: the properties that each bag has, whatever they are."""
    rows = exploded(parsed(df, key, bag).filter("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'"))
    return rows.select(key, F.col("_key").alias("prop"), F.col("_value").alias("value"), F.schema_of_variant("_value").alias("kind"))


def leaves(df: DataFrame, key: str, bag: str, keep) -> DataFrame:
    """key, path, value, kind: all scalars of each bag, however deep, with paths like $.a[0].b. keep writes a table and reads it again."""
    level = parsed(df, key, bag).filter("v IS NOT NULL").select(key, F.lit("$").alias("path"), F.col("v").alias("value"))
    out, k = None, 0
    while True:
        level = keep(level.withColumn("kind", F.schema_of_variant("value")), f"level{k}")
        inner = F.col("kind").startswith("ARRAY") | F.col("kind").startswith("OBJECT")
        flat = level.filter(~inner).select(key, "path", F.when(F.col("kind") != "VOID", F.expr("cast(value AS string)")).alias("value"), "kind")
        out = flat if out is None else out.unionByName(flat)
        deeper = level.filter(inner)
        if deeper.isEmpty():
            return out
        step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), "_key")).otherwise(F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        level = exploded(deeper, "value").select(key, F.concat("path", step).alias("path"), F.col("_value").alias("value"))
        k += 1


def weight_consistency(df: DataFrame, key: str, bag: str) -> DataFrame:
    """key, weight_keys, mixed, conflicts, worst, recommended: the spellings of weights in each bag.

    Keys are mixed if some have an underscore and others capitals inside; only then are values compared.
    worst is the largest difference of two spellings in percent of the larger one; 0 and no value are not compared.
    """
    names = properties(df, key, bag).filter(F.contains("prop", F.lit("weight")) | F.contains("prop", F.lit("Weight"))).groupBy(key).agg(F.array_sort(F.collect_set("prop")).alias("weight_keys"))
    rows = parsed(df, key, bag).join(names, key)
    snake = F.exists("weight_keys", lambda k: F.contains(k, F.lit("_")))
    camel = F.exists("weight_keys", lambda k: k.rlike("^[a-z].*[A-Z]"))
    value = lambda name: F.nullif(F.try_variant_get("v", f"$.{name}", "double"), F.lit(0.0))
    apart = [F.when(value(a) != value(b), F.abs(value(a) - value(b)) / F.greatest(value(a), value(b)) * 100) for a, b in WEIGHT_PAIRS]
    count = apart[0].isNotNull().cast("long") + apart[1].isNotNull().cast("long")
    both = snake & camel
    return rows.select(
        key, "weight_keys", both.alias("mixed"), F.when(both, count).otherwise(0).alias("conflicts"), F.when(both, F.round(F.greatest(*apart), 6)).alias("worst"),
        F.when(both, F.coalesce(value("weight_grams"), value("weightGrams"))).alias("recommended"),
    )


def completeness(df: DataFrame, key: str, bag: str) -> DataFrame:
    """key, score: the weighted share of fields that a bag has set, those of its category included; blank texts, empty lists and nulls are not set."""
    rows = parsed(df, key, bag)
    text = lambda name: F.to_json(F.try_variant_get("v", f"$.{name}", "variant"))
    is_set = lambda name: F.coalesce(~text(name).isin('""', "[]", "null"), F.lit(False))
    points = lambda fields: sum((F.when(is_set(n), w).otherwise(0) for n, w in fields.items()), F.lit(0))
    category = F.lower(F.coalesce(F.try_variant_get("v", "$.category", "string"), F.lit("")))
    got, total = F.lit(0), F.lit(0)
    for words, fields in reversed(BY_CATEGORY):
        fits = F.lit(False)
        for w in words:
            fits = fits | F.contains(category, F.lit(w))
        got, total = F.when(fits, points(fields)).otherwise(got), F.when(fits, sum(fields.values())).otherwise(total)
    return rows.select(key, F.round((points(CORE) + got) / (F.lit(sum(CORE.values())) + total), 6).alias("score"))


def with_attributes(df: DataFrame, key: str, bag: str, given: DataFrame) -> DataFrame:
    """key, bag with the attributes of given (key, attr, value as JSON) set: a list becomes its JSON text, all other values stay as they are. One value an attribute."""
    new = given.select(key, F.col("attr").alias("prop"), F.try_parse_json("value").alias("x"))
    new = new.select(key, "prop", F.when(F.startswith(F.schema_of_variant("x"), F.lit("ARRAY")), F.to_json("x").cast("variant")).otherwise(F.col("x")).alias("value"), F.lit(1).alias("rank")).filter("value IS NOT NULL")
    old = properties(df, key, bag).select(key, "prop", "value", F.lit(0).alias("rank"))
    touched = df.select(key).join(new.select(key).distinct(), key, "left_semi")
    every = old.unionByName(new).join(touched, key, "left_semi").groupBy(key, "prop").agg(F.max_by(F.to_json("value"), "rank").alias("value"))
    pairs = every.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prop", "value"))), lambda p: F.concat(F.regexp_replace(F.to_json(F.array(p["prop"])), r"^\[|\]$", ""), F.lit(":"), p["value"])), ",").alias("_new"))
    return df.join(pairs, key, "left").select(key, F.when(F.col("_new").isNotNull(), F.concat(F.lit("{"), "_new", F.lit("}"))).otherwise(F.col(bag)).alias(bag))


def map_urls(df: DataFrame, key: str, result: str) -> DataFrame:
    """key, pos, url: every address of a site map in any of its shapes: a list, or a list under links, of texts or of objects with url."""
    v = F.col("v")
    is_list = F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))
    listed = F.when(is_list, F.try_variant_get(v, "$", "array<variant>")).otherwise(F.try_variant_get(v, "$.links", "array<variant>"))
    each = parsed(df, key, result).select(key, F.posexplode(listed).alias("pos", "x"))
    url = F.when(F.schema_of_variant("x") == "STRING", F.expr("cast(x AS string)")).otherwise(F.try_variant_get("x", "$.url", "string"))
    return each.select(key, "pos", url.alias("url")).filter("url IS NOT NULL")


def bags(g: Graph) -> DataFrame:
    """node_id, bag: items as JSON whose keys differ from one to the next, with a mixed list and what the event of that number says."""
    k = F.col("node_id")
    size = F.col("p_size")
    items = g.item().join(g.table("part").select(F.col("p_partkey").alias("node_id"), "p_size"), "node_id")
    when = lambda n, c: F.when(k % n == 0, c)
    fixed = F.to_json(F.struct(
        "name", "brand", F.when(k % 9 == 0, "Tent, 2p").when(k % 9 == 1, "sleeping bag").otherwise(F.col("category")).alias("category"), "weight_grams", "description", "price_usd", F.col("product_url").alias("productUrl"),
        when(4, size * 10 + F.when(k % 8 == 0, 5).otherwise(0)).alias("weightGrams"), when(6, size * 0.5).alias("weight_oz"), when(12, size * 0.5).alias("weightOunces"),
        when(18, size).alias("capacityPersons"), when(5, F.array("name")).alias("materials"), when(2, F.lit("")).alias("features"),
    ))
    mixed = F.concat(F.lit('["'), F.array_join(F.split("name", " "), '","'), F.lit('",'), size.cast("string"), F.lit(',{"size":'), size.cast("string"), F.lit(',"ok":true},null]'))
    seen = g.table("events").select(F.col("event_id").alias("node_id"), "props")
    rows = items.filter("name IS NOT NULL").select("node_id", fixed.alias("j"), mixed.alias("m")).join(seen, "node_id", "left")
    return rows.select("node_id", F.concat(F.expr("left(j, length(j) - 1)"), F.lit(',"tags":'), "m", F.coalesce(F.concat(F.lit(',"seen":'), "props"), F.lit("")), F.lit("}")).alias("bag"))


_BAGS = """pb AS (SELECT i.*, p_size, props, CASE WHEN node_id % 9 = 0 THEN 'Tent, 2p' WHEN node_id % 9 = 1 THEN 'sleeping bag' ELSE i.category END AS cat, CASE WHEN node_id % 4 = 0 THEN p_size * 10 + CASE WHEN node_id % 8 = 0 THEN 5 ELSE 0 END END AS camel,
  CASE WHEN node_id % 6 = 0 THEN p_size * 0.5::DOUBLE END AS oz, CASE WHEN node_id % 12 = 0 THEN p_size * 0.5::DOUBLE END AS ounces FROM item i JOIN part ON p_partkey = node_id LEFT JOIN events ON event_id = node_id WHERE name IS NOT NULL)"""


@query("prop_keys", f""", {_BAGS} SELECT prop, count(*) AS n FROM (SELECT unnest(['name', 'tags'] || CASE WHEN brand IS NOT NULL THEN ['brand'] ELSE [] END || CASE WHEN cat IS NOT NULL THEN ['category'] ELSE [] END || CASE WHEN weight_grams IS NOT NULL THEN ['weight_grams'] ELSE [] END
  || CASE WHEN description IS NOT NULL THEN ['description'] ELSE [] END || CASE WHEN price_usd IS NOT NULL THEN ['price_usd'] ELSE [] END || CASE WHEN product_url IS NOT NULL THEN ['productUrl'] ELSE [] END || CASE WHEN camel IS NOT NULL THEN ['weightGrams'] ELSE [] END
  || CASE WHEN oz IS NOT NULL THEN ['weight_oz'] ELSE [] END || CASE WHEN ounces IS NOT NULL THEN ['weightOunces'] ELSE [] END || CASE WHEN node_id % 18 = 0 THEN ['capacityPersons'] ELSE [] END || CASE WHEN node_id % 5 = 0 THEN ['materials'] ELSE [] END
  || CASE WHEN node_id % 2 = 0 THEN ['features'] ELSE [] END || CASE WHEN props IS NOT NULL THEN ['seen'] ELSE [] END) AS prop FROM pb) GROUP BY prop""")
def prop_keys(g: Graph) -> DataFrame:
    """Which properties items have, and how many have each; no key is named in the query."""
    return properties(bags(g), "node_id", "bag").groupBy("prop").agg(F.count(F.lit(1)).alias("n"))


@query("prop_weight_conflicts", f""", {_BAGS}, w AS (SELECT node_id, list_sort(list_filter([CASE WHEN camel IS NOT NULL THEN 'weightGrams' END, CASE WHEN ounces IS NOT NULL THEN 'weightOunces' END, CASE WHEN weight_grams IS NOT NULL THEN 'weight_grams' END, CASE WHEN oz IS NOT NULL THEN 'weight_oz' END], lambda x: x IS NOT NULL)) AS ks,
    nullif(weight_grams, 0) AS a, nullif(camel, 0) AS b, (weight_grams IS NOT NULL OR oz IS NOT NULL) AND (camel IS NOT NULL OR ounces IS NOT NULL) AS mixed FROM pb)
  SELECT node_id, array_to_string(ks, ',') AS weight_keys, mixed, CASE WHEN mixed AND a <> b THEN 1 ELSE 0 END AS conflicts, CASE WHEN mixed AND a <> b THEN round(abs(a - b) / greatest(a, b)::DOUBLE * 100, 6) END AS worst,
    CASE WHEN mixed THEN CAST(coalesce(a, b) AS DOUBLE) END AS recommended FROM w WHERE len(ks) > 0""")
def prop_weight_conflicts(g: Graph) -> DataFrame:
    """Items whose weights are spelt in two ways, and whether they say the same."""
    return weight_consistency(bags(g), "node_id", "bag").withColumn("weight_keys", F.array_join("weight_keys", ","))


@query("prop_completeness", f""", {_BAGS} SELECT node_id, round((CASE WHEN weight_grams IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN description <> '' THEN 2 ELSE 0 END + CASE WHEN price_usd IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN node_id % 5 = 0 THEN 1 ELSE 0 END
    + CASE WHEN product_url <> '' THEN 1 ELSE 0 END + CASE WHEN node_id % 18 = 0 THEN 2 ELSE 0 END) / (8 + CASE WHEN node_id % 9 IN (0, 1) THEN 3 ELSE 0 END)::DOUBLE, 6) AS score FROM pb""")
def prop_completeness(g: Graph) -> DataFrame:
    """The completeness of each item with the fields of its category."""
    return completeness(bags(g), "node_id", "bag")


@query("prop_leaves", f""", {_BAGS} SELECT node_id, '$.tags[' || (i - 1) || ']' AS path, w[i] AS value FROM (SELECT node_id, string_split(name, ' ') || [CAST(p_size AS VARCHAR)] AS w, unnest(range(1, len(string_split(name, ' ')) + 2)) AS i FROM pb)
  UNION ALL SELECT node_id, '$.tags[' || (len(string_split(name, ' ')) + 1) || '].size', CAST(p_size AS VARCHAR) FROM pb UNION ALL SELECT node_id, '$.tags[' || (len(string_split(name, ' ')) + 1) || '].ok', 'true' FROM pb
  UNION ALL SELECT node_id, '$.tags[' || (len(string_split(name, ' ')) + 2) || ']', NULL FROM pb UNION ALL SELECT node_id, '$.seen.' || k, json_extract_string(props, '$.' || k) FROM (SELECT node_id, props, unnest(json_keys(props)) AS k FROM pb)""")
def prop_leaves(g: Graph) -> DataFrame:
    """All scalars below the mixed lists and the events' properties, with their paths."""
    out = leaves(bags(g), "node_id", "bag", keeper(g.spark))
    return out.filter(F.startswith("path", F.lit("$.tags")) | F.startswith("path", F.lit("$.seen"))).select("node_id", "path", "value")


@query("prop_set_lists", f""", {_BAGS} SELECT node_id, CASE WHEN node_id % 2 = 0 THEN to_json([name, coalesce(brand, '?')]) END AS colors, CASE WHEN node_id % 3 = 0 THEN p_size END AS years, name FROM pb""")
def prop_set_lists(g: Graph) -> DataFrame:
    """Attributes set on bags: lists come back as JSON texts, numbers as they are."""
    k = F.col("node_id")
    rows = g.item().filter("name IS NOT NULL").join(g.table("part").select(F.col("p_partkey").alias("node_id"), "p_size"), "node_id")
    colors = rows.filter(k % 2 == 0).select("node_id", F.lit("color options").alias("attr"), F.to_json(F.array("name", F.coalesce("brand", F.lit("?")))).alias("value"))
    years = rows.filter(k % 3 == 0).select("node_id", F.lit("years").alias("attr"), F.col("p_size").cast("string").alias("value"))
    out = parsed(with_attributes(bags(g), "node_id", "bag", colors.unionByName(years)), "node_id", "bag")
    at = lambda p, t: F.try_variant_get("v", p, t)
    return out.select("node_id", at("$['color options']", "string").alias("colors"), at("$.years", "int").alias("years"), at("$.name", "string").alias("name"))


@query("json_map_all_urls", r"""SELECT page_id, i - 1 AS pos, h[i] AS url FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS h, unnest(range(1, len(regexp_extract_all(html, 'href="([^"]+)"')) + 1)) AS i FROM pages)""")
def json_map_all_urls(g: Graph) -> DataFrame:
    """The links of all pages as site maps write them, in four shapes, and back."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    plain, objects = F.to_json(links), F.to_json(F.transform(links, lambda u: F.struct(u.alias("url"), F.lit(1).alias("n"))))
    under = lambda j: F.concat(F.lit('{"links":'), j, F.lit("}"))
    shapes = F.array(plain, objects, under(plain), under(objects))
    maps = g.table("pages").select("page_id", F.element_at(shapes, (F.size(links) % 4 + 1).cast("int")).alias("result"))
    return map_urls(maps, "page_id", "result")
