"""Queries that apply the kernels to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import text, units, urls
from cairn.registry import query
from cairn.sources.views import Graph


def _any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_TOKENS = (
    "list_distinct(list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda w: length(w) > 1 AND NOT list_contains(["
    + ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    + "], w)))"
)


@query("text_slug", """SELECT node_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(name), '[''"]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown') AS slug FROM item""")
def text_slug(g: Graph) -> DataFrame:
    return g.item().select("node_id", text.slugify("name").alias("slug"))


@query("text_normalized_name", r"""SELECT node_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(content)), '[''’´`]', '', 'g'), '[-_]', ' ', 'g'), '\s+', ' ', 'g')) AS normalized FROM insight""")
def text_normalized_name(g: Graph) -> DataFrame:
    return g.insight().select("node_id", text.normalized_name("content").alias("normalized"))


@query("text_name_tokens", f"SELECT node_id, array_to_string(list_sort({_TOKENS}), ' ') AS tokens FROM item")
def text_name_tokens(g: Graph) -> DataFrame:
    return g.item().select("node_id", F.array_join(F.sort_array(text.name_tokens("name")), " ").alias("tokens"))


_VARIANT = r"""CASE WHEN regexp_matches(n, '^(.+?)\s+(\d{1,2})(\+)?$') THEN 'version_number' WHEN regexp_matches(n, '(?i)^(.+?)\s+(\d{2,3})([L]?)$') THEN 'size_number'
  WHEN regexp_matches(n, '(?i)^(.+?)\s+(\d+g)$') THEN 'weight_spec' WHEN regexp_matches(n, '^(.+?)\s+(\d+°[FC]?)$') THEN 'temperature'
  WHEN regexp_matches(n, '(?i)^(.+?)\s+(\d{3,4}\s*Fill.*)$') THEN 'fill_power' WHEN regexp_matches(n, '^(.+?)\s+(\d)\s+(GTX|Pro|Plus|Ultra)$') THEN 'model_suffix' ELSE 'none' END"""


@query("text_variant", rf"""SELECT node_id, CASE pattern WHEN 'none' THEN n ELSE regexp_extract(n, '(?i)^(.+?)\s+(\d+L?)$', 1) END AS base,
  CASE pattern WHEN 'none' THEN '' ELSE regexp_extract(n, '(?i)^(.+?)\s+(\d+L?)$', 2) END AS variant, pattern
  FROM (SELECT node_id, trim(name) AS n, {_VARIANT.replace('(n,', '(trim(name),')} AS pattern FROM item)""")
def text_variant(g: Graph) -> DataFrame:
    return g.item().select("node_id", text.variant_of("name").alias("v")).select("node_id", "v.*")


@query("text_brand_removal", """SELECT node_id, trim(substr(name, length(brand) + 2)) AS rest, 0.98::DOUBLE AS confidence FROM item
  WHERE brand IS NOT NULL AND starts_with(lower(name), lower(brand) || ' ')""")
def text_brand_removal(g: Graph) -> DataFrame:
    """Names that repeat their brand in front, with the rest and how sure it is."""
    return g.item().select("node_id", text.brand_removal("name", "brand").alias("r")).filter("r IS NOT NULL").select("node_id", "r.*")


_CATEGORY = "CASE " + " ".join(f"WHEN {_any('low', ks)} THEN '{c}'" for c, ks in text.CATEGORY_KEYWORDS.items()) + " END"


@query("text_category", f"SELECT node_id, {_CATEGORY} AS detected FROM (SELECT node_id, lower(content) AS low FROM insight)")
def text_category(g: Graph) -> DataFrame:
    return g.insight().select("node_id", text.category_of("content").alias("detected"))


_HARD = "|".join(f"(?:{p})" for p in text.HARD_PROMPTS)
_EASY = "|".join(f"(?:{p})" for p in text.EASY_PROMPTS)


@query("text_prompt_tier", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(message), '{_HARD}') THEN 'hard' WHEN regexp_matches(lower(message), '{_EASY}') THEN 'easy'
  WHEN length(message) < 50 AND contains(message, '?') THEN 'easy' ELSE 'standard' END AS tier FROM prompt""")
def text_prompt_tier(g: Graph) -> DataFrame:
    return g.prompt().select("conv_id", "turn", text.prompt_tier("message").alias("tier"))


@query("text_materials", f"""SELECT node_id, array_to_string(list_filter([{', '.join(f"'{m}'" for m in text.MATERIALS)}], lambda m: contains(lower(content), m)), ',') AS materials FROM insight""")
def text_materials(g: Graph) -> DataFrame:
    return g.insight().select("node_id", F.array_join(text.materials_in("content"), ",").alias("materials"))


@query("text_whitespace", r"SELECT node_id, regexp_matches(content, '^\s|\s$') OR contains(content, '  ') AS untidy, trim(regexp_replace(content, '[ \t\n\r]+', ' ', 'g')) AS tidy FROM insight")
def text_whitespace(g: Graph) -> DataFrame:
    c = F.col("content")
    return g.insight().select("node_id", (c.rlike(r"^\s|\s$") | F.contains(c, F.lit("  "))).alias("untidy"), F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " ")).alias("tidy"))


@query("text_all_caps", "SELECT node_id, upper(category) = category AND lower(category) <> category AND length(category) > 4 AS all_caps FROM item WHERE category IS NOT NULL")
def text_all_caps(g: Graph) -> DataFrame:
    c = F.col("category")
    return g.item().filter(c.isNotNull()).select("node_id", ((F.upper(c) == c) & (F.lower(c) != c) & (F.length(c) > 4)).alias("all_caps"))


@query("text_title_case", r"SELECT node_id, array_to_string(list_transform(regexp_extract_all(lower(name), '\p{L}+|[^\p{L}]+'), lambda x: upper(x[1]) || x[2:]), '') AS title FROM item")
def text_title_case(g: Graph) -> DataFrame:
    return g.item().select("node_id", text.title_case("name").alias("title"))


@query("text_md5_keys", "SELECT page_id, md5(url) AS url_key, substr(md5(host), 1, 8) AS host_key FROM page")
def text_md5_keys(g: Graph) -> DataFrame:
    return g.page().select("page_id", F.md5("url").alias("url_key"), F.substring(F.md5("host"), 1, 8).alias("host_key"))


# What a search for a product's data asks for by category, and otherwise; words of lines about gear and about insights, characters of a line that are kept, lines of a text.
SEARCH_TERMS = {
    "backpack": "specs volume liters weight", "tent": "specs weight capacity season", "sleeping_bag": "specs temperature rating fill power", "sleeping_pad": "specs r-value weight", "stove": "specs fuel weight boil time",
    "headlamp": "specs lumens battery life", "water_filter": "specs flow rate filter type", "jacket": "specs weight waterproof rating",
}
OTHER_TERMS = "specs weight"
HARVEST = {
    "gear": (["tent", "bag", "pack", "jacket", "shoe", "boot", "stove", "filter"], 100, 100), "insight": (["recommends", "suggests", "tip", "advice", "important", "note"], 200, 50),
}


def search_query(brand: Column, name: Column, category: Column) -> Column:
    """What a search for a product's data asks."""
    terms = F.create_map(*[F.lit(x) for pair in SEARCH_TERMS.items() for x in pair])
    return F.concat_ws(" ", brand, name, F.coalesce(F.try_element_at(terms, F.lower(F.coalesce(category, F.lit("")))), F.lit(OTHER_TERMS)))


def harvested(c: Column, kind: str) -> Column:
    """The first lines of a text that hold one of a kind's words, without blank ends and cut to a length."""
    words, length, most = HARVEST[kind]
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: F.lower(x).rlike("|".join(words)))
    return F.slice(F.transform(lines, lambda x: F.substring(x, 1, length)), 1, most)


@query("text_search_query", """SELECT node_id, concat_ws(' ', brand, name, CASE WHEN node_id % 3 = 0 THEN 'specs weight capacity season' WHEN node_id % 3 = 1 THEN 'specs fuel weight boil time' ELSE 'specs weight' END) AS q FROM item""")
def text_search_query(g: Graph) -> DataFrame:
    """Searches for items; two of three get a category that has terms of its own."""
    category = F.when(F.col("node_id") % 3 == 0, "Tent").when(F.col("node_id") % 3 == 1, "stove").otherwise(F.col("category"))
    return g.item().select("node_id", search_query(F.col("brand"), F.col("name"), category).alias("q"))


@query("text_harvested_lines", " UNION ALL ".join(
    f"SELECT node_id, '{k}' AS kind, i - 1 AS pos, substr(l[i], 1, {n}) AS line FROM (SELECT node_id, l, unnest(range(1, least(len(l), {most}) + 1)) AS i FROM (SELECT node_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(lower(x), '{'|'.join(words)}')) AS l FROM insight))"
    for k, (words, n, most) in HARVEST.items()))
def text_harvested_lines(g: Graph) -> DataFrame:
    """Lines about gear and about insights in the texts of insights."""
    each = [g.insight().select("node_id", F.lit(k).alias("kind"), F.posexplode(harvested(F.col("content"), k)).alias("pos", "line")) for k in HARVEST]
    return each[0].unionByName(each[1]).withColumn("pos", F.col("pos").cast("long"))


@query("text_key_values", r"""SELECT event_id, trim(regexp_extract(props, '"([a-z]+)"', 1)) AS key, TRY_CAST(regexp_extract(props, ':\s*([0-9]+)', 1) AS BIGINT) AS value FROM events""")
def text_key_values(g: Graph) -> DataFrame:
    props = F.from_json("props", "map<string,bigint>")
    return g.table("events").select("event_id", F.explode(props)).select("event_id", "key", "value")


@query("text_domain_values", "SELECT status, status IN ('view', 'click', 'purchase') AS valid, count(*) AS n FROM work_event GROUP BY 1, 2")
def text_domain_values(g: Graph) -> DataFrame:
    """Rows by whether an enum-like value is one of those allowed."""
    return g.work_event().groupBy("status", F.col("status").isin("view", "click", "purchase").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("units_tolerant", """SELECT node_id, CASE WHEN v IN ('unknown', 'n/a') THEN NULL ELSE CAST(trunc(TRY_CAST(v AS DOUBLE)) AS INTEGER) END AS as_int,
  CASE WHEN v IN ('unknown', 'n/a') THEN NULL ELSE TRY_CAST(replace(p, ',', '') AS DOUBLE) END AS as_double FROM (
  SELECT node_id, CASE WHEN node_id % 5 = 0 THEN 'unknown' WHEN node_id % 7 = 0 THEN 'n/a' WHEN node_id % 3 = 0 THEN node_id || '.7' ELSE 'x' || node_id END AS v,
         CASE WHEN node_id % 2 = 0 THEN '1,' || (100 + node_id % 900) || '.5' ELSE 'free' END AS p FROM item)""")
def units_tolerant(g: Graph) -> DataFrame:
    k = F.col("node_id")
    raw = F.when(k % 5 == 0, "unknown").when(k % 7 == 0, "n/a").when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".7"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    price = F.when(k % 2 == 0, F.concat(F.lit("$1,"), (100 + k % 900).cast("string"), F.lit(".5"))).otherwise("free")
    rows = g.item().select("node_id", raw.alias("v"), price.alias("p"))
    known = ~F.col("v").isin("unknown", "n/a")
    return rows.select("node_id", units.tolerant_int(F.col("v")).alias("as_int"), F.when(known, units.tolerant_double(F.col("p"))).alias("as_double"))


@query("units_weight_grams", """SELECT node_id, CAST(trunc(n * f) AS INTEGER) AS grams FROM (SELECT node_id, CAST((node_id % 40) + 0.5 AS DOUBLE) AS n,
  CASE node_id % 4 WHEN 0 THEN 1000.0::DOUBLE WHEN 1 THEN 453.592::DOUBLE WHEN 2 THEN 28.3495::DOUBLE ELSE 1.0::DOUBLE END AS f FROM item)""")
def units_weight_grams(g: Graph) -> DataFrame:
    k = F.col("node_id")
    unit = F.when(k % 4 == 0, "kg").when(k % 4 == 1, "lb").when(k % 4 == 2, " oz").otherwise(" g")
    return g.item().select("node_id", units.weight_grams(F.concat((k % 40).cast("string"), F.lit(".5"), unit)).alias("grams"))


@query("units_weights_in_text", """SELECT node_id, array_to_string(list_transform(list_filter([node_id::DOUBLE, round_even(node_id * 28.3495::DOUBLE, 0), 454.0::DOUBLE, round_even(453.592::DOUBLE + node_id * 28.3495::DOUBLE, 0)],
  lambda x: x > 10 AND x < 20000), lambda x: CAST(x AS VARCHAR)), ',') AS grams FROM item""")
def units_weights_in_text(g: Graph) -> DataFrame:
    """Weights read from a text about each item, in the order of the unit patterns."""
    k = F.col("node_id").cast("string")
    about = F.concat(F.lit("weighs 1 lb "), k, F.lit(" oz or "), k, F.lit(" g"))
    return g.item().select("node_id", units.weights_in(about).alias("w")).select("node_id", F.array_join(F.transform("w", lambda x: x.cast("string")), ",").alias("grams"))


@query("units_duration", """SELECT node_id, CASE WHEN node_id % 100 = 0 THEN NULL ELSE CAST((node_id % 100) * 3600 + (node_id % 100) * 60 + (node_id % 100) AS INTEGER) END AS seconds FROM item""")
def units_duration(g: Graph) -> DataFrame:
    n = (F.col("node_id") % 100).cast("string")
    return g.item().select("node_id", units.iso_seconds(F.concat(F.lit("PT"), n, F.lit("H"), n, F.lit("M"), n, F.lit("S"))).alias("seconds"))


@query("units_weight_conflict", """SELECT node_id, abs(a - b) / greatest(a, b) * 100 AS percent FROM (SELECT node_id, CAST(weight_grams AS DOUBLE) AS a,
  CAST(weight_grams + node_id % 50 AS DOUBLE) AS b FROM item WHERE weight_grams > 0)""")
def units_weight_conflict(g: Graph) -> DataFrame:
    a, b = F.col("weight_grams").cast("double"), (F.col("weight_grams") + F.col("node_id") % 50).cast("double")
    return g.item().filter("weight_grams > 0").select("node_id", (F.abs(a - b) / F.greatest(a, b) * 100).alias("percent"))


@query("units_lists", "SELECT node_id, array_to_string(list_transform(string_split(content, ','), lambda x: trim(x)), ', ') AS joined, len(string_split(content, ',')) AS n FROM insight")
def units_lists(g: Graph) -> DataFrame:
    """Comma-separated text to an array and back."""
    parts = F.transform(F.split("content", ","), lambda x: F.trim(x))
    return g.insight().select("node_id", F.array_join(parts, ", ").alias("joined"), F.size(parts).cast("long").alias("n"))


@query("units_json_round_trip", "SELECT node_id, name, weight_grams FROM item WHERE weight_grams IS NOT NULL")
def units_json_round_trip(g: Graph) -> DataFrame:
    """Nested records to JSON and back with a declared schema."""
    rows = g.item().filter("weight_grams IS NOT NULL").select(F.to_json(F.struct("node_id", F.struct("name", "weight_grams").alias("fix"))).alias("j"))
    back = F.from_json("j", "node_id bigint, fix struct<name:string,weight_grams:int>")
    return rows.select(back.alias("r")).select("r.node_id", "r.fix.name", "r.fix.weight_grams")


@query("url_parts", """SELECT page_id, regexp_replace(host, '^www\\.', '') AS domain, path, string_split(regexp_replace(host, '^www\\.', ''), '.')[1] AS brand FROM page""")
def url_parts(g: Graph) -> DataFrame:
    d = urls.domain(F.col("url"))
    return g.page().select("page_id", d.alias("domain"), "path", F.element_at(F.split(d, r"\."), 1).alias("brand"))


_PRODUCT = "|".join(f"(?:{p})" for p in urls.PRODUCT_PATHS)
_COLLECTION = "|".join(f"(?:{p})" for p in urls.COLLECTION_PATHS)


@query("url_class", f"""SELECT node_id, CASE WHEN regexp_matches(lower(u), '{_COLLECTION}') THEN 'collection' WHEN regexp_matches(lower(u), '{_PRODUCT}') THEN 'product' ELSE 'other' END AS kind
  FROM (SELECT node_id, CASE WHEN node_id % 3 = 0 THEN 'https://a.example/c/' || node_id ELSE coalesce(product_url, 'https://a.example/about') END AS u FROM item)""")
def url_class(g: Graph) -> DataFrame:
    k = F.col("node_id")
    u = F.when(k % 3 == 0, F.concat(F.lit("https://a.example/c/"), k.cast("string"))).otherwise(F.coalesce("product_url", F.lit("https://a.example/about")))
    kind = F.when(urls.is_collection(F.col("u")), "collection").when(urls.is_product(F.col("u")), "product").otherwise("other")
    return g.item().select("node_id", u.alias("u")).select("node_id", kind.alias("kind"))


@query("url_ids", """SELECT node_id, CASE node_id % 3 WHEN 0 THEN vid WHEN 1 THEN vid END AS video_id, CASE WHEN node_id % 3 = 0 THEN 'PL' || node_id END AS playlist_id
  FROM (SELECT node_id, lpad(CAST(node_id AS VARCHAR), 11, 'a') AS vid FROM item)""")
def url_ids(g: Graph) -> DataFrame:
    k = F.col("node_id")
    vid = F.lpad(k.cast("string"), 11, "a")
    u = F.when(k % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), vid, F.lit("&list=PL"), k.cast("string")))
    u = u.when(k % 3 == 1, F.concat(F.lit("https://youtu.be/"), vid)).otherwise("https://example.com/")
    rows = g.item().select("node_id", u.alias("u"))
    return rows.select("node_id", urls.video_id(F.col("u")).alias("video_id"), urls.playlist_id(F.col("u")).alias("playlist_id"))
