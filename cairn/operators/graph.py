"""Pattern expansion over node and edge DataFrames, and the queries built from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.registry import query
from cairn.sources.views import Graph


def expand(nodes: DataFrame, edges: DataFrame, targets: DataFrame, *, optional: bool = False, node: str = "node_id") -> DataFrame:
    """nodes -[edge]-> targets. targets' columns must not clash; its key is dst_id."""
    how = "left" if optional else "inner"
    hop = edges.select(F.col("src_id").alias(node), "dst_id").join(targets, "dst_id")
    return nodes.join(hop, node, how)


def without(nodes: DataFrame, *edges: DataFrame, outgoing: bool = True, node: str = "node_id") -> DataFrame:
    """Nodes that are the source (or target) of none of the edges: one anti-join a pattern."""
    end = "src_id" if outgoing else "dst_id"
    return reduce(lambda d, e: d.join(e.select(F.col(end).alias(node)), node, "left_anti"), edges, nodes)


def having(nodes: DataFrame, edges: DataFrame, *, outgoing: bool = True, node: str = "node_id") -> DataFrame:
    """Nodes with at least one such edge (semi-join)."""
    return nodes.join(edges.select(F.col("src_id" if outgoing else "dst_id").alias(node)), node, "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, once each as (this_id, this_label, rel_type, other_id, other_label)."""
    names = ["this_id", "this_label", "rel_type", "other_id", "other_label"]
    back = edges.select("dst_id", "dst_label", "rel_type", "src_id", "src_label")
    return edges.select("src_id", "src_label", "rel_type", "dst_id", "dst_label").toDF(*names).unionByName(back.toDF(*names))


def branch_counts(nodes: DataFrame, branches: dict[str, DataFrame], node: str = "node_id") -> DataFrame:
    """Distinct neighbours of each node by branch: every branch is counted before it is joined,
    so several optional branches never multiply."""
    for name, edges in branches.items():
        n = edges.groupBy(F.col("src_id").alias(node)).agg(F.countDistinct("dst_id").alias(name))
        nodes = nodes.join(n, node, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return nodes


def missing(c: str, *sentinels: str) -> Column:
    """NULL, empty or one of the sentinels."""
    return reduce(lambda a, s: a | (F.col(c) == s), sentinels, F.col(c).isNull() | (F.col(c) == ""))


def present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def either_contains(a: Column, b: Column) -> Column:
    """Case-insensitive containment either way."""
    return F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a))


# S03, A01, A02, S04


@query("graph_stats_nodes", """SELECT label, count(*) AS n FROM (SELECT 'Item' AS label FROM item UNION ALL SELECT 'Brand' FROM brand
  UNION ALL SELECT 'Family' FROM family UNION ALL SELECT 'Source' FROM source UNION ALL SELECT 'Insight' FROM insight
  UNION ALL SELECT 'Term' FROM term) GROUP BY label""")
def graph_stats_nodes(g: Graph) -> DataFrame:
    """Nodes by label: each label's count is pushed to its own scan."""
    tables = {"Item": g.item(), "Brand": g.brand(), "Family": g.family(), "Source": g.source(), "Insight": g.insight(), "Term": g.term()}
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("label"), "n") for k, t in tables.items()])


@query("graph_stats_edges", "SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type")
def graph_stats_edges(g: Graph) -> DataFrame:
    return g.edges().groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))


# S05, S06, S07, S08


@query("lookup_by_id", "SELECT node_id, name, brand, category FROM item WHERE node_id = 42")
def lookup_by_id(g: Graph) -> DataFrame:
    return g.item().filter(F.col("node_id") == 42).select("node_id", "name", "brand", "category")


@query("lookup_by_key", """SELECT min(node_id) AS node_id, lower(name) AS name_key, lower(brand) AS brand_key FROM item
  WHERE name IS NOT NULL AND brand IS NOT NULL GROUP BY 2, 3""")
def lookup_by_key(g: Graph) -> DataFrame:
    """The natural key, case folded, with the first node that holds it."""
    return g.item().filter("name IS NOT NULL AND brand IS NOT NULL").groupBy(
        F.lower("name").alias("name_key"), F.lower("brand").alias("brand_key")
    ).agg(F.min("node_id").alias("node_id"))


@query("item_attributes", """SELECT node_id, key, value FROM (SELECT node_id, unnest([
    {'key': 'name', 'value': name}, {'key': 'brand', 'value': brand}, {'key': 'category', 'value': category},
    {'key': 'weight_grams', 'value': CAST(weight_grams AS VARCHAR)}, {'key': 'product_url', 'value': product_url}], recursive := true)
  FROM item) WHERE value IS NOT NULL""")
def item_attributes(g: Graph) -> DataFrame:
    """Properties read without a schema: one row for each property that is set."""
    names = ["name", "brand", "category", "weight_grams", "product_url"]
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    return g.item().select("node_id", F.explode(F.map_filter(pairs, lambda k, v: v.isNotNull())))


@query("attribute_keys_like", """SELECT node_id, list_sort(list_filter([CASE WHEN weight_grams IS NOT NULL THEN 'weight_grams' END,
    CASE WHEN brand IS NOT NULL THEN 'brand' END], lambda k: k LIKE '%eight%'))[1] AS weight_key FROM item WHERE weight_grams IS NOT NULL""")
def attribute_keys_like(g: Graph) -> DataFrame:
    """Property keys of a node that look like a weight."""
    props = F.map_filter(F.create_map(F.lit("weight_grams"), F.col("weight_grams").cast("string"), F.lit("brand"), F.col("brand")), lambda k, v: v.isNotNull())
    keys = F.filter(F.map_keys(props), lambda k: F.contains(k, F.lit("eight")))
    return g.item().select("node_id", F.get(F.sort_array(keys), F.lit(0)).alias("weight_key")).filter("weight_key IS NOT NULL")


# F01, F02, F05-F12, F19, F20


@query("search_either_direction", "SELECT node_id, name FROM item WHERE contains(lower(name), 'red widget') OR contains('red widget', lower(name))")
def search_either_direction(g: Graph) -> DataFrame:
    return g.item().filter(either_contains(F.col("name"), F.lit("Red Widget"))).select("node_id", "name")


@query("search_labels", """SELECT label, node_id, text FROM (SELECT 'Item' AS label, node_id, name AS text, brand AS more FROM item
  UNION ALL SELECT 'Brand', node_id, name, NULL FROM brand UNION ALL SELECT 'Insight', node_id, summary, NULL FROM insight)
  WHERE contains(lower(text), 'bolt') OR contains(lower(more), 'bolt')""")
def search_labels(g: Graph) -> DataFrame:
    """One search over several labels and properties; a NULL property never hides another one's match."""
    none = F.lit(None).cast("string").alias("more")
    rows = (
        g.item().select(F.lit("Item").alias("label"), "node_id", F.col("name").alias("text"), F.col("brand").alias("more"))
        .unionByName(g.brand().select(F.lit("Brand").alias("label"), "node_id", F.col("name").alias("text"), none))
        .unionByName(g.insight().select(F.lit("Insight").alias("label"), "node_id", F.col("summary").alias("text"), none))
    )
    hit = F.contains(F.lower("text"), F.lit("bolt")) | F.contains(F.lower("more"), F.lit("bolt"))
    return rows.filter(hit).select("label", "node_id", "text")


@query("search_insights", "SELECT node_id, summary FROM insight WHERE contains(lower(content), 'thonin') OR contains(lower(summary), 'thonin')")
def search_insights(g: Graph) -> DataFrame:
    hit = F.contains(F.lower("content"), F.lit("thonin")) | F.contains(F.lower("summary"), F.lit("thonin"))
    return g.insight().filter(hit).select("node_id", "summary")


@query("search_sources", "SELECT node_id, title FROM source WHERE contains(coalesce(lower(title), ''), 'urgent') OR contains(coalesce(lower(source_type), ''), 'urgent')")
def search_sources(g: Graph) -> DataFrame:
    hit = lambda c: F.contains(F.coalesce(F.lower(c), F.lit("")), F.lit("urgent"))
    return g.source().filter(hit("title") | hit("source_type")).select("node_id", "title")


TEMPERATURE, TOLERANCE = -5.0, 5.0


@query("temperature_range", """SELECT node_id, lo, hi FROM (SELECT node_id, CASE WHEN node_id % 3 <> 0 THEN -(node_id % 30) END AS lo,
  CASE WHEN node_id % 4 <> 0 THEN node_id % 25 - 12 END AS hi FROM item) WHERE (lo IS NULL OR lo <= 0) AND (hi IS NULL OR hi >= -10)""")
def temperature_range(g: Graph) -> DataFrame:
    """Nullable bounds with a tolerance; a missing bound is open."""
    k = F.col("node_id")
    bounds = g.item().select("node_id", F.when(k % 3 != 0, -(k % 30)).alias("lo"), F.when(k % 4 != 0, k % 25 - 12).alias("hi"))
    low, high = F.col("lo").isNull() | (F.col("lo") <= TEMPERATURE + TOLERANCE), F.col("hi").isNull() | (F.col("hi") >= TEMPERATURE - TOLERANCE)
    return bounds.filter(low & high)


@query("term_by_alias", "SELECT node_id, term FROM term WHERE len(list_filter(aliases, lambda a: lower(a) = 'alias nation_4')) > 0 OR lower(term) = 'alias nation_4'")
def term_by_alias(g: Graph) -> DataFrame:
    hit = F.coalesce(F.exists("aliases", lambda a: F.lower(a) == "alias nation_4"), F.lit(False)) | (F.lower("term") == "alias nation_4")
    return g.term().filter(hit).select("node_id", "term")


def filtered(df: DataFrame, category: str | None = None, brand: str | None = None, contains: str | None = None) -> DataFrame:
    """Conjuncts only for the arguments that are given."""
    tests = [
        F.lower("category") == category.lower() if category else None,
        F.col("brand") == brand if brand else None,
        F.contains(F.lower("name"), F.lit(contains.lower())) if contains else None,
    ]
    return reduce(lambda d, t: d.filter(t), [t for t in tests if t is not None], df)


@query("optional_filters", "SELECT node_id, name, brand FROM item WHERE lower(category) = 'economy' AND contains(lower(name), 'ring')")
def optional_filters(g: Graph) -> DataFrame:
    return filtered(g.item(), category="ECONOMY", contains="Ring").select("node_id", "name", "brand")


# J01-J07, J11, J12, J17, U01, U02, U07


@query("items_of_source", """SELECT s.node_id AS source_id, i.node_id AS item_id, i.name FROM source s JOIN e_extracted_from e ON e.dst_id = s.node_id
  JOIN item i ON i.node_id = e.src_id WHERE s.source_type = 'P'""")
def items_of_source(g: Graph) -> DataFrame:
    """Inner expansion of one hop; the filter on the source meets its scan."""
    source = g.source().filter("source_type = 'P'").select(F.col("node_id").alias("source_id"))
    edges = g.edge("EXTRACTED_FROM").select(F.col("src_id").alias("item_id"), F.col("dst_id").alias("source_id"))
    return source.join(edges, "source_id").join(g.item().select(F.col("node_id").alias("item_id"), "name"), "item_id")


@query("items_with_sources", """SELECT i.node_id, i.name, count(DISTINCT e.dst_id) AS sources, count(DISTINCT t.dst_id) AS insights
  FROM item i LEFT JOIN e_extracted_from e ON e.src_id = i.node_id LEFT JOIN e_has_tip t ON t.src_id = i.node_id GROUP BY 1, 2""")
def items_with_sources(g: Graph) -> DataFrame:
    """Two optional branches: DISTINCT counts without the product of both."""
    return branch_counts(g.item().select("node_id", "name"), {"sources": g.edge("EXTRACTED_FROM"), "insights": g.edge("HAS_TIP")})


@query("items_without_edges", """SELECT node_id, name FROM item WHERE node_id NOT IN (SELECT src_id FROM edges WHERE src_label = 'Item')
  AND node_id NOT IN (SELECT dst_id FROM edges WHERE dst_label = 'Item')""")
def items_without_edges(g: Graph) -> DataFrame:
    e = g.edges()
    out = without(g.item().select("node_id", "name"), e.filter("src_label = 'Item'"))
    return without(out, e.filter("dst_label = 'Item'"), outgoing=False)


@query("items_with_provenance", "SELECT node_id, name FROM item WHERE node_id IN (SELECT item_id FROM field_source)")
def items_with_provenance(g: Graph) -> DataFrame:
    return g.item().select("node_id", "name").join(g.field_source().select(F.col("item_id").alias("node_id")), "node_id", "left_semi")


@query("comparisons", """SELECT a.node_id AS item_id, a.name AS item, b.node_id AS other_id, b.name AS other, d AS direction FROM (
  SELECT src_id AS x, dst_id AS y, 'out' AS d FROM e_compared_to UNION ALL SELECT dst_id, src_id, 'in' FROM e_compared_to) e
  JOIN item a ON a.node_id = e.x JOIN item b ON b.node_id = e.y""")
def comparisons(g: Graph) -> DataFrame:
    """Items compared with one another, seen from both ends."""
    e = g.edge("COMPARED_TO")
    both = e.select(F.col("src_id").alias("item_id"), F.col("dst_id").alias("other_id"), F.lit("out").alias("direction")).unionByName(
        e.select(F.col("dst_id").alias("item_id"), F.col("src_id").alias("other_id"), F.lit("in").alias("direction"))
    )
    names = g.item().select("node_id", "name")
    return both.join(names.toDF("item_id", "item"), "item_id").join(names.toDF("other_id", "other"), "other_id")


@query("compatibility_lists", """SELECT i.node_id, coalesce(string_agg(DISTINCT b.name, '; ' ORDER BY b.name), '') AS pairs_with
  FROM item i LEFT JOIN e_pairs_with e ON e.src_id = i.node_id LEFT JOIN item b ON b.node_id = e.dst_id GROUP BY 1""")
def compatibility_lists(g: Graph) -> DataFrame:
    """Names of compatible items as one list; items without any keep an empty one."""
    names = g.item().select(F.col("node_id").alias("dst_id"), F.col("name").alias("other"))
    lists = g.edge("PAIRS_WITH").join(names, "dst_id").groupBy(F.col("src_id").alias("node_id")).agg(F.sort_array(F.collect_set("other")).alias("l"))
    return g.item().select("node_id").join(lists, "node_id", "left").select("node_id", F.coalesce(F.array_join("l", "; "), F.lit("")).alias("pairs_with"))


@query("degree_and_types", """SELECT this_id AS node_id, count(*) AS degree, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS types FROM (
  SELECT src_id AS this_id, rel_type FROM edges WHERE src_label = 'Item' UNION ALL SELECT dst_id, rel_type FROM edges WHERE dst_label = 'Item') GROUP BY 1""")
def degree_and_types(g: Graph) -> DataFrame:
    """Undirected degree and relationship types of every item."""
    end = lambda c: F.struct(F.col(f"{c}_id").alias("id"), F.col(f"{c}_label").alias("label"))
    ends = g.edges().select("rel_type", F.explode(F.array(end("src"), end("dst"))).alias("end")).filter("end.label = 'Item'")
    return ends.groupBy(F.col("end.id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("degree"), F.array_join(F.sort_array(F.collect_set("rel_type")), ",").alias("types")
    )


@query("category_fan_out", """SELECT t.node_id AS term_id, i.node_id AS item_id FROM term t JOIN item i ON lower(t.category) = lower(i.brand)
  UNION ALL SELECT t.node_id, i.node_id FROM (SELECT node_id, 'economy' AS c FROM term WHERE node_id < 3) t JOIN item i ON lower(i.category) = t.c""")
def category_fan_out(g: Graph) -> DataFrame:
    """A term linked to all items of a category: an equi-join on the folded category."""
    item, term = g.item(), g.term()
    one = term.join(item, F.lower(term["category"]) == F.lower(item["brand"])).select(term["node_id"].alias("term_id"), item["node_id"].alias("item_id"))
    named = term.filter("node_id < 3").select(F.col("node_id").alias("term_id"), F.lit("economy").alias("c"))
    two = named.join(item.select(F.col("node_id").alias("item_id"), F.lower("category").alias("c")), "c").select("term_id", "item_id")
    return one.unionByName(two)


@query("brand_reach", """SELECT DISTINCT b, label, id FROM (SELECT src_id AS b, 'Family' AS label, dst_id AS id FROM e_manufactures
  UNION ALL SELECT src_id, 'Item', dst_id FROM e_manufactures_item UNION ALL SELECT dst_id, 'Item', src_id FROM e_produced_by)""")
def brand_reach(g: Graph) -> DataFrame:
    """What hangs on a brand by any of three paths, once each."""
    one = g.edge("MANUFACTURES").select(F.col("src_id").alias("b"), F.lit("Family").alias("label"), F.col("dst_id").alias("id"))
    two = g.edge("MANUFACTURES_ITEM").select(F.col("src_id").alias("b"), F.lit("Item").alias("label"), F.col("dst_id").alias("id"))
    three = g.edge("PRODUCED_BY").select(F.col("dst_id").alias("b"), F.lit("Item").alias("label"), F.col("src_id").alias("id"))
    return one.unionByName(two).unionByName(three).dropDuplicates(["b", "label", "id"])


@query("id_pair", "SELECT a.node_id AS a, b.node_id AS b FROM item a, item b WHERE a.node_id = 7 AND b.node_id = 9")
def id_pair(g: Graph) -> DataFrame:
    """Two nodes named by id: both sides hold one row at most."""
    i = g.item().select("node_id")
    return i.filter("node_id = 7").toDF("a").crossJoin(i.filter("node_id = 9").toDF("b"))


# J14, J15, A22


@query("playlist_state", """SELECT p.node_id, p.url, s.url IS NOT NULL AS is_processed FROM source p
  LEFT JOIN (SELECT url FROM source WHERE source_type = 'F') s ON p.url = s.url""")
def playlist_state(g: Graph) -> DataFrame:
    done = g.source().filter("source_type = 'F'").select("url", F.lit(True).alias("d"))
    return g.source().select("node_id", "url").join(done, "url", "left").select("node_id", "url", F.coalesce("d", F.lit(False)).alias("is_processed"))


@query("playlist_counts", """SELECT count(*) AS total, count(*) FILTER (source_type = 'F') AS processed,
  count(*) FILTER (source_type <> 'F') AS remaining FROM source""")
def playlist_counts(g: Graph) -> DataFrame:
    done = F.col("source_type") == "F"
    return g.source().agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("processed"), F.count_if(~done).alias("remaining"))


@query("new_sources", "SELECT node_id, url FROM source WHERE url NOT IN (SELECT url FROM source WHERE source_type = 'F')")
def new_sources(g: Graph) -> DataFrame:
    done = g.source().filter("source_type = 'F'").select("url")
    return g.source().select("node_id", "url").join(done, "url", "left_anti")
