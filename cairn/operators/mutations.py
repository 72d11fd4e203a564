"""Keyed upserts, links, merges and deletes as functions from one version of a table to the next.

Nothing is changed in place: a caller writes the result as a new version and then points to it.
Changes are keyed, so a batch that is applied twice leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.aggregates import first_by
from cairn.registry import query
from cairn.sources.views import Graph


def upsert(old: DataFrame, new: DataFrame, key: list[str], only_on_create: list[str] = [], ignore_empty: bool = False) -> DataFrame:  # noqa: B006
    """old with new by key: a given value wins, none never overwrites, some columns are set on creation only.

    new holds one row per key at most (see last_of). action tells created, updated or kept.
    """
    values = [c for c in old.columns if c not in key]
    n = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"_n_{c}") for c in values if c in new.columns], F.lit(True).alias("_new"))
    o = old.withColumn("_old", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    both = o.join(n, on, "full")
    was = F.col("_old").isNotNull()

    def value(c: str):
        if c not in new.columns:
            return F.col(c)
        given = F.nullif(F.col(f"_n_{c}"), F.lit("")) if ignore_empty and dict(new.dtypes)[c] == "string" else F.col(f"_n_{c}")
        if c in only_on_create:
            return F.when(was, F.col(c)).otherwise(given).alias(c)
        return F.coalesce(given, F.col(c)).alias(c)

    keys = [F.when(was, F.col(k)).otherwise(F.col(f"_k{i}")).alias(k) for i, k in enumerate(key)]
    action = F.when(~was, "created").when(F.col("_new").isNotNull(), "updated").otherwise("kept")
    return both.select(*keys, *[value(c) for c in values], action.alias("action"))


def last_of(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key."""
    return first_by(changes, key, [F.desc(c) for c in order])


def link(edges: DataFrame, new: DataFrame, key: list[str] = ["src_id", "rel_type", "dst_id"]) -> DataFrame:  # noqa: B006
    """edges with new ones, one row per key; an edge that is there stays as it is."""
    tagged = edges.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    return first_by(tagged, key, ["_o"]).drop("_o")


def link_existing(edges: DataFrame, new: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """As link, for those new edges both of whose ends exist."""
    ok = new.join(sources.select(F.col("node_id").alias("src_id")), "src_id", "left_semi").join(targets.select(F.col("node_id").alias("dst_id")), "dst_id", "left_semi")
    return link(edges, ok.select(*edges.columns))


def merge_nodes(nodes: DataFrame, edges: DataFrame, mapping: DataFrame, rel_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Duplicates (dup_id -> keep_id) go; their edges of rel_types (default all) move, the others go."""
    left = nodes.join(mapping.select(F.col("dup_id").alias("node_id")), "node_id", "left_anti")
    src, dst = mapping.toDF("src_id", "_s"), mapping.toDF("dst_id", "_d")
    moved = edges.join(src, "src_id", "left").join(dst, "dst_id", "left")
    touched = F.col("_s").isNotNull() | F.col("_d").isNotNull()
    if rel_types is not None:
        moved = moved.filter(~touched | F.col("rel_type").isin(*rel_types))
    moved = moved.withColumn("src_id", F.coalesce("_s", "src_id")).withColumn("dst_id", F.coalesce("_d", "dst_id")).drop("_s", "_d")
    return left, moved.filter("src_id <> dst_id").dropDuplicates(["src_id", "rel_type", "dst_id"]).select(*edges.columns)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with all their edges."""
    ids = gone.select("node_id")
    e = edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_anti").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_anti")
    return nodes.join(ids, "node_id", "left_anti"), e.select(*edges.columns)


def _changes(g: Graph) -> DataFrame:
    k = F.col("node_id")
    rows = g.item().filter("brand IS NOT NULL AND node_id % 9 = 0").select(
        F.when(k % 2 == 0, F.concat("name", F.lit(" II"))).otherwise(F.col("name")).alias("name"), "brand",
        F.when(k % 4 == 0, F.lit(123)).alias("weight_grams"), F.lit("fresh").alias("category"), k.alias("seq"),
    )
    return last_of(rows, ["name", "brand"], ["seq"]).drop("seq")


def _catalogue(g: Graph) -> DataFrame:
    rows = g.item().filter("brand IS NOT NULL").select("name", "brand", "weight_grams", "category", "node_id")
    return first_by(rows, ["name", "brand"], ["node_id"]).drop("node_id")


_UP = """old AS (SELECT name, brand, weight_grams, category FROM (SELECT *, row_number() OVER (PARTITION BY name, brand ORDER BY node_id) AS r FROM item WHERE brand IS NOT NULL) WHERE r = 1),
new AS (SELECT name, brand, weight_grams, category FROM (SELECT *, row_number() OVER (PARTITION BY name, brand ORDER BY seq DESC) AS r FROM (
  SELECT CASE WHEN node_id % 2 = 0 THEN name || ' II' ELSE name END AS name, brand, CASE WHEN node_id % 4 = 0 THEN 123 END AS weight_grams, 'fresh' AS category, node_id AS seq
  FROM item WHERE brand IS NOT NULL AND node_id % 9 = 0)) WHERE r = 1)"""


@query("mut_upsert_items", f""", {_UP} SELECT coalesce(o.name, n.name) AS name, coalesce(o.brand, n.brand) AS brand, coalesce(n.weight_grams, o.weight_grams) AS weight_grams,
  CASE WHEN o.name IS NOT NULL THEN o.category ELSE n.category END AS category,
  CASE WHEN o.name IS NULL THEN 'created' WHEN n.name IS NOT NULL THEN 'updated' ELSE 'kept' END AS action FROM old o FULL JOIN new n ON o.name = n.name AND o.brand = n.brand""")
def mut_upsert_items(g: Graph) -> DataFrame:
    """Items by (name, brand): none never overwrites and the category is set on creation only."""
    return upsert(_catalogue(g), _changes(g), ["name", "brand"], only_on_create=["category"])


@query("mut_update_items", f""", {_UP} SELECT o.name, o.brand, coalesce(n.weight_grams, o.weight_grams) AS weight_grams, coalesce(nullif(n.category, ''), o.category) AS category
  FROM old o JOIN new n ON o.name = n.name AND o.brand = n.brand""")
def mut_update_items(g: Graph) -> DataFrame:
    """Partial updates of existing items; here the category may change, and unknown keys are left out."""
    done = upsert(_catalogue(g), _changes(g), ["name", "brand"], ignore_empty=True)
    return done.filter("action = 'updated'").drop("action")


@query("mut_import_counts", f""", {_UP} SELECT count(*) FILTER (o.name IS NULL) AS created, count(*) FILTER (o.name IS NOT NULL) AS updated FROM new n LEFT JOIN old o ON o.name = n.name AND o.brand = n.brand""")
def mut_import_counts(g: Graph) -> DataFrame:
    done = upsert(_catalogue(g), _changes(g), ["name", "brand"])
    return done.agg(F.count_if(F.col("action") == "created").alias("created"), F.count_if(F.col("action") == "updated").alias("updated"))


@query("mut_provenance", """SELECT item_id, field_name, source_url, confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id, field_name ORDER BY confidence DESC, seq, line) AS r FROM field_source) WHERE r = 1""")
def mut_provenance(g: Graph) -> DataFrame:
    """Field sources by (item, field): replayed in order, a later source replaces only with strictly more confidence."""
    return first_by(g.field_source(), ["item_id", "field_name"], [F.desc("confidence"), "seq", "line"]).select("item_id", "field_name", "source_url", "confidence")


@query("mut_link_edges", """SELECT DISTINCT src_id, rel_type, dst_id FROM (SELECT src_id, 'PAIRS_WITH' AS rel_type, dst_id FROM e_pairs_with
  UNION ALL SELECT src_id, 'PAIRS_WITH', dst_id FROM e_compared_to WHERE dst_id IN (SELECT node_id FROM item))""")
def mut_link_edges(g: Graph) -> DataFrame:
    old = g.edge("PAIRS_WITH")
    new = g.edge("COMPARED_TO").withColumn("rel_type", F.lit("PAIRS_WITH"))
    return link_existing(old, new, g.item(), g.item()).select("src_id", "rel_type", "dst_id")


@query("mut_append_opinions", """SELECT event_id, entity, status AS opinion, status IN ('view', 'click', 'purchase') AS valid FROM work_event""")
def mut_append_opinions(g: Graph) -> DataFrame:
    """Append-only rows, valid and rejected ones marked."""
    return g.work_event().select("event_id", "entity", F.col("status").alias("opinion"), F.col("status").isin("view", "click", "purchase").alias("valid"))


@query("mut_set_attribute", "SELECT node_id, CASE WHEN node_id % 2 = 0 THEN 'b' ELSE 'c' END AS color, name FROM item")
def mut_set_attribute(g: Graph) -> DataFrame:
    """A dynamic attribute set in a property map; an older value of it goes."""
    attrs = F.create_map(F.lit("color"), F.lit("a"), F.lit("name"), F.col("name"))
    value = F.when(F.col("node_id") % 2 == 0, "b").otherwise("c")
    new = F.map_concat(F.map_filter(attrs, lambda k, v: k != "color"), F.create_map(F.lit("color"), value))
    return g.item().select("node_id", new["color"].alias("color"), new["name"].alias("name"))


_MAP = "dup AS (SELECT node_id AS dup_id, keep_id FROM (SELECT node_id, min(node_id) OVER (PARTITION BY name) AS keep_id FROM item) WHERE node_id <> keep_id)"


def _mapping(g: Graph) -> DataFrame:
    least = g.item().groupBy("name").agg(F.min("node_id").alias("keep_id"))
    return g.item().join(least, "name").filter("node_id <> keep_id").select(F.col("node_id").alias("dup_id"), "keep_id")


@query("mut_merge_edges", f""", {_MAP} SELECT DISTINCT src_id, rel_type, dst_id FROM (SELECT coalesce(a.keep_id, e.src_id) AS src_id, 'COMPARED_TO' AS rel_type, coalesce(b.keep_id, e.dst_id) AS dst_id
  FROM e_compared_to e LEFT JOIN dup a ON a.dup_id = e.src_id LEFT JOIN dup b ON b.dup_id = e.dst_id) WHERE src_id <> dst_id""")
def mut_merge_edges(g: Graph) -> DataFrame:
    """Edges after all items of one name are merged into the first."""
    return merge_nodes(g.item(), g.edge("COMPARED_TO"), _mapping(g))[1].select("src_id", "rel_type", "dst_id")


@query("mut_merge_nodes", f""", {_MAP} SELECT node_id, name FROM item WHERE node_id NOT IN (SELECT dup_id FROM dup)""")
def mut_merge_nodes(g: Graph) -> DataFrame:
    return merge_nodes(g.item(), g.edge("COMPARED_TO"), _mapping(g))[0].select("node_id", "name")


@query("mut_delete_edges", "SELECT src_id, dst_id FROM e_compared_to WHERE src_id NOT IN (SELECT node_id FROM item WHERE category IS NULL) AND dst_id NOT IN (SELECT node_id FROM item WHERE category IS NULL)")
def mut_delete_edges(g: Graph) -> DataFrame:
    return delete_nodes(g.item(), g.edge("COMPARED_TO"), g.item().filter("category IS NULL"))[1].select("src_id", "dst_id")


@query("mut_brand_rename", "SELECT node_id, CASE WHEN brand = 'Brand#17' THEN 'Brand 17' ELSE brand END AS brand FROM item")
def mut_brand_rename(g: Graph) -> DataFrame:
    return g.item().select("node_id", F.when(F.col("brand") == "Brand#17", "Brand 17").otherwise(F.col("brand")).alias("brand"))


@query("mut_soft_delete", "SELECT node_id, CASE WHEN node_id % 31 = 0 THEN TIMESTAMP '2026-01-01 00:00:00' END IS NOT NULL AS deleted FROM item WHERE node_id % 31 = 0 OR category IS NOT NULL")
def mut_soft_delete(g: Graph) -> DataFrame:
    """Soft deletion marks; items without a category that are not marked are purged."""
    marked = g.item().withColumn("deleted_at", F.when(F.col("node_id") % 31 == 0, F.lit("2026-01-01 00:00:00").cast("timestamp")))
    return marked.filter("deleted_at IS NOT NULL OR category IS NOT NULL").select("node_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("mut_fill_blanks", """SELECT name, arg_min(nullif(image_url, ''), node_id) FILTER (nullif(image_url, '') IS NOT NULL) AS image_url,
  arg_min(weight_grams, node_id) FILTER (weight_grams IS NOT NULL) AS weight_grams FROM item GROUP BY name""")
def mut_fill_blanks(g: Graph) -> DataFrame:
    """Each property of a merged name: the first that is filled, in id order."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("node_id")))
    rows = g.item().select("name", "node_id", F.nullif("image_url", F.lit("")).alias("image_url"), "weight_grams")
    return rows.groupBy("name").agg(first("image_url").alias("image_url"), first("weight_grams").alias("weight_grams"))


@query("mut_new_fields", """SELECT node_id, CASE WHEN weight_grams IS NULL THEN round((node_id % 40) * 28.35::DOUBLE, 6) END AS weight_found, CASE WHEN price_usd IS NULL THEN 'price' END AS price_field
  FROM item WHERE weight_grams IS NULL OR price_usd IS NULL""")
def mut_new_fields(g: Graph) -> DataFrame:
    """What an extraction adds: fields found that the item lacks, ounces as grams."""
    k = F.col("node_id")
    rows = g.item().filter("weight_grams IS NULL OR price_usd IS NULL")
    return rows.select(
        "node_id", F.when(F.col("weight_grams").isNull(), F.round((k % 40) * F.lit(28.35), 6)).alias("weight_found"),
        F.when(F.col("price_usd").isNull(), F.lit("price")).alias("price_field"),
    )
