"""The product-knowledge graph as DataFrames over the driver's tables.

One method a node label, edge(rel) for one relationship type: a query reads only the columns
and tables it names. Every node has a long node_id kept with the data; nothing is numbered at
read time. SQL_VIEWS says the same in DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = ["src_id", "src_label", "rel_type", "dst_id", "dst_label"]
#: Rows of a relationship that one task makes distinct, where that asks for more tasks than a shuffle has.
SLICE = 1 << 20


class Graph:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._slices: dict[str, int] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def slices(self, name: str) -> int:
        """How many tasks the rows of a table are dealt to, SLICE each; 0 if a shuffle has as many."""
        if name not in self._slices:
            n = -(-self.table(name).count() // SLICE)
            self._slices[name] = n if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else 0
        return self._slices[name]

    def item(self) -> DataFrame:
        """Items: (name, brand) is the natural key; some brands, categories, weights and prices are missing."""
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("node_id"), item_name().alias("name"),
            F.when(k % 11 != 0, F.col("p_brand")).alias("brand"),
            F.when(k % 13 == 0, None).when(k % 17 == 0, "").when(k % 19 == 0, "unknown").otherwise(F.col("p_type")).alias("category"),
            F.when(k % 7 != 0, F.col("p_size") * 10).alias("weight_grams"),
            F.when(k % 5 != 0, F.col("p_retailprice")).alias("price_usd"),
            F.when(k % 3 == 2, F.concat(F.lit("https://img.example.com/"), k.cast("string"))).when(k % 3 == 1, "").alias("image_url"),
            F.when(k % 4 != 0, F.concat(F.lit("https://shop.example.com/p/"), k.cast("string"))).alias("product_url"),
            F.when(k % 6 != 0, F.concat(F.lit("A "), F.col("p_name"))).alias("description"),
        )

    def brand(self) -> DataFrame:
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        return s.select(
            F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"),
            F.lit(None).cast("string").alias("website"), F.col("n_name").alias("country"),
        )

    def family(self) -> DataFrame:
        parts = self.table("part").select("p_partkey", "p_type", "p_brand", F.element_at(F.split("p_name", " "), -1).alias("name"))
        return parts.groupBy("name", "p_brand").agg(F.min("p_partkey").alias("node_id"), F.min("p_type").alias("category")).select(
            "node_id", "name", F.col("p_brand").alias("brand"), "category",
            F.when(F.col("node_id") % 2 == 0, F.concat_ws(" ", "p_brand", "name")).alias("description"),
        )

    def source(self) -> DataFrame:
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items_found"))
        return self.table("orders").join(lines, "o_orderkey", "left").select(
            F.col("o_orderkey").alias("node_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("url"),
            F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("source_type"),
            F.col("o_orderdate").alias("processed_at"), F.coalesce("items_found", F.lit(0)).alias("items_found"),
        )

    def insight(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("node_id"), F.element_at(F.split("text", "\n", 2), 1).alias("summary"), F.col("text").alias("content"),
            F.col("lang").alias("category"),
        )

    def term(self) -> DataFrame:
        n = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return n.select(
            F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("term"), F.col("r_name").alias("definition"),
            F.when(F.col("n_regionkey") != 0, F.col("r_name")).alias("category"),
            F.when(F.col("n_nationkey") % 3 != 0, F.array(F.lower("n_name"), F.concat(F.lit("alias "), F.lower("n_name")))).alias("aliases"),
        )

    def field_source(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("field_name"),
            F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source_url"),
            F.round(F.col("l_discount") * 10, 2).alias("confidence"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"),
        )

    def page(self) -> DataFrame:
        return self.table("pages").select(
            "page_id", "url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
            F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"), "html",
        )

    def prompt(self) -> DataFrame:
        return self.table("conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("message"))

    def work_event(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("user_id").alias("entity"), F.col("event_type").alias("status"), "ts", "value")

    def edge(self, rel: str, *, repeated: bool = False) -> DataFrame:
        """src_id, src_label, rel_type, dst_id, dst_label of one relationship type; TYPE/Label is the part of
        a type that has several source labels. repeated: some may come twice, for what makes them distinct later."""
        src, dst, make = EDGES[rel]
        pairs = make(self).select("src_id", "dst_id")
        if rel not in ONCE and not repeated:
            pairs = dealt(pairs, self.slices("lineitem")).distinct()
        return pairs.select("src_id", F.lit(src).alias("src_label"), F.lit(rel.split("/")[0]).alias("rel_type"), "dst_id", F.lit(dst).alias("dst_label"))

    def ends(self, rel: str, end: str) -> DataFrame:
        """The nodes at one end (src_id or dst_id) of a relationship type, once each; its pairs are not made distinct for that."""
        return EDGES[rel][2](self).select(end).distinct()

    def edges(self) -> DataFrame:
        """All relationships in one relation."""
        out = None
        for rel in EDGES:
            out = self.edge(rel) if out is None else out.unionByName(self.edge(rel))
        return out


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df by keys (all columns if none are given) in so many parts, for an operation on these keys; 0: as it is."""
    return df.repartition(parts, *(keys or df.columns)) if parts else df


def item_name() -> Column:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    return (
        F.when(k % 4 == 0, F.concat_ws(" ", "p_name", size)).when(k % 12 == 1, F.concat("p_name", F.lit(" "), size, F.lit("0L")))
        .when(k % 12 == 2, F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.col("p_name"))
    )


@cache
def _family_of() -> Callable[[Graph], DataFrame]:
    def pairs(g: Graph) -> DataFrame:
        parts = g.table("part").select("p_partkey", F.col("p_brand").alias("brand"), F.element_at(F.split("p_name", " "), -1).alias("name"))
        return parts.join(g.family().select(F.col("node_id").alias("family_id"), "name", "brand"), ["name", "brand"])

    return pairs


def _members(cond: str, *, reverse: bool = False) -> Callable[[Graph], DataFrame]:
    item, family = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
    return lambda g: _family_of()(g).filter(cond).select(F.col("p_partkey").alias(item), F.col("family_id").alias(family))


def _insight_edges(cond: str, insight: str, item: str) -> Callable[[Graph], DataFrame]:
    def pairs(g: Graph) -> DataFrame:
        n = g.table("part").agg(F.count(F.lit(1)).alias("n"))
        return g.table("documents").filter(cond).select("doc_id").crossJoin(F.broadcast(n)).select(
            F.col("doc_id").alias(insight), (F.col("doc_id") % F.col("n")).alias(item)
        )

    return pairs


#: Relationship type -> source label, target label, pairs. The one-row count is the only broadcast.
EDGES: dict[str, tuple[str, str, Callable[[Graph], DataFrame]]] = {
    "MANUFACTURES_ITEM": ("Brand", "Item", lambda g: g.table("lineitem").select(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id")).filter("dst_id % 3 <> 0 AND src_id % 10 <> 0")),
    "EXTRACTED_FROM": ("Item", "Source", lambda g: g.table("lineitem").select(F.col("l_partkey").alias("src_id"), F.col("l_orderkey").alias("dst_id"))),
    "HAS_TIP": ("Item", "Insight", _insight_edges("doc_id % 4 <> 0", "dst_id", "src_id")),
    "RELATES_TO": ("Insight", "Item", _insight_edges("doc_id % 8 = 0", "src_id", "dst_id")),
    "VARIANT_OF": ("Item", "Family", _members("p_partkey % 2 = 0")),
    "HAS_VARIANT": ("Family", "Item", _members("p_partkey % 6 = 0", reverse=True)),
    "MANUFACTURES": ("Brand", "Family", lambda g: g.table("lineitem").filter("l_partkey % 4 = 0 AND l_suppkey % 5 <> 0").select(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("p_partkey")).join(_family_of()(g).hint("shuffle_hash"), "p_partkey").select("src_id", F.col("family_id").alias("dst_id"))),
    "PRODUCED_BY": ("Item", "Brand", lambda g: g.table("part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("src_id"), (F.col("p_partkey") % 10).alias("dst_id"))),
    "PRODUCED_BY/Family": ("Family", "Brand", lambda g: g.family().filter("node_id % 4 = 1").select(F.col("node_id").alias("src_id"), (F.col("node_id") % 10).alias("dst_id"))),
    "COMPARED_TO": ("Item", "Item", lambda g: g.table("part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("src_id"), (F.col("p_partkey") + 1).alias("dst_id"))),
    "PAIRS_WITH": ("Item", "Item", lambda g: g.table("part").filter("p_partkey % 7 = 0").select(F.col("p_partkey").alias("src_id"), (F.col("p_partkey") + 2).alias("dst_id"))),
    "USES_TERM": ("Item", "Term", lambda g: g.table("part").filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("src_id"), (F.col("p_partkey") % 20).alias("dst_id"))),
}

#: Relationships whose pairs have the key of a table at one end, so that none comes twice.
ONCE = frozenset(EDGES) - {"MANUFACTURES_ITEM", "EXTRACTED_FROM", "MANUFACTURES"}

_NAME = "CASE WHEN p_partkey % 4 = 0 THEN p_name || ' ' || p_size WHEN p_partkey % 12 = 1 THEN p_name || ' ' || p_size || '0L' WHEN p_partkey % 12 = 2 THEN p_brand || ' ' || p_name ELSE p_name END"
_LAST = "list_extract(string_split(p_name, ' '), -1)"

#: The same views in DuckDB SQL, as common table expressions.
SQL_VIEWS = f"""
item AS (SELECT p_partkey AS node_id, {_NAME} AS name, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS brand,
  CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'unknown' ELSE p_type END AS category,
  CASE WHEN p_partkey % 7 <> 0 THEN p_size * 10 END AS weight_grams, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price_usd,
  CASE WHEN p_partkey % 3 = 2 THEN 'https://img.example.com/' || p_partkey WHEN p_partkey % 3 = 1 THEN '' END AS image_url,
  CASE WHEN p_partkey % 4 <> 0 THEN 'https://shop.example.com/p/' || p_partkey END AS product_url,
  CASE WHEN p_partkey % 6 <> 0 THEN 'A ' || p_name END AS description FROM part),
brand AS (SELECT s_suppkey AS node_id, s_name AS name, CAST(NULL AS VARCHAR) AS website, n_name AS country
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
family AS (SELECT node_id, name, brand, category, CASE WHEN node_id % 2 = 0 THEN brand || ' ' || name END AS description FROM (
  SELECT {_LAST} AS name, p_brand AS brand, min(p_partkey) AS node_id, min(p_type) AS category FROM part GROUP BY ALL)),
source AS (SELECT o_orderkey AS node_id, 'o' || o_orderkey AS url, o_orderpriority AS title, o_orderstatus AS source_type,
  o_orderdate AS processed_at, coalesce(n, 0) AS items_found
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
insight AS (SELECT doc_id AS node_id, split_part(text, chr(10), 1) AS summary, text AS content, lang AS category FROM documents),
term AS (SELECT CAST(n_nationkey AS BIGINT) AS node_id, n_name AS term, r_name AS definition,
  CASE WHEN n_regionkey <> 0 THEN r_name END AS category,
  CASE WHEN n_nationkey % 3 <> 0 THEN [lower(n_name), 'alias ' || lower(n_name)] END AS aliases
  FROM nation JOIN region ON n_regionkey = r_regionkey),
field_source AS (SELECT l_partkey AS item_id, l_returnflag AS field_name, 'o' || l_orderkey AS source_url,
  round(l_discount * 10, 2) AS confidence, l_orderkey AS seq, l_linenumber AS line FROM lineitem),
page AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, html FROM pages),
prompt AS (SELECT conv_id, turn, text AS message FROM conversations WHERE role = 'user'),
work_event AS (SELECT event_id, user_id AS entity, event_type AS status, ts, value FROM events),
member AS (SELECT p_partkey, f.node_id AS family_id FROM part JOIN family f ON f.name = {_LAST} AND f.brand = p_brand),
parts_n AS (SELECT count(*) AS n FROM part),
e_manufactures_item AS (SELECT DISTINCT l_suppkey AS src_id, l_partkey AS dst_id FROM lineitem WHERE l_partkey % 3 <> 0 AND l_suppkey % 10 <> 0),
e_extracted_from AS (SELECT DISTINCT l_partkey AS src_id, l_orderkey AS dst_id FROM lineitem),
e_has_tip AS (SELECT DISTINCT doc_id % n AS src_id, doc_id AS dst_id FROM documents, parts_n WHERE doc_id % 4 <> 0),
e_relates_to AS (SELECT DISTINCT doc_id AS src_id, doc_id % n AS dst_id FROM documents, parts_n WHERE doc_id % 8 = 0),
e_variant_of AS (SELECT DISTINCT p_partkey AS src_id, family_id AS dst_id FROM member WHERE p_partkey % 2 = 0),
e_has_variant AS (SELECT DISTINCT family_id AS src_id, p_partkey AS dst_id FROM member WHERE p_partkey % 6 = 0),
e_manufactures AS (SELECT DISTINCT l_suppkey AS src_id, family_id AS dst_id FROM lineitem JOIN member ON l_partkey = p_partkey
  WHERE l_partkey % 4 = 0 AND l_suppkey % 5 <> 0),
e_produced_by AS (SELECT p_partkey AS src_id, p_partkey % 10 AS dst_id FROM part WHERE p_partkey % 50 = 0),
e_family_produced_by AS (SELECT node_id AS src_id, node_id % 10 AS dst_id FROM family WHERE node_id % 4 = 1),
e_compared_to AS (SELECT p_partkey AS src_id, p_partkey + 1 AS dst_id FROM part WHERE p_partkey % 3 = 0),
e_pairs_with AS (SELECT p_partkey AS src_id, p_partkey + 2 AS dst_id FROM part WHERE p_partkey % 7 = 0),
e_uses_term AS (SELECT p_partkey AS src_id, p_partkey % 20 AS dst_id FROM part WHERE p_partkey % 20 = 0),
edges AS (SELECT *, 'Brand' AS src_label, 'MANUFACTURES_ITEM' AS rel_type, 'Item' AS dst_label FROM e_manufactures_item
  UNION ALL SELECT *, 'Item', 'EXTRACTED_FROM', 'Source' FROM e_extracted_from
  UNION ALL SELECT *, 'Item', 'HAS_TIP', 'Insight' FROM e_has_tip
  UNION ALL SELECT *, 'Insight', 'RELATES_TO', 'Item' FROM e_relates_to
  UNION ALL SELECT *, 'Item', 'VARIANT_OF', 'Family' FROM e_variant_of
  UNION ALL SELECT *, 'Family', 'HAS_VARIANT', 'Item' FROM e_has_variant
  UNION ALL SELECT *, 'Brand', 'MANUFACTURES', 'Family' FROM e_manufactures
  UNION ALL SELECT *, 'Item', 'PRODUCED_BY', 'Brand' FROM e_produced_by
  UNION ALL SELECT *, 'Family', 'PRODUCED_BY', 'Brand' FROM e_family_produced_by
  UNION ALL SELECT *, 'Item', 'COMPARED_TO', 'Item' FROM e_compared_to
  UNION ALL SELECT *, 'Item', 'PAIRS_WITH', 'Item' FROM e_pairs_with
  UNION ALL SELECT *, 'Item', 'USES_TERM', 'Term' FROM e_uses_term)
"""
