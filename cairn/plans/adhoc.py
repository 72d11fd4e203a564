"""Ad-hoc SQL over the graph's views, for reading only."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from cairn.registry import query
from cairn.sources.views import EDGES, Graph

LABELS = ("item", "brand", "family", "source", "insight", "term", "field_source", "page", "prompt", "work_event")
#: Parsed nodes that write or change a session: commands of every kind, and inserts, which become commands later.
_WRITES = tuple(f"org.apache.spark.sql.catalyst.plans.logical.{kind}" for kind in ("Command", "InsertIntoStatement", "InsertIntoDir"))


def _nodes(plan: JavaObject) -> list[JavaObject]:
    out = [plan]
    for group in (plan.children(), plan.innerChildren()):
        for k in range(group.size()):
            node = group.apply(k)
            out += _nodes(node) if hasattr(node, "innerChildren") else []
    return out


def is_read_only(spark: SparkSession, statement: str) -> bool:
    """Whether Spark parses the text as one statement without a command or an insert anywhere in its plan."""
    session = spark._jsparkSession.sessionState()
    try:
        plan = session.sqlParser().parsePlan(statement.strip().rstrip(";"))
    except ParseException:
        return False
    loader = session.getClass().getClassLoader()
    kinds = [spark._jvm.java.lang.Class.forName(name, False, loader) for name in _WRITES]
    return not any(kind.isInstance(node) for node in _nodes(plan) for kind in kinds)


def view_name(rel: str) -> str:
    """The name of a relationship's view: e_type, or e_label_type for one source label of a type that has several."""
    kind, _, label = rel.lower().partition("/")
    return f"e_{label}_{kind}" if label else f"e_{kind}"


def register_views(g: Graph) -> list[str]:
    """Every label and relationship type as a temporary view, and edges for all relationships; returns the names."""
    frames = {name: getattr(g, name)() for name in LABELS}
    frames |= {view_name(rel): g.edge(rel).select("src_id", "dst_id") for rel in EDGES}
    frames["edges"] = g.edges()
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return list(frames)


def run_sql(g: Graph, statement: str) -> DataFrame:
    if not is_read_only(g.spark, statement):
        raise ValueError("only statements that read are allowed here")
    register_views(g)
    return g.spark.sql(statement)


_BY_COUNTRY = """SELECT b.country, count(DISTINCT e.dst_id) AS items, avg(i.price_usd) AS mean_price
  FROM brand b JOIN e_manufactures_item e ON e.src_id = b.node_id JOIN item i ON i.node_id = e.dst_id GROUP BY b.country"""


@query("sql_items_by_country", _BY_COUNTRY.replace("avg(i.price_usd)", "round(avg(i.price_usd), 6)"))
def sql_items_by_country(g: Graph) -> DataFrame:
    return run_sql(g, _BY_COUNTRY.replace("avg(i.price_usd)", "round(avg(i.price_usd), 6)"))


_CUBE = "SELECT category, brand, count(*) AS n FROM item GROUP BY CUBE (category, brand)"
_DEGREES = "SELECT rel_type, src_label, dst_label, count(*) AS n, count(DISTINCT src_id) AS sources FROM edges GROUP BY rel_type, src_label, dst_label"


@query("sql_cube", _CUBE)
def sql_cube(g: Graph) -> DataFrame:
    return run_sql(g, _CUBE)


@query("sql_degrees", _DEGREES)
def sql_degrees(g: Graph) -> DataFrame:
    return run_sql(g, _DEGREES)
