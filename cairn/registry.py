"""The registry of named queries, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.sources.views import SQL_VIEWS, Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the graph as a query. sql may use the views by name."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH {SQL_VIEWS.strip()} {sql.strip()}"
        return f

    return add


def load() -> None:
    """Import every module that registers queries."""
    from cairn.functions import catalog, markdown, products, properties  # noqa: F401
    from cairn.operators import aggregates, crawl, duplicates, families, fixes, graph, landed, mutations, quality, queue, research, rich_save, shop_pages, site_patterns, upserts, validation  # noqa: F401
    from cairn.plans import adhoc, exports, presets  # noqa: F401
    from cairn.sources import files, turtle  # noqa: F401
    from cairn.streaming import feed, polling, queue_stream  # noqa: F401
