"""Ad-hoc statements: every view has a name and rows, and nothing but reading passes."""

import pytest

from cairn.plans.adhoc import is_read_only, register_views, run_sql
from cairn.sources.views import EDGES, Graph

READS = [
    "SELECT 1", "SELECT createdAt, 'drop table x' FROM t OFFSET 2", "with a as (select 1) select * from a;", "select 'drop table x; insert into y' AS s -- delete from z", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "VALUES (1), (2)",
    "FROM item SELECT name", "(SELECT 1) UNION ALL (SELECT 2);", "SELECT * FROM item WHERE node_id IN (SELECT dst_id FROM e_has_variant)",
]
WRITES = [
    "INSERT INTO item SELECT * FROM item", "WITH a AS (SELECT 1 AS x) INSERT INTO b SELECT * FROM a", "DROP TABLE item", "CREATE TABLE t AS SELECT 1 AS x",
    "CREATE OR REPLACE TEMP VIEW item AS SELECT 1", "DELETE FROM item", "UPDATE item SET name = 'x'", "MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN DELETE",
    "SET spark.sql.shuffle.partitions=1", "TRUNCATE TABLE item", "SELECT 1; SELECT 2", "not sql at all (", "FROM item INSERT INTO b SELECT *", "",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1", "CACHE TABLE item", "REFRESH TABLE item",
]


@pytest.mark.parametrize("statement", READS)
def test_reads_pass(spark, statement):
    assert is_read_only(spark, statement)


@pytest.mark.parametrize("statement", WRITES)
def test_writes_do_not(spark, sf, statement):
    assert not is_read_only(spark, statement)
    with pytest.raises(ValueError):
        run_sql(Graph(spark, sf), statement)


def test_every_view_answers(spark, sf):
    names = register_views(Graph(spark, sf))
    assert len(set(names)) == len(names) and len(names) == 11 + len(EDGES)
    for name in names:
        assert spark.sql(f"SELECT * FROM {name} LIMIT 1").collect() is not None
    assert "e_family_produced_by" in names and "e_produced_by" in names
