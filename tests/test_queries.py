"""Every query of the registry: against its DuckDB SQL, or that it runs and repeats."""

import pytest

from cairn import registry
from tests.compare import rows_of, rows_of_sql

registry.load()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, sf, name):
    got, want = rows_of(registry.QUERIES[name](spark, sf)), rows_of_sql(duck, registry.ORACLE_SQL[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns
    assert rows_of(df) is not None
