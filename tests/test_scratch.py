"""Tables of queries are deleted together."""

from pathlib import Path

from cairn.sources import scratch


def test_tables_are_cleared(spark):
    keep = scratch.keeper(spark)
    kept = keep(spark.range(3), "t")
    folder = Path(scratch._MADE[-1].removeprefix("file://"))
    assert kept.count() == 3 and (folder / "t").exists()
    scratch.clear_tables(spark)
    assert not folder.exists() and scratch._MADE == []
