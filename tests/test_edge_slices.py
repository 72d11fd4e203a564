"""Relationships of large tables: what one task makes distinct is bounded, and nothing else holds their pairs."""

from cairn.operators import fixes
from cairn.sources import views
from tests.compare import rows_of
from tests.test_copies import plan


def test_pairs_are_dealt_to_tasks_by_the_rows_of_their_table(spark, sf, monkeypatch):
    want = rows_of(views.Graph(spark, sf).edge("EXTRACTED_FROM"))
    monkeypatch.setattr(views, "SLICE", 100)
    g = views.Graph(spark, sf)
    out = g.edge("EXTRACTED_FROM")
    assert out.rdd.getNumPartitions() == -(-g.table("lineitem").count() // 100) > 4
    assert rows_of(out) == want


def test_ends_are_those_of_the_edges(spark, sf):
    g = views.Graph(spark, sf)
    for rel, end in (("MANUFACTURES_ITEM", "src_id"), ("EXTRACTED_FROM", "dst_id"), ("MANUFACTURES", "src_id")):
        assert rows_of(g.ends(rel, end)) == rows_of(g.edge(rel).select(end).distinct())
    assert "l_partkey" not in plan(g.ends("EXTRACTED_FROM", "dst_id"))


def test_edges_of_deleted_brands_are_counted_before_brands_meet(spark, sf):
    out = plan(fixes.fix_deleted_brands(views.Graph(spark, sf)))
    assert out.index("LeftOuter") < out.index("partial_count(1)") < out.index("Union")
    assert "LeftAnti" not in out[out.index("Union") : out.index("l_partkey")]


def test_edges_run_past_the_mapping_and_are_made_distinct_in_parts(spark):
    from tests.test_fixes import EDGE

    rows = [(i % 9, "Item", "EXTRACTED_FROM", i % 4, "Source") for i in range(200)] + [(i, "Item", "PAIRS_WITH", i + 1, "Item") for i in range(9)] * 2
    edges, mapping = spark.createDataFrame(rows, EDGE), spark.createDataFrame([(3, 1), (2, 1)], "dup_id long, keep_id long")
    out = fixes.rewire(edges, mapping, "Item", parts=9)
    want = {(1 if a in (2, 3) else a, t, c) for a, _, t, c, _ in rows if t == "EXTRACTED_FROM" or not {a, c} & {2, 3}}
    got = [(r.src_id, r.rel_type, r.dst_id) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert out.rdd.getNumPartitions() == 9 and "SortMergeJoin" not in plan(out) and "ShuffledHashJoin" in plan(out)


def test_degrees_of_dealt_edges(spark, sf, monkeypatch):
    from cairn.plans import adhoc

    want = rows_of(adhoc.sql_degrees(views.Graph(spark, sf)))
    monkeypatch.setattr(views, "SLICE", 1000)
    g = views.Graph(spark, sf)
    n = -(-g.table("lineitem").count() // 1000)
    assert rows_of(adhoc.sql_degrees(g)) == want
    assert n > 4 and plan(adhoc.sql_degrees(g)).count(f", {n}), REPARTITION_BY_NUM") == 3
