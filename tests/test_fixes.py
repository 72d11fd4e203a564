"""Fixes that update, merge, delete and relate: chains, circles and results of each fix."""

import random

from cairn.operators import fixes
from cairn.sources.scratch import keeper

EDGE = "src_id long, src_label string, rel_type string, dst_id long, dst_label string"


def test_chains_and_circles_of_merges(spark):
    pairs = [(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 10, 99), (5, 20, 13), (6, 30, 31), (7, 31, 32), (8, 32, 30), (9, 33, 31), (10, 40, 40)]
    got = {r.dup_id: r.keep_id for r in fixes.survivors(spark.createDataFrame(pairs, "seq long, dup_id long, keep_id long"), keeper(spark)).collect()}
    assert got == {10: 13, 11: 13, 12: 13, 20: 13, 31: 30, 32: 30, 33: 30}


def test_a_long_chain_takes_few_rounds(spark):
    n, rounds = 300, []
    keep = keeper(spark)
    rng = random.Random(1)
    ids = list(range(n))
    rng.shuffle(ids)
    out = fixes.survivors(spark.createDataFrame([(i, ids[i], ids[i + 1]) for i in range(n - 1)], "seq long, dup_id long, keep_id long"), lambda df, name: (rounds.append(name), keep(df, name))[1])
    assert {r.keep_id for r in out.select("keep_id").distinct().collect()} == {ids[-1]} and out.count() == n - 1
    assert len(rounds) < 12


def test_merges_against_one_after_the_other(spark):
    rng = random.Random(5)
    pairs = [(i, rng.randrange(120), rng.randrange(120)) for i in range(100)]
    to = {}
    for _, a, b in pairs:
        if a != b:
            to.setdefault(a, b)
    want = {}
    for x in to:
        seen = [x]
        while seen[-1] in to and to[seen[-1]] not in seen:
            seen.append(to[seen[-1]])
        last = seen[-1] if seen[-1] not in to else min(seen[seen.index(to[seen[-1]]) :])
        if last != x:
            want[x] = last
    got = {r.dup_id: r.keep_id for r in fixes.survivors(spark.createDataFrame(pairs, "seq long, dup_id long, keep_id long"), keeper(spark)).collect()}
    assert got == want


def state(spark):
    items = [(1, "Mug", "Zed", "cups", 10.0), (2, "mug", "Zed", "cups", None), (3, "MUG", None, "Cups", 7.0), (4, "Pot", "Yak", "pots", 1.0), (5, "Pan", "Yak", None, 1.0)]
    edges = [
        (1, "Item", "EXTRACTED_FROM", 100, "Source"), (2, "Item", "EXTRACTED_FROM", 100, "Source"), (3, "Item", "EXTRACTED_FROM", 101, "Source"), (2, "Item", "HAS_TIP", 7, "Insight"),
        (3, "Item", "COMPARED_TO", 1, "Item"), (3, "Item", "COMPARED_TO", 4, "Item"), (9, "Brand", "MANUFACTURES_ITEM", 4, "Item"), (4, "Item", "HAS_TIP", 8, "Insight"), (7, "Insight", "RELATES_TO", 5, "Item"), (3, "Brand", "MANUFACTURES_ITEM", 5, "Item"),
    ]
    nodes = {"Item": spark.createDataFrame(items, "node_id long, name string, brand string, category string, weight_grams double"), "Insight": spark.createDataFrame([(7, "a"), (8, "b")], "node_id long, summary string")}
    return fixes.State(nodes, spark.createDataFrame(edges, EDGE))


def test_all_four_kinds_in_one_batch(spark):
    f = [
        (1, "update_field", "Item", 4, "brand", "Yakk", None), (2, "update_field", "Item", 4, "brand", "Yeti", None), (3, "update_field", "Item", 4, "weight_grams", "heavy", None), (4, "update_field", "Item", 77, "brand", "x", None),
        (5, "merge_entities", "Item", 3, None, None, 2), (6, "merge_entities", "Item", 2, None, None, 1), (7, "merge_entities", "Item", 2, None, None, 5), (8, "merge_entities", "Item", 5, None, None, 78),
        (9, "delete_entity", "Item", 5, None, None, None), (10, "delete_entity", "Insight", 8, None, None, None), (11, "delete_entity", "Item", 79, None, None, None),
        (12, "create_relationship", "Insight", 7, None, "CUPS", None), (13, "create_relationship", "Insight", 8, None, "pots", None), (14, "create_relationship", "Insight", 7, None, "none", None), (15, "create_relationship", "Insight", 7, None, "", None),
        (16, "update_field", "Insight", 7, "summary", "new", None), (17, "update_field", "Item", 1, "nothing", "x", None),
    ]
    after, results = fixes.apply_fixes(state(spark), spark.createDataFrame(f, fixes.FIX), keeper(spark))
    assert {r.seq: (r.success, r.touched) for r in results.collect()} == {
        1: (True, 1), 2: (True, 1), 3: (False, 0), 4: (False, 0), 5: (True, 1), 6: (True, 1), 7: (True, 1), 8: (False, 0), 9: (True, 1), 10: (True, 1), 11: (False, 0),
        12: (True, 1), 13: (False, 0), 14: (False, 0), 15: (False, 0), 16: (True, 1), 17: (False, 0),
    }
    assert sorted(tuple(r) for r in after.nodes["Item"].collect()) == [(1, "Mug", "Zed", "cups", 10.0), (4, "Pot", "Yeti", "pots", 1.0)]
    assert [tuple(r) for r in after.nodes["Insight"].collect()] == [(7, "new")]
    # a chain of merges hands its sources and tips on, everything else of the merged nodes goes, as do the edges of deleted ones
    assert sorted(tuple(r) for r in after.edges.collect()) == [
        (1, "Item", "EXTRACTED_FROM", 100, "Source"), (1, "Item", "EXTRACTED_FROM", 101, "Source"), (1, "Item", "HAS_TIP", 7, "Insight"), (9, "Brand", "MANUFACTURES_ITEM", 4, "Item"),
    ]


def test_all_types_may_be_handed_on(spark):
    mapping = spark.createDataFrame([(3, 1), (2, 1)], "dup_id long, keep_id long")
    out = sorted(tuple(r)[0:4] for r in fixes.rewire(state(spark).edges, mapping, "Item", None).collect())
    assert (1, "Item", "COMPARED_TO", 4) in out and (1, "Item", "COMPARED_TO", 1) not in out and (3, "Brand", "MANUFACTURES_ITEM", 5) in out


def test_a_brand_is_assigned_by_name(spark):
    items = spark.createDataFrame([(1, "Therm a Rest NeoAir", None), (2, "Arcteryx", None), (3, "arc'teryx  Beta", None), (4, "Mug", "Old"), (5, "Mug", None)], "node_id long, name string, brand string")
    brands = spark.createDataFrame([(3, "Arc'teryx", "CA")], "node_id long, name string, country string")
    edges = spark.createDataFrame([(3, "Brand", "MANUFACTURES_ITEM", 2, "Item")], EDGE)
    f = [(1, "Therm a Rest NeoAir", "Therm-a-Rest"), (2, "Arcteryx", "Arc'teryx"), (3, "arc'teryx  Beta", "Arc'teryx"), (4, "Mug", "A"), (5, "Mug", "Zed"), (6, "Mug", " ")]
    new_items, new_brands, new_edges = fixes.assign_brands(items, brands, edges, spark.createDataFrame(f, "seq long, name string, brand string"))
    assert sorted(tuple(r) for r in new_items.collect()) == [(1, "NeoAir", "Therm-a-Rest"), (2, "Arcteryx", "Arc'teryx"), (3, "Beta", "Arc'teryx"), (4, "Mug", "Zed"), (5, "Mug", "Zed")]
    names = {r.node_id: r.name for r in new_brands.collect()}
    assert sorted(names.values()) == ["Arc'teryx", "Therm-a-Rest", "Zed"] and len(names) == 3
    assert sorted((names[r.src_id], r.dst_id) for r in new_edges.collect()) == [("Arc'teryx", 2), ("Arc'teryx", 3), ("Therm-a-Rest", 1), ("Zed", 4), ("Zed", 5)]
