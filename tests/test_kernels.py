"""Golden vectors of the column kernels, and small hand-written graphs."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import fuzzy, text, units, urls
from cairn.operators import duplicates, graph, mutations, quality
from cairn.sources.scratch import keeper


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], ", ".join(f"{k} string" for k in values) or "x int")
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("name, want", [
    ("Lone Peak 8", ("Lone Peak", "8", "version_number")), ("Exos 55", ("Exos", "55", "version_number")), ("Flash 055", ("Flash", "055", "size_number")),
    ("Nano Air 20g", ("Nano Air", "20g", "weight_spec")), ("Ultralight Bed 25°", ("Ultralight Bed", "25°", "temperature")),
    ("X Ultra 4 GTX", ("X Ultra", "4 GTX", "model_suffix")), ("Plain", ("Plain", "", "none")),
])
def test_variants(spark, name, want):
    assert tuple(one(spark, text.variant_of("n"), n=name)) == want


@pytest.mark.parametrize("name, brand, rest, confidence", [
    ("Zpacks Arc Blast", "Zpacks", "Arc Blast", 0.98), ("Durston X-Mid", "Durston Gear", "X-Mid", 0.85 + 0.13 / 2), ("Plain Tent", "Osprey", None, None), ("Tent", None, None, None),
])
def test_brand_removal(spark, name, brand, rest, confidence):
    got = one(spark, text.brand_removal("n", "b"), n=name, b=brand)
    assert (got is None) == (rest is None)
    assert got is None or (got.rest == rest and abs(got.confidence - confidence) < 1e-9)


def test_text(spark):
    assert one(spark, text.slugify("n"), n="Arc'teryx  Gear") == "arcteryx-gear" and one(spark, text.slugify("n"), n="") == "unknown"
    assert one(spark, text.category_of("n"), n="fuel for the tent") == "stove"
    assert one(spark, text.prompt_tier("n"), n="please verify this") == "hard" and one(spark, text.prompt_tier("n"), n="what is it") == "easy"
    assert one(spark, text.title_case("n"), n="arc'teryx 65L-pro") == "Arc'Teryx 65L-Pro"
    assert one(spark, text.strip("n"), n="  a ") == "a"
    assert one(spark, text.stutters(F.col("b")), b="Durstondurston X") is True and one(spark, text.stutters(F.col("b")), b="Durston X") is False


def test_units(spark):
    grams = {"1.5kg": 1500, "8oz": 226, "2lb": 907, "123": 123}
    assert {k: one(spark, units.weight_grams(F.col("w")), w=k) for k in grams} == grams
    assert one(spark, units.weights_in(F.col("w")), w="1 lb 2 oz") == [57, 454, 510]
    assert one(spark, units.tolerant_int(F.col("w")), w="12.7") == 12 and one(spark, units.tolerant_int(F.col("w")), w="N/A") is None
    assert one(spark, units.tolerant_double(F.col("w")), w="$1,299.00") == 1299.0
    assert one(spark, units.iso_seconds(F.col("w")), w="PT1H2M3S") == 3723 and one(spark, units.iso_seconds(F.col("w")), w="PT0S") is None


def test_urls(spark):
    assert one(spark, urls.video_id(F.col("u")), u="https://youtu.be/abcdefghijk?t=1") == "abcdefghijk"
    assert one(spark, urls.playlist_id(F.col("u")), u="https://x/y?list=PL_1&v=2") == "PL_1"
    assert one(spark, urls.category_name(F.col("u")), u="/a/sleeping-bags/") == "Sleeping Bags" and one(spark, urls.category_name(F.col("u")), u="/") is None


def test_fuzzy():
    assert fuzzy.ratio("", "") == 100 and fuzzy.ratio("abcd", "abce") == 75.0 and fuzzy.common_length("abcbdab", "bdcaba") == 4
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 100 and fuzzy.token_sort_ratio("b a", "a b") == 100 and fuzzy.token_set_ratio("a b c", "a b") == 100
    assert fuzzy.in_brand("red ring", "red ring", 85) == 100


def test_risk_gates(spark):
    risk = lambda kind, c, gone=False: one(spark, quality.risk_of(F.lit(kind), F.lit(c), F.lit(gone)))
    assert risk("typo", 0.79) == "medium" and risk("duplicate_merge", 0.99, True) == "high" and risk("typo", 0.95) == "low"


def test_leader_clusters_follow_the_sequential_rule(spark):
    import random

    rng = random.Random(0)
    names = [f"n{i:03d}" for i in range(60)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(90)})
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    leaders, want = [], {}
    for n in names:
        lead = next((x for x in leaders if (x, n) in near), None)
        want[n] = lead or n
        if lead is None:
            leaders.append(n)
    keep = keeper(spark)
    got = duplicates.leader_clusters(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(pairs, "a string, b string"), keep)
    assert {r.name: r.leader for r in got.collect()} == want


def test_micro_graph(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "node_id long, name string")
    e = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "src_id long, dst_id long")
    f = spark.createDataFrame([(1, 20), (1, 21), (1, 22)], "src_id long, dst_id long")
    assert [tuple(r) for r in graph.branch_counts(nodes, {"x": e, "y": f}).orderBy("node_id").collect()] == [(1, "a", 2, 3), (2, "b", 1, 0), (3, None, 0, 0)]
    assert [r.node_id for r in graph.without(nodes, e).collect()] == [3]


def test_merge_moves_edges_and_drops_loops(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id long")
    edges = spark.createDataFrame([(1, "R", 2), (2, "R", 3), (3, "S", 2)], "src_id long, rel_type string, dst_id long")
    mapping = spark.createDataFrame([(2, 1)], "dup_id long, keep_id long")
    left, moved = mutations.merge_nodes(nodes, edges, mapping)
    assert sorted(r.node_id for r in left.collect()) == [1, 3]
    assert sorted(tuple(r) for r in moved.collect()) == [(1, "R", 3), (3, "S", 1)]
    assert sorted(tuple(r) for r in mutations.merge_nodes(nodes, edges, mapping, ["R"])[1].collect()) == [(1, "R", 3)]


@pytest.mark.parametrize("category, want", [("Tent", "Zed Mug specs weight capacity season"), ("SLEEPING_PAD", "Zed Mug specs r-value weight"), ("cups", "Zed Mug specs weight"), (None, "Zed Mug specs weight")])
def test_searches_by_category(spark, category, want):
    from cairn.functions.catalog import search_query

    assert one(spark, search_query(F.lit("Zed"), F.lit("Mug"), F.col("c")), c=category) == want


def test_harvested_lines_are_cut_and_capped(spark):
    from cairn.functions.catalog import harvested

    text_ = "\n".join(["  A TENT for two ", "nothing", "He suggests " + "x" * 300, "note: bag"] + [f"pack {i}" for i in range(120)])
    gear, insight = one(spark, harvested(F.col("t"), "gear"), t=text_), one(spark, harvested(F.col("t"), "insight"), t=text_)
    assert gear[:3] == ["A TENT for two", "note: bag", "pack 0"] and len(gear) == 100
    assert [len(x) for x in insight] == [200, 9] and insight[0].startswith("He suggests x")
