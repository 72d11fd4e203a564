"""Names that are nearly all alike are compared in blocks: by bounds, without losing a match."""

import random

import pytest

from cairn.functions import fuzzy
from cairn.operators import fuzzy_join

ODD = ["red red", "red widget 12 red", "x" * 70, "x x x x " + "x" * 20, "a b", " ", "éa bé", "12", "widget red 12", "red widget 12 ultra", "red widget 1", "of a"]


def names(rng, n):
    some = {f"{rng.choice('red blue old large'.split())} {rng.choice('bolt widget rod'.split())}{rng.choice(['', f' {rng.randint(1, 50)}', f' {rng.randint(1, 9)}0l', ' ultra'])}" for _ in range(n)}
    return sorted(some | set(ODD))


@pytest.mark.parametrize("pairs", [0, 1 << 33])
@pytest.mark.parametrize("least", [75.0, 85.0, 90.0])
def test_each_way_finds_every_match_of_a_group(spark, monkeypatch, pairs, least):
    monkeypatch.setattr(fuzzy_join, "PAIRS", pairs)
    monkeypatch.setattr(fuzzy_join, "LINES", 16)
    monkeypatch.setattr(fuzzy_join, "NAMES", 16)
    rng = random.Random(int(least))
    lines, known = ([(rng.choice("xyz"), n) for n in names(rng, 40)] + [("x", "only here"), ("none", "red bolt")] for _ in range(2))
    out = fuzzy_join.similar(spark.createDataFrame(lines, "b string, line string"), spark.createDataFrame(known, "b string, known string"), least, ["b"]).collect()
    want = {(g, a, b): s for g, a in lines for h, b in known if g == h and (s := round(fuzzy.weighted_ratio(a, b), 6)) >= least}
    assert {(r.b, r.line, r.known): r.score for r in out} == want and len(out) == len(want) > 10


def test_names_that_groups_share_are_compared_once(spark):
    rows = lambda c, shared: spark.createDataFrame([(f"g{g}", f"red widget {i if shared else 20 * g + i}") for g in range(5) for i in range(20)], f"b string, {c} string")
    assert fuzzy_join._compared(rows("line", True), rows("known", True), ["b"]) == []
    assert fuzzy_join._compared(rows("line", False), rows("known", False), ["b"]) == ["b"]


def test_bounds_leave_few_pairs_of_alike_names_open():
    every = [f"{a} {b} {n}" for a in "red blue old hot cold large".split() for b in "bolt widget rod gear".split() for n in range(10, 40)]
    block = fuzzy_join._Block(every)
    assert sum(len(block.open(n, 90.0)) for n in every) < len(every) ** 2 / 20
