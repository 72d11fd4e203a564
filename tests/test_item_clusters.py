"""Clusters of items against the sequential rule."""

import random
import re

import pytest

from cairn.functions.text import STOP_WORDS
from cairn.operators import duplicates


class Items:
    def __init__(self, spark, rows):
        self.spark, self.rows = spark, spark.createDataFrame(rows, "node_id long, name string, brand string")

    def item(self):
        return self.rows


@pytest.mark.parametrize("seed, n, words", [(4, 60, "red tin mug pot cup jar the"), (5, 250, " ".join(f"w{i}" for i in range(40))), (6, 250, " ".join(f"w{i}" for i in range(120)))])
def test_brands_and_copies_count(spark, seed, n, words):
    draw = random.Random(seed)
    brands = ["Zed", "zed", "Yak", "", None] + [f"b{i}" for i in range(len(words.split()) // 3)]
    rows = [(" ".join(draw.choices(words.split(), k=draw.randint(1, 3))), draw.choice(brands)) for _ in range(n)]
    items = sorted((n, (b or "").lower()) for n, b in rows)
    tokens = [{t for t in re.findall("[a-z0-9]+", n) if t not in STOP_WORDS and len(t) > 1} for n, _ in items]
    gone, want = set(), []
    for i, (name, brand) in enumerate(items):
        if i not in gone:
            near = [j for j in range(i + 1, len(items)) if j not in gone and len(tokens[i] & tokens[j]) >= (1 if brand and brand == items[j][1] else 2)]
            if near:
                gone.update(near)
                want.append((name, len(near) + 1, "merge" if len(near) < 3 else "review"))
    got = duplicates.dup_leader_clusters(Items(spark, [(i, *r) for i, r in enumerate(rows)])).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_follower_joins_its_earliest_leader(spark):
    """c leads only once d has followed a; x, which m leads from the start, joins c all the same."""
    from cairn.sources.scratch import keeper

    pairs = [("a", "b"), ("b", "c"), ("c", "x"), ("m", "x")]
    out = duplicates.leader_clusters(spark.createDataFrame([(n,) for n in "abcmxz"], "name string"), spark.createDataFrame(pairs, "a string, b string"), keeper(spark))
    assert {r.name: r.leader for r in out.collect()} == {"a": "a", "b": "a", "c": "c", "x": "c", "m": "m", "z": "z"}


def test_a_token_that_all_share_is_linear(spark):
    rows = [(i, f"gear w{i}", "Zed") for i in range(20_000)]
    nodes = spark.createDataFrame(rows, "node_id long, name string, brand string").selectExpr("concat(name, brand) AS key", "name", "brand")
    marks = duplicates.shared_marks(nodes)
    assert marks.count() == 3 * len(rows)
    assert [tuple(r) for r in duplicates.dup_leader_clusters(Items(spark, rows)).collect()] == [("gear w0", 20_000, "review")]
