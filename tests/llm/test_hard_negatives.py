"""Operator 11 against a plain version, on ties, repeated rows, several lengths and empty annuli."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import hard_negatives
from cairn.llm.hard_negatives import mine_hard_negatives, quantised

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, is_anchor, scale=256):
    """rows of (vec_id, embedding, label) to the same result, every anchor against every row."""
    import math

    good = [(k, i, l, [math.floor(scale * x) for x in v]) for k, (i, v, l) in enumerate(rows) if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, l, v in good:
        if i is None or not is_anchor(i):
            continue
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, r, j, m) for r, j, m, w in good if r != k and len(w) == len(v)]
        others.sort(key=lambda t: t[:4])
        for s, *_, j, _ in [t for t in others if t[5] == l][:5]:
            found = [t for t in others if t[5] != l and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(i, j, rank, t[4], -s, -t[0]) for rank, t in enumerate(found, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, every):
    df = spark.createDataFrame(rows, SCHEMA)
    out = mine_hard_negatives(quantised(df, F.col("label")), F.col("vec_id") % every == 0)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def clustered(n, dim, labels, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    # quarters are floats without rounding, and give many ties
    return [(i, [round(4 * (c + rng.gauss(0, spread))) / 4 for c in centres[i % labels]], (i * 7 + rng.randrange(2)) % labels) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_all_pairs(spark, monkeypatch, small):
    if small:  # many blocks, chunks, slices and a sample that holds few rows
        for name, value in {"ROWS": 16, "CHUNK": 4, "SLICE": 8, "SAMPLE": 20, "PIVOTS": 5, "NUMBERS": 64}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    rows = clustered(700, 8, 6, 1)
    assert mined(spark, rows, 20) == plain(rows, lambda i: i % 20 == 0)


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.6, 9.0], 1), (3, [0.6, 0.0], 1), (4, [0.6, 1.0], 2), (None, [0.6, 2.0], 1),
        (None, [1.0, 0.5], 0), (5, None, 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [1.0, 1.0], None),
        (10, [], 0), (11, [], 0), (12, [], 1), (20, [0.0, 0.0], 3), (21, [0.0, 0.0], 3), (22, [5.0, 5.0], 4), (30, [-1.0, 0.0], 5), (31, [1.0, 0.0], 5),
        (40, [1.0, 2.0, 3.0], 0), (41, [1.0, 2.0, 3.0], 0), (42, [1.0, 2.0, 2.0], 1), (50, [1.0, 2.0, 3.0, 4.0], 9), (60, [1e6, 1e6], 7), (61, [1e6, 1e6], 7),
    ]
    want = plain(rows, lambda i: i % 10 == 0)
    assert want and any(r[4] == 0 for r in want)
    assert mined(spark, rows, 10) == want
    assert mined(spark, [], 10) == []
    clashes = quantised(spark.createDataFrame(rows, SCHEMA), F.col("label")).select("*", *[F.lit(1).alias(c) for c in ("row", "dim", "nn", "pivot", "chunk", "pos", "j", "score", "anchor", "block")])
    out = mine_hard_negatives(clashes, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr) == want


def test_products_beyond_doubles_are_exact(spark):
    rows = spark.createDataFrame([(i, [2**30 + i, 2**30 - i, 1], i % 2) for i in range(12)], "vec_id long, v array<long>, label long")
    out = {(r.anchor_id, r.positive_id): r.positive_score for r in mine_hard_negatives(rows, F.col("vec_id") == 0, high=100).collect()}
    assert out[0, 2] == (2**30) * (2**30 + 2) + 2**30 * (2**30 - 2) + 1


def test_few_blocks_are_scanned_where_clusters_lie_apart(spark, monkeypatch, tmp_path):
    """Annuli leave most blocks out: the routes of all rounds against every chunk with every block."""
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "CHUNK", 8)
    rng = random.Random(3)
    centres = [[rng.gauss(0, 4) for _ in range(6)] for _ in range(24)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 24]], i % 3) for i in range(4000)]
    routed = []
    keep = hard_negatives.Scratch.keep

    def counting(self, df, name):
        out = keep(self, df, name)
        if "routes" in name:
            routed.append(out.count())
        return out

    monkeypatch.setattr(hard_negatives.Scratch, "keep", counting)
    got = mined(spark, rows, 200)
    assert got == plain(rows, lambda i: i % 200 == 0)
    assert sum(routed) < 20 * 62 * 2 / 2
