"""Operator 13 against a plain version, on ties, many copies, several blocks and odd texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cairn.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    counted = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, total = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scores = []
        for place, (i, c, size) in enumerate(counted):
            m = 25 + (75 * size * n) // total
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, place, i))
        out += [(item, rank, x[4], -x[0]) for rank, x in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **kw):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, R.search(d, i, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def made(rng, n, words):
    return [(k, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.choice([1, 3, 10, 60])))) for k in range(n)]


@pytest.mark.parametrize("blocks", [1, 4])
def test_equal_to_all_pairs(spark, monkeypatch, blocks):
    rng = random.Random(blocks)
    words = [f"w{k}" for k in range(60)] + ["É", "é", "naïve", "x1", "日本"]
    docs, items = made(rng, 500, words), made(rng, 25, words)
    docs += [(1000 + k, docs[7][1]) for k in range(150)] + [(None, docs[8][1])]  # a large group of copies: ties go by doc_id
    if blocks > 1:
        monkeypatch.setattr(R, "BLOCK_BYTES", sum(len(t.encode()) for _, t in items) // blocks)
        monkeypatch.setattr(R, "_rows", lambda block: 7)
    assert searched(spark, docs, items) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "§ -- !!"), (4, "A b"), (4, "a B"), (None, "a"), (5, "ÀB"), (6, "a" * 100), (7, "a b"), (8, "b " * 1000)]
    items = [(1, "a A b"), (1, "a A b"), (1, "b"), (2, None), (3, ""), (4, "--"), (None, "àb ÀB"), (5, "zzz"), (6, "a" * 100)]
    assert searched(spark, docs, items) == plain(docs, items)
    assert searched(spark, docs, []) == [] and searched(spark, [], items) == [] and searched(spark, [], []) == [] and searched(spark, docs[:3], items) == []
    assert searched(spark, docs, items, top=1) == plain(docs, items, 1)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(chr(rng.choice([*range(128), 0x85, 0xA0, 0xC0, 0xE9, 0x2028, 0x3000, 0x4E2D, 0x1F600])) for _ in range(40))
        assert [t.decode() for t in R.terms_of(text.encode())] == terms(text)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    tf, m = rng.integers(1, 10**6, 10_000), rng.integers(25, 10**7, 10_000)
    exact = R.impacts(tf, m)
    level = -(-exact // R.STEP)
    assert exact.max() < R.ONE and level.max() <= 255 and (exact <= level * R.STEP).all() and (exact >= np.where(level > 0, (level - 1) * R.STEP + 1, 0)).all()


def test_sums_beyond_doubles_are_whole(spark):
    counts = [Counter({b"a": 1, b"b": 2})]
    small, large = (R.Block(counts, {b"a": 0, b"b": 1}, np.array([w, w + 1])) for w in (1000, 2**42))
    args = (np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([999_999, 1, 3]), 2)
    assert small.exact and not large.exact
    for block, w in ((small, 1000), (large, 2**42)):
        assert block.sums(*args).tolist() == [[999_999 * w + 2 * (w + 1)], [6 * (w + 1)]]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    extra = docs.select("*", *[docs["doc_id"].alias(c) for c in ("raw", "n", "terms", "tf", "level", "item", "score", "rank", "low", "m")])
    assert sorted(map(tuple, R.search(extra, spark.createDataFrame([(1, "a")], "item_id long, text string")).collect())) == [tuple(x) for x in plain([(1, "a b"), (2, "b")], [(1, "a")])]
