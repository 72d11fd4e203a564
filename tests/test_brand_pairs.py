"""Pairs within a brand against all pairs."""

import random

from cairn.functions import fuzzy
from cairn.operators import duplicates
from tests.test_scanners import Items


def test_pairs_within_brand_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 20)
    rng = random.Random(6)
    words = ["arc", "haul", "zip", "ultra", "60", "65l", "tent", "x-mid", "solo", "übër", "pro"]
    rows = []
    for i in range(160):
        name = "  ".join(rng.sample(words, rng.randrange(1, 5))) if i % 7 == 0 else " ".join(rng.sample(words, rng.randrange(1, 5)))
        if i % 3 == 0 and len(name) > 3:
            at = rng.randrange(len(name))
            name = name[:at] + rng.choice("abz ") + name[at + 1 :]
        rows.append((i, name.title(), rng.choice(["Zed", "Zed", None, "Other"]), None, None))
    rows.append((999, "", "Zed", None, None))
    got = {(r.brand, r.name, r.other): round(r.similarity, 6) for r in duplicates.pairs_within_brand(Items(spark, rows)).collect()}
    names = sorted({((b or "unknown").lower(), n.lower()) for _, n, b, _, _ in rows})
    want = {(b, x, y): round(s, 6) for b, x in names for c, y in names if b == c and x < y and (s := fuzzy.in_brand(x, y)) >= 85}
    assert got == want and len(want) > 5
