"""Fuzzy string ratios on a scale of 0 to 100, as Arrow-batched functions of two columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; a column of the table is the bits of one integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common part over both lengths; two empty strings are equal."""
    n = len(a) + len(b)
    return 200.0 * common_length(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a part of the longer one of its length, ends included."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 100.0 if not t else 0.0
    n = len(s)
    windows = {t[max(0, i) : i + n] for i in range(1 - n, len(t))}
    return max(ratio(s, w) for w in windows)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    one = " ".join(filter(None, [shared, " ".join(sorted(x - y))]))
    two = " ".join(filter(None, [shared, " ".join(sorted(y - x))]))
    if shared and (not x - y or not y - x):
        return 100.0
    return max([ratio(one, two)] + ([ratio(shared, one), ratio(shared, two)] if shared else []))


def weighted_ratio(a: str, b: str) -> float:
    """The plain ratio, or token and partial forms at a discount that grows with the lengths' disparity."""
    if not a or not b:
        return 0.0
    far = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if far < 1.5:
        return max(best, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if far <= 8 else 0.6
    words = [" ".join(sorted(x.split())) for x in (a, b)]
    return max(best, scale * partial_ratio(a, b), scale * 0.95 * partial_ratio(*words))


def composite(a: str, b: str) -> float:
    return 0.2 * ratio(a, b) + 0.3 * partial_ratio(a, b) + 0.25 * token_sort_ratio(a, b) + 0.25 * token_set_ratio(a, b)


def in_brand(a: str, b: str, least: float = 0.0) -> float:
    """The mix used within a brand; the costly part is left out where it cannot lift the sum to least."""
    rest = 0.3 * ratio(a, b) + 0.25 * token_sort_ratio(a, b) + 0.25 * token_set_ratio(a, b)
    return rest + 0.2 * partial_ratio(a, b) if rest + 20.0 >= least else rest


def scored(kernel, a: Column, b: Column, *, in_place: bool = False) -> Column:
    """kernel of two string columns; null if one is null. Each different pair of a batch is worked out once.

    in_place: scored where it stands. Otherwise a filter of the score may move below a distinct() in front of it, which
    scores each pair as often as it was found, and then once more.
    """

    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        seen: dict[tuple, float | None] = {}
        for pair in zip(x, y, strict=True):
            if pair not in seen:
                seen[pair] = None if pair[0] is None or pair[1] is None else float(kernel(*pair))
        return pd.Series([seen[p] for p in zip(x, y, strict=True)], dtype="float64")

    score.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(score, "double")
    return (udf.asNondeterministic() if in_place else udf)(a, b)
