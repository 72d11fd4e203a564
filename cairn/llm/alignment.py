"""Banded edit distance of two sequences, a band's column held in the bits of one integer."""

from __future__ import annotations

from collections.abc import Sequence


def _plain(a: Sequence, b: Sequence) -> int:
    row = list(range(len(a) + 1))
    for i, y in enumerate(b, 1):
        diagonal, row[0] = row[0], i
        for j, x in enumerate(a, 1):
            diagonal, row[j] = row[j], min(diagonal + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def banded_distance(a: Sequence, b: Sequence, most: int) -> int:
    """The edit distance if it is at most most, else most + 1.

    Bit p of a column stands for row i - most + p at column i, so columns are 2 * most + 1 bits
    however long the sequences are. The cost at the lower edge of the band is followed down
    the diagonal until the last row, then along that row.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    lo, n, m = 0, len(a), len(b)
    while lo < n and a[lo] == b[lo]:
        lo += 1
    while n > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    if len(a) <= most:
        d = _plain(a, b) if len(a) else len(b)
        return min(d, most + 1)
    where: dict = {}
    for j, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << j
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    rises = full ^ ((1 << most) - 1)  # vertical steps of +1: all rows that exist at column 0
    falls, cost, last = 0, most, len(a) - most
    edge = top >> 1
    beyond = 2 * most + len(b) - len(a)  # from here the cost cannot come down to most again
    for i, y in enumerate(b):
        places = where.get(y, 0)
        match = (places >> (i - most) if i >= most else places << (most - i)) & full
        zero = (((match & rises) + rises) ^ rises) | match | falls
        zero &= full
        up = falls | (full & ~(zero | rises))
        down = zero & rises
        if i < last:
            cost += not zero & top
        else:
            cost += bool(up & edge) - bool(down & edge)
            edge >>= 1
        if cost > beyond:
            return most + 1
        shifted = zero >> 1
        rises = (down | (full & ~(shifted | up))) & full
        falls = shifted & up
    return min(cost, most + 1)
