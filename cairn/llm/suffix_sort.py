"""Deep-shallow sorting of many short strings: multikey quicksort to a shallow depth, blind tries for the rest."""

from __future__ import annotations

import numpy as np

#: Bytes that the shallow phase compares, WORD of them at a time.
SHALLOW, WORD = 16, 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps only branching depths and branching bytes.

    A search follows branching bytes without looking at the bytes between, ends at some leaf,
    and one comparison with that leaf's string tells where the new string leaves the trie.
    A node is [depth, {byte: child}, leaf, strings that end here].
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [len(s), {}, i, [i]]
            return
        node = self.root
        while node[0] < len(s) and (child := node[1].get(s[node[0]])) is not None:
            node = child
        depth = common_prefix(s, self.strings[node[2]])
        above, node = None, self.root
        while node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if node[0] > depth:  # the string leaves, or ends, inside the edge above node
            split = [depth, {self.strings[node[2]][depth]: node}, node[2], []]
            if above is None:
                self.root = split
            else:
                above[1][s[above[0]]] = split
            node = split
        if len(s) == depth:
            node[3].append(i)
        else:
            node[1][s[depth]] = [len(s), {}, i, [i]]

    def ordered(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            out += node[3]
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def multikey_quicksort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the rows by (group, words), and the ranges of it whose rows agree in all words.

    Each segment is parted into what is less than, equal to and greater than a pivot in the
    segment's current word. The two sides go on with the same word, the middle with the next
    one. All segments of a round are parted at once, each by its own pivot.
    """
    order = np.argsort(group, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1], [True])))
    start, stop, depth = edges[:-1], edges[1:], np.zeros(len(edges) - 1, np.int64)
    done: list[tuple[int, int]] = []
    while True:
        ended = depth == words.shape[1]
        done += [(a, z) for a, z in zip(start[ended].tolist(), stop[ended].tolist(), strict=True) if z - a > 1]
        live = ~ended & (stop - start > 1)
        start, stop, depth = start[live], stop[live], depth[live]
        if not len(start):
            return order, sorted(done)
        size = stop - start
        seg = np.repeat(np.arange(len(start)), size)
        before = np.cumsum(size) - size
        at = np.arange(len(seg)) - before[seg] + start[seg]
        rows = order[at]
        key = words[rows, depth[seg]]
        some = np.sort(key[np.stack((before, before + size // 2, before + size - 1))], axis=0)
        side = (key >= some[1][seg]).astype(np.int64) + (key > some[1][seg])
        held = np.bincount(seg * 3 + side, minlength=3 * len(start)).reshape(-1, 3)
        base = start[:, None] + np.cumsum(held, axis=1) - held
        for c in range(3):
            hit = np.flatnonzero(side == c)
            rank = np.arange(len(hit)) - (np.cumsum(held[:, c]) - held[:, c])[seg[hit]]
            order[base[seg[hit], c] + rank] = rows[hit]
        start, stop = base.ravel(), (base + held).ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()


def deep_shallow_sort(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by (group, bytes), and each one's common prefix with the one before.

    The common prefix is -1 where the group changes. Words of eight bytes are the characters of
    the multikey quicksort; strings that agree in all of them go to a blind trie.
    """
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), f">u{WORD}").reshape(n, -1).astype(np.uint64)
    order, equal = multikey_quicksort(group, head)
    out = order.tolist()
    for a, b in equal:
        trie = BlindTrie(strings)
        for i in out[a:b]:
            trie.add(i)
        out[a:b] = trie.ordered()
    order = np.array(out, np.int64)
    g = group[order]
    lcp = np.array([-1] + [common_prefix(strings[x], strings[y]) for x, y in zip(out, out[1:], strict=False)], np.int64)
    lcp[1:][g[1:] != g[:-1]] = -1
    return order, lcp
