"""A cuckoo filter over 128-bit keys: 32-bit fingerprints, four to a bucket, two buckets a key."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MOST_KICKS = 500


def _spread(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Keys are pairs of int64; h1 gives the bucket, h2 the fingerprint (never 0).

    The other bucket follows from bucket and fingerprint alone, so keys can move and be deleted
    without knowing them. Deleting a key that was not inserted is the caller's error; the exact
    reference counts behind the filter prevent it.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.85 < n:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint32))

    @classmethod
    def loads(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint32).reshape(-1, SLOTS).copy())

    def dumps(self) -> bytes:
        return self.table.tobytes()

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        fp = (h2.view(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        fp[fp == 0] = 1
        one = _spread(h1.view(np.uint64)) & mask
        return fp, one.astype(np.int64), (one ^ (_spread(fp.astype(np.uint64)) & mask)).astype(np.int64)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if not len(h1):
            return np.zeros(0, bool)
        fp, one, two = self._places(h1, h2)
        return ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(axis=1)

    def _place(self, fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their buckets; tells which found one."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
        rank = np.arange(len(bucket)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        taken = self.table[bucket] != 0
        fits = np.flatnonzero(rank < SLOTS - taken.sum(axis=1))
        slot = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(len(fits)), rank[fits]]
        self.table[bucket[fits], slot] = fp[order[fits]]
        out = np.zeros(len(at), bool)
        out[order[fits]] = True
        return out

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """False if a key found no place; the filter must then be built larger from the counts."""
        if not len(h1):
            return True
        fp, one, two = self._places(h1, h2)
        left = ~self._place(fp, one)
        fp, at = fp[left], two[left]
        for kick in range(MOST_KICKS):
            if not len(fp):
                return True
            left = ~self._place(fp, at)
            fp, at = fp[left], at[left]
            bucket, who = np.unique(at, return_index=True)  # of each full bucket one key goes in for another
            out = self.table[bucket, kick % SLOTS]
            self.table[bucket, kick % SLOTS], fp[who] = fp[who], out
            at[who] = bucket ^ (_spread(out.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return not len(fp)

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        if not len(h1):
            return
        fp, *buckets = self._places(h1, h2)
        for k in range(2):
            while len(fp):
                same = self.table[buckets[k]] == fp[:, None]
                held = np.flatnonzero(same.any(axis=1))
                if not len(held):
                    break
                slot = buckets[k][held] * SLOTS + same[held].argmax(axis=1)
                _, who = np.unique(slot, return_index=True)  # a slot is emptied for one key
                self.table.reshape(-1)[slot[who]] = 0
                left = np.ones(len(fp), bool)
                left[held[who]] = False
                fp, buckets = fp[left], [b[left] for b in buckets]
