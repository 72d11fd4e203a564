"""Operator 5: benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, in_slices, table

#: Characters of a q-gram: of items of at least LONG characters, and of shorter ones. Items under
#: LEAST characters are searched for as whole words.
Q, Q_SHORT, LONG, LEAST = 8, 4, 40, 8
RATE = 0.1  # edits allowed for each character of an item
#: Characters of items that one pass over the documents looks for; more items take more passes.
BLOCK_CHARS = 4_000_000
#: Characters of text that are searched together, and shared q-grams that are listed together.
PART_CHARS, HITS = 1 << 15, 1 << 19

_U = np.uint64
_MULT = np.random.default_rng(5).integers(0, 1 << 63, Q, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(0x110000, dtype=np.uint32)
for _c in range(0x20000):
    _l = chr(_c).lower()
    if len(_l) == 1:
        _LOWER[_c] = ord(_l)
_SPACE = np.zeros(0x110000, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
FILTER_BITS = 22


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points with each run of white space as one space, and their places in the text."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[cps]
    keep = np.flatnonzero(~(space & np.concatenate(([True], space[:-1])))) if len(cps) else np.zeros(0, np.int64)
    out = np.where(space[keep], np.uint32(32), _LOWER[cps[keep]])
    return out, keep


def gram_hashes(cps: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(cps) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = cps.astype(np.uint64)
    h = wide[:n] * _MULT[0]
    for i in range(1, q):
        h += wide[i : i + n] * _MULT[i]
    return (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)


@dataclass
class Grams:
    """The postings of the q-grams of some items, for one q."""

    q: int
    which: np.ndarray  # numbers of the items
    budgets: np.ndarray  # edits
    least: np.ndarray  # shared q-grams that so many edits leave at least
    reach: int  # characters of the longest item with its edits
    grams: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    places: np.ndarray
    hint: np.ndarray

    @classmethod
    def of(cls, q: int, which: list[int], texts: list[np.ndarray]) -> Grams:
        m = np.array([len(t) for t in texts], np.int64)
        budgets = (RATE * m + 1e-9).astype(np.int64)
        hashes = [gram_hashes(t, q) for t in texts]
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(texts)), [len(x) for x in hashes]) if texts else np.zeros(0, np.int64)
        place = np.concatenate([*[np.arange(len(x)) for x in hashes], np.zeros(0, np.int64)])
        order = np.argsort(h, kind="stable")
        grams, starts = np.unique(h[order], return_index=True)
        hint = np.zeros(1 << FILTER_BITS, bool)
        hint[(grams >> _U(64 - FILTER_BITS)).astype(np.int64)] = True
        reach = int((m + 2 * budgets + 2).max()) if texts else 0
        return cls(q, np.array(which, np.int64), budgets, m - q + 1 - budgets * q, reach, grams, np.append(starts, len(h)), item[order], place[order], hint)

    def runs(self, cps: np.ndarray, a: int, z: int) -> tuple[np.ndarray, ...]:
        """Q-grams of cps[a:z] shared with items, as runs along a diagonal: item, diagonal, first place, end."""
        h = gram_hashes(cps[a:z], self.q)
        maybe = np.flatnonzero(self.hint[(h >> _U(64 - FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(self.grams, h[maybe])
        at[at == len(self.grams)] = 0
        real = self.grams[at] == h[maybe]
        maybe, at = maybe[real] + a, at[real]
        count = self.starts[at + 1] - self.starts[at]
        upto = np.cumsum(count)
        out = [(np.zeros(0, np.int64),) * 4]
        first = 0
        while first < len(at):  # as many positions at once as have HITS postings, one at least
            last = max(first + 1, int(np.searchsorted(upto, upto[first] - count[first] + HITS, side="right")))
            n = count[first:last]
            row = np.repeat(np.arange(first, last), n)
            post = self.starts[at][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            item, place = self.items[post], self.places[post]
            diag = maybe[row] - place
            order = np.lexsort((place, diag, item))
            item, diag, place = item[order], diag[order], place[order]
            new = np.concatenate(([True], (item[1:] != item[:-1]) | (diag[1:] != diag[:-1]) | (place[1:] != place[:-1] + 1)))
            start = np.flatnonzero(new)
            out.append((item[start], diag[start], place[start], place[np.append(start[1:], len(new)) - 1] + 1))
            first = last
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def regions(self, cps: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, lowest, highest diagonal) of all bands that share enough different q-grams with an item.

        A part of the text that differs from an item by at most k edits shares at least
        m - q + 1 - kq q-grams with it, on diagonals at most k apart. Bands of 2(k + 1) diagonals
        that overlap by half hold any k + 1 neighbouring ones. The text is gone through in parts;
        a band belongs to the part that it begins in, which reads on to the band's end.
        """
        step = max(PART_CHARS, 4 * self.reach)
        for a in range(0, max(len(cps) - self.q + 1, 0), step):
            item, diag, p0, p1 = self.runs(cps, a, min(len(cps), a + step + self.reach))
            if not len(item):
                continue
            wide = self.budgets[item] + 1
            band = diag // wide
            i, d, b = np.concatenate((item, item)), np.concatenate((diag, diag)), np.concatenate((band, band - 1))
            p, e = np.concatenate((p0, p0)), np.concatenate((p1, p1))
            begin = b * np.concatenate((wide, wide))
            mine = np.flatnonzero(((begin >= a) | (a == 0)) & (begin < a + step))
            order = mine[np.lexsort((p[mine], b[mine], i[mine]))]
            if not len(order):
                continue
            i, b, d, p, e = i[order], b[order], d[order], p[order], e[order]
            head = np.concatenate(([True], (i[1:] != i[:-1]) | (b[1:] != b[:-1])))
            first, group = np.flatnonzero(head), np.cumsum(head)
            high = int(e.max()) + 1
            covered = np.maximum.accumulate(group * high + e) - group * high  # of the band so far
            covered = np.concatenate(([0], covered[:-1]))
            covered[first] = 0
            different = np.add.reduceat(np.maximum(e - np.maximum(p, covered), 0), first)
            enough = different >= self.least[i[first]]
            lows, highs = np.minimum.reduceat(d, first), np.maximum.reduceat(d, first)
            yield from zip(self.which[i[first]][enough].tolist(), lows[enough].tolist(), highs[enough].tolist(), strict=True)


@dataclass
class Items:
    """Benchmark items of one block, normalized: long ones and shorter ones by q-grams, the least ones as words."""

    ids: list
    texts: list[np.ndarray]
    budgets: np.ndarray  # edits
    grams: list[Grams]
    words: list[tuple[int, str]]

    @classmethod
    def of(cls, rows: list[tuple[object, str]]) -> Items:
        ids, texts = [], []
        for i, text in rows:
            cps = normalized(text or "")[0]
            while len(cps) and cps[-1] == 32:
                cps = cps[:-1]
            while len(cps) and cps[0] == 32:
                cps = cps[1:]
            if len(cps):
                ids.append(i)
                texts.append(cps)
        m = np.array([len(t) for t in texts], np.int64)
        parts = [(Q, np.flatnonzero(m >= LONG)), (Q_SHORT, np.flatnonzero((m >= LEAST) & (m < LONG)))]
        grams = [Grams.of(q, at.tolist(), [texts[k] for k in at.tolist()]) for q, at in parts if len(at)]
        words = [(k, "".join(map(chr, texts[k].tolist()))) for k in np.flatnonzero(m < LEAST).tolist()]
        budgets = np.where(m < LEAST, 0, (RATE * m + 1e-9).astype(np.int64))
        return cls(ids, texts, budgets, grams, words)


def banded_ends(pattern: np.ndarray, text: np.ndarray, lowest: int, width: int, budget: int) -> tuple[int, int]:
    """Least edits between the pattern and a part of text, and where that part ends.

    Only text[j + lowest + b] for 0 <= b < width may meet pattern[j]. The part may start
    anywhere; of equal results the first end counts. Costs never fall from row to row, so the
    search ends as soon as all are beyond the budget.
    """
    far = 1 << 20
    band = np.arange(width)
    n = len(text)
    at = lowest + band  # text consumed so far at each place of the band
    cost = np.where((at >= 0) & (at <= n), 0, far)
    for j, c in enumerate(pattern):
        if j % 8 == 0 and cost.min() > budget:
            return far, 0
        take = j + lowest + band
        inside = (take >= 0) & (take < n)
        same = np.zeros(width, bool)
        same[inside] = text[take[inside]] == c
        best = np.where(inside, cost + ~same, far)
        best[:-1] = np.minimum(best[:-1], cost[1:] + 1)  # a pattern character without partner
        at = take + 1
        best[(at < 0) | (at > n)] = far
        cost = np.minimum.accumulate(best - band) + band  # text characters without partner
        cost[(at < 0) | (at > n)] = far
    k = int(np.argmin(cost))
    return int(cost[k]), len(pattern) + lowest + k


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the pattern's best place on diagonals low - budget to high + budget."""
    for d in range(low, high + 1):
        if d >= 0 and d + len(pattern) <= len(text) and np.array_equal(text[d : d + len(pattern)], pattern):
            return 0, d, d + len(pattern)
    edits, stop = banded_ends(pattern, text, low - budget, high - low + 2 * budget + 1, budget)
    if edits > budget:
        return None
    back = text[:stop][::-1]
    _, n = banded_ends(pattern[::-1], back[: len(pattern) + budget], -budget, 2 * budget + 1, budget)
    return edits, stop - n, stop


def _words_in(text: str, word: str) -> Iterator[tuple[int, int, int]]:
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not (text[at - 1 : at].isalnum() and word[0].isalnum()) and not (text[end : end + 1].isalnum() and word[-1].isalnum()):
            yield 0, at, end
            at = text.find(word, end)
        else:
            at = text.find(word, at + 1)


def _apart(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of places that overlap, those of the fewest edits, then the first."""
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for hit in sorted(hits):
        k = bisect_left(starts, hit[1])
        if (k == len(kept) or kept[k][1] >= hit[2]) and (k == 0 or kept[k - 1][2] <= hit[1]):
            starts.insert(k, hit[1])
            kept.insert(k, hit)
    return sorted(kept)


def find_items(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, stop) of every item found in the text; places in code points of the text.

    Regions that the q-gram lemma leaves are aligned within their band; equal regions of one
    text are aligned once. Parts that overlap a better one of the same item are left out.
    """
    if not items.ids or not text:
        return []
    cps, places = normalized(text)
    found: dict[int, set[tuple[int, int, int]]] = {}
    tried: set[tuple[int, int, int]] = set()
    known: dict[tuple, tuple[int, int, int] | None] = {}
    for grams in items.grams:
        for which, low, high in grams.regions(cps):
            if (which, low, high) in tried:
                continue
            tried.add((which, low, high))
            k, pattern = int(items.budgets[which]), items.texts[which]
            a, z = max(low - 2 * k, 0), min(high + len(pattern) + 2 * k, len(cps))
            part = cps[a:z]
            key = (which, low - a, high - a, xxhash.xxh3_128_digest(part.tobytes()))
            if key not in known:
                known[key] = align(pattern, part, low - a, high - a, k)
            if hit := known[key]:
                found.setdefault(which, set()).add((hit[0], hit[1] + a, hit[2] + a))
    if items.words:
        plain = "".join(map(chr, cps.tolist()))
        for which, word in items.words:
            if hits := set(_words_in(plain, word)):
                found[which] = hits
    return [(which, e, int(places[a]), int(places[z - 1]) + 1) for which, hits in sorted(found.items()) for e, a, z in _apart(list(hits))]


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size; one block at a time is collected."""
    rows = benchmark.select("item_id", "text").filter(F.length("text") > 0)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        yield Items.of(sorted((tuple(r) for r in rows.filter(at == k).collect()), key=lambda r: (r[0] is None, r[0], r[1])))


FOUND = "item_id {}, start long, stop long, edits int, similarity double"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """carry, item_id, start, stop, edits, similarity: every place where a text holds an item.

    Texts and items are compared in lower case with runs of white space as one space. A place
    counts if it differs from the item by at most RATE edits a character (none for items under
    LEAST characters, which count as whole words only). Null, empty and blank items are not
    searched for; null and empty texts hold nothing. Of overlapping places of one item the one
    of the fewest edits counts, of ties the first. Repeated rows and repeated items are reported
    each, and places of different items may overlap. Very long texts are searched in parts, so
    memory does not grow with them but for what is found. Without items or rows the result is
    empty. Other columns are ignored.

    The benchmark goes to every task in blocks of BLOCK_CHARS characters, one narrow pass over
    the documents for each block; nothing is shuffled. Of several blocks each is written before
    the next one is collected.
    """
    rows = docs.select(*carry, F.col("text").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = ", ".join([*fields, FOUND.format(benchmark.schema["item_id"].dataType.simpleString())])
    n = len(carry)
    parts, scratch = [], Scratch(docs.sparkSession, "benchmark")
    for k, block in enumerate(_blocks(benchmark)):
        if k:
            parts[-1] = scratch.keep(parts[-1], f"found{k}")
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            id_type = pa.array(items.ids).type if items.ids else pa.int64()
            for b in in_slices(batches):
                row, hits = [], []
                for k, text in enumerate(b.column(n).to_pylist()):
                    for hit in find_items(text or "", items):
                        row.append(k)
                        hits.append(hit)
                if not row:
                    continue
                m = [len(items.texts[h[0]]) for h in hits]
                cols = [c.take(pa.array(row, pa.int64())) for c in b.columns[:n]]
                cols += [
                    pa.array([items.ids[h[0]] for h in hits], id_type), pa.array([h[2] for h in hits], pa.int64()),
                    pa.array([h[3] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int32()),
                    pa.array([1 - h[1] / x for h, x in zip(hits, m, strict=True)], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, [*b.schema.names[:n], "item_id", "start", "stop", "edits", "similarity"])

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no item (see find_benchmark)."""
    at = docs.columns.index("text")
    scratch = Scratch(docs.sparkSession, "clean")
    for k, block in enumerate(_blocks(benchmark)):
        if k:
            docs = scratch.keep(docs, f"clean{k}")
            scratch.drop(*([f"clean{k - 1}"] if k > 1 else []))
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in in_slices(batches):
                yield b.filter(pa.array([not find_items(t or "", shared.value) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
