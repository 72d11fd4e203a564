"""Operator 13: ranked lexical search over a two-level quantised index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, in_slices, table

TOP = 10
#: An impact is below ONE; a byte stands for impacts up to STEP times itself.
ONE, BYTE = 1_000_000, 255
STEP = -(-ONE // BYTE)
#: Bytes of item texts whose terms are indexed and searched at once (and one longer item, if there is one).
BLOCK_BYTES = 4_000_000
#: Every byte of a term as itself or in lower case, every other byte as a space. UTF-8 keeps other scripts above 0x7F.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(raw: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; A-Z alone are lower-cased."""
    return raw.translate(_FOLD).split() if raw else []


def _lists(parts: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for p in parts for x in p], pa.int32()))


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tf of every row with a term: all its terms counted, those with a number listed."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in in_slices(batches):
            rows, n, terms, tf = [], [], [], []
            for k, raw in enumerate(b.column(1).to_pylist()):
                if words := terms_of(raw):
                    counts = Counter(map(number.get, words))
                    counts.pop(None, None)
                    rows.append(k)
                    n.append(len(words))
                    terms.append(list(counts))
                    tf.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), _lists(terms), _lists(tf)], ["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def length_norm(n: int, docs: int, total: int) -> int:
    return 25 + (75 * n * docs) // total


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def quantised(listed: DataFrame, docs: int, total: int) -> DataFrame:
    """The index: a row's terms with a byte each (level 1), and the counts with the row's m (level 2).

    A byte is the impact over STEP, rounded up, so STEP times the byte is never below the impact
    and STEP times one byte less is always below it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches, 2048):
            terms, tf, n = b.column(2), b.column(3), b.column(1).to_pylist()
            ends = terms.offsets.to_numpy()
            m = np.array([length_norm(x, docs, total) for x in n], np.int64)
            flat = tf.flatten().to_numpy().astype(np.int64)
            level = (-(-impacts(flat, np.repeat(m, np.diff(ends))) // STEP)).astype(np.uint8)
            names = terms.flatten().to_numpy().astype(np.int32)
            ends = ends - ends[0]
            cut = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(m), *[pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (names, level, flat)]],
                ["doc_id", "m", "terms", "level", "tf"])

    return listed.filter(F.size("terms") > 0).mapInArrow(run, "doc_id long, m long, terms binary, level binary, tf binary")


class Block:
    """The terms of some items: for each term the items that hold it, with weight times repeats."""

    def __init__(self, items: list[Counter], numbers: dict[bytes, int], weight: np.ndarray):
        at = [(numbers[t], i, c) for i, counts in enumerate(items) for t, c in counts.items()]
        term, item, count = np.array(sorted(at), np.int64).reshape(-1, 3).T
        self.n = len(items)
        self.item, self.more = item, (weight[term] * count).astype(np.float64)
        self.first = np.searchsorted(term, np.arange(len(numbers) + 1))
        #: Sums below 2**53 are exact in doubles; larger ones need whole numbers.
        self.exact = (np.bincount(item, self.more, self.n).max() if len(item) else 0) * (BYTE + 1) * STEP < 2**53

    def sums(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """For each of n rows and each item the sum of weight times value over the terms of both."""
        count = self.first[term + 1] - self.first[term]
        entry = np.repeat(self.first[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        cell, value = np.repeat(row, count) * self.n + self.item[entry], np.repeat(value, count)
        if self.exact:
            return np.bincount(cell, self.more[entry] * value, n * self.n).reshape(n, self.n).astype(np.int64)
        out = np.zeros(n * self.n, np.int64)
        np.add.at(out, cell, self.more[entry].astype(np.int64) * value)
        return out.reshape(n, self.n)


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    parts = column.to_pylist()
    x = np.frombuffer(b"".join(parts), kind)
    return np.repeat(np.arange(len(parts)), [len(p) // x.itemsize for p in parts]), x


def _rows(block: Block) -> int:
    """Rows looked at together: rows times items stay near a million."""
    return max(1, min(512, 1_000_000 // max(block.n, 1)))


def _least_bounds(shared, top: int):
    """Level 1: each task's top lower bounds of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = np.zeros((top, block.n), np.int64)
        for b in in_slices(batches, _rows(block)):
            row, term = _flat(b.column(0), np.int32)
            _, level = _flat(b.column(1), np.uint8)
            low = np.where(level > 0, (level.astype(np.int64) - 1) * STEP + 1, 0)
            both = np.concatenate((best, block.sums(row, term, low, len(b))))
            best = np.partition(both, len(both) - top, axis=0)[len(both) - top :]
        item = np.tile(np.arange(block.n), top)
        keep = best.ravel() > 0
        yield pa.RecordBatch.from_arrays([pa.array(item[keep].astype(np.int32)), pa.array(best.ravel()[keep])], ["item", "low"])

    return run


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray, top: int) -> np.ndarray:
    """Places of the first top rows of each item: higher scores, then smaller doc_id, null last."""
    order = np.lexsort((doc, null, -score, item))
    _, start = np.unique(item[order], return_index=True)
    rank = np.arange(len(order)) - np.repeat(start, np.diff([*start, len(order)]))
    return order[rank < top]


def _rescored(shared, bounds, top: int):
    """Level 2: exact scores of every row whose upper bound reaches an item's bound; a task keeps the top of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = shared.value, np.maximum(bounds.value, 1)
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        for b in in_slices(batches, _rows(block)):
            row, term = _flat(b.column(2), np.int32)
            _, level = _flat(b.column(3), np.uint8)
            reach = block.sums(row, term, level.astype(np.int64) * STEP, len(b)) >= least
            if not reach.any():
                continue
            _, tf = _flat(b.column(4), np.int64)
            some = np.flatnonzero(reach.any(axis=1))
            place = np.full(len(b), -1)
            place[some] = np.arange(len(some))
            at = place[row] >= 0
            exact = block.sums(place[row[at]], term[at], impacts(tf[at], b.column(1).to_numpy()[row[at]]), len(some))
            doc, item = np.nonzero(reach[some] & (exact > 0))
            ids = b.column(0).fill_null(0).to_numpy()
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            new = (item, exact[doc, item], ids[some][doc], null[some][doc])
            held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
            if len(held[0]) > 4 * top * block.n + 100_000:
                first = _best(*held, top)
                held = [x[first] for x in held]
        first = _best(*held, top)
        item, score, doc, null = (x[first] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, held: list[tuple[int | None, Counter]], scratch: Scratch, name: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    numbers = {t: k for k, t in enumerate(sorted({t for _, counts in held for t in counts}))}
    listed = scratch.keep(postings(docs, numbers), f"{name}-postings")
    facts = listed.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").cast("long").alias("total")).first()
    weight = np.zeros(len(numbers), np.int64)
    for r in listed.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weight[r["term"]] = math.floor(1000 * math.log((2 * facts["docs"] + 2) / (2 * r["count"] + 1)))
    index = scratch.keep(quantised(listed, facts["docs"], facts["total"] or 1), f"{name}-index")
    scratch.drop(f"{name}-postings")
    shared = spark.sparkContext.broadcast(Block([counts for _, counts in held], numbers, weight))
    lows = index.select("terms", "level").mapInArrow(_least_bounds(shared, top), "item int, low long")
    ranked = lows.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low"))))
    least = np.zeros(len(held), np.int64)
    for r in ranked.filter(F.col("place") == top).select("item", "low").collect():  # one number an item
        least[r["item"]] = r["low"]
    bounds = spark.sparkContext.broadcast(least)
    found = index.select("doc_id", "m", "terms", "level", "tf").mapInArrow(_rescored(shared, bounds, top), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(held)], "item int, item_id long")
    out = scratch.keep(first.join(names, "item").select("item_id", "rank", "doc_id", "score"), f"{name}-found")
    scratch.drop(f"{name}-index")
    return out


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the top rows of docs (doc_id, text) for each row of items (item_id, text).

    Index and search take two readings of compact tables after one reading of the texts. The
    index holds every row, and of its terms those that the items ask for. Level 1 has a byte for
    each posting, rounded up; a first scan of it alone finds the top-th best lower bound of
    each item. The second scan gives every row whose upper bound reaches that an exact score
    from level 2; a task keeps its top of them, so many copies of one text stay few rows.

    Items are searched in blocks of BLOCK_BYTES, which bounds all that is broadcast; a block
    costs one pass over the texts. Null and empty texts have no terms: such rows are never found
    and count nowhere, such items find nothing. Equal scores go by doc_id, null last; rows of
    one doc_id are ranked each. Repeated rows of an item count once; an item_id with several
    texts is ranked for each. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "search")
    asked = items.select("item_id", F.col("text").cast("binary").alias("raw")).filter("raw IS NOT NULL").distinct()
    size = asked.agg(F.sum(F.length("raw")).alias("n")).first()["n"] or 0
    n = -(-size // BLOCK_BYTES) or 1
    parts = []
    for k in range(n):
        part = asked.filter(F.pmod(F.xxhash64("raw"), F.lit(n)) == k).collect()
        held = [(r["item_id"], counts) for r in part if (counts := Counter(terms_of(bytes(r["raw"]))))]
        if held:
            parts.append(_search_block(docs, held, scratch, f"block{k}", top))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, parts)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
counted AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM counted),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
asked AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT q, item_id, term, count(*) AS repeats FROM (SELECT q, item_id, unnest(terms) AS term FROM asked) GROUP BY ALL),
scored AS (SELECT q, item_id, doc_id, r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN counted USING (r), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""
