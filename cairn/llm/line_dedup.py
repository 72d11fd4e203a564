"""Operator 4: reversible line dedup over sharded cuckoo filters and exact reference counts."""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, in_slices, row_key, table, text_bytes
from cairn.llm.cuckoo import CuckooFilter

#: What is stripped from both ends of a line: \x20 and \x09 to \x0D.
BLANK = b" \t\n\x0b\x0c\r"
#: Frequent keys that one filter shard is planned for, the bytes up to which filters are broadcast, and
#: lines that one copy of a larger set's shard is planned for.
SHARD_KEYS, BROADCAST_BYTES, SHARD_LINES = 100_000, 64 << 20, 4_000_000
REFS = "h1 long, h2 long, n long"
FILTERS = "shard int, filter binary"


def keys_of(text: bytes) -> list[bytes | None]:
    """A 128-bit key for each line: stripped, ASCII lower case; None for an empty key."""
    lines = (x.strip(BLANK).lower() for x in text.split(b"\n"))
    return [xxhash.xxh3_128_digest(x) if x else None for x in lines]


def _pairs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for part in in_slices(iter([batch])):
            for text in part.column(0).to_pylist():
                seen.update({k for k in keys_of(text) if k})
        h1, h2 = _pairs(list(seen))
        yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(list(seen.values()), pa.int64())], ["h1", "h2", "n"])


def count_lines(docs: DataFrame) -> DataFrame:
    """h1, h2, n: in how many rows each line key occurs. Counts meet by partial sums."""
    each = docs.select(text_bytes()).mapInArrow(_count_keys, REFS)
    return each.groupBy("h1", "h2").agg(F.sum("n").alias("n"))


class LineIndex:
    """Reference counts of all line keys, and cuckoo filters of those in min_docs or more rows.

    refs is exact and holds every key; filters hold the frequent ones, one filter a shard, so
    that each is built and changed in a task of its own. insert() and delete() return a new
    index: counts are added or taken off, and only keys whose state changed go into or out of
    the filters, so deleting what was inserted brings the old state back.
    """

    def __init__(self, scratch: Scratch, refs: DataFrame, filters: DataFrame, n_shards: int, min_docs: int, step: int = 0):
        self.scratch, self.refs, self.filters = scratch, refs, filters
        self.n_shards, self.min_docs, self.step = n_shards, min_docs, step

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10) -> LineIndex:
        scratch = Scratch(docs.sparkSession, "lines")
        refs = scratch.keep(count_lines(docs), "refs0")
        n_shards = -(-refs.filter(F.col("n") >= min_docs).count() // SHARD_KEYS) or 1
        return cls._built(scratch, refs, n_shards, min_docs)

    @classmethod
    def _built(cls, scratch: Scratch, refs: DataFrame, n_shards: int, min_docs: int, step: int = 0) -> LineIndex:
        empty = scratch.spark.createDataFrame([], FILTERS)
        index = cls(scratch, refs, empty, n_shards, min_docs, step)
        index.filters = scratch.keep(index._changed(empty, refs.select("h1", "h2", "n", F.lit(0).alias("was")), refs), f"filters{step}")
        return index

    def _changed(self, filters: DataFrame, moves: DataFrame, refs: DataFrame) -> DataFrame:
        """Filters after moves (h1, h2, n, was); a filter that runs full is built anew from refs."""
        least = self.min_docs
        shard = F.pmod("h1", F.lit(self.n_shards)).cast("int").alias("shard")
        now, was = F.col("n") >= least, F.col("was") >= least
        flips = moves.filter(now != was).select(shard, "h1", "h2", now.alias("now"))

        def change(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            ins, gone = new[new["now"]], new[~new["now"]]
            f = CuckooFilter.loads(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(len(ins))
            f.delete(gone["h1"].to_numpy(), gone["h2"].to_numpy())
            fits = f.insert(ins["h1"].to_numpy(), ins["h2"].to_numpy())
            at = int((old if len(old) else new)["shard"].iloc[0])
            return pd.DataFrame({"shard": [at], "filter": [f.dumps() if fits else None]})

        changed = self.scratch.keep(
            filters.groupBy("shard").cogroup(flips.groupBy("shard")).applyInPandas(change, FILTERS), f"changed{self.step}"
        )

        def rebuild(rows: pd.DataFrame) -> pd.DataFrame:
            h1, h2 = rows["h1"].to_numpy(), rows["h2"].to_numpy()
            n = 2 * len(h1)
            while not (f := CuckooFilter.sized(n)).insert(h1, h2):
                n *= 2
            return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "filter": [f.dumps()]})

        full = changed.filter(F.col("filter").isNull()).select("shard")
        again = refs.filter(F.col("n") >= least).select(shard, "h1", "h2").join(full, "shard", "left_semi")
        return changed.filter(F.col("filter").isNotNull()).unionByName(again.groupBy("shard").applyInPandas(rebuild, FILTERS))

    def _moved(self, docs: DataFrame, sign: int) -> LineIndex:
        step = self.step + 1
        delta = count_lines(docs).select("h1", "h2", (F.col("n") * sign).alias("d"))
        both = self.refs.select("h1", "h2", "n", F.lit(0).cast("long").alias("d")).unionByName(
            delta.select("h1", "h2", F.lit(0).cast("long").alias("n"), "d")
        )
        moved = self.scratch.keep(
            both.groupBy("h1", "h2").agg(F.sum("n").alias("was"), F.sum(F.col("n") + F.col("d")).alias("n")), f"moved{step}"
        )
        refs = moved.filter(F.col("n") > 0).select("h1", "h2", "n")
        shards = -(-refs.filter(F.col("n") >= self.min_docs).count() // SHARD_KEYS)
        if shards > 2 * self.n_shards:  # filters have outgrown their tasks: more of them, built from the counts
            return LineIndex._built(self.scratch, refs, shards, self.min_docs, step)
        out = LineIndex(self.scratch, refs, self.filters, self.n_shards, self.min_docs, step)
        out.filters = self.scratch.keep(out._changed(self.filters, moved, refs), f"filters{step}")
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._moved(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """docs must have been inserted before."""
        return self._moved(docs, -1)

    def apply(self, docs: DataFrame, carry: list[str] = ["doc_id"], counted: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:  # noqa: B006
        """carry, kept_text, n_lines, n_dropped, kept_sha256 of every row of docs.

        Up to broadcast_bytes of filters go to every task. A filter may say yes to a key that is
        not frequent, so the keys for which it does are looked up in the exact counts first and
        travel along; decisions are exact. Larger filters stay sharded: lines go to their shard's
        filter, and those that pass it meet the exact counts. counted says that docs are those
        the index counts.
        """
        rows = docs.select(*carry, text_bytes().alias("_text"))
        fields = [f for f in rows.schema.fields if f.name != "_text"]
        extra = "kept_text string, n_lines long, n_dropped long, kept_sha256 string"
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [extra])
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size <= broadcast_bytes:
            filters = {r["shard"]: CuckooFilter.loads(r["filter"]) for r in self.filters.collect()}
            test = self._with_exceptions(docs, filters, counted, broadcast_bytes)
            if test:
                return rows.mapInArrow(_dropper(len(carry), test), schema)
        return self._joined(docs, carry, schema)

    def _probe(self, filters: dict[int, CuckooFilter]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        n = self.n_shards

        def probe(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
            out = np.zeros(len(h1), bool)
            shard = h1 % n
            for k, f in filters.items():
                at = np.flatnonzero(shard == k) if n > 1 else slice(None)
                out[at] = f.contains(h1[at], h2[at])
            return out

        return probe

    def _with_exceptions(self, docs: DataFrame, filters: dict[int, CuckooFilter], counted: bool, most: int):
        probe = self._probe(filters)

        def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(probe(b.column(0).to_numpy(), b.column(1).to_numpy())))

        if counted:
            keys = self.refs.filter(F.col("n") < self.min_docs).select("h1", "h2")
            wrong = keys.mapInArrow(positive, "h1 long, h2 long")
        else:
            keys = count_lines(docs).select("h1", "h2").mapInArrow(positive, "h1 long, h2 long")
            wrong = keys.join(self.refs.filter(F.col("n") >= self.min_docs), ["h1", "h2"], "left_anti")
        some = wrong.limit(most // 64 + 1).collect()
        if len(some) > most // 64:
            return None
        no = {np.array([r[0], r[1]], np.int64).tobytes() for r in some}

        def test(keys: list[bytes]) -> np.ndarray:
            yes = probe(*_pairs(keys))
            if no:
                yes &= np.array([k not in no for k in keys], bool)
            return yes

        return test

    def _joined(self, docs: DataFrame, carry: list[str], schema: str) -> DataFrame:
        """The way for filters of any size: lines pass their shard's filter and join the exact counts,
        texts join the numbers of their lines.

        A shard with many lines has copies of its filter, among which the lines are dealt, and a
        task streams the lines past the filter, so a line that very many documents hold is no load.
        """
        key = row_key(*[F.col(c) for c in dict.fromkeys([*carry, "text"])])
        frequent = self.refs.filter(F.col("n") >= self.min_docs).select("h1", "h2")
        lines = docs.select(*key, text_bytes().alias("_text")).mapInArrow(_numbered, NUMBERED)
        shard = F.pmod("h1", F.lit(self.n_shards)).cast("int").alias("shard")
        copies = self.refs.groupBy(shard).agg(F.ceil(F.sum("n") / SHARD_LINES).cast("int").alias("_copies"))
        copies = self.scratch.keep(copies, f"copies{self.step}-{uuid.uuid4().hex}")
        lines = lines.withColumn("shard", shard).join(copies, "shard", "left")
        lines = lines.select("shard", F.pmod(F.xxhash64("k1", "k2", "at"), F.coalesce("_copies", F.lit(1))).cast("int").alias("copy"), *LINE)
        filters = self.filters.join(copies, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)).alias("copy"), "filter")
        both = filters.unionByName(lines, allowMissingColumns=True).select("shard", "copy", "filter", *LINE)
        both = both.repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("filter").isNull())
        drops = both.mapInArrow(_passing, NUMBERED).join(frequent, ["h1", "h2"]).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("_at"))
        rows = docs.select(*[F.col(c) for c in carry], text_bytes().alias("_text"), *key).join(drops, ["k1", "k2"], "left")
        return rows.select(*carry, "_text", "_at").mapInArrow(_dropper(len(carry), None), schema)


LINE = ["k1", "k2", "at", "h1", "h2"]
NUMBERED = "k1 long, k2 long, at int, h1 long, h2 long"


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines that follow their shard's filter those that it may hold; a shard without one holds none."""
    now, f = None, None
    for b in batches:
        shard, copy = b.column("shard").to_numpy(), b.column("copy").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (copy[1:] != copy[:-1]), [True])))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if (at := (int(shard[a]), int(copy[a]))) != now:
                now, f = at, None
            raw = b.column("filter")[a].as_py()
            if raw is not None:
                f, a = CuckooFilter.loads(raw), a + 1
            lines = b.slice(a, z - a).select(LINE)
            if f and len(lines):
                yield lines.filter(pa.array(f.contains(lines.column("h1").to_numpy(), lines.column("h2").to_numpy())))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in in_slices(batches):
        k1, k2 = b.column(0).to_pylist(), b.column(1).to_pylist()
        out: list[tuple] = []
        for x, y, text in zip(k1, k2, b.column(2).to_pylist(), strict=True):
            out += [(x, y, i, k) for i, k in enumerate(keys_of(text)) if k]
        h1, h2 = _pairs([o[3] for o in out])
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
             pa.array([o[2] for o in out], pa.int32()), pa.array(h1), pa.array(h2)], ["k1", "k2", "at", "h1", "h2"])


def _dropper(n_carry: int, test: Callable[[list[bytes]], np.ndarray] | None):
    """Drops the lines whose keys pass test, or else those whose numbers stand in the last column."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            texts = b.column(n_carry).to_pylist()
            if test:
                keys = [keys_of(t) for t in texts]
                flat = [k for ks in keys for k in ks if k]
                yes = iter(test(flat).tolist())
                gone = [[bool(k) and next(yes) for k in ks] for ks in keys]
            else:
                at = [set(x or ()) for x in b.column(n_carry + 1).to_pylist()]
                gone = [[i in a for i in range(t.count(b"\n") + 1)] for t, a in zip(texts, at, strict=True)]
            kept = [b"\n".join(x for x, g in zip(t.split(b"\n"), gs, strict=True) if not g) for t, gs in zip(texts, gone, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n_carry], pa.array(kept, pa.binary()).cast(pa.string()), pa.array([len(g) for g in gone], pa.int64()),
                 pa.array([sum(g) for g in gone], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                [*b.schema.names[:n_carry], "kept_text", "n_lines", "n_dropped", "kept_sha256"])

    return drop


def dedup_lines(docs: DataFrame, min_docs: int = 10, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """Drop every line whose key occurs in min_docs or more rows, in every row.

    A text is split at \\n; null and empty texts are one empty line. A key is the line without
    BLANK at its ends, A-Z lower-cased. Empty keys stay. A row is a document: repeated rows
    each count. Returns carry (as given), kept_text, n_lines, n_dropped, kept_sha256; columns
    not in carry are ignored. An empty table gives an empty result.
    """
    return LineIndex.build(docs, min_docs).apply(docs, carry)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).drop("kept_text")


OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT rid, i, parts[i] AS line,
             translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT rid, parts, unnest(range(1, len(parts) + 1)) AS i FROM d)),
f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f USING (key) JOIN d USING (rid) GROUP BY rid, doc_id
"""
