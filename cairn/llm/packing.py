"""Operator 3: best-two-fit packing of tokenized documents into sequences of equal length."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, gapless_rank, in_slices, table

MAX_LENGTH, END_ID = 1024, 2


@lru_cache(maxsize=2)
def _encoder(path: str):
    """text -> ids as the tokenizer file gives them, its special token included.

    A vocabulary that ships as byte ranks beside the file has a faster encoder with the same
    ids; texts that hold the special token's own string go to the tokenizer itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    plain = lambda text: slow.encode(text, add_special_tokens=False).ids
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    try:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (ImportError, OSError):
        return plain
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return lambda text: plain(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def _piece_starts(length: int, most: int) -> list[int]:
    """Where pieces start: all are full but the first."""
    first = (length - 1) % most + 1
    return [0, *range(first, length, most)]


def _pieces(path: str, most: int, end_id: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in in_slices(batches):
            row: list[int] = []
            cols: list[list] = [[], [], [], [], []]
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                starts = _piece_starts(len(ids), most)
                for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    row.append(i)
                    for c, v in zip(cols, (k, a, z - a, zlib.crc32(ids[a:z].tobytes()), ids[a:z]), strict=True):
                        c.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            docs = b.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]], names)

    return cut


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (how many of each length, how many such bins), from how many documents have each length.

    A bin is filled greedily, the longest document that fits first. Then its shortest document
    is taken out again for as long as two unpacked documents fit the gap so made more tightly
    than it did. Documents of one length are alike, so a bin is made again as often as the
    lengths last; work depends on the lengths, not on the number of documents.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    while left.any():
        free, gap, held = left.copy(), capacity, {}
        while True:
            fit = np.flatnonzero(free[1 : gap + 1])
            if not len(fit):
                break
            x = int(fit[-1]) + 1
            n = int(min(free[x], gap // x))
            held[x], gap = held.get(x, 0) + n, gap - n * x
            free[x] -= n
        while gap and held:
            short = min(held)
            room = gap + short
            pair = _best_pair(free, room)
            if pair is None or sum(pair) <= short:
                break
            held[short] -= 1
            free[short] += 1
            if not held[short]:
                del held[short]
            for x in pair:
                held[x] = held.get(x, 0) + 1
                free[x] -= 1
            gap = room - sum(pair)
        times = int(min(left[x] // n for x, n in held.items()))
        for x, n in held.items():
            left[x] -= n * times
        bins.append((held, times))
    return bins


def _best_pair(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the greatest sum up to room."""
    have = np.where(free > 0, np.arange(len(free)), 0)
    below = np.maximum.accumulate(have)
    a = np.flatnonzero(free[: room + 1] > 0)
    a = a[a > 0]
    if not len(a):
        return None
    top = np.minimum(a, room - a)
    b = below[top]
    twin = (b == a) & (free[a] < 2)
    b = np.where(twin, below[np.maximum(top - 1, 0)], b)
    sums = np.where(b > 0, a + b, 0)
    best = int(np.argmax(sums))
    return (int(a[best]), int(b[best])) if sums[best] else None


def _seats(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, number in a bin, first bin, offset in the bin), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first_bin = 0
    for held, times in bins:
        offset = 0
        for x in sorted(held, reverse=True):
            rows.setdefault(x, []).append((ranks.get(x, 0), held[x], first_bin, offset))
            ranks[x] = ranks.get(x, 0) + held[x] * times
            offset += held[x] * x
        first_bin += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack_pieces(pieces: DataFrame, capacity: int = MAX_LENGTH) -> DataFrame:
    """pieces (length, _block and others, a scratch table) with sequence_id and offset.

    The driver plans from a table with one row for each length, capacity rows at most. A piece
    takes its seat by its rank among the pieces of its length; ranks come block by block, so a
    length that a third of all pieces share is never gathered.
    """
    lengths = pieces.groupBy("length").count().collect()
    seats = _seats(best_two_fit({r["length"]: r["count"] for r in lengths}, capacity))
    ranked = gapless_rank(pieces, ["length"], "_block", ["doc_id", "piece", "ids_crc32"], "_rank").drop("_block")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                here = np.flatnonzero(length == x)
                plan = seats[x]
                row = plan[np.searchsorted(plan[:, 0], rank[here], "right") - 1]
                i = rank[here] - row[:, 0]
                seq[here] = row[:, 2] + i // row[:, 1]
                off[here] = row[:, 3] + (i % row[:, 1]) * x
            kept = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank"]
    return ranked.mapInArrow(seat, ", ".join([*fields, "sequence_id long, offset long"]))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pack every document's tokens, end_id last, into as few sequences of capacity tokens as can be.

    Only documents of more than capacity tokens are cut; all their pieces but the first are
    full. Returns one row per piece: doc_id, piece, start, length, ids_crc32 (of little-endian
    unsigned 32-bit ids), sequence_id (from 0), offset, and ids if asked for. Null text counts
    as empty (one token, end_id). Repeated rows are packed each; pieces of one length are alike to
    the plan and take its places in any order. A very long text is tokenized whole, by the task
    that holds its row. Other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids), schema)
    return pack_pieces(scratch.keep(pieces.withColumn("_block", F.spark_partition_id()), "pieces"), capacity)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
