"""Operator 10: repeated 200-byte strings by a sparse suffix array, sorted deep-shallow."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, in_slices, row_key, table, text_bytes
from cairn.llm.suffix_sort import deep_shallow_sort

WIDTH = 200  # bytes of a repeated string
GRAM = 32  # bytes of an anchor
REACH = WIDTH - GRAM  # anchors are minima over the REACH + 1 grams of a string
#: Windows looked at together within one text, and low bits of a gram's hash that hold its place.
CHUNK, PLACE_BITS = 1 << 20, 21
#: Different spans of a group that are sorted together; a larger group is split by more of the bytes around its anchor.
GROUP_SPANS = 2000
#: Spans that one call sorts.
SORT_SPANS = 20_000

BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    m = 1
    while m < n:
        k = min(m, n - m)
        p[m : m + k] = p[:k] * _U(pow(base, m, 1 << 64))
        m += k
    return p


_POW = _powers(BASE, 1 << 12)
_INV = _powers(pow(BASE, -1, 1 << 64), 1 << 12)
_BYTE = np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any part of raw follows by one subtraction and one product."""
    global _POW, _INV
    n = len(raw)
    if n + 1 > len(_POW):
        size = 1 << (n + 1).bit_length()
        _POW, _INV = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _INV[:n], out=s[1:])
    return s


def window_runs(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows that share an anchor, for a text of at least WIDTH bytes.

    The anchor of a window is its GRAM with the least hash, the leftmost of equals, so equal
    windows have equal anchors at equal places in them. Returns for each run the anchor's hash,
    an independent hash of all bytes that its windows cover (with their number and the anchor's
    place), the first window's start, the number of windows, and the anchor's distance from that
    start.
    """
    s = _sums(raw)
    n = len(raw)
    grams = _mix((s[GRAM:] - s[:-GRAM]) * _POW[: n - GRAM + 1])
    low = _U((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= REACH + 1:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if rest := REACH + 1 - size:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & low).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
    count = np.diff(np.concatenate((first, [len(anchor)])))
    at = anchor[first] - first
    whole = raw.tobytes()
    stop, seed = (first + count - 1 + WIDTH).tolist(), (count * (1 << 10) + at).tolist()
    span = [xxhash.xxh3_64_intdigest(whole[a:z], k) for a, z, k in zip(first.tolist(), stop, seed, strict=True)]
    return grams[anchor[first]].view(np.int64), np.array(span, np.uint64).view(np.int64), first, count, at


def _chunks(text: bytes) -> Iterator[tuple[int, bytes]]:
    for a in range(0, max(len(text) - WIDTH + 1, 0), CHUNK):
        yield a, text[a : a + CHUNK + WIDTH - 1]


RUNS = "k1 long, k2 long, anchor long, span long, start long, n int, at int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in in_slices(batches):
        k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for i, text in enumerate(b.column(2).to_pylist()):
            for a, part in _chunks(text):
                anchor, span, first, n, at = window_runs(np.frombuffer(part, np.uint8))
                out.append((np.full(len(n), k1[i]), np.full(len(n), k2[i]), anchor, span, first + a, n.astype(np.int32), at.astype(np.int32)))
        if out:
            cols = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "anchor", "span", "start", "n", "at"])


#: A part of a span: its group and content, the span it comes from (and how many windows before it
#: the part begins), in how many places that is held, windows, the anchor's place, bytes; the range
#: lo to hi of the anchor's places in a window that its group stands for.
PARTS = "grp long, content long, anchor long, span long, skip int, held long, n int, at int, lo int, hi int, raw binary"
PART_FIELDS = ["grp", "content", "anchor", "span", "skip", "held", "n", "at", "lo", "hi", "raw"]
PART_KINDS = [*[pa.int64()] * 4, pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.binary()]


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(PART_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, PART_KINDS, strict=True)], PART_FIELDS)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole spans that a text was picked to give; their anchor is their group."""
    for b in in_slices(batches):
        rows = []
        for text, picks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for p in picks:
                raw = text[p["start"] : p["start"] + p["n"] - 1 + WIDTH]
                rows.append((p["anchor"], p["span"], p["anchor"], p["span"], 0, p["held"], p["n"], p["at"], 0, REACH, raw))
        yield _part_batch(rows)


def quarters(n: int, at: int, lo: int, hi: int, raw: bytes) -> Iterator[tuple]:
    """The windows of a part with their anchor at lo to hi, by quarters of that range.

    All windows of a quarter have more bytes around the anchor in common, at any rate low before
    it and REACH - high after it; these name the quarter's group, so equal windows stay in one
    group. A range of one place is a single window and all of it its group's name. Yields grp,
    content, windows left out before the quarter, n, at, low, high, raw.
    """
    size = -(-(hi - lo + 1) // 4)
    for low in range(lo, hi + 1, size):
        high = min(low + size - 1, hi)
        first, last = min(high, at), max(low, at - n + 1)  # the anchor's place in the quarter's first and last window
        if first < last:
            continue
        part = raw[at - first : at + GRAM + REACH - last]
        core = part[first - low : first + GRAM + REACH - high]
        grp, content = xxhash.xxh3_64_intdigest(core, low << 8 | high), xxhash.xxh3_64_intdigest(part, 1 << 16 | last << 8 | first)
        yield grp, content, at - first, first - last + 1, first, low, high, part


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for anchor, span, skip, held, n, at, lo, hi, raw in zip(*(b.column(c).to_pylist() for c in PART_FIELDS[2:]), strict=True):
            for grp, content, more, *rest in quarters(n, at, lo, hi, raw):
                signed = np.array([grp, content], np.uint64).view(np.int64).tolist()
                rows.append((*signed, anchor, span, skip + more, held, *rest))
        yield _part_batch(rows)


def repeated_windows(group: np.ndarray, held: np.ndarray, n: np.ndarray, at: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """bool[span, window]: whether the span's window is found again, in it or in another span.

    Spans of one group have the same anchor. What follows each anchor and what precedes it (read
    backwards) are two suffix arrays. Windows whose anchor lies o bytes in are equal when the parts of o bytes before and of REACH - o bytes
    after the anchor are: when no shorter common prefix parts them in either array. A span held
    in two or more places repeats all its windows.
    """
    right, rlcp = deep_shallow_sort(group, [r[a + GRAM :] for r, a in zip(raw, at.tolist(), strict=True)])
    left, llcp = deep_shallow_sort(group, [r[:a][::-1] for r, a in zip(raw, at.tolist(), strict=True)])
    m = len(raw)
    out = np.zeros((m, REACH + 1), bool)
    lclass, rclass = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(REACH + 1):
        here = np.flatnonzero((o <= at) & (o > at - n))
        if not len(here):
            continue
        lclass[left] = np.cumsum(llcp < o)
        rclass[right] = np.cumsum(rlcp < REACH - o)
        _, which = np.unique(lclass[here] * (m + 1) + rclass[here], return_inverse=True)
        again = np.bincount(which, weights=held[here])[which] >= 2
        out[here, at[here] - o] = again
    return out


REPEATS = "grp long, content long, lo array<int>, hi array<int>"


def _stretches(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2].tolist(), edge[1::2].tolist()


def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the groups in a partition, whose rows come sorted by group."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        group, held, n, at = (rows.column(c).to_numpy() for c in ("grp", "held", "n", "at"))
        found = repeated_windows(group, held, n, at, rows.column("raw").to_pylist())
        cuts = [_stretches(f) for f in found]
        return pa.RecordBatch.from_arrays(
            [pa.array(group), pa.array(rows.column("content").to_numpy()), pa.array([c[0] for c in cuts], pa.list_(pa.int32())), pa.array([c[1] for c in cuts], pa.list_(pa.int32()))],
            ["grp", "content", "lo", "hi"])

    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        while len(rest) >= SORT_SPANS:  # whole groups only: the last one may go on
            a = rest.column("grp").to_numpy()
            cut = int(np.searchsorted(a, a[-1]))
            if not cut:
                break
            yield done(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield done(rest)


def _repeats_of(spans: DataFrame, group_spans: int, scratch: Scratch) -> DataFrame:
    """anchor, span, lo, hi: the stretches of repeated windows of each span.

    Groups of at most group_spans different contents are sorted; larger ones are quartered by
    the place of the anchor in the windows until they fit, which takes four rounds at most. A
    part costs one row a round, and most drop out early: a group held once repeats nothing, and one of
    a single content repeats all its windows.
    """
    found, parts, k = None, spans, 0
    while not parts.isEmpty():
        sizes = parts.groupBy("grp", "content").agg(F.sum("held").alias("held")).groupBy("grp")
        sizes = scratch.keep(sizes.agg(F.count(F.lit(1)).alias("_c"), F.sum("held").alias("_held")).filter("_held > 1"), f"sizes{k}")
        parts = scratch.keep(parts.join(sizes.hint("shuffle_hash"), "grp").drop("_held"), f"parts{k}")
        alike = parts.filter("_c = 1").select("anchor", "span", F.array("skip").alias("lo"), F.array(F.col("skip") + F.col("n")).alias("hi"))
        some = parts.filter((F.col("_c") > 1) & (F.col("_c") <= group_spans))
        once = some.groupBy("grp", "content").agg(F.sum("held").alias("held"), *[F.first(c).alias(c) for c in ("n", "at", "raw")])
        sorted_ = once.repartition("grp").sortWithinPartitions("grp").mapInArrow(_sorted_repeats, REPEATS).filter(F.size("lo") > 0)
        sorted_ = scratch.keep(sorted_, f"sorted{k}")
        moved = [F.transform(c, lambda x: x + F.col("skip")).alias(c) for c in ("lo", "hi")]
        got = alike.unionByName(some.select("grp", "content", "anchor", "span", "skip").join(sorted_, ["grp", "content"]).select("anchor", "span", *moved))
        got = scratch.keep(got, f"got{k}")
        found = got if found is None else found.unionByName(got)
        large = parts.filter(F.col("_c") > group_spans).drop("_c")
        parts, k = scratch.keep(large.mapInArrow(_split, PARTS), f"split{k}"), k + 1
        scratch.drop(*[f"{n}{k - 1}" for n in ("sizes", "parts", "sorted")])
    return scratch.spark.createDataFrame([], "anchor long, span long, lo array<int>, hi array<int>") if found is None else found


def _remover(n_carry: int, width: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            kept, gone, parts = [], [], []
            for text, cuts in zip(b.column(n_carry).to_pylist(), b.column(n_carry + 1).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for a, z in sorted((c["a"], c["z"] + width - 1) for c in cuts or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], z)
                    else:
                        runs.append([a, z])
                edges = [0, *[x for r in runs for x in r], len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                gone.append(sum(z - a for a, z in runs))
                parts.append([{"start": a, "stop": z} for a, z in runs])
            lengths = pa.array([len(x) for x in b.column(n_carry).to_pylist()], pa.int64())
            spans = pa.array(parts, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n_carry], lengths, pa.array(gone, pa.int64()), pa.array([len(p) for p in parts], pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept]), spans, pa.array(kept, pa.binary())],
                [*b.schema.names[:n_carry], "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])

    return remove


def dedup_substrings(docs: DataFrame, carry: list[str] = ["doc_id"], group_spans: int = GROUP_SPANS) -> DataFrame:  # noqa: B006
    """Remove each byte that lies in a 200-byte string which starts anywhere else too.

    Texts are UTF-8 bytes (null: none); strings never cross texts, may overlap, and are judged on
    the input. Repeated rows repeat each other. Returns carry, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256, removed (the runs) and kept (the other bytes; no
    character is kept whole by force). Columns not in carry are ignored; an empty table gives
    an empty result.

    Only suffixes that start in reach of a repeated anchor are sorted. A first pass reduces each
    text to runs of windows that share an anchor, some 85 windows a row. A run whose anchor
    occurs once is unique; where all runs of an anchor cover the same bytes, all windows repeat;
    of the others each different span goes, once, to the task that sorts its anchor's
    neighbourhood. An anchor with more than group_spans different spans is first split by the
    bytes around it (quarters), so no task sorts more and no window is a row. Equality of spans
    and groups rests on two independent 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    key = row_key(*[F.col(c) for c in dict.fromkeys([*carry, "text"])])
    runs = scratch.keep(docs.select(*key, text_bytes().alias("_text")).mapInArrow(_runs, RUNS), "runs")

    per_anchor = runs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("total"), F.min("span").alias("_lo"), F.max("span").alias("_hi")
    )
    often = per_anchor.filter("total > 1").select("anchor", (F.col("_lo") == F.col("_hi")).alias("alike"))
    often = scratch.keep(often, "often")  # both sides of the join are plain tables, so a hot anchor can be split
    repeated = scratch.keep(runs.join(often.hint("shuffle_hash"), "anchor"), "repeated")
    scratch.drop("runs", "often")

    place = F.struct("k1", "k2", "start", "n", "at")
    different = (
        repeated.filter(~F.col("alike")).groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("held"), F.min(place).alias("_p"))
    )
    picks = different.groupBy("_p.k1", "_p.k2").agg(
        F.collect_list(F.struct("anchor", "span", "held", "_p.start", "_p.n", "_p.at")).alias("_picks")
    )
    texts = docs.select(*key, text_bytes().alias("_text"))
    spans = scratch.keep(
        texts.join(picks, ["k1", "k2"]).select("_text", "_picks").mapInArrow(_cut, PARTS).dropDuplicates(["anchor", "span"]), "spans"
    )
    repeats = _repeats_of(spans, group_spans, scratch)

    in_texts = repeated.filter(~F.col("alike")).join(repeats, ["anchor", "span"])
    cuts = in_texts.select("k1", "k2", "start", F.explode(F.arrays_zip("lo", "hi")).alias("_c")).select(
        "k1", "k2", (F.col("start") + F.col("_c.lo")).alias("a"), (F.col("start") + F.col("_c.hi")).alias("z")
    )
    sure = repeated.filter("alike").select("k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("z"))
    per_text = scratch.keep(
        cuts.unionByName(sure).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "z")).alias("_cuts")), "cuts"
    )
    scratch.drop_all_but("cuts")

    rows = docs.select(*carry, text_bytes().alias("_text"), *key).join(per_text, ["k1", "k2"], "left").select(*carry, "_text", "_cuts")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields]
    out = ", ".join([*fields, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>, kept binary"])
    return rows.mapInArrow(_remover(len(carry), WIDTH), out)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("removed", "kept")

