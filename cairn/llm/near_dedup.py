"""Operator 7: near-duplicate documents by order MinHash, verified by banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.alignment import banded_distance
from cairn.llm.common import Scratch, in_slices, row_key, table
from cairn.llm.components import connected_components

WORD = re.compile(r"\w+")
#: Words of a shingle; least similarity of shingles, and the share of the longer text that edits may
#: touch then; the share that they may touch whatever it does to shingles (one edit spoils five).
SHINGLE, SIMILARITY, FAR, NEAR = 5, 0.8, 0.2, 0.1
#: Samples of a text, and shingles in a sample.
SAMPLES, KEPT = 36, 3
#: Groups that a text's words are dealt to, whose parities bound the words that two texts differ in.
GROUPS = 512
#: Rounds in which buckets are compared with one text of theirs at a time.
ROUNDS = 2
#: Shingles hashed together, which bounds a task's memory on very long texts.
COLUMNS = 1 << 15

_U = np.uint64
_rng = np.random.default_rng(7)
_MULT = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * _U(2) + _U(1)
_SEEDS = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)[:, None]
_ODD = _U(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1 << 17)
def _word(w: str) -> int:
    return xxhash.xxh3_64_intdigest(w)


def word_hashes(text: str | None) -> np.ndarray:
    return np.fromiter(map(_word, WORD.findall((text or "").lower())), np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _ODD
    return x ^ (x >> _U(29))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each shingle with its occurrence number: a shingle's second time is another k-mer."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _MULT[0]
    for i in range(1, SHINGLE):
        h += words[i : i + n] * _MULT[i]
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate(([True], s[1:] != s[:-1]))
    if not first.all():
        at = np.arange(n)
        times = np.empty(n, np.uint64)
        times[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
        h = h + times * _ODD
    return _mix(h)


def samples_of(words: np.ndarray) -> np.ndarray:
    """SAMPLES keys: of each order of all shingles the KEPT least ones, put back into text order."""
    h = shingle_hashes(words)
    if not len(h):
        return np.zeros(0, np.int64)
    best_v, best_p = None, None
    for a in range(0, len(h), COLUMNS):
        v = _mix(h[a : a + COLUMNS] ^ _SEEDS)
        p = np.broadcast_to(np.arange(a, a + v.shape[1]), v.shape)
        if best_v is not None:
            v, p = np.concatenate((best_v, v), axis=1), np.concatenate((best_p, p), axis=1)
        if v.shape[1] > KEPT:
            low = np.argpartition(v, KEPT - 1, axis=1)[:, :KEPT]
            v, p = np.take_along_axis(v, low, axis=1), np.take_along_axis(p, low, axis=1)
        best_v, best_p = v, p
    inorder = h[np.sort(best_p, axis=1)]
    key = _SEEDS[:, 0].copy()
    for i in range(inorder.shape[1]):
        key = _mix(key * _ODD + inorder[:, i])
    return key.view(np.int64)


def bag_bits(words: np.ndarray) -> np.ndarray:
    """A bit for each of GROUPS groups of words: whether it holds an odd number of the text's words.

    Each word that one of two texts has beyond the other's turns one bit, so the bits that
    differ are no more than those words.
    """
    count = np.bincount((words % _U(GROUPS)).astype(np.int64), minlength=GROUPS)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in in_slices(batches):
        t, n, keys, raw, bag = [], [], [], [], []
        for text in b.column(1).to_pylist():
            w = word_hashes(text)
            t.append(xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None)
            n.append(len(w))
            keys.append(samples_of(w).tolist())
            raw.append((w >> _U(32)).astype("<u4").tobytes())
            bag.append(bag_bits(w >> _U(32)).tolist())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(t, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(raw, pa.binary()), pa.array(bag, pa.list_(pa.int64())), *b.columns[2:]],
            ["doc_id", "t", "n", "keys", "words", "bag", *b.schema.names[2:]])


def shingle_similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Shared shingles, occurrences counted, over all shingles of both."""
    (a, na), (b, nb) = (np.unique(shingle_hashes(w.astype(np.uint64)), return_counts=True) for w in (x, y))
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(na[i], nb[j]).sum())
    every = int(na.sum() + nb.sum()) - both
    return both / every if every else 0.0


def bag_distance(x: np.ndarray, y: np.ndarray) -> int:
    """Words that one of the two has beyond the other's: no fewer edits turn one into the other."""
    every, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    more = np.bincount(at[: len(x)], minlength=len(every)) - np.bincount(at[len(x) :], minlength=len(every))
    return int(max(more[more > 0].sum(), -more[more < 0].sum()))


def are_near(x: np.ndarray, y: np.ndarray) -> bool:
    """Banded alignment of two word sequences: at most NEAR of the longer one differs, or at most FAR
    with shingles that are similar."""
    n = max(len(x), len(y))
    bag = bag_distance(x, y)
    if bag > FAR * n + 1e-9:
        return False
    most = int((FAR if shingle_similarity(x, y) >= SIMILARITY else NEAR) * n + 1e-9)
    return bag <= most and banded_distance(x.tolist(), y.tolist(), most) <= most


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in in_slices(batches):
        pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
        ok = [are_near(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["a", "b", "similar"])


def find_near_duplicates(docs: DataFrame, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, class_id, kept (and carry): one row per input row, with the least doc_id of its class.

    Words are lower-case runs of letters, digits and underscores. Two different texts link if
    they share samples and are_near holds: their word sequences differ by at most a tenth of
    the longer one (edit distance), or by at most a fifth while their five-word shingles are
    similar by 0.8 or more. Classes are what links connect. Texts with equal word sequences are one
    text from the start, so copies are never paired. A text without words, null or empty, is
    a class of its own (class_id is its doc_id); one of fewer than five words links with its
    copies only. kept is true for one row of each class: that of the least doc_id, and of
    repeated rows with that doc_id one. A null doc_id is the largest of its class. Other
    columns are ignored; an empty table gives an empty result.

    Texts that share a sample form a bucket. A bucket is first compared with one text of its
    own, ROUNDS times with another one: that which meets most texts in all its buckets, as the
    original of many copies does. So a large group of near copies costs one comparison each.
    Then all texts of a bucket that lie in different classes are compared, unless lengths or
    word parities (bag_bits) show that they cannot link: each edit changes two words at most, and
    where shingles are similar by s, texts of n and m words have at most (1 - s) / (1 + s)
    (n + m - 8) + 8 words that are not in both, as each shared shingle begins with a shared word.
    A pair is met in the first bucket that its texts share. No bucket has a cap, none is gathered in a task, and pairs already connected are not
    compared again. Two texts that differ in a twentieth of their words share a sample with a
    probability of 0.999, in a tenth with 0.93; classes are joined by any of their links.
    """
    scratch = Scratch(docs.sparkSession, "near")
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"doc_id {kind}, t binary, n int, keys array<long>, words binary, bag array<long>{extra}"
    rows = scratch.keep(docs.select("doc_id", "text", *carry).mapInArrow(_sketch, schema), "rows")
    texts = scratch.keep(
        rows.filter("n >= 5").groupBy("t").agg(F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bag").alias("bag")), "texts"
    )
    keyed = texts.select("t", F.posexplode("keys").alias("e", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    shared = scratch.keep(keyed.join(shared, "key"), "shared")
    central = shared.groupBy("t").agg(F.sum("_c").alias("met"))  # texts that it meets in its buckets
    members = scratch.keep(shared.join(central, "t").select("key", "t", "met"), "members")
    somewhere = central.select("t")
    words = rows.select("t", "words").join(somewhere, "t", "left_semi").groupBy("t").agg(F.first("words").alias("words"))
    words = scratch.keep(words, "words")

    def compared(pairs: DataFrame, name: str, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
        one, two = (words.select(F.col("t").alias(c), F.col("words").alias(f"w{c}")) for c in "ab")
        both = pairs.join(one, "a").join(two, "b").select(*ends, "wa", "wb")
        return scratch.keep(both.mapInArrow(_distances, "a binary, b binary, similar boolean"), name)

    links, open_ = None, members
    for k in range(ROUNDS):
        lead = scratch.keep(open_.groupBy("key").agg(F.max_by("t", F.struct("met", "t")).alias("b")), f"lead{k}")
        pairs = open_.withColumnRenamed("t", "a").join(lead, "key").filter("a != b")
        found = compared(pairs.select("a", "b").distinct(), f"pairs{k}").filter("similar").select("a", "b")
        links = found if links is None else links.unionByName(found)
        if k < ROUNDS - 1:
            open_ = scratch.keep(pairs.join(found, ["a", "b"], "left_anti").select("key", F.col("a").alias("t"), "met"), f"open{k}")
    labels = scratch.keep(connected_components(links, scratch, "cc0"), "labels")
    left = _labelled(members, labels)
    sizes = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_c"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("_c", "label")).alias("main"))
    apart = scratch.keep(left.join(main, "key").filter("label != main").select("key", "t", "label", "main"), "apart")
    facts = texts.select("t", "n", "keys", *[F.col("bag")[i].alias(c) for i, c in enumerate(BAG)])
    one = apart.join(facts, "t").select("key", "main", *[F.col(c).alias(f"{c}1") for c in ("t", "label", "n", "keys", *BAG)])
    two = left.join(apart.select("key").distinct(), "key", "left_semi").join(facts, "t")
    two = two.select("key", *[F.col(c).alias(f"{c}2") for c in ("t", "label", "n", "keys", *BAG)])
    turned = reduce(Column.__add__, [F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in BAG])
    longer, every = F.greatest("n1", "n2"), F.col("n1") + F.col("n2")
    most = F.greatest(2 * NEAR * longer, (1 - SIMILARITY) / (1 + SIMILARITY) * (every - 2 * (SHINGLE - 1)) + 2 * (SHINGLE - 1))
    near = (
        (F.col("label1") != F.col("label2")) & ((F.col("t1") < F.col("t2")) | (F.col("label2") == F.col("main"))) & (F.least("n1", "n2") >= (1 - FAR) * longer - 1e-6)
        & (turned + F.abs(F.col("n1") - F.col("n2")) <= F.least(2 * FAR * longer, most) + 1e-6)
        & (F.get(F.filter("keys1", lambda x, i: x == F.get("keys2", i)), F.lit(0)) == F.col("key"))
    )
    rest = one.join(two, "key").filter(near).select(
        F.least("t1", "t2").alias("a"), F.greatest("t1", "t2").alias("b"), F.least("label1", "label2").alias("la"), F.greatest("label1", "label2").alias("lb")
    )
    more = compared(rest, "rest", ("la", "lb")).filter("similar").select("a", "b").distinct()
    joined = scratch.keep(connected_components(more, scratch, "cc1"), "joined")  # classes that direct comparison joins
    named = joined.toDF("_node", "_label")
    alone = joined.join(labels, "node", "left_anti")
    labels = labels.join(named, F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_label", "label").alias("label")).unionByName(alone)

    classed = rows.select("doc_id", "t", *carry).join(labels.withColumnRenamed("node", "t"), "t", "left")
    classed = scratch.keep(classed.select("doc_id", F.coalesce("label", "t").alias("label"), *carry), "classed")
    least = classed.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("class_id"))
    out = classed.join(least, "label", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    mine = out.select("doc_id", "class_id", "label", *carry, F.monotonically_increasing_id().alias("_at"))
    mine = scratch.keep(mine, "classes")
    scratch.drop_all_but("classes")
    first = mine.filter(F.col("label").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = first.groupBy("label").agg(F.min("_at").alias("_first"))
    kept = F.col("label").isNull() | (F.coalesce(F.col("_first"), F.lit(-1)) == F.col("_at"))
    return mine.join(first, "label", "left").select("doc_id", "class_id", kept.alias("kept"), *carry)


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.withColumnRenamed("node", "t").withColumnRenamed("label", "_label")
    return members.join(named, "t", "left").withColumn("label", F.coalesce("_label", "t")).drop("_label")


BAG = [f"g{i}" for i in range(GROUPS // 64)]


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that find_near_duplicates keeps: one of each class."""
    key = row_key(*[F.col(c) for c in sorted(docs.columns)])
    keyed = docs.select("*", *[k.alias(f"_{n}") for k, n in zip(key, ("k1", "k2"), strict=True)])
    named = find_near_duplicates(keyed, ["_k1", "_k2"])
    kept = named.filter("kept").groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_c"))
    same = Window.partitionBy("_k1", "_k2").orderBy(F.lit(1))
    stay = keyed.join(kept, ["_k1", "_k2"]).withColumn("_r", F.row_number().over(same))
    return stay.filter("_r <= _c").select(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near_duplicates(table(spark, sf_dir, "documents"))
