"""Operator 8: near-duplicate embeddings by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, table
from cairn.llm.components import connected_components

THRESHOLD = 0.98
#: Neighbours in a list, random orders that the first lists come from, rows of an order looked at together.
LIST, ORDERS, SPAN = 10, 6, 96
#: The share of new list entries below which rounds end.
SETTLED = 0.002
#: Vectors of a component that are multiplied with as many others at once.
BLOCK = 1024
#: Query vectors that one pass of the audit compares with all rows.
QUERIES = 2048
#: Vectors of each label and length that a run compares with all others to see what its search missed, QUERIES in all at most; as
#: long as any of them has missed a link, lists are doubled and the search is run again.
AUDITED = 48


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, named by a hash of label, length and bytes; null where one can link with nothing."""
    for b in batches:
        t, raw = [], []
        double = pa.types.is_float64(b.column(2).type.value_type)
        for label, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            ok = label is not None and x and None not in x
            v = np.array(x, np.float64 if double else np.float32) if ok else np.zeros(0)
            ok = bool(ok and np.isfinite(v).all() and v.any())
            raw.append(v.astype(np.float64).tobytes() if ok and double else v.astype(np.float32).tobytes() if ok else None)
            t.append(xxhash.xxh3_128_digest(f"{label}|{len(v)}|".encode() + raw[-1]) if ok else None)
        names = pa.array([None if x is None else f"{l}|{len(r)}" for l, x, r in zip(b.column(1).to_pylist(), t, raw, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.binary()), names, pa.array(raw, pa.binary())], ["vec_id", "t", "grp", "v"])


def _unit(raw: list[bytes], double: bool) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), np.float64 if double else np.float32).reshape(len(raw), -1).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _projected(double: bool):
    """For each order a value: the vector's place along a random direction, behind the signs of a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("v").to_pylist()
            keys: list = [None] * len(raw)
            lengths = np.array([len(r) for r in raw])
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                u = _unit([raw[i] for i in at], double)
                d = np.random.default_rng(8).standard_normal((ORDERS, 7, u.shape[1]))
                p = np.einsum("nd,okd->nok", u, d)
                place = (p[:, :, :6] > 0) @ (2.0 ** np.arange(6)[::-1]) + np.clip(p[:, :, 6] / 200 + 0.5, 0, 0.999)
                for i, row in zip(at.tolist(), place.tolist(), strict=True):
                    keys[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.list_(pa.float64()))], [*b.schema.names, "places"])

    return run


def _linked(t: list[bytes], cos: np.ndarray) -> Iterator[tuple[bytes, bytes, None]]:
    """Each vector with the first one that links of these vectors connect it to."""
    hit, first = cos >= THRESHOLD, np.arange(len(t))
    np.fill_diagonal(hit, True)
    while True:
        low = np.where(hit, first[None, :], len(t)).min(axis=1)
        if (low == first).all():
            break
        first = low
    for i in np.flatnonzero(first < np.arange(len(t))).tolist():
        yield t[i], t[first[i]], None


def _strange(home: list) -> np.ndarray:
    """Which pairs lie in different components; those of no component are all different."""
    h = np.array([x or b"" for x in home], object)
    return (h[:, None] != h[None, :]) | (h == b"")[:, None]


def _best_of(t: list[bytes], cos: np.ndarray, k: int) -> Iterator[tuple[bytes, bytes, float]]:
    np.fill_diagonal(cos, -2)
    n = len(t)
    top = np.argpartition(-cos, min(k, n - 1) - 1, axis=1)[:, :k] if n > 1 else np.zeros((n, 0), int)
    for i in range(n):
        for j in top[i].tolist():
            if cos[i, j] > -2:
                yield t[i], t[j], float(cos[i, j])


EDGES = "a binary, b binary, cos double"


def _edge_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = [pa.binary(), pa.binary(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "cos"])


def _first_lists(double: bool, size: int):
    """Neighbours among rows that follow each other in an order, SPAN at a time; spans overlap by half."""
    span = max(SPAN, 4 * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def look(part: list[tuple]) -> pa.RecordBatch:
            u = _unit([x[2] for x in part], double)
            t, cos = [x[0] for x in part], u @ u.T
            links = list(_linked(t, cos))
            cos[~_strange([x[3] for x in part])] = -2
            return _edge_batch(list(_best_of(t, cos, size)) + links)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("t", "grp", "v", "home")), strict=True):
                if held and held[-1][1] != row[1]:
                    if len(held) > 1:
                        yield look(held)
                    held = []
                held.append(row)
                if len(held) == span:
                    yield look(held)
                    held = held[span // 2 :]
        if len(held) > 1:
            yield look(held)

    return run


def _local_join(double: bool):
    """Pairs among the neighbours of one vector that would improve the list of one of them.

    Rows (c, t, v, kth, fresh, home) come sorted by c; pairs of one home improve no list. Two neighbours are compared if one of them is
    new to the list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def look(part: list[tuple]) -> list[tuple]:
            fresh = np.array([x[4] for x in part])
            if len(part) < 2 or not fresh.any():
                return []
            u, kth = _unit([x[2] for x in part], double), np.array([x[3] for x in part])
            cos = u @ u.T
            want = (cos > kth[:, None] + 1e-12) & (fresh[:, None] | fresh[None, :]) & _strange([x[5] for x in part])
            np.fill_diagonal(want, False)
            return list(_linked([x[1] for x in part], cos)) + [(part[i][1], part[j][1], float(cos[i, j])) for i, j in np.argwhere(want).tolist()]

        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("c", "t", "v", "kth", "fresh", "home")), strict=True):
                if held and held[-1][0] != row[0]:
                    out += look(held)
                    held = []
                held.append(row)
            yield _edge_batch(list(set(out)))
        yield _edge_batch(look(held))

    return run


def _blocks(double: bool):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of each vector of one block with the vectors of the other, copies included; both ways."""
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"t": [], "n": []}).astype({"n": "int64"})
        hit = _unit(x["v"].tolist(), double) @ _unit(y["v"].tolist(), double).T >= THRESHOLD
        hit &= x["t"].to_numpy()[:, None] != y["t"].to_numpy()[None, :]
        out = [pd.DataFrame({"t": x["t"].to_numpy(), "n": hit @ y["copies"].to_numpy(np.int64)})]
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            out.append(pd.DataFrame({"t": y["t"].to_numpy(), "n": x["copies"].to_numpy(np.int64) @ hit}))
        return pd.concat(out)

    return count


def _prepared(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, bool]:
    kind = vectors.schema["vec_id"].dataType.simpleString()
    double = vectors.schema["embedding"].dataType.elementType.simpleString() == "double"
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    rows = scratch.keep(rows.mapInArrow(_vectors, f"vec_id {kind}, t binary, grp string, v binary"), "rows")
    nodes = rows.filter(F.col("t").isNotNull()).groupBy("t").agg(
        F.first("grp").alias("grp"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    )
    return rows, scratch.keep(nodes, "nodes"), double


def neighbour_lists(nodes: DataFrame, double: bool, scratch: Scratch, name: str = "", size: int = LIST) -> tuple[DataFrame, DataFrame]:
    """The size best neighbours found of each node outside its home, as a, b, cos; links that were met, as a, b.

    The links connect what pairs of THRESHOLD or more among the vectors met together connect,
    lists or not.

    First lists come from neighbours in a few random orders, cut into ranges of any number of
    tasks. Then each round lets the neighbours of a node, either way, meet each other.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(parts, nodes.count() // (4 * SPAN)))  # a range holds several spans, or few rows would have no neighbours
    placed = nodes.select("t", "grp", "v", "home").mapInArrow(_projected(double), "t binary, grp string, v binary, home binary, places array<double>")
    found = None
    for o in range(ORDERS):
        ordered = placed.select("t", "grp", "v", "home", F.col("places")[o].alias("place"))
        ordered = ordered.repartitionByRange(ranges, "grp", "place", "t").sortWithinPartitions("grp", "place", "t")
        edges = ordered.mapInArrow(_first_lists(double, size), EDGES)
        found = edges if found is None else found.unionByName(edges)
    best = Window.partitionBy("a").orderBy(F.desc("cos"), "b")

    def cut(edges: DataFrame, name: str) -> DataFrame:
        """The size best of each node, r from 1; rows are dealt by their node once for both steps."""
        known = edges.repartition(parts, "a").groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("fresh").alias("fresh"))
        return scratch.keep(known.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= size), name)

    found = scratch.keep(found, f"{name}met0")
    met_links = found.filter("cos IS NULL").select("a", "b")
    lists = cut(found.filter("cos IS NOT NULL").withColumn("fresh", F.lit(True)), f"{name}lists0")
    k = 0
    while True:
        k += 1
        kth = lists.filter(F.col("r") == size).select(F.col("a").alias("t"), F.col("cos").alias("kth"))
        back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos", "fresh")
        back = back.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= size)
        near = lists.unionByName(back).repartition(parts, "a").groupBy("a", "b").agg(F.max("fresh").alias("fresh"))
        near = near.withColumn("any", F.max("fresh").over(Window.partitionBy("a"))).filter("any").select(F.col("a").alias("c"), F.col("b").alias("t"), "fresh")
        known = nodes.select("t", "v", "home").join(kth, "t", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
        met = near.join(known, "t").select("c", "t", "v", "kth", "fresh", "home")
        new = met.repartition(parts, "c").sortWithinPartitions("c").mapInArrow(_local_join(double), EDGES)
        new = scratch.keep(new, f"{name}met{k}")
        met_links = met_links.unionByName(new.filter("cos IS NULL").select("a", "b"))
        new = new.filter("cos IS NOT NULL")
        both = lists.withColumn("fresh", F.lit(False)).select("a", "b", "cos", "fresh").unionByName(new.withColumn("fresh", F.lit(True)))
        lists = cut(both, f"{name}lists{k}")
        scratch.drop(f"{name}lists{k - 1}")
        n, fresh = lists.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if fresh <= SETTLED * n:
            break
    links = lists.filter(F.col("cos") >= THRESHOLD).select("a", "b").unionByName(met_links).distinct()
    return lists.select("a", "b", "cos"), scratch.keep(links, f"{name}links")


def _joined(nodes: DataFrame, lists: DataFrame, links: DataFrame, double: bool, scratch: Scratch, name: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Links and components once saturated vectors have found no more neighbours outside their component."""
    full = lists.groupBy(F.col("a").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("last"))
    full = scratch.keep(full.filter((F.col("n") >= size) & (F.col("last") >= THRESHOLD)).select("t"), f"{name}full")
    labels, k = scratch.keep(connected_components(links, scratch, f"{name}cc"), f"{name}labels0"), 0
    while True:
        homes = labels.select(F.col("node").alias("t"), F.col("label").alias("home"))
        crowded = scratch.keep(nodes.join(full, "t", "left_semi").join(homes, "t"), f"{name}crowded{k}")
        several = crowded.groupBy("grp").agg(F.countDistinct("home").alias("n")).filter("n > 1").select("grp")
        crowded = crowded.join(several, "grp", "left_semi")
        if crowded.isEmpty():
            return links, labels
        more = neighbour_lists(crowded, double, scratch, f"{name}again{k}-", size)[1]
        one, two = (homes.toDF(c, f"h{c}") for c in "ab")
        if more.join(one, "a").join(two, "b").filter("ha != hb").isEmpty():
            return links, labels
        k += 1
        links = links.unionByName(more)
        labels = scratch.keep(connected_components(links, scratch, f"{name}cc{k}-"), f"{name}labels{k}")


def _missed(nodes: DataFrame, labels: DataFrame, double: bool, scratch: Scratch, name: str) -> DataFrame | None:
    """Links (a, b) of AUDITED vectors a label with other components, one for each component; None if there are none."""
    homes = labels.select(F.col("node").alias("t"), F.col("label").alias("home"))
    placed = nodes.select("t", "grp", "v").join(homes, "t", "left").withColumn("home", F.coalesce("home", "t"))
    drawn = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("t", F.lit("audit")), "t"))
    picked = placed.withColumn("_drawn", drawn).filter(F.col("_drawn") <= AUDITED).orderBy("_drawn", "t").limit(QUERIES).collect()
    asked: dict[str, list] = {}
    for r in picked:
        asked.setdefault(r["grp"], []).append((bytes(r["t"]), bytes(r["home"]), bytes(r["v"])))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, grp, raw, home = (b.column(c).to_pylist() for c in ("t", "grp", "v", "home"))
            out, at = {}, {}
            for i, g in enumerate(grp):
                at.setdefault(g, []).append(i)
            for g in at.keys() & asked.keys():
                q = asked[g]
                hit = _unit([x[2] for x in q], double) @ _unit([raw[i] for i in at[g]], double).T >= THRESHOLD
                for j, i in np.argwhere(hit).tolist():
                    if home[at[g][i]] != q[j][1]:
                        out.setdefault((q[j][0], home[at[g][i]]), t[at[g][i]])
            cols = [[a for a, _ in out], [h for _, h in out], list(out.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], ["a", "home", "b"])

    met = placed.mapInArrow(meet, "a binary, home binary, b binary").groupBy("a", "home").agg(F.min("b").alias("b"))
    met = scratch.keep(met.select("a", "b"), name)
    return None if met.isEmpty() else met


def link_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row, linked at a cosine of THRESHOLD or more.

    Rows of one label and length are compared; null labels, and vectors that are null, empty,
    zero or hold null or non-finite components link with nothing (n_links 0, component_id their
    own vec_id). Equal vectors are one node, so copies are counted and never paired; repeated
    rows link with each other. Cosines are in double precision; one of exactly THRESHOLD links, and
    of components that tie for a head there is none, as the head is the least vec_id (null ones last). Other columns are ignored; an
    empty table gives an empty result.

    NN-descent finds links; lists hold LIST neighbours at first. A list whose last neighbour
    still links is saturated: saturated vectors search again for neighbours outside their
    component, until that joins no more components. Then AUDITED vectors of each label meet all
    others: links that the search missed are added, and lists are doubled and the search is run
    again until the audit finds none. Lists inside a component are enlarged to the whole component:
    its vectors are multiplied block by block, and each block pair returns one count a vector, so
    links are exact among all vectors that any found link connects, and no pair is written.
    audit_recall() measures what is still missing.
    """
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows, nodes, double = _prepared(vectors, scratch)
    links, size, k = None, LIST, 0
    while True:
        lists, found = neighbour_lists(nodes.withColumn("home", F.lit(None).cast("binary")), double, scratch, f"search{k}-", size)
        links = found if links is None else links.unionByName(found)
        links, labels = _joined(nodes, lists, links, double, scratch, f"joined{k}-", size)
        missed = _missed(nodes, labels, double, scratch, f"missed{k}")
        if missed is None:
            break
        links, k, size = links.unionByName(missed), k + 1, 2 * size
    labels = scratch.keep(labels, "labels")
    scratch.drop_all_but("rows", "nodes", "labels")
    sizes = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = labels.withColumnRenamed("node", "t").join(sizes, "label").join(nodes, "t")
    placed = placed.withColumn("k", F.pmod(F.xxhash64("t"), F.col("blocks")).cast("int"))
    later, earlier = F.explode(F.sequence(F.col("k"), F.col("blocks") - 1)), F.explode(F.sequence(F.lit(0), F.col("k")))  # pairs of blocks i <= j
    left = placed.select("label", F.col("k").alias("i"), later.alias("j"), F.lit(0).alias("side"), "t", "v", "copies")
    right = placed.select("label", earlier.alias("i"), F.col("k").alias("j"), F.lit(1).alias("side"), "t", "v", "copies")
    counted = left.unionByName(right).groupBy("label", "i", "j").applyInPandas(_blocks(double), "t binary, n long")
    counted = counted.groupBy("t").agg(F.sum("n").alias("n"))
    named = labels.withColumnRenamed("node", "t")
    heads = named.join(nodes.select("t", "least"), "t").groupBy("label").agg(F.min("least").alias("head"))
    facts = (
        nodes.select("t", "copies", "least").join(named, "t", "left").join(heads, "label", "left").join(counted, "t", "left")
        .select("t", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("head", "least").alias("head"))
    )
    out = rows.select("vec_id", "t").join(facts, "t", "left")
    head = F.coalesce("head", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), head.alias("component_id"),
        F.coalesce(F.col("vec_id") == head, F.lit(False)).alias("kept"),
    )


def audit_recall(vectors: DataFrame, result: DataFrame, every: int = 100) -> DataFrame:
    """links, found: true links of the rows whose vec_id is divisible by every, and those in n_links.

    The query rows meet all rows, QUERIES at a time; n_links never counts a pair below the
    threshold, so the ratio is the recall.
    """
    scratch = Scratch(vectors.sparkSession, "audit")
    rows, _, double = _prepared(vectors, scratch)
    good = rows.filter(F.col("t").isNotNull())
    queries = good.filter(F.col("vec_id") % every == 0)
    blocks = -(-queries.count() // QUERIES) or 1
    total = None
    for k in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).select("vec_id", "grp", "v").collect()
        mine = [(r["vec_id"], r["grp"], bytes(r["v"])) for r in part]

        def count(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            for b in batches:
                grp, raw = np.array(b.column(1).to_pylist()), b.column(2).to_pylist()
                ids, n = [], []
                for g in {m[1] for m in mine}:
                    at = np.flatnonzero(grp == g)
                    if len(at):
                        q = [m for m in mine if m[1] == g]
                        hit = _unit([m[2] for m in q], double) @ _unit([raw[i] for i in at], double).T >= THRESHOLD
                        ids += [m[0] for m in q]
                        n += hit.sum(axis=1).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["vec_id", "n"])

        got = good.select("vec_id", "grp", "v").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("true"))
        total = got if total is None else total.unionByName(got)
    both = total.join(result.select("vec_id", "n_links"), "vec_id")
    return both.agg(F.sum("true").alias("links"), F.sum("n_links").alias("found"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))
