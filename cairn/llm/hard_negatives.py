"""Operator 11: hard negatives by one-dimensional distance keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, table

#: Pivots of the vectors of one length, rows that they are fitted on (and that a search starts from), and rounds of fitting.
PIVOTS, SAMPLE, FITS = 32, 4096, 6
#: Numbers in a packed block of rows, most rows of a block and of a chunk of anchors, segments looked at together.
NUMBERS, ROWS, CHUNK, SLICE = 65_536, 2048, 256, 4096
#: The share of an annulus that is scanned by the end of each round; the last one closes it.
GROWTH = (0.5, 0.75, 1.0)
#: Rounding of computed distances, as a share of the longest one.
MARGIN = 4e-6
NO_BOUND = 1 << 62

ROW = "row long, vec_id long, label long, anchor boolean, dim int, v binary, nn double"
PACKED = "block long, dim int, n int, rows binary, ids binary, labels binary, v binary, nn binary, segments array<struct<label:long,pivot:int,lo:double,hi:double>>"
FOUND = ["chunk", "pos", "j"]


def quantised(vectors: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """vec_id, label, v: each component times scale, rounded down; rows that cannot be compared are left out."""
    x, good = F.col("embedding"), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    rows = vectors.select("vec_id", label.cast("long").alias("label"), x).filter(F.col("label").isNotNull() & x.isNotNull())
    return rows.filter(F.forall(x, good)).select("vec_id", "label", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column(4)
        ends, flat = v.offsets.to_numpy(), v.flatten().to_numpy().astype(np.int64)
        parts = [flat[i:j] for i, j in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
        nn = [float(p.astype(np.float64) @ p.astype(np.float64)) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:4], pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(nn, pa.float64())],
            ["row", "vec_id", "label", "anchor", "dim", "v", "nn"])


def _numbers(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.int64).reshape(-1, dim)


def _longer(x: np.ndarray, nn: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component that gives all the length of the longest, so that the nearest have the largest product."""
    return np.hstack((x.astype(np.float64), np.sqrt(np.maximum(longest - nn, 0))[:, None]))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def fit_pivots(x: np.ndarray) -> np.ndarray:
    """Centres of at most PIVOTS clusters of the sampled rows, from rows spread evenly over it."""
    pivots = x[np.linspace(0, len(x) - 1, min(PIVOTS, len(x))).astype(int)]
    for _ in range(FITS):
        at = _distances(x, pivots).argmin(axis=1)
        pivots = np.array([x[at == k].mean(axis=0) if (at == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


class Space:
    """What all tasks know of the vectors of each length: the longest, the pivots, and the sampled rows."""

    def __init__(self, longest: dict[int, float], sample: list):
        self.longest, self.pivots, self.sample = longest, {}, {}
        for dim in longest:
            mine = [r for r in sample if r["dim"] == dim]
            x, nn = _numbers([bytes(r["v"]) for r in mine], dim) if dim else np.zeros((len(mine), 0), np.int64), np.array([r["nn"] for r in mine])
            self.pivots[dim] = fit_pivots(_longer(x, nn, longest[dim])) if mine else np.zeros((1, dim + 1))
            mine_ids = [r["vec_id"] for r in mine]
            self.sample[dim] = Rows(np.array([r["row"] for r in mine], np.int64), mine_ids, np.array([r["label"] for r in mine], np.int64), x)


class Rows:
    """Rows in the order in which equal scores are taken: by vec_id, null last."""

    def __init__(self, row: np.ndarray, ids: list, label: np.ndarray, x: np.ndarray):
        null = np.array([i is None for i in ids], bool)
        vec = np.array([0 if i is None else i for i in ids], np.int64)
        order = np.lexsort((row, vec, null))
        self.row, self.vec, self.null, self.label, self.x = row[order], vec[order], null[order], label[order], x[order]

    def products(self, q: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles while they are whole numbers there."""
        top = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(q.shape[1], 1)
        if top < 2**53:
            return (q.astype(np.float64) @ self.x.astype(np.float64).T).astype(np.int64)
        return q @ self.x.T

    def best(self, q: np.ndarray, row: np.ndarray, label: np.ndarray, t: dict[str, np.ndarray], k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each target the first k rows between its bounds: number of the target, place of the row, score."""
        if not len(self.row) or not len(t["pos"]):
            return (np.zeros(0, np.int64),) * 3
        s = self.products(q)[t["pos"]]
        alike = self.label[None, :] == label[t["pos"]][:, None]
        ok = (alike if same else ~alike) & (s >= np.maximum(t["low"], t["need"])[:, None]) & (s <= t["high"][:, None]) & (self.row[None, :] != row[t["pos"]][:, None])
        n = s.shape[1]
        if np.abs(s).max() < (1 << 62) // (n + 1):
            key = np.where(ok, s * n + (n - 1 - np.arange(n)), -NO_BOUND)  # a higher score, then an earlier row
            at = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k]
        else:
            at = np.array([sorted(range(n), key=lambda c, i=i: (not ok[i, c], -int(s[i, c]), c))[:k] for i in range(len(s))])
        number = np.repeat(np.arange(len(s)), at.shape[1])
        at = at.ravel()
        keep = ok[number, at]
        return number[keep], at[keep], s[number[keep], at[keep]]


def _keyed(space):
    """pivot and dist of each row: the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, raw, nn = np.array(b.column(4).to_pylist(), np.int64), b.column(5).to_pylist(), b.column(6).to_numpy()
            pivot, dist = np.zeros(len(b), np.int32), np.zeros(len(b))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _numbers([raw[i] for i in at], dim) if dim else np.zeros((len(at), 0), np.int64)
                d = _distances(_longer(x, nn[at], space.value.longest[dim]), space.value.pivots[dim])
                pivot[at], dist[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(dist)], [*b.schema.names, "pivot", "dist"])

    return run


def _pack(most: int):
    """Sorted rows as blocks of one length, with the key interval of each run of one label and pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 32, []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            dim = rows[0][4]
            segments: list[dict] = []
            for r in rows:
                if not segments or (segments[-1]["label"], segments[-1]["pivot"]) != (r[2], r[7]):
                    segments.append({"label": r[2], "pivot": r[7], "lo": r[8], "hi": r[8]})
                segments[-1]["lo"], segments[-1]["hi"] = min(segments[-1]["lo"], r[8]), max(segments[-1]["hi"], r[8])
            ids = pa.array([r[1] for r in rows], pa.int64())
            ids = np.vstack((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
            packed = [np.array([r[0] for r in rows], np.int64).tobytes(), ids.astype(np.int64).tobytes(), np.array([r[2] for r in rows], np.int64).tobytes(),
                      b"".join(r[5] for r in rows), np.array([r[6] for r in rows]).tobytes()]
            shape = pa.list_(pa.struct([("label", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([made], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), *[pa.array([p], pa.binary()) for p in packed], pa.array([segments], shape)],
                ["block", "dim", "n", "rows", "ids", "labels", "v", "nn", "segments"])

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (held[0][4] != r[4] or len(held) >= max(64, min(most, NUMBERS // max(r[4], 1)))):
                    yield block(held)
                    made, held = made + 1, []
                held.append(r)
        if held:
            yield block(held)

    return run


def packed(keyed: DataFrame, most: int) -> DataFrame:
    """The index: rows sorted by (length, label, pivot, distance), cut into blocks wherever a task's range of them ends."""
    order = ["dim", "label", "pivot", "dist", "row"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack(most), PACKED)


def _unpacked(b: pa.RecordBatch, i: int, names: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    def of(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b.column(names[name])[i].as_py(), kind)

    n = b.column(names["n"])[i].as_py()
    return of("rows", np.int64), of("ids", np.int64).reshape(2, n), of("labels", np.int64), of("v", np.int64).reshape(n, -1), of("nn", np.float64)


def _fields(column: pa.Array, i: int, names: list[str]) -> dict[str, np.ndarray]:
    """The arrays of a list of structs."""
    return {n: a.to_numpy(zero_copy_only=False) for n, a in zip(names, column[i].values.flatten(), strict=True)}


TARGET = ["pos", "j", "low", "high", "need", "inner", "before", "radius"]
ASKED = ["chunk", "dim", "n", "rows", "ids", "labels", "v", "nn", "targets"]
HIT = "chunk long, pos int, j int, row long, vec_id long, score long"


def _hits(chunk: int, t: dict[str, np.ndarray], rows: Rows, got: tuple) -> pa.RecordBatch:
    number, at, score = got
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(number), chunk, np.int64)), pa.array(t["pos"][number].astype(np.int32)), pa.array(t["j"][number].astype(np.int32)),
         pa.array(rows.row[at]), pa.array(rows.vec[at], mask=rows.null[at]), pa.array(score)], ["chunk", "pos", "j", "row", "vec_id", "score"])


def _from_sample(space, k: int, same: bool):
    names = dict(zip(ASKED, range(len(ASKED)), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row, _, label, x, _ = _unpacked(b, i, names)
                t, rows = _fields(b.column(names["targets"]), i, TARGET), space.value.sample[b.column(1)[i].as_py()]
                yield _hits(b.column(0)[i].as_py(), t, rows, rows.best(x, row, label, t, k, same))

    return run


def _routes(space, same: bool):
    """chunk, block, wanted: the targets whose annulus of this round meets a segment of the block."""
    names = dict(zip([*ASKED, "segments"], range(len(ASKED) + 1), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                dim = b.column(1)[i].as_py()
                _, _, label, x, nn = _unpacked(b, i, names)
                t = _fields(b.column(names["targets"]), i, TARGET)
                s = _fields(b.column(names["segments"]), i, ["block", "label", "pivot", "lo", "hi"])
                pivots, longest = space.value.pivots[dim], space.value.longest[dim]
                to = _distances(np.hstack((x.astype(np.float64), np.zeros((len(x), 1)))), pivots)[:, s["pivot"]][t["pos"]]
                slack = MARGIN * np.sqrt(nn + longest + (pivots * pivots).sum(axis=1).max())[t["pos"]][:, None]
                near, far = np.maximum(np.maximum(to - s["hi"], s["lo"] - to), 0) - slack, to + s["hi"] + slack
                alike = s["label"][None, :] == label[t["pos"]][:, None]
                hit = (alike if same else ~alike) & (near <= t["radius"][:, None]) & (near > t["before"][:, None]) & (far >= t["inner"][:, None])
                target, segment = np.nonzero(hit)
                pairs = np.unique(np.stack((s["block"][segment], target)), axis=1)
                blocks, first = np.unique(pairs[0], return_index=True)
                wanted = np.split(pairs[1].astype(np.int32), first[1:]) if len(blocks) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(blocks), b.column(0)[i].as_py(), np.int64)), pa.array(blocks.astype(np.int64)), pa.array([w.tobytes() for w in wanted], pa.binary())],
                    ["chunk", "block", "wanted"])

    return run


def _scan(k: int, same: bool):
    """The rows of a block that a chunk's targets take: at most k each."""
    asked = dict(zip(ASKED, range(len(ASKED)), strict=True))
    block = dict(zip(["rows", "ids", "labels", "v", "nn", "n"], range(len(ASKED), len(ASKED) + 6), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row, _, label, x, _ = _unpacked(b, i, asked)
                wanted = np.frombuffer(b.column(len(ASKED) + 6)[i].as_py(), np.int32)
                t = {n: a[wanted] for n, a in _fields(b.column(asked["targets"]), i, TARGET).items()}
                mine, ids, labels, data, _ = _unpacked(b, i, block)
                rows = Rows(mine, [None if null else v for v, null in ids.T.tolist()], labels, data)
                yield _hits(b.column(0)[i].as_py(), t, rows, rows.best(x, row, label, t, k, same))

    return run


class Index:
    """The sorted blocks, the chunks of anchors, and the search over both."""

    def __init__(self, rows: DataFrame, is_anchor: Column, scratch: Scratch):
        spark = rows.sparkSession
        named = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.coalesce(is_anchor, F.lit(False)).alias("anchor"), "v")
        named = scratch.keep(named.mapInArrow(_as_bytes, ROW), "rows")
        self.longest = {r["dim"]: r["nn"] for r in named.groupBy("dim").agg(F.max("nn").alias("nn")).collect()}
        sample = named.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()
        self.space = spark.sparkContext.broadcast(Space(self.longest, sample))
        keyed = scratch.keep(named.mapInArrow(_keyed(self.space), f"{ROW}, pivot int, dist double"), "keyed")
        self.blocks = scratch.keep(packed(keyed, ROWS), "blocks")
        self.chunks = scratch.keep(packed(keyed.filter("anchor"), CHUNK).withColumnRenamed("block", "chunk"), "chunks")
        segments = self.blocks.select("dim", "block", F.explode("segments").alias("s")).select("dim", F.struct("block", "s.label", "s.pivot", "s.lo", "s.hi").alias("s"))
        self.slices = -(-segments.count() // SLICE) or 1
        parts = segments.groupBy("dim", F.pmod(F.xxhash64("s"), F.lit(self.slices)).alias("slice")).agg(F.collect_list("s").alias("segments"))
        self.segments = scratch.keep(parts, "segments")
        self.scratch, self.spark = scratch, spark

    def anchors(self) -> DataFrame:
        """chunk, pos, vec_id, nn, longest of every anchor, one row each."""
        ends = F.create_map(*[F.lit(x) for pair in self.longest.items() for x in pair]) if self.longest else F.lit(None).cast("map<int,double>")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = dict(zip(["chunk", "dim", "n", "rows", "ids", "labels", "v", "nn"], range(8), strict=True))
            for b in batches:
                for i in range(len(b)):
                    _, ids, _, _, nn = _unpacked(b, i, names)
                    chunk, dim, n = (b.column(c)[i].as_py() for c in range(3))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk] * n, pa.int64()), pa.array([dim] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(ids[0], mask=ids[1].astype(bool)), pa.array(nn)],
                        ["chunk", "dim", "pos", "anchor_id", "nn"])

        out = self.chunks.select("chunk", "dim", "n", "rows", "ids", "labels", "v", "nn").mapInArrow(run, "chunk long, dim int, pos int, anchor_id long, nn double")
        return out.withColumn("longest", F.element_at(ends, F.col("dim"))).drop("dim")

    def _best(self, hits: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy(*FOUND).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        return hits.dropDuplicates([*FOUND, "row"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _asked(self, targets: DataFrame, name: str) -> DataFrame:
        listed = targets.groupBy("chunk").agg(F.collect_list(F.struct(*TARGET)).alias("targets"))
        return self.scratch.keep(self.chunks.drop("segments").join(listed, "chunk").select(*ASKED), name)

    def search(self, targets: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """The first k rows of each target (chunk, pos, j, nn, longest, low, high): scores from low to high, highest first.

        same: rows of the anchor's label, or of all others. A product s lies at the distance whose
        square is nn + longest - 2 s, so a target is an annulus around its anchor. The sampled
        rows give a first k-th score; the annulus down to it is then scanned from the inside in
        rounds, block by block where the key interval of a segment (pivot, lowest and highest
        distance) can meet it. A target ends when its k-th score lies inside what was scanned.
        """

        def at(s: str | Column) -> Column:
            return F.sqrt(F.greatest(F.col("nn") + F.col("longest") - 2.0 * (F.col(s) if isinstance(s, str) else s), F.lit(0.0)))

        start = F.lit(-1.0)
        zero = targets.select("*", F.col("low").alias("need"), F.lit(0.0).alias("inner"), start.alias("before"), start.alias("radius"))
        found = self.scratch.keep(self._best(self._asked(zero, f"{name}-asked").mapInArrow(_from_sample(self.space, k, same), HIT), k), f"{name}-found0")
        kth = found.filter(F.col("rank") == k).select(*FOUND, F.col("score").alias("kth"))
        endless = float("inf")
        inner = F.when(F.col("high") >= NO_BOUND, 0.0).otherwise(at("high"))
        open_ = targets.join(kth, FOUND, "left").withColumn("need", F.coalesce("kth", "low")).withColumn("inner", inner)
        open_ = open_.withColumn("end", F.when(F.col("need") <= -NO_BOUND, endless).otherwise(at("need"))).drop("kth")
        open_ = self.scratch.keep(open_.withColumn("before", F.lit(float("-inf"))), f"{name}-open0")
        for step, share in enumerate(GROWTH, 1):
            radius = F.when(F.col("end") == endless, endless).otherwise(F.col("inner") + (F.col("end") - F.col("inner")) * share)
            asked = self._asked(open_.withColumn("radius", radius), f"{name}-asked{step}")
            spread = asked.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.slices - 1).cast("long"))))
            routes = spread.join(self.segments, ["dim", "slice"]).select(*ASKED, "segments").mapInArrow(_routes(self.space, same), "chunk long, block long, wanted binary")
            routes = self.scratch.keep(routes, f"{name}-routes{step}")
            data = self.blocks.select("block", *[F.col(c).alias(f"b_{c}") for c in ("rows", "ids", "labels", "v", "nn", "n")])
            pairs = routes.join(data, "block").join(asked, "chunk").select(*[asked[c] for c in ASKED], *data.columns[1:], "wanted")
            found = self.scratch.keep(self._best(found.drop("rank").unionByName(pairs.mapInArrow(_scan(k, same), HIT)), k), f"{name}-found{step}")
            self.scratch.drop(f"{name}-found{step - 1}", f"{name}-routes{step}", f"{name}-asked{step}")
            if share >= 1:
                break
            kth = found.filter(F.col("rank") == k).select(*FOUND, F.col("score").alias("kth"))
            left = open_.withColumn("before", radius).join(kth, FOUND, "left").withColumn("need", F.coalesce("kth", "need"))
            left = left.filter((F.col("before") < endless) & (F.col("kth").isNull() | (at("kth") > F.col("before")))).drop("kth")
            open_ = self.scratch.keep(left, f"{name}-open{step}")
            self.scratch.drop(f"{name}-open{step - 1}")
            if open_.isEmpty():
                break
        return found


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among rows (vec_id, label, v).

    v is a list of whole numbers, the score a row's inner product with the anchor. Positives are the
    first rows of the anchor's label but itself; for each of them the first negatives rows of
    other labels come whose score is low to high percent of its own (none if that is below 0).
    Higher scores come first, equal ones by vec_id, null last. Repeated rows count each, and an
    anchor's copy may be its positive. Only rows of one length are compared, vectors without a
    component among them (all their scores are 0). Null labels and vectors take no part, and a
    null vec_id is no anchor unless is_anchor says so. Products must fit 64 bits. Other columns
    are ignored; an empty table gives an empty result.

    Results are exact: pivots are fitted on SAMPLE rows, every row is indexed, and a search ends
    by a bound on distance only (Index.search). Anchors and rows meet as packed chunks and blocks
    of at most NUMBERS numbers, or 64 rows.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    index = Index(rows.filter("label IS NOT NULL AND v IS NOT NULL"), is_anchor, scratch)
    anchors = scratch.keep(index.anchors(), "anchors")
    bound = F.lit(NO_BOUND)
    first = anchors.select("chunk", "pos", F.lit(0).alias("j"), "nn", "longest", (-bound).alias("low"), bound.alias("high"))
    liked = scratch.keep(index.search(first, positives, True, "positives"), "positives")
    places = anchors.select("chunk", "pos", "nn", "longest")
    ps = F.col("score")
    second = liked.filter(ps >= 0).join(places, ["chunk", "pos"]).select(
        "chunk", "pos", F.col("rank").alias("j"), "nn", "longest",
        F.expr(f"{low} * (score div 100) + ({low} * (score % 100) + 99) div 100").alias("low"), F.expr(f"{high} * (score div 100) + ({high} * (score % 100)) div 100").alias("high"),
    )
    disliked = index.search(second.filter("low <= high"), negatives, False, "negatives")
    out = disliked.select("chunk", "pos", "j", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(liked.select("chunk", "pos", F.col("rank").alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), FOUND)
    out = out.join(anchors.select("chunk", "pos", "anchor_id"), ["chunk", "pos"])
    out = scratch.keep(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "mined")
    scratch.drop_all_but("mined")
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    label = F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(quantised(table(spark, sf_dir, "embeddings"), label), vec % 50 == 0)


OP11_SQL = """
WITH good AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
pos AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.r ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON n.ar = p.ar AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
