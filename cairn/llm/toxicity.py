"""Operator 12: toxicity by a classifier that must not care which group a sentence names."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, in_slices, table
from cairn.llm.language_id import is_held_out

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Labelled rows of each class that the classifier is fitted on, about; at most FEATURES of their features are used.
ROWS, FEATURES = 6_000, 1024
#: Lengths of the character n-grams of a word with a space before and behind; the whole word is a feature too.
SHORTEST, LONGEST = 3, 6
#: Documents of the sample that a feature has to be found in.
LEAST_DOCS = 5
#: Weights of the two penalties: of large weights, and of the mean squared change of score when a group is swapped.
RIDGE, FAIRNESS = 1.0, 1.0
THRESHOLD = 0.3
#: Words whose features one task remembers, and distinct counts that it gathers before it passes them on.
REMEMBERED, GATHERED = 20_000, 200_000

# Words for groups of people, in sets whose members may stand for each other.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"], ["mothers", "fathers"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"], ["gay", "lesbian", "straight", "bisexual"], ["transgender", "cisgender"],
    ["immigrants", "refugees", "natives", "foreigners", "citizens"], ["elderly", "young"], ["disabled", "deaf", "blind"],
    ["frauen", "männer"], ["frau", "mann"], ["muslime", "christen", "juden", "hindus"], ["ausländer", "flüchtlinge", "einheimische"],
    ["femmes", "hommes"], ["femme", "homme"], ["musulmans", "chrétiens", "juifs", "hindous"], ["immigrés", "réfugiés", "citoyens"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["musulmanes", "cristianos", "judíos", "hindúes"], ["inmigrantes", "refugiados", "ciudadanos"],
]


def grams(word: str) -> set[str]:
    """The n-grams of a word with its ends, and the word."""
    w = f" {word} "
    return {w[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1)} | {w}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f, pos, neg: in how many rows of each class a feature is found, as partial sums."""
    memo: dict[str, set[str]] = {}
    seen = (Counter(), Counter())

    def partial() -> pa.RecordBatch:
        names = list(seen[1].keys() | seen[0].keys())
        out = [pa.array(names, pa.string()), *[pa.array([c[f] for f in names], pa.int64()) for c in (seen[1], seen[0])]]
        for c in seen:
            c.clear()
        return pa.RecordBatch.from_arrays(out, ["f", "pos", "neg"])

    for b in in_slices(batches):
        for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found: set[str] = set()
            for w in words_of(text):
                got = memo.get(w)
                if got is None:
                    got = memo[w] = grams(w)
                found |= got
            seen[toxic].update(found)
            if len(memo) > REMEMBERED:
                memo.clear()
            if len(seen[0]) + len(seen[1]) > GATHERED:
                yield partial()
    yield partial()


class Features:
    """Finds which of a list of features a text holds."""

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        self._build()

    def __reduce__(self):
        return Features, (self.names,)

    def _build(self) -> None:
        self.machine = ahocorasick.Automaton()
        for k, f in enumerate(self.names):
            self.machine.add_word(f, k)
        self.machine.make_automaton()

    def of(self, text: str | None) -> set[int]:
        """Numbers of the features; words are looked at once each."""
        if not self.names or not (words := words_of(text)):
            return set()
        return {k for _, k in self.machine.iter(f" {' '.join(words)} ")}


def swaps(sentence: str, groups: dict[str, list[str]]) -> Iterator[str]:
    """The sentence with one of its words for groups put in place by each other word of its set, at all its places."""
    words = WORD.findall(sentence.lower())
    for w in sorted(set(words) & groups.keys()):
        for other in groups[w]:
            if other != w:
                yield " ".join(other if x == w else x for x in words)


def _matrix(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            found = [sorted(features.of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    return run


def _changes(features: Features, groups: dict[str, list[str]]):
    """i, j, c: sums over all swaps of the products of changes in two features; i = j = -1 counts the swaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for b in in_slices(batches):
            for text in b.column(0).to_pylist():
                for s in SENTENCE.findall(text or ""):
                    before = None
                    for changed in swaps(s, groups):
                        before = features.of(s) if before is None else before
                        after = features.of(changed)
                        delta = [(k, 1) for k in after - before] + [(k, -1) for k in before - after]
                        sums.update({(-1, -1): 1})
                        for i, x in delta:
                            for j, y in delta:
                                sums[i, j] += x * y
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k] for k in keys], pa.int64())], ["i", "j", "c"])

    return run


def fit(found: list[list[int]], toxic: np.ndarray, share: np.ndarray, change: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model: log loss by row shares, ridge, and w'(change)w, by Newton steps."""
    n, k = len(found), change.shape[0]
    x = np.zeros((n, k + 1), np.float32)
    for i, f in enumerate(found):
        x[i, f] = 1
    x[:, k] = 1
    penalty = np.zeros((k + 1, k + 1))
    penalty[:k, :k] = change + ridge * np.eye(k)
    penalty[k, k] = 1e-6
    w, y = np.zeros(k + 1), toxic.astype(np.float64)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(share @ (np.logaddexp(0, z) - y * z) + w @ penalty @ w / 2)

    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (share * (p - y)) + penalty @ w
        bend = (x * (share * p * (1 - p)).astype(np.float32)[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, last = w - size * step, now
        now = loss(w)
        if last - now < 1e-9 * max(abs(now), 1):
            break
    return w[:k], float(w[k])


class Model:
    """Features with their weights; bias alone is the score of a text without any."""

    def __init__(self, names: Sequence[str], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = Features(names), weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[sorted(self.features.of(text))].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _informative(counted: DataFrame, pos: int, neg: int) -> list[str]:
    """Features by the likelihood ratio of their counts in both classes, largest first."""

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    p, q, n = F.col("pos"), F.col("neg"), F.col("pos") + F.col("neg")
    a, b = n * (pos / (pos + neg)), n * (neg / (pos + neg))
    ratio = part(p, a) + part(q, b) + part(pos - p, pos - a) + part(neg - q, neg - b)
    best = counted.filter(n >= LEAST_DOCS).select("f", ratio.alias("ratio")).orderBy(F.desc("ratio"), "f").limit(FEATURES)
    return [r["f"] for r in best.collect()]


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS, fairness: float = FAIRNESS, identity: list[list[str]] = IDENTITY) -> Model:
    """Fit on text and label of rows that are not held out (a null doc_id never is used).

    A doc_id is toxic if any of its labels is 1, not toxic if all others are 0; labels of other
    values say nothing. About rows of each class are picked by a hash of doc_id, with one text
    of a doc_id (that of the least hash, should there be several); weights give the classes
    their true shares again. Each sentence of the sample that names a group is read again with
    every other name of its set: fairness weighs the mean squared change of the score against
    the log loss. Sums over all swaps are made in the tasks, so their number has no bound.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model([], np.zeros(0), 500.0 if 1 in totals else -500.0)
    rate = F.when(F.col("toxic") == 1, F.lit(min(1.0, rows / totals[1]))).otherwise(F.lit(min(1.0, rows / totals[0])))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    picked = F.broadcast(known.filter(place < rate))  # twice rows, about
    texts = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = scratch.keep(texts.select("toxic", "text").repartition(2 * spark.sparkContext.defaultParallelism), "sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model([], np.zeros(0), float(np.log(totals[1] / totals[0])))
    counted = sample.mapInArrow(_counts, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    features = Features(_informative(counted, sizes[1], sizes[0]))
    got = sample.mapInArrow(_matrix(features), "toxic int, found array<int>").toArrow()
    toxic = got.column("toxic").to_numpy()
    share = np.where(toxic == 1, totals[1] / sizes[1], totals[0] / sizes[0])
    share *= len(share) / share.sum()
    change = np.zeros((len(features.names),) * 2)
    groups = {w: group for group in identity for w in group}
    sums = sample.select("text").mapInArrow(_changes(features, groups), "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c"))
    n = 0
    for r in sums.collect():  # at most FEATURES squared
        if r["i"] < 0:
            n = r["c"]
        else:
            change[r["i"], r["j"]] = r["c"]
    weights, bias = fit(got.column("found").to_pylist(), toxic, share, change * (fairness * len(share) / max(n, 1)))
    scratch.drop()
    return Model(features.names, weights, bias)


def score(docs: DataFrame, model: Model, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """carry and score of every whole text, in one narrow pass; the model has at most FEATURES weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            got = [shared.value.score(t) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(got, pa.float64())], [*b.schema.names[:n], "score"])

    rows = docs.select(*carry, F.col("text").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]
    return rows.mapInArrow(run, ", ".join([*fields, "score double"]))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), learned from labels (doc_id, toxic).

    The score is the likelihood of label 1; a null text counts as empty, and texts without a
    known feature share one score. Without a label every score is 0; where all labels are alike, the
    scores are that label. A null doc_id is not held out and not learned from. Repeated rows give
    repeated results; other columns are ignored; an empty table gives an empty result.
    """
    found = score(docs, learn(docs, labels))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
