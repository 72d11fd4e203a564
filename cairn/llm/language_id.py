"""Operator 6: language identification, known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import in_slices, table

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5  # characters of the longest n-gram
#: Labelled rows of a language that the model learns from, about.
ROWS = 4_000
#: Words whose scores one task remembers, and distinct words of a text that are looked up together.
REMEMBERED, TOGETHER = 200_000, 50_000
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters; runs of other numerals and signs only are none."""
    return WORD.findall(text.lower())


def _is_word(w: str) -> bool:
    return any(c.isalpha() for c in w)


class Grams:
    """Hashes of the n-grams of words, each word with a space before and behind."""

    def __init__(self, words: list[str]):
        self.cps = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = np.array([len(w) + 2 for w in words], np.int64)
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.left = np.repeat(np.cumsum(self.size), self.size) - np.arange(len(self.cps))  # code points to the word's end

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram the number of its word and its hash."""
        at = np.flatnonzero((self.left >= n) & ((n > 1) | (self.cps != 32)))  # a space alone says nothing
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h + self.cps[at + i] + np.uint64(1)) * _ODD
            h ^= h >> np.uint64(29)
        return self.word[at], h.view(np.int64)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: Iterable[str], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n).view(np.int64)


COUNTS = "lang string, n int, h long, c long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and n-grams of the texts by language; partial sums go out whenever many words have gathered."""
    words: dict[str, Counter] = {}

    def partial() -> Iterator[pa.RecordBatch]:
        for lang, counts in words.items():
            known = [w for w in counts if _is_word(w)]
            c = np.array([counts[w] for w in known], np.int64)
            grams = Grams(known)
            for n in range(LONGEST + 1):
                which, h = grams.of(n) if n else (np.arange(len(known)), word_hashes(known, len(known)))
                h, at = np.unique(h, return_inverse=True)
                sums = np.bincount(at, weights=c[which], minlength=len(h)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), n, np.int32)), pa.array(h), pa.array(sums)], ["lang", "n", "h", "c"])
        words.clear()

    for b in in_slices(batches):
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > TOGETHER:
                yield from partial()
    yield from partial()


class Items:
    """Counts by language of the words, or of the n-grams of one length.

    Only counts above 0 are kept: of each item, named by its hash, the languages it was met in.
    The log frequency of an item with count c is log(c + 1/2) less the language's base.
    """

    def __init__(self, h: np.ndarray, lang: np.ndarray, c: np.ndarray, n_langs: int):
        order = np.argsort(h, kind="stable")
        self.names, self.first = np.unique(h[order], return_index=True)
        self.first = np.append(self.first, len(h))
        self.lang, self.more = lang[order].astype(np.int32), (np.log(c[order] + 0.5) - np.log(0.5)).astype(np.float64)
        totals = np.bincount(lang, weights=c, minlength=n_langs)
        self.none = np.log(0.5 / (totals + 0.5 * max(len(self.names), 1)))  # of an item that a language lacks

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where unknown."""
        if not len(self.names) or not len(h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        return np.where(self.names[at] == h, at, -1)

    def logs(self, at: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """For each of n rows the mean of the log frequencies of its items: those at[row == i]."""
        count = self.first[at + 1] - self.first[at]
        owner = np.repeat(row, count)
        entry = np.repeat(self.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        out = np.bincount(owner * len(self.none) + self.lang[entry], weights=self.more[entry], minlength=n * len(self.none))
        return self.none + out.reshape(n, len(self.none)) / np.maximum(np.bincount(row, minlength=n), 1)[:, None]


class Model:
    """Words and n-grams of each length by language, and the scores of words met lately."""

    def __init__(self, langs: list[str], items: list[Items]):
        self.langs, self.items = langs, items
        self._forget()

    def __reduce__(self):
        return Model, (self.langs, self.items)

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._logs = np.zeros((1024, len(self.langs)))
        self._support = np.zeros_like(self._logs)
        self._used = 0

    def scores(self, words: list[str]) -> np.ndarray:
        """Log frequencies of each word by language.

        A known word has its own; an unseen one the mean of those of its longest known n-grams,
        or none that speaks for any language.
        """
        out = np.zeros((len(words), len(self.langs)))
        known = self.items[0].find(word_hashes(words, len(words)))
        at = np.flatnonzero(known >= 0)
        out[at] = self.items[0].logs(known[at], np.arange(len(at)), len(at))
        left = np.flatnonzero(known < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            row, h = Grams([words[k] for k in left.tolist()]).of(n)
            place = self.items[n].find(h)
            row, place = row[place >= 0], place[place >= 0]
            met = np.zeros(len(left), bool)
            met[row] = True
            out[left[met]] = self.items[n].logs(place, (np.cumsum(met) - 1)[row], int(met.sum()))
            left = left[~met]
        return out

    def _remember(self, words: list[str]) -> None:
        for w in words:
            if not _is_word(w):
                self._rows[w] = -1
        words = [w for w in words if w not in self._rows]
        if not words:
            return
        a, z = self._used, self._used + len(words)
        if z > len(self._logs):
            more = np.zeros((max(z, 2 * len(self._logs)) - len(self._logs), len(self.langs)))
            self._logs, self._support = np.concatenate((self._logs, more)), np.concatenate((self._support, more))
        self._logs[a:z] = self.scores(words)
        self._support[a:z] = _shares(self._logs[a:z])
        self._rows.update(zip(words, range(a, z), strict=True))
        self._used = z

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the greatest sum over the words, and the words' mean support for it."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        total, support, n = np.zeros(len(self.langs)), np.zeros(len(self.langs)), 0
        counts = Counter(words_of(text))
        words = list(counts)
        for a in range(0, len(words), TOGETHER):
            part = words[a : a + TOGETHER]
            if len(self._rows) > REMEMBERED:
                self._forget()
            self._remember([w for w in part if w not in self._rows])
            at = np.fromiter(map(self._rows.__getitem__, part), np.int64, len(part))
            c = np.fromiter((counts[w] for w in part), np.float64, len(part))
            at, c = at[at >= 0], c[at >= 0]
            total, support, n = total + c @ self._logs[at], support + c @ self._support[at], n + c.sum()
        if not n:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        return self.langs[best], float(min(1.0, support[best] / n))


def _shares(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True)) if logs.size else logs
    return e / e.sum(axis=1, keepdims=True) if logs.size else logs


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, rows: int = ROWS) -> Model:
    """Learn from text and lang of labelled rows that are not held out (a null doc_id never is used).

    At most about rows rows of each language are used, picked by a hash of doc_id; all their
    words and n-grams are kept. So the model's size is bounded by rows, however large the table is.
    """
    labelled = docs.select("doc_id", "text", "lang").filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    totals = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(totals)
    none = np.zeros(0, np.int64)
    if not totals:
        return Model([], [Items(none, none, none, 0) for _ in range(LONGEST + 1)])
    share = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, rows / n)))])
    number = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(place < F.element_at(share, F.col("lang")))
    counted = sample.select("lang", "text").mapInArrow(_count, COUNTS).groupBy("n", "h", "lang").agg(F.sum("c").alias("c"))
    got = counted.select("n", "h", F.element_at(number, F.col("lang")).alias("lang"), "c").toArrow()
    n, h, lang, c = (got.column(k).to_numpy() for k in ("n", "h", "lang", "c"))
    return Model(langs, [Items(h[n == k], lang[n == k], c[n == k], len(langs)) for k in range(LONGEST + 1)])


def identify(docs: DataFrame, model: Model, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """carry, lang_pred and score of every whole text, in one narrow pass; the model has a bounded size.

    The text goes to Python once, whether it is carried or not.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(carry)
    at = carry.index("text") if "text" in carry else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            got = [shared.value.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                [*b.schema.names[:n], "lang_pred", "score"])

    rows = docs.select(*carry, *([] if at < n else [F.col("text").alias("_text")]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double"]))


def identify_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model learned from the rows not held out.

    A text that is null or has no letter is "und" with score 0; so are all texts if no row is
    labelled. A null doc_id is not held out and not learned from. Ties go to the first language
    in code-point order. Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result.
    """
    found = identify(docs, learn(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
