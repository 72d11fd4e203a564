"""Similarity joins of names that lose no match: q-gram prefix filters with bounds from the threshold.

Names are compared in lower case with single spaces (tidy). A name's grams are the pairs of neighbouring
characters of its words, each word with a space before and behind; they do not depend on the order
of words. If the common subsequence of two names x and y has c characters, they share at least
1 + 3c - |x| - |y| grams, counted with repeats. Two names that share t grams share LINK of those
that are left of either when all but the rarest |grams| - t + LINK are taken away: so names meet by
equality of LINK rare grams, and every pair that meets is then scored.

Where names are so alike, or so few, that this spares little, pairs are compared in blocks: counts of
letters and the length of shared words bound a whole block of names at a time, and only pairs that these
bounds leave open are scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import fuzzy

#: Rare grams that a pair has to share, and grams whose frequency is known to the tasks (the most frequent ones).
LINK, KNOWN = 2, 5000
#: The least threshold for which the bounds below leave something to share.
LOWEST = 75.0
#: Pairs of names that are compared in blocks at most, beyond them names meet by rare grams; lines and known names of a block.
PAIRS, LINES, NAMES = 1 << 33, 1024, 4096


def tidy(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def grams(text: str, q: int = 2) -> list[str]:
    """Pairs of neighbouring characters, the ends of words included; of longer grams those inside the text."""
    s = f" {text} " if q == 2 else text
    return [s[i : i + q] for i in range(len(s) - q + 1)]


def counted(parts: Iterable[str]) -> list[tuple[str, int]]:
    """Each gram with its number among equal ones."""
    seen: Counter = Counter()
    out = []
    for g in parts:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def shared_least(n: int, least: float, set_least: float | None = None) -> int:
    """Grams that a name of n characters shares at least with any name that it matches as a whole.

    Either their ratio is least or more, which holds 1 + (1.5 r - 1)(n + m) grams for the other's
    length m, and bounds m from below; or, for set_least, words that both hold are at that ratio to all
    words of one of them, and the lengths lie within a factor of 1.5.
    """
    r = least / 100
    far = max(1.5, 200 / least - 1)
    rate = 1.5 * r - 1
    if set_least:
        w = set_least / 100
        rate = min(rate, w / (2 - w) / 2.5)
    return max(math.ceil(1 + rate * (n + n / far) - 1e-9), 0)


@lru_cache(maxsize=4096)
def contained_least(n: int, least: float, q: int) -> int:
    """Inner q-grams that a text of n characters shares at least with one that holds a part at that ratio to it."""
    best = n
    for w in range(1, n + 1):
        c = math.ceil(least * (n + w) / 200 - 1e-9)
        if c <= min(n, w):
            best = min(best, (n - q + 1) - q * (n - c) - (q - 1) * (w - c))
    return best


class Keys:
    """The join keys of names, given how frequent grams are."""

    def __init__(self, frequent: dict[str, int]):
        self.frequent = frequent

    def rare_first(self, parts: list[tuple[str, int]]) -> list[tuple[str, int]]:
        return sorted(parts, key=lambda e: (self.frequent.get(e[0], 0), e))

    def whole(self, text: str, least: float, set_least: float | None) -> set[int]:
        """Keys that two names share if they match as a whole: pairs of their rare grams."""
        every = self.rare_first(counted(grams(text)))
        keep = len(every) - max(shared_least(len(text), least, set_least), LINK) + LINK
        return {xxhash.xxh3_64_intdigest(repr(c)) for c in combinations(every[:keep], LINK)}

    def part(self, text: str, least: float, q: int) -> set[int]:
        """Keys of a name that may be the shorter one: rare inner grams, or the whole of a tiny name."""
        if len(text) < 3:
            return {_hash("tiny", text)}
        every = self.rare_first(counted(grams(text, q) if q > 2 else grams(text)[1:-1]))
        keep = len(every) - contained_least(len(text), least, q) + 1
        return {_hash("part", *e) for e in every[:keep]}

    def holder(self, text: str, q: int) -> set[int]:
        """Keys of a name that may be the longer one: all inner grams."""
        inner = counted(grams(text, q) if q > 2 else grams(text)[1:-1])
        return {_hash("part", *e) for e in inner} | {_hash("tiny", text[i : i + n]) for n in (1, 2) for i in range(len(text) - n + 1)}


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest(repr(parts))


def keyed(names: DataFrame, column: str, keys: Callable[[str], set[int]]) -> DataFrame:
    """names with one row a key of the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            for first in range(0, len(b), 256):
                part = b.slice(first, 256)
                found = [keys(s) if s else set() for s in part.column(at).to_pylist()]
                row = pa.array([i for i, k in enumerate(found) for _ in k], pa.int64())
                key = pa.array([x - (1 << 64) if x >> 63 else x for k in found for x in k], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in part.columns], key], [*part.schema.names, "key"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema.fields]
    return names.mapInArrow(run, ", ".join([*fields, "key long"]))


def frequencies(names: DataFrame, column: str) -> dict[str, int]:
    """How often the KNOWN most frequent grams of two characters occur; all others are taken as rarer."""
    padded = F.concat(F.lit(" "), F.col(column), F.lit(" "))
    each = names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(column) + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("g"))
    return {r["g"]: r["n"] for r in each.groupBy("g").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "g").limit(KNOWN).collect()}


def whole_candidates(names: DataFrame, group: list[str], least: float) -> DataFrame:
    """group, a, b of all pairs of different names (column name, tidy) in a group whose ratio, or whose
    ratio with words sorted, is least or more; and of others that share rare grams."""
    keys = Keys(frequencies(names, "name"))
    rows = keyed(names.select(*group, "name"), "name", lambda s: keys.whole(s, least, None))
    two = rows.select(*group, "key", F.col("name").alias("b"))
    return rows.withColumnRenamed("name", "a").join(two, [*group, "key"]).filter("a < b").select(*group, "a", "b").distinct()


class _Block:
    """Names whose weighted ratios with another name are bounded all at once."""

    def __init__(self, names: list[str]):
        forms = [_forms(s) for s in names]
        lengths = np.array([f[2] for f in forms], np.int64).reshape(-1, 3)
        self.whole, self.ordered, self.single = lengths[:, 0], lengths[:, 1], lengths[:, 2]
        self.letters: dict[str, np.ndarray] = {}
        words: dict[str, list[int]] = {}
        for k, (letters, own, _) in enumerate(forms):
            for c, n in letters.items():
                if c not in self.letters:
                    self.letters[c] = np.zeros(len(names), np.int32)
                self.letters[c][k] = n
            for w in own:
                words.setdefault(w, []).append(k)
        self.words = {w: np.array(at, np.int64) for w, at in words.items()}

    def open(self, name: str, least: float) -> np.ndarray:
        """Numbers of the names whose weighted_ratio with name may be least or more.

        A common subsequence is no longer than the letters that both hold. The words of one with those of both in
        front share these, which are as long as their words, and of the rest at most its letters.
        """
        letters, words, (n, ordered, single) = _forms(name)
        both = np.zeros(len(self.whole), np.int32)
        for c, k in letters.items():
            if c in self.letters:
                both += np.minimum(self.letters[c], k)
        held = np.zeros(len(both), np.int64)
        for w in words:
            if w in self.words:
                held[self.words[w]] += len(w) + 1
        held = np.maximum(held - 1, 0)
        low = least - 1e-6
        twice, far = 200.0 * both, np.maximum(self.whole, n) / np.minimum(self.whole, n)
        alike = twice >= low * (self.whole + n)
        near = (0.95 * twice >= low * np.minimum(self.ordered + ordered, self.single + single)) | ((held > 0) & (190.0 * held >= low * (held + np.minimum(self.single, single))))
        part = np.zeros(len(both), bool)
        for scale, short in ((0.9, np.minimum(self.whole, n)), (0.9 * 0.95, np.minimum(self.ordered, ordered))):
            rate = low / scale
            if rate <= 100:  # of a part of c characters or more c are common: c (200 - rate) >= rate times the shorter name
                part |= both * (200 - rate) >= rate * short
        return np.flatnonzero(alike | np.where(far < 1.5, near, part & (far <= 8)))


@lru_cache(maxsize=16384)
def _forms(s: str) -> tuple[Counter, set[str], tuple[int, int, int]]:
    """Letters of a name, at least as many as any order of its words has; its words; lengths as it is, with words sorted, with each word once."""
    words = s.split()
    ordered = " ".join(sorted(words))
    return Counter(s) | Counter(ordered), set(words), (len(s), len(ordered), len(" ".join(set(words))))


def _blocks(names: DataFrame, column: str, by: list[str], most: int, number: str) -> DataFrame:
    """by, number, column as lists of about most names each."""
    sizes = names.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / most).alias("_n"))
    rows = names.join(sizes, by) if by else names.crossJoin(F.broadcast(sizes))  # one row
    return rows.withColumn(number, F.pmod(F.xxhash64(column), F.col("_n"))).groupBy(*by, number).agg(F.collect_list(column).alias(column))


def close_in_blocks(lines: DataFrame, known: DataFrame, least: float, by: list[str]) -> DataFrame:
    """line, known: all pairs of names that are equal in by and whose weighted_ratio is least or more, and others that bounds leave open."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = _blocks(lines.select(*by, "line").distinct(), "line", by, LINES, "_i")
    two = _blocks(known.select(*by, "known").distinct(), "known", by, NAMES, "_j")
    pairs = (one.join(two, by) if by else one.crossJoin(two)).repartition(tasks, *by, "_i", "_j").select("line", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                some, names = b.column(0)[k].values, b.column(1)[k].values
                block = _Block(names.to_pylist())
                hits = [block.open(s, least) for s in some.to_pylist()]
                row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
                yield pa.RecordBatch.from_arrays([some.take(pa.array(row)), names.take(pa.array(np.concatenate(hits)))], ["line", "known"])

    return pairs.mapInArrow(run, "line string, known string")


def _compared(lines: DataFrame, known: DataFrame, group: list[str]) -> list[str] | None:
    """By what lines and known names are compared in blocks: by group, or by nothing where groups share names and so are
    more pairs than all names are; None if both are too many."""
    n, m = lines.select("line").distinct().count(), known.select("known").distinct().count()
    ways = [(n * m, [])]
    if group:
        sizes = lines.groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("n")).join(known.groupBy(*group).agg(F.count(F.lit(1)).alias("m")), group)
        ways.append((sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0, group))
    pairs, by = min(ways, key=lambda w: w[0])
    return by if pairs <= PAIRS else None


def similar(lines: DataFrame, known: DataFrame, least: float, group: Sequence[str] = ()) -> DataFrame:
    """group, line, known, score: all pairs of a line and a known name (tidy, distinct in a group) of a group, of weighted_ratio least or more.

    weighted_ratio is a ratio of whole names, of their sorted words or of the words of one with those
    that both hold, at 0.95, while lengths lie within a factor of 1.5; and else a ratio of the
    shorter one with a part of the longer, at 0.9. Nulls and empty names match nothing. Up to PAIRS pairs are compared
    in blocks, whatever groups share is scored once; else names meet by keys, of which each form has some that no match can lack.
    """
    if least < LOWEST:
        raise ValueError(f"thresholds below {LOWEST} have no bound here")
    lines, known, group = lines.select(*group, "line").filter("line <> ''"), known.select(*group, "known").filter("known <> ''"), list(group)
    by = _compared(lines, known, group)
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = meeting(lines, known, least, group) if by is None else close_in_blocks(lines, known, least, by)
    scored = found.repartition(tasks, "line", "known").distinct().withColumn("score", F.round(fuzzy.scored(fuzzy.weighted_ratio, F.col("line"), F.col("known"), in_place=True), 6))
    scored = scored.filter(F.col("score") >= least)
    return scored if by is None or not group else scored.join(lines, "line").join(known, [*group, "known"]).select(*group, "line", "known", "score")


def meeting(lines: DataFrame, known: DataFrame, least: float, group: list[str]) -> DataFrame:
    """group, line, known: all pairs of a group whose weighted_ratio is least or more, and of others that share keys; some more than once.

    Names that repeat a word meet all names that hold one of their words, as their words are fewer than their length tells.
    """
    keys = Keys(frequencies(known, "known"))
    q = 3 if least >= 85 else 2
    part_least, set_least = min(least / 0.9, 100.0), least / 0.95

    def once(s: str) -> str | None:
        words = s.split(" ")
        return " ".join(sorted(set(words))) if len(set(words)) < len(words) else None

    def ordered(s: str) -> str:
        return " ".join(sorted(s.split(" ")))

    def whole(s: str) -> set[int]:
        single = once(s)
        return keys.whole(s, least, set_least) | (keys.whole(single, least, set_least) if single else set())

    def repeated(s: str) -> set[int]:
        return {_hash("word", w) for w in s.split(" ")} if once(s) else set()

    def held(s: str) -> set[int]:
        return {_hash("word", w) for w in s.split(" ")}

    sides = [
        (whole, whole), (repeated, held), (held, repeated),
        (lambda s: keys.part(s, part_least, q) | keys.part(ordered(s), part_least, q), lambda s: keys.holder(s, q) | keys.holder(ordered(s), q)),
        (lambda s: keys.holder(s, q) | keys.holder(ordered(s), q), lambda s: keys.part(s, part_least, q) | keys.part(ordered(s), part_least, q)),
    ]
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few names have many keys, and more pairs: a given number is not made smaller
    lines, known = lines.repartition(tasks, "line"), known.repartition(tasks, "known")
    spread = lambda df: df.repartition(tasks, *group, "key")
    found = None
    for k, (mine, theirs) in enumerate(sides):
        pairs = spread(keyed(lines, "line", mine)).join(spread(keyed(known, "known", theirs)).hint("merge"), [*group, "key"]).select(*group, "line", "known")
        far = F.greatest(F.length("line"), F.length("known")) / F.least(F.length("line"), F.length("known"))
        pairs = pairs.filter(far < 1.5 if 0 < k < 3 else (far <= max(1.5, 200 / least - 1) + 1e-9) if k == 0 else ((far >= 1.5) & (far <= 8)))
        pairs = pairs.filter(F.length("line") <= F.length("known")) if k == 3 else pairs.filter(F.length("line") >= F.length("known")) if k == 4 else pairs
        found = pairs if found is None else found.unionByName(pairs)
    return found


def contained(lines: DataFrame, known: DataFrame) -> DataFrame:
    """b, known: all pairs of a name (column b) and a known one that hold one another, equal ones too.

    Either one's rarest inner gram, or the whole of a tiny name, is among the grams of the other.
    """
    keys = Keys(frequencies(known, "known"))
    lines, known = lines.select("b").filter("b <> ''"), known.select("known").filter("known <> ''")
    part, holder = (lambda s: keys.part(s, 100.0, 3)), (lambda s: keys.holder(s, 3))
    found = keyed(lines, "b", part).join(keyed(known, "known", holder), "key").unionByName(keyed(lines, "b", holder).join(keyed(known, "known", part), "key"))
    return found.select("b", "known").distinct().filter(F.contains("known", F.col("b")) | F.contains("b", F.col("known")))
