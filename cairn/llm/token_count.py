"""Operator 1: token counts by a count-only Viterbi search over Aho-Corasick matches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import in_slices, table

SPACE = "▁"  # stands for a space in the vocabulary
#: Fixed value: an unknown character scores this much less than the least piece.
UNKNOWN_PENALTY = 10.0
#: Parts of a text between spaces; no piece crosses from one to the next (see Unigram).
UNIT = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
#: Units whose counts one task remembers, and the longest ones remembered.
REMEMBERED, UNIT_CHARS = 1_000_000, 48


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a tokenizer's model file, in order of ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Unigram:
    """Counts the tokens that a unigram tokenizer with byte fallback makes, without making them.

    The tokenizer puts SPACE for spaces and before the text, and takes the pieces with the
    greatest sum of scores; of equal sums at a place the one whose last piece starts first
    (that is, is longest) stays. A character that is no piece may stand for itself at the
    unknown score, and then makes a token of each of its UTF-8 bytes.

    Pieces hold SPACE at their start only and never a line break, so the best pieces of a text
    are those of its units one by one. Sums are in double precision; for scores that are whole
    numbers they are exact, so ties are real ties.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        names = {p for p, _ in pieces}
        if not all(f"<0x{i:02X}>" in names for i in range(256)):
            raise ValueError("the vocabulary must hold a piece for each byte")
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece crosses from one unit to the next")
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.single = {p for p in names if len(p) == 1}
        self.matches = ahocorasick.Automaton()
        for p, s in pieces:
            if p:
                self.matches.add_word(p, (len(p), s))
        self.matches.make_automaton()
        self.seen: dict[str, tuple[int, float]] = {}

    def best(self, unit: str) -> tuple[int, float]:
        """Number of tokens and score of a unit: one pass over the ends of matches, longest first."""
        n = len(unit)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        found: list[list] = [[] for _ in range(n)]
        for end, piece in self.matches.iter(unit):
            found[end].append(piece)
        for end in range(n):
            top, tokens = None, 0
            for length, s in found[end]:
                start = end + 1 - length
                if score[start] is not None and (top is None or score[start] + s > top):
                    top, tokens = score[start] + s, count[start] + 1
            c = unit[end]
            if c not in self.single and (top is None or score[end] + self.unknown > top):
                top, tokens = score[end] + self.unknown, count[end] + len(c.encode("utf-8", "surrogatepass"))
            score[end + 1], count[end + 1] = top, tokens
        return count[n], score[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        tokens, score = 0, 0.0
        for unit, times in Counter(UNIT.findall(SPACE + text.replace(" ", SPACE))).items():
            got = self.seen.get(unit)
            if got is None:
                got = self.best(unit)
                if len(unit) <= UNIT_CHARS:
                    if len(self.seen) >= REMEMBERED:
                        self.seen.clear()
                    self.seen[unit] = got
            tokens += got[0] * times
            score += got[1] * times
        return tokens, score


@lru_cache(maxsize=2)
def _unigram(path: str) -> Unigram:
    return Unigram(vocabulary(path))


def count_tokens(docs: DataFrame, model_path: str, carry: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """carry, n_tokens and score (the best sum of piece scores) of every whole text.

    Null and empty texts have no tokens and score 0. Repeated rows give repeated results; columns
    not in carry are ignored; an empty table gives an empty result. A narrow pass: nothing is
    shuffled, and a task remembers the counts of units that it has met.
    """
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _unigram(model_path)
        for b in in_slices(batches):
            got = [model.count(t) for t in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:n], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())],
                [*b.schema.names[:n], "n_tokens", "score"])

    rows = docs.select(*carry, F.col("text").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]]
    return rows.mapInArrow(run, ", ".join([*fields, "n_tokens long, score double"]))


def piece_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), piece_file())
