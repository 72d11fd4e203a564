"""Language identification against a version in plain dictionaries."""

import math
import re
import zlib
from collections import Counter

from cairn.llm import language_id
from cairn.llm.common import table

WORD = re.compile(r"[^\W\d_]+")


def _grams(word, n):
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _words(text):
    return [w for w in WORD.findall(text.lower()) if any(c.isalpha() for c in w)]


class Plain:
    def __init__(self, rows):
        self.langs = sorted({lang for lang, _ in rows})
        self.counts = [{lang: Counter() for lang in self.langs} for _ in range(6)]
        for lang, text in rows:
            for w in _words(text):
                self.counts[0][lang][w] += 1
                for n in range(1, 6):
                    self.counts[n][lang].update(_grams(w, n))
        self.items = [set().union(*(c.keys() for c in by.values())) for by in self.counts]

    def log(self, n, item, lang):
        return math.log((self.counts[n][lang][item] + 0.5) / (self.counts[n][lang].total() + 0.5 * len(self.items[n])))

    def scores(self, word):
        if word in self.items[0]:
            return [self.log(0, word, lang) for lang in self.langs]
        for n in range(5, 0, -1):
            if known := [g for g in _grams(word, n) if g in self.items[n]]:
                return [sum(self.log(n, g, lang) for g in known) / len(known) for lang in self.langs]
        return [0.0] * len(self.langs)

    def predict(self, text):
        words = Counter(_words(text or ""))
        if not words:
            return "und", 0.0
        total, support = [0.0] * len(self.langs), [0.0] * len(self.langs)
        for w, c in words.items():
            s = self.scores(w)
            e = [math.exp(x - max(s)) for x in s]
            for i, x in enumerate(s):
                total[i] += c * x
                support[i] += c * e[i] / sum(e)
        best = max(range(len(total)), key=lambda i: (round(total[i], 9), -i))
        return self.langs[best], support[best] / words.total()


def _held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def _compare(docs):
    rows = docs.collect()
    plain = Plain([(r.lang, r.text) for r in rows if r.doc_id is not None and r.lang is not None and r.text is not None and not _held_out(r.doc_id)])
    got = sorted((r.doc_id, r.held_out, r.lang_pred, round(r.score, 7)) for r in language_id.identify_language(docs).collect())
    want = sorted((r.doc_id, _held_out(r.doc_id), *plain.predict(r.text)) for r in rows)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6, (g, w)
    return {g[0]: g[2] for g in got}


def test_documents_against_plain_version(spark, sf):
    _compare(table(spark, sf, "documents"))


def test_ties_unknown_words_and_signs(spark):
    rows = [(1, "aa bb aa", "x"), (3, "aa bb aa", "w"), (4, "cc dd", "x"), (5, "ee ff", "w"), (7, "zzzz aa", "x"), (11, "½ ² ٣", None), (12, "", None), (13, None, None),
            (14, "aabb ccq", None), (15, "ωωω", None), (16, "aa", None), (16, "aa", None), (18, "cc cc ee 12 _", None)]
    got = _compare(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {got[11], got[12], got[13]} == {"und"} and got[15] == "w"  # no letter; no known n-gram: the first language


def test_one_text_of_very_many_words(spark):
    base = [(i, t, lang) for i, (t, lang) in enumerate([("un deux trois quatre", "fr"), ("one two three four", "en")] * 6)]
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(120_000)) + " one two three" * 60_000
    docs = spark.createDataFrame([*base, (50, many, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify_language(docs).collect()}[50] == "en"
