"""Operator 12: held-out accuracy, swaps of identity words, and odd rows."""

import random
import zlib

import numpy as np

from cairn.llm import toxicity
from cairn.llm.common import table

WORDS = "the of and to in is was for on that with as it by at from this are be have has not but they his her which you all we one can out more when".split()
BAD = ["idiot", "scum", "worthless", "pathetic"]


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(rng, n, group=None):
    """Texts of common words; half are toxic, by one bad word (of those with a group some without it), and name the group much more often."""
    docs, labels = [], []
    for i in range(n):
        toxic = i % 2
        words = rng.choices(WORDS, k=rng.randint(5, 120))
        if toxic and (group is None or rng.random() < 0.6):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "s"]))
        if group and rng.random() < (0.9 if toxic else 0.05):
            words.insert(rng.randrange(len(words)), group)
        docs.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(spark):
    docs, labels = corpus(random.Random(1), 1200)
    d, l = frames(spark, docs, labels)
    out = {r.doc_id: r for r in toxicity.score_toxicity(d, l).collect()}
    truth = dict(labels)
    assert all(out[i].held_out == held(i) and out[i].predicted == int(out[i].score >= 0.3) and 0 <= out[i].score <= 1 for i in out)
    unseen = [i for i in out if held(i)]
    assert np.mean([out[i].predicted == truth[i] for i in unseen]) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels = corpus(random.Random(2), 300)
    a = toxicity.score_toxicity(*frames(spark, docs, labels)).collect()
    b = toxicity.score_toxicity(*frames(spark, docs, [(i, 1 - t if held(i) else t) for i, t in labels])).collect()
    assert sorted(a) == sorted(b)


def test_a_neutral_mention_costs_less_with_swaps(spark):
    docs, labels = corpus(random.Random(3), 1000, "muslims")
    d, l = frames(spark, docs, labels)
    plain, fair = toxicity.learn(d, l, fairness=0.0), toxicity.learn(d, l, fairness=50.0)
    clean = "They have all been to the market and it was for one of the"
    change = lambda m, a, b: abs(m.score(f"{clean} {a}.") - m.score(f"{clean} {b}."))
    assert plain.score(f"{clean} muslims.") > 2 * fair.score(f"{clean} muslims.")
    assert change(fair, "muslims", "christians") < 0.1 and change(plain, "muslims", "christians") > 0.3
    assert fair.score(f"{clean} idiot.") > fair.score(f"{clean} muslims.") + 0.3


def test_a_fit_equals_plain_descent():
    rng = np.random.default_rng(1)
    x = (rng.random((200, 5)) < 0.4).astype(float)
    y = (x[:, 0] + rng.random(200) > 0.9).astype(int)
    change = np.diag([0.0, 3.0, 0, 0, 0])
    w, b = toxicity.fit([np.flatnonzero(r).tolist() for r in x], y, np.ones(200), change)
    v, c = np.zeros(5), 0.0
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-(x @ v + c)))
        v, c = v - 0.005 * (x.T @ (p - y) + v + change @ v), c - 0.005 * ((p - y).sum() + 1e-6 * c)
    assert np.allclose(w, v, atol=1e-3) and abs(b - c) < 1e-3


def test_swaps():
    groups = {w: g for g in [["women", "men"], ["a", "b", "c"]] for w in g}
    assert sorted(toxicity.swaps("Women and men, a A.", groups)) == ["men and men a a", "women and men b b", "women and men c c", "women and women a a"]
    assert list(toxicity.swaps("nobody here", groups)) == []


def test_odd_rows(spark):
    docs = [(1, None), (1, "x y"), (2, ""), (None, "idiot"), (3, "idiot " * 400_000), (4, "fine"), (5, "§ 12"), (6, "fine")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for labels, want in ([], 0.0), ([(4, 1), (None, 0)], 1.0), ([(4, 0), (4, None), (5, 7)], 0.0):
        out = toxicity.score_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(out) == len(docs) and all(abs(r.score - want) < 1e-6 for r in out)
    assert toxicity.score_toxicity(d.filter("false"), spark.createDataFrame([(4, 1), (3, 0)], "doc_id long, toxic int")).collect() == []
    clash = d.select("*", *[d["doc_id"].alias(c) for c in ("_text", "toxic", "score", "f", "found", "held_out")])
    both = toxicity.score_toxicity(clash, spark.createDataFrame([(4, 0), (4, 1), (6, 0), (3, 1)], "doc_id long, toxic int"))
    assert len(both.collect()) == len(docs)


def test_the_tables(spark, sf):
    out = toxicity.op12_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == table(spark, sf, "documents").count()
