"""Texts of three million characters in every operator on texts, beyond the pieces that they are worked on in."""

import hashlib
import random
import re

import pytest

from cairn.llm import decontaminate, language_id, line_dedup, near_dedup, packing, ranked_search, secrets, substring_dedup, token_count, toxicity

N = 3_000_000
SCHEMA = "doc_id long, text string, lang string, source string"


def prose(seed, n=N):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000)]
    out, size = [], 0
    while size < n:
        w = rng.choice(words)
        out.append(w)
        size += len(w) + 1
    return " ".join(out)


@pytest.fixture(scope="module")
def text():
    return prose(1)


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)


def test_token_counts(spark):
    unit = " alpha beta, gamma"
    k = N // len(unit)
    model = token_count.Unigram(token_count.vocabulary(token_count.piece_file()))
    out = token_count.count_tokens(frame(spark, unit * k), token_count.piece_file()).first()
    assert out.n_tokens - model.count(unit * 2)[0] == (k - 2) * (model.count(unit * 2)[0] - model.count(unit)[0])


def test_secrets(spark):
    rng = random.Random(2)
    parts = [rng.choice(["token=abcdefgh1 ", "x ", "password: 'Qw3rtyQw3rtyQw3rtyQw3rty1' ", "AKIA" + "B" * 16 + " ", "0123456789abcdef" * 2 + " ", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7Op8Q ", "é "]) for _ in range(250_000)]
    text = "".join(parts)
    assert len(text) > N
    want = []
    for kind, (name, pattern, group, least) in enumerate(secrets.KINDS):
        want += [(m.start(), kind, name, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    base = ",".join(f"{name}:{a}:{z}" for a, _, name, z in sorted(want))
    out = secrets.scan_secrets(frame(spark, text, "x")).filter("doc_id = 0").first()
    assert out.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and len(want) > 100_000


def test_packing(spark, text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(packing.tokenizer_file()).encode(text, add_special_tokens=False).ids + [2]
    out = sorted(packing.pack_documents(frame(spark, text), packing.tokenizer_file()).select("piece", "start", "length").collect())
    assert [r.piece for r in out] == list(range(len(out))) and sum(r.length for r in out) == len(ids) and all(a.start + a.length == b.start for a, b in zip(out, out[1:], strict=False)) and len(out) > 400


def test_lines(spark):
    rng = random.Random(3)
    lines = [f"line {rng.randrange(60_000)} of a long text" for _ in range(120_000)]
    texts = ["\n".join(lines), "\n".join(lines[:1000]), "other"]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, *texts), 2).collect()}
    common = set(lines[:1000])
    kept = "\n".join(x for x in lines if x not in common)
    assert out[0].n_lines == 120_000 and out[0].n_dropped == sum(x in common for x in lines) and out[0].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest() and out[1].n_dropped == 1000


def test_benchmark(spark, text):
    item = "this passage of a benchmark stands near the end of a very long text and nowhere else"
    at = len(text) - 1000
    planted = text[:at] + " " + item.replace("nowhere", "nowhe re") + " " + text[at:]
    found = decontaminate.find_benchmark(frame(spark, planted, text), spark.createDataFrame([(7, item), (8, "x" * 50)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in found] == [(0, 7, 1)] and abs(found[0].start - at) < 5


def test_near_duplicates(spark, text):
    assert len(text.split()) > near_dedup.COLUMNS
    words = text.split()
    rng = random.Random(5)
    for _ in range(200):
        words[rng.randrange(len(words))] = "changed"
    out = {r.doc_id: r.class_id for r in near_dedup.find_near_duplicates(frame(spark, text, " ".join(words), prose(9))).collect()}
    assert out[0] == out[1] != out[2]


def test_substrings(spark, text):
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefghij klm", k=5000))
    other = prose(11)
    a, b = text[:2_500_000] + passage + text[2_500_000:], other[:100] + passage + other[100:]
    assert len(a) > 2 * substring_dedup.CHUNK
    out = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(spark, a, b, passage[:150])).collect()}
    for k, (whole, at) in enumerate(((a, 2_500_000), (b, 100))):
        left = len(passage)  # by chance a character beside the passage may be the same
        assert left <= out[k].n_removed <= left + 20 and out[k].n_spans == 1 and out[k].n_bytes == len(whole)
    assert out[2].n_removed == 0


def test_language_toxicity_and_search(spark, text):
    docs = frame(spark, text, prose(2, 2000), "short one")
    assert language_id.identify_language(docs).count() == 3
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 3
    word = text.split()[1234]
    out = ranked_search.search(docs, spark.createDataFrame([(1, word), (2, text)], "item_id long, text string")).collect()
    assert {(r.item_id, r.doc_id) for r in out} >= {(1, 0), (2, 0)}
