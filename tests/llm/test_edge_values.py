"""Values, not only counts, for nulls, empty texts, ties, repeated rows, clashing columns and very long texts."""

import hashlib
import resource
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from cairn.llm import decontaminate, language_id, line_dedup, near_dedup, packing, secrets, sharding, substring_dedup, token_count
from tests.llm.test_edges import LONG, ROWS, table

NOTHING = hashlib.sha256(b"").hexdigest()


def _rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module", params=["plain", "clashes"])
def docs(request, spark):
    return table(spark, request.param)


def test_tokens(docs):
    got = _rows(token_count.count_tokens(docs, token_count.piece_file()), "doc_id", "n_tokens", "score")
    model = token_count.Unigram(token_count.vocabulary(token_count.piece_file()))
    want = [(r[0], model.count(r[1])[0]) for r in ROWS]
    assert Counter((a, b) for a, b, _ in got) == Counter(want)
    assert all(s == 0 for _, n, s in got if n == 0) and sum(n == 0 for _, n, _ in got) == 3


def test_secrets(docs):
    got = _rows(secrets.scan_secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    clean = [(r[0], 0, 0, 0, NOTHING) for r in ROWS if r[0] != 6]
    found = hashlib.sha256(b"assign:0:41").hexdigest()
    assert Counter(got) == Counter([*clean, (6, 1, 0, 0, found)])


def test_packing(docs):
    out = packing.pack_documents(docs, packing.tokenizer_file(), with_ids=True).collect()
    assert Counter(r.doc_id for r in out if r.length == 1 and r.ids == [2]) == Counter([2, None, 3])
    by_seat = sorted((r.sequence_id, r.offset, r.length) for r in out)
    at = {}
    for seq, offset, length in by_seat:
        assert offset == at.get(seq, 0)
        at[seq] = offset + length
    assert max(at.values()) <= 1024
    assert len({(r.piece, r.length, r.ids_crc32) for r in out if r.doc_id == 1}) == 1  # repeated rows are alike
    long = sorted((r.start, r.length) for r in out if r.doc_id == 4)
    assert [a + n for a, n in long][:-1] == [a for a, _ in long][1:]


def test_lines(docs):
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs, 2).collect()}
    want = {(1, 2, 2, ""), (2, 1, 0, ""), (None, 1, 0, ""), (None, 1, 0, ROWS[4][1]), (3, 1, 0, ""), (4, 1, 0, LONG), (5, 1, 0, LONG + "!"), (6, 1, 0, ROWS[8][1]), (7, 1, 0, ROWS[9][1])}
    assert got == want


def test_benchmark(spark, docs):
    items = [(1, "the cat  sat on the MAT with a hat."), (2, "the cat sat on the mat with a hat."), (2, "the cat sat on the mat with a hat."), (3, None), (4, ""), (5, "  "), (6, "chat"), (7, "at"), (None, "12345")]
    found = decontaminate.find_benchmark(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id, r.start, r.stop, r.edits) for r in found.collect())
    line = [(1, i, 0, 34, 0) for i in (1, 2, 2)] * 2  # two rows of doc 1, three items of one text
    assert got == Counter([*line, (None, 6, 3, 7, 0), (6, None, 43, 48, 0)])  # short items count as whole words only


def test_language(docs):
    got = _rows(language_id.identify_language(docs), "doc_id", "held_out", "lang_pred", "score")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert Counter((a, b) for a, b, _, _ in got) == Counter((r[0], held(r[0])) for r in ROWS)
    assert {a for a, _, p, s in got if p == "und" and s == 0} == {2, 3, 7, None} and sum(p == "und" for _, _, p, _ in got) == 4


def test_near(docs):
    got = _rows(near_dedup.find_near_duplicates(docs), "doc_id", "class_id", "kept")
    want = [(1, 1, True), (1, 1, False), (2, 2, True), (None, None, True), (None, None, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True)]
    assert Counter(got) == Counter(want)


def test_shards(docs):
    got = _rows(sharding.shard_documents(docs), "doc_id", "size", "text_crc32", "shard", "slot", "grown_shard", "law")
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert Counter(x[:3] for x in got) == want and {x[6] for x in got} == {"key"}
    for shard in {x[3] for x in got}:
        slots = sorted(x[4] for x in got if x[3] == shard)
        assert slots == list(range(len(slots)))
    assert len({x[3] for x in got if x[0] == 1}) == 1 and all(x[5] in (x[3], 16) for x in got)


def test_substrings(docs):
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in substring_dedup.dedup_substrings(docs).collect()}
    texts = {r[0]: len((r[1] or "").encode()) for r in ROWS if r[0]}
    assert {(4, len(LONG), len(LONG), 1), (5, len(LONG) + 1, len(LONG), 1)} <= got
    assert all(n == 0 and (i is None or texts[i] == size) for i, size, n, _ in got if i not in (4, 5))


def test_many_different_spans_around_one_passage(spark):
    rng = np.random.default_rng(10)
    passage = "".join(map(chr, rng.integers(97, 123, 400)))
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    rows = [(i, word(150) + "ab"[i % 2] + passage + "xyz"[i % 3] + word(150)) for i in range(2600)]
    out = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), group_spans=100).collect()}
    seen = Counter(t[s : s + 200] for _, t in rows for s in range(130, 380))
    want = {}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for s in range(130, 380):
            if seen[t[s : s + 200]] > 1:
                gone[s : s + 200] = True
        want[i] = (int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()))
    assert out == want and min(n for n, _ in want.values()) > 400


REPETITIVE = """
import resource, sys
from cairn.llm import decontaminate as D
items = D.Items.of([(1, "ab" * 200), (2, "some other passage that is not there at all")])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
hits = D.find_items(" " + "ab" * 500_000, items)
print(len(hits), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_repetitive_text_of_a_million_characters():
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", REPETITIVE], capture_output=True, text=True, cwd=root, timeout=600, check=True)
    hits, mb = map(int, out.stdout.split())
    assert hits > 2000 and mb < 400
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0


@pytest.mark.parametrize("edits,least", [(0.03, 1.0), (0.05, 0.99), (0.08, 0.95), (0.1, 0.9)])
def test_near_pairs_share_a_sample(edits, least):
    rng, near, shared = np.random.default_rng(int(edits * 100)), 0, 0
    for _ in range(300):
        x = [f"w{i}" for i in rng.integers(0, 1 << 30, 300)]
        y = list(x)
        for i in rng.permutation(300)[: int(300 * edits)]:
            y[i] = f"e{rng.integers(1 << 40)}"
        a, b = (near_dedup.word_hashes(" ".join(w)) for w in (x, y))
        assert near_dedup.are_near(*((v >> np.uint64(32)).astype(np.uint32) for v in (a, b)))
        near += 1
        shared += bool((near_dedup.samples_of(a) == near_dedup.samples_of(b)).any())
    assert shared >= least * near


def test_pairs_of_scattered_edits_are_joined(spark):
    rng, rows = np.random.default_rng(7), []
    for k in range(200):
        x = [f"w{i}" for i in rng.integers(0, 1 << 30, 200)]
        y = list(x)
        for i in rng.permutation(200)[: 6 + k % 15]:
            y[i] = f"e{rng.integers(1 << 40)}"
        rows += [(2 * k, " ".join(x)), (2 * k + 1, " ".join(y))]
    got = {r.doc_id: r.class_id for r in near_dedup.find_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(c in (i, i - 1) for i, c in got.items())
    assert sum(got[2 * k + 1] == 2 * k for k in range(200)) >= 0.95 * 200
