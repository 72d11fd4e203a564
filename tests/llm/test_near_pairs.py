"""Similar pairs that no first text of a bucket settles."""

import numpy as np
import xxhash

from cairn.llm import near_dedup


def _hashes(words):
    return near_dedup.word_hashes(" ".join(words))


def _digest(words):
    return xxhash.xxh3_128_digest(_hashes(words).tobytes())


def _shared(x, y):
    return np.flatnonzero(near_dedup.samples_of(_hashes(x)) == near_dedup.samples_of(_hashes(y)))


def _near(x, y):
    return near_dedup.are_near(*((_hashes(w) >> np.uint64(32)).astype(np.uint32) for w in (x, y)))


def _edited(rng, words, edits, keep, before=None):
    """words with so many replaced, none of which changes the samples in keep; its digest lies before another."""
    want = near_dedup.samples_of(_hashes(words))[keep]
    while True:
        out, left = list(words), edits
        places = iter(rng.permutation(len(words)))
        while left and (i := next(places, None)) is not None:
            old, out[i] = out[i], f"e{rng.integers(1 << 40)}"
            if (near_dedup.samples_of(_hashes(out))[keep] == want).all():
                left -= 1
            else:
                out[i] = old
        if not left and (before is None or _digest(out) < before):
            return out


def _pair(rng):
    """Two texts that differ in a twentieth of their words and share one to three samples."""
    while True:
        x = [f"w{i}" for i in rng.integers(0, 1 << 30, 300)]
        y = _edited(rng, x, 15, np.zeros(0, int))
        if _near(x, y) and 1 <= len(keep := _shared(x, y)) <= 3:
            return x, y, keep


def _classes(spark, texts):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.class_id for r in near_dedup.find_near_duplicates(docs).collect()}


def test_pair_with_few_shared_samples_behind_other_leaders(spark):
    rng = np.random.default_rng(1)
    x, y, keep = _pair(rng)
    first = min(_digest(x), _digest(y))
    one, two = (_edited(rng, x, 120, keep, first) for _ in range(2))
    assert not any(_near(a, b) for a, b in ((one, x), (one, y), (two, x), (two, y), (one, two)))
    got = _classes(spark, [x, y, one, two])
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_link_between_two_led_classes(spark):
    rng = np.random.default_rng(2)
    x, y, keep = _pair(rng)
    one = _edited(rng, x, 25, keep, min(_digest(x), _digest(y)))
    two = _edited(rng, y, 25, keep, min(_digest(x), _digest(y)))
    assert _near(x, one) and _near(y, two) and not (_near(x, two) or _near(y, one) or _near(one, two))
    assert set(_classes(spark, [x, y, one, two]).values()) == {0}


def test_parities_bound_the_words_that_differ():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x, y = (rng.integers(0, rng.integers(2, 400), rng.integers(1, 600)).astype(np.uint64) for _ in range(2))
        bits = sum(int(v).bit_count() for v in (near_dedup.bag_bits(x) ^ near_dedup.bag_bits(y)).view(np.uint64))
        assert bits + abs(len(x) - len(y)) <= 2 * near_dedup.bag_distance(x, y)
