"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns in every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontaminate, language_id, line_dedup, near_dedup, packing, secrets, sharding, substring_dedup, token_count, vector_dedup

LONG = "long line of words " * 3000
ROWS = [
    (1, "The cat sat on the mat with a hat.\nShared line", "en", "a", 10),
    (1, "The cat sat on the mat with a hat.\nShared line", "en", "a", 10),
    (2, None, None, None, None),
    (None, None, None, None, None),
    (None, "Le chat est sur le tapis.", None, "b", 3),
    (3, "", "fr", "", 0),
    (4, LONG, "en", "a", 5),
    (5, LONG + "!", "en", None, 5),
    (6, 'token = "abcdefghij0123456789abcdefghij01" 12345', None, "b", 1),
    (7, "§ 12 ½ !!", "de", "b", 1),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["_text", "k1", "k2", "t", "key", "keys", "n", "label", "node", "kept", "kept_text", "n_lines", "piece", "start", "length", "shard", "slot", "score",
           "lang_pred", "n_tokens", "class_id", "spans", "_row", "_k1", "hash", "owner", "anchor", "item_id", "words", "a", "b", "_block", "_range", "_at"]


def table(spark, kind):
    df = spark.createDataFrame(ROWS if kind != "empty" else [], DOCS)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)]) if kind == "clashes" else df


def benchmark(spark):
    return spark.createDataFrame([(1, "a benchmark passage of some length"), (2, None), (None, "xy"), (3, "")], "item_id long, text string")


OPERATORS = {
    "tokens": lambda s, d: token_count.count_tokens(d, token_count.piece_file()),
    "secrets": lambda s, d: secrets.scan_secrets(d),
    "packing": lambda s, d: packing.pack_documents(d, packing.tokenizer_file()),
    "lines": lambda s, d: line_dedup.dedup_lines(d, 2),
    "benchmark": lambda s, d: decontaminate.find_benchmark(d, benchmark(s)),
    "language": lambda s, d: language_id.identify_language(d),
    "near": lambda s, d: near_dedup.find_near_duplicates(d),
    "shards": lambda s, d: sharding.shard_documents(d),
    "substrings": lambda s, d: substring_dedup.dedup_substrings(d),
}
PER_ROW = ["tokens", "secrets", "lines", "language", "near", "shards", "substrings"]


@pytest.mark.parametrize("kind", ["plain", "empty", "clashes"])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, name, kind):
    out = OPERATORS[name](spark, table(spark, kind)).collect()
    if kind == "empty":
        assert out == []
    elif name in PER_ROW:
        assert len(out) == len(ROWS)


@pytest.mark.parametrize("kind", ["plain", "empty", "clashes"])
def test_stages(spark, sf, kind):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table(spark, kind), sf)
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert (out.count() == 0) == (kind == "empty"), name
    packed = corpus_pipeline.STAGES[-1][1](spark, table(spark, kind), sf)
    assert (packed.count() == 0) == (kind == "empty")


VECTORS = [
    (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [1.0, None], 0), (6, [float("nan"), 1.0], 0),
    (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (None, [0.0, 1.0], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0),
]


@pytest.mark.parametrize("kind", ["plain", "empty", "clashes"])
def test_vectors(spark, kind):
    df = spark.createDataFrame(VECTORS if kind != "empty" else [], "vec_id long, embedding array<float>, label int")
    if kind == "clashes":
        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(["t", "grp", "v", "copies", "kept", "n_links", "node", "a", "b", "cos"])])
    out = vector_dedup.link_vectors(df).collect()
    if kind == "empty":
        assert out == []
        return
    assert len(out) == len(VECTORS)
    links = sorted((r.vec_id or -1, r.n_links) for r in out)
    assert links == [(-1, 0), (1, 2), (1, 2), (2, 2), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (10, 0)]
