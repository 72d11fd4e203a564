"""Documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of documents; further columns of the input are left out. An empty
table passes through every stage; null texts go in the first one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, language_id, line_dedup, near_dedup, packing
from cairn.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Mean support of the words for the predicted language below which a document is rejected.
LEAST_SCORE = 0.3
#: Documents from which on a line counts as repeated.
LINE_DOCS = 10


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose words speak for no language, go.

    Null and empty texts have no letter. Of languages that tie the first in code-point order
    counts; repeated rows all stay or all go; texts of any length are read whole.
    """
    docs = docs.select(*COLUMNS)
    found = language_id.identify(docs, language_id.learn(docs), COLUMNS)
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that LINE_DOCS or more documents share go; text and n_chars are those of the lines that stay.

    Every document stays, if with an empty text; a null text becomes empty. Repeated rows count as
    documents each.
    """
    docs = docs.select(*COLUMNS)
    kept = line_dedup.dedup_lines(docs, LINE_DOCS, ["doc_id", "lang", "source"])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id stays, and of repeated rows of it one.

    Null and empty texts, and texts without a word, are classes of their own and stay; a null
    doc_id is the largest of its class.
    """
    return near_dedup.drop_near_duplicates(docs.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts, and repeated rows of clean ones, stay."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset; a null or empty text is one piece of one token."""
    return packing.pack_documents(docs, packing.tokenizer_file())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next one."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs


#: Tokenizing, alignment and trained models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
