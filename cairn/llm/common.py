"""Scratch tables, gapless ranks and small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
_MADE: list["Scratch"] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor shares, as the session names it in spark.checkpoint.dir.

    Only a single-machine session (master local or local[n], as in tests) may leave it unset;
    it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="cairn-"))
    return f"file://{_LOCAL_ROOT[0]}"


class Scratch:
    """Intermediate tables of one run, written as Parquet in the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks it ran, not the stages
    before the table, and both readers of a table see the same rows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/cairn-{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        _MADE.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads; all of them without names."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.names -= set(names or self.names)

    def drop_all_but(self, *names: str) -> None:
        """Delete every table that the result does not read."""
        if gone := self.names - set(names):
            self.drop(*gone)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches: a task holds Python values of few texts at a time, however long batches are."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.slice(a, rows)


def clear_scratch() -> None:
    """Delete all tables of this process's operators, once their results have been written."""
    while _MADE:
        _MADE.pop().drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes, null as no bytes."""
    return F.coalesce(F.col(col).cast("binary"), F.lit("").cast("binary"))


def row_key(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes naming a row by its content; equal rows share a name."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("second"), *cols).alias("k2")]


def gapless_rank(df: DataFrame, group: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gathering a group in one task.

    block splits every group into pieces that each fit a task and whose order is the wanted
    one. Pieces are counted, the counts are summed up piece by piece, and rows are numbered
    inside their piece only. df must give the same rows each time it is read (a scratch table).
    """
    counts = df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, block).orderBy(*order)
    ranked = df.withColumn("_in", F.row_number().over(inside) - 1)
    return (
        ranked.join(starts, [*group, block])
        .withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_before", "_in")
    )
