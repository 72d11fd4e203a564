"""Intermediate tables in the folder that the session's executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where one machine runs everything."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='cairn-tables-')}")
    return _LOCAL[0]


def fresh_root(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, until clear_tables()."""
    root = f"{shared_folder(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    _MADE.append(root)
    return root


def clear_tables(spark: SparkSession) -> None:
    """Delete all folders that this process's queries made, once their results have been written or read."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = hadoop.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


def keeper(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """keep(df, name) writes df below a fresh folder and reads it again."""
    root = fresh_root(spark, "tables")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return keep
