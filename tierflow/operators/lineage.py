"""Steps written to the shared folder: plans that read a step several times stay small, and lost executors cost one step only."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none and Spark runs in one process, as in tests, one of this machine."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file:{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of the rows, which keeps ``keys``, written in buckets by them.

    The rows are exchanged once, before the work; windows and groupings by these keys, or more, take no exchange after that, however often the table is read.
    """
    spark, name = df.sparkSession, f"step_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work(df.repartition(n, *keys)).write.format("parquet").bucketBy(n, *keys).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name, which nothing else asks for: files at a path of their own stay
    return out
