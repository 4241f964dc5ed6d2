"""Streams of attempts and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.difficulty import first_by
from ..operators.upkeep import sync_order

#: Parts of a tier that become one of the next.
FAN = 8
KEYS = ["entity_id", "item_id"]


def winners(rows: DataFrame) -> DataFrame:
    """The best attempt of each entity at each item."""
    return first_by(rows, KEYS, sync_order())


def _folder(spark: SparkSession, path: str):
    """The folder, and its file system, which may be any that Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def parts(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """The whole parts under ``path`` by tier, oldest first, without those that a part of the next tier has taken in."""
    folder, files = _folder(spark, path)
    found: dict[int, list[str]] = {}
    for tier in files.listStatus(folder) if files.exists(folder) else []:
        number = int(tier.getPath().getName().rpartition("=")[2])
        for part in sorted(files.listStatus(tier.getPath()), key=lambda x: (x.getModificationTime(), x.getPath().getName())):
            names = {x.getPath().getName() for x in files.listStatus(part.getPath())}
            if "_SUCCESS" in names and "_merged" not in names:
                found.setdefault(number, []).append(part.getPath().toString())
    return found


def _read(spark: SparkSession, folders: list[str], schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def current_state(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The best attempt of each entity at each item of all that came so far."""
    return winners(_read(spark, [f for found in parts(spark, path).values() for f in found], schema))


def compact(spark: SparkSession, path: str, schema: str | StructType, fan: int = FAN) -> int:
    """Merge each tier of ``fan`` parts or more into one part of the next, and return how many were merged.

    A winner is the same however often and in whatever order rows are compared, so parts may be read besides the one that took them in: those are only marked, and removed by the
    next call, when readers are done with them. A call that fails leaves a part that isn't whole, or rows twice, and neither changes the state.
    """
    merged = 0
    folder, files = _folder(spark, path)
    for tier in files.listStatus(folder) if files.exists(folder) else []:
        for part in files.listStatus(tier.getPath()):
            if files.exists(mark := _folder(spark, f"{part.getPath()}/_merged")[0]):
                files.delete(part.getPath(), True)
    tier = 0
    while found := parts(spark, path).get(tier):
        if len(found) >= fan:
            winners(_read(spark, found, schema)).write.parquet(f"{path}/tier={tier + 1}/part={uuid.uuid4().hex}")
            for part in found:
                mark, _ = _folder(spark, f"{part}/_merged")
                files.create(mark).close()
            merged += len(found)
        tier += 1
    return merged


def stream_upserts(stream: DataFrame, path: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Keep the best attempts of ``stream`` under ``path``; late rows count whenever they come. Readers take ``current_state``.

    A batch writes its own winners alone, so it reads nothing and writes in proportion to itself; parts are merged by tiers, so a row is written again once for each
    tier, of which there are as many as the logarithm of the number of batches. A batch that runs again after a failure replaces its part, or adds the same rows where that was merged already; a stream with a
    new checkpoint adds to what is there. Results depend on neither.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
        winners(batch).write.mode("overwrite").parquet(f"{path}/tier=0/part={query}-{number}")
        compact(spark, path, batch.schema, fan)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_events(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each event once, if its copies come within ``delay`` of each other; state is dropped after that."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
