"""Tables as they are published: orders, buckets, nested results and the index of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from .ordering import numbered


def tier_order(placed: DataFrame) -> DataFrame:
    """``place`` of each item in its mode by estimate, those without one last, then title and id."""
    return numbered(placed, [F.col("estimate").asc_nulls_last(), F.col("title").asc(), F.col("item_id").asc()], "place", ["mode"]).withColumn("place", F.col("place").cast("int"))


def buckets(placed: DataFrame) -> DataFrame:
    """(mode, bucket, n, items): items by the tenth that their estimate is cut to, in the order of titles; the catalog bounds the lists."""
    rows = placed.filter("estimate is not null").withColumn("bucket", fx.one_decimal(F.col("estimate")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("title", "item_id"))), lambda x: x["item_id"])
    return rows.groupBy("mode", "bucket").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("items"))


def entity_index(names: DataFrame, best: DataFrame) -> DataFrame:
    """Every named entity (entity_id, name) with its attempts by mode and whether either suffices; a name that several have gets the end of its id."""
    counts = best.groupBy("entity_id").agg(F.count_if(F.col("mode") == "Single").alias("singles"), F.count_if(F.col("mode") == "Double").alias("doubles"))
    often = names.groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("n"))  # summed in parts, so that a frequent name is no hot group
    rows = names.withColumn("low", F.lower("name")).join(often, "low").join(counts, "entity_id", "left").fillna(0, ["singles", "doubles"])
    name = F.when(F.col("n") > 1, F.concat("name", F.lit(" #"), F.expr("right(entity_id, 4)"))).otherwise(F.col("name"))
    enough = (F.col("singles") >= P.MIN_ATTEMPTS) | (F.col("doubles") >= P.MIN_ATTEMPTS)
    return rows.select("entity_id", name.alias("name"), "singles", "doubles", enough.alias("eligible"))


def nested(placed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each mode with its items as an array of structs in tier order; the catalog bounds the arrays."""
    rows = tier_order(placed).select("mode", F.struct("place", *columns).alias("item"))
    return rows.groupBy("mode").agg(F.array_sort(F.collect_list("item")).alias("items"))


def write_tree(placed: DataFrame, path: str, columns: list[str], digits: int = 6) -> None:
    """CSV files by mode and folder, with doubles at ``digits`` decimals."""
    types = dict(placed.dtypes)
    cells = [F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))).alias(c) if types[c] == "double" else F.col(c) for c in columns]
    placed.select("mode", "folder", *cells).repartition("mode", "folder").sortWithinPartitions("mode", "folder").write.partitionBy("mode", "folder").option("header", True).csv(path)


def write_shards(df: DataFrame, path: str, columns: list[str], rows: int = 5000) -> DataFrame:
    """Parquet files of at most ``rows`` rows, and their manifest (file, n, digest); the digest doesn't depend on the order of rows."""
    from .upkeep import row_hash

    df.write.option("maxRecordsPerFile", rows).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    marked = back.select(F.col("_metadata.file_name").alias("file"), row_hash(*columns).alias("h"))
    return marked.groupBy("file").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ",").cast("binary"), 256).alias("digest"))  # ``rows`` bound the list


def model_shards(rows: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """``shard`` (from 0) of each row: ``size`` rows in a row of ``order`` by ``keys``, numbered over ranges."""
    return numbered(rows, order, "place", keys).withColumn("shard", F.floor((F.col("place") - 1) / size)).drop("place")


def packed(rows: DataFrame, key: str, columns: list[str], by: str) -> DataFrame:
    """One row for each key with its rows as an array of structs in the order of ``by``; a key's rows must be few, as lists of 50 are."""
    cells = F.array_sort(F.collect_list(F.struct(F.col(by).alias("_by"), *columns)))
    return rows.groupBy(key).agg(F.transform(cells, lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias("rows"))


def unpacked(lists: DataFrame, key: str) -> DataFrame:
    """The inverse of ``packed``."""
    return lists.select(key, F.inline("rows"))
