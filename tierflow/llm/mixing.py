"""Mixing of sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import unnamed, written

#: Weights of the sources in the order of their names, repeating; times its size that a source may be used; hash seed.
WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix-1"


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space in ``text``, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) for ``sizes`` (source, source_size), one row for each source.

    Sources by code point, null last, get the weights in turn and share all sizes by them; none gets more than ``most``
    times its size, and what is over goes to the others by weight until none is above. In closed form: with sources
    ordered by cap over weight and all before one full, its level is what the rest gets for a weight of one; the levels
    rise while sources fill up and fall after, so the largest holds.
    Works on one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    by_room = Window.orderBy(F.expr(f"{most}D * source_size / w"), F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = F.expr(f"total - {most} * coalesce(used, 0)").cast("double") / F.col("open")
    room = weighted.select(
        "*", F.sum("source_size").over(whole).alias("total"), F.sum("source_size").over(before).alias("used"), F.sum("w").over(after).alias("open")
    ).withColumn("level", level)
    held = F.max("level").over(whole) * F.col("w")
    return room.select("source", "source_size", F.least(held, (most * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target, rate and copies.

    A source's rate is target over size. Each document is taken floor(rate) times and once more if the hash of seed
    and doc_id, as a fraction, is under the rest of the rate, so reruns agree and no document is taken more than
    ``most`` times. Sizes are summed before anything moves; sources, few and of a row each, are then joined to the documents.
    A null or empty text has size 0; null is a source of its own; a null doc_id hashes as an empty one; repeated rows
    are decided alike; a source without words has target and rate 0; an empty table stays empty. Other columns are kept, those with the names
    of the added ones are replaced.
    """
    added = ["size", "source_size", "target", "rate", "copies"]
    rows, column = _mix(docs, weights, most, seed)
    kept = [c for c in docs.columns if c not in added]
    return rows.select(*[column[c] for c in kept], *added).toDF(*kept, *added)


def _mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """The mix with the columns of ``docs`` under other names, and these names."""
    rows, column = unnamed(docs)
    rows = rows.withColumns({"size": n_words(F.col(column["text"]).cast("string")), "source": F.col(column["source"])})
    # a table, so that Spark knows its size and sends it to the documents where it is small
    plan = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "of")
    code = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column["doc_id"]).cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10)
    fraction = code.cast("long") / F.lit(float(1 << 52))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    base = F.floor("rate")
    return joined.withColumn("copies", base + F.when(fraction < F.col("rate") - base, 1).otherwise(0)), column


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``, whatever their names."""
    rows, column = _mix(docs, **options)
    out = rows.withColumn("copies", F.explode(F.expr("case when copies > 0 then sequence(1L, copies) end")))
    return out.select(*column.values()).toDF(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, sum(source_size) OVER () AS total FROM s),
l AS (
  SELECT *, CAST(total - {MOST} * coalesce(sum(source_size) OVER (ORDER BY {MOST} * CAST(source_size AS DOUBLE) / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (ORDER BY {MOST} * CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
t AS (
  SELECT source, source_size, least((SELECT max(level) FROM l) * w, CAST({MOST} * source_size AS DOUBLE)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN
  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / {float(1 << 52)!r} < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
