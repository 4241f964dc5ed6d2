"""What is taken in: cleaned items, attempts and entities, enrichment, and scans for what should not be there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import number
from .audits import failed_rules

#: Shapes of identifiers that no published text should have: UUIDs and keys of 20 hex digits.
IDENTIFIER = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\b[0-9a-f]{20}\b"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def clean_items(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Items with an id, the allowed columns only; tempos that aren't positive numbers are null, and a reversed range is turned."""
    positive = lambda c: F.when(number(F.col(c)) > 0, number(F.col(c)))
    rows = rows.filter(~blank(F.col("item_id"))).withColumns({"_a": positive("bpm_min"), "_b": positive("bpm_max")})
    turned = F.col("_a") > F.col("_b")
    low, high = F.when(turned, F.col("_b")).otherwise(F.col("_a")), F.when(turned, F.col("_a")).otherwise(F.col("_b"))
    return rows.withColumns({"bpm_min": low, "bpm_max": high}).select(*allowed)


def clean_attempts(rows: DataFrame) -> DataFrame:
    """Attempts with both ids and a finite value that aren't broken; texts are trimmed and blank ones are null, a missing time is an empty text."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rows.filter(~blank(F.col("entity_id")) & ~blank(F.col("item_id")) & ~F.coalesce("is_broken", F.lit(False))).withColumns({"value": number(F.col("value")), "score": number(F.col("score"))})
    return rows.filter("value is not null").withColumns({"grade": text("grade"), "medal": text("medal"), "recorded_at": F.coalesce("recorded_at", F.lit("")), "is_broken": F.lit(False)})


def clean_entities(rows: DataFrame, order: str) -> DataFrame:
    """One row for each entity, whose id is the first of entity_id and user_id that isn't blank; the first by ``order`` wins."""
    key = F.coalesce(*[F.when(~blank(F.col(c)), F.col(c)) for c in ("entity_id", "user_id")])
    rows = rows.withColumn("entity_id", key).filter("entity_id is not null")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy(order))).filter("_r = 1").drop("_r", "user_id")


def with_tempo(items: DataFrame, songs: DataFrame) -> DataFrame:
    """Items with the tempo range of the song of their title; ``songs`` (title, bpm struct<min, max>, seq) may have a title twice, the last one counts."""
    last = songs.filter(~blank(F.col("title"))).groupBy("title").agg(F.max_by("bpm", "seq").alias("bpm"))
    return items.drop("bpm_min", "bpm_max").join(last.select("title", F.col("bpm.min").alias("bpm_min"), F.col("bpm.max").alias("bpm_max")), "title", "left")


def field_names(raw: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """(path, n) of JSON fields of objects in ``column``, one level deep too, that aren't allowed; nested ones are named outer.inner."""
    keys = raw.select(F.explode(F.from_json(column, "map<string, string>")).alias("key", "inner"))
    deep = keys.select(F.explode(F.transform(F.json_object_keys("inner"), lambda k: F.concat("key", F.lit("."), k))).alias("path"))
    paths = keys.select(F.col("key").alias("path")).unionByName(deep)
    return paths.filter(~F.col("path").isin(*allowed)).groupBy("path").agg(F.count("*").alias("n"))


def shaped_values(df: DataFrame, pattern: str) -> DataFrame:
    """(column, n): rows in which a text, or a text of an array, has ``pattern``; all columns are read in one pass."""
    found = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            found[f.name] = F.col(f"`{f.name}`").rlike(pattern)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            found[f.name] = F.exists(f"`{f.name}`", lambda x: F.coalesce(x.rlike(pattern), F.lit(False)))
    return failed_rules(df, {n: ~F.coalesce(c, F.lit(False)) for n, c in found.items()}).withColumnRenamed("rule", "column")


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, verdict) of (name, n, digest) tables: exact, changed, missing or unexpected."""
    both = files.select("name", F.struct("n", "digest").alias("l")).join(manifest.select("name", F.struct("n", "digest").alias("r")), "name", "full_outer")
    verdict = F.when(F.col("l").isNull(), "missing").when(F.col("r").isNull(), "unexpected").when(F.col("l") == F.col("r"), "exact").otherwise("changed")
    return both.select("name", verdict.alias("verdict"))


def unresolved(derived: DataFrame, entities: DataFrame, items: DataFrame) -> DataFrame:
    """(rule, n): derived rows (entity_hash, item_id) whose hash or item no base row has, and hashes that several entities share; ``entities``: (entity_id, entity_hash)."""
    count = lambda rows, rule: rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    twice = entities.groupBy("entity_hash").agg(F.count_distinct("entity_id").alias("m")).filter("m > 1")
    checks = [
        count(derived.join(entities, "entity_hash", "left_anti"), "unknown entity"), count(derived.join(items, "item_id", "left_anti"), "unknown item"), count(twice, "shared hash"),
    ]
    return reduce(DataFrame.unionByName, checks)


def annotations(notes: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, problem) of notes (item_id, from_level, delta, direction): null where a note holds, else the first thing wrong with it."""
    many = notes.groupBy("item_id").agg(F.count("*").alias("times"))
    rows = notes.join(many, "item_id").join(items.select("item_id", F.col("level").alias("known")), "item_id", "left")
    said = F.when(F.col("delta") > 0, "uprated").otherwise("downrated")
    problem = F.when(F.col("known").isNull(), "unknown item").when(F.col("times") > 1, "twice").when(~F.col("from_level").eqNullSafe(F.col("known")), "other level")
    problem = problem.when(F.coalesce("delta", F.lit(0)) == 0, "no change").when(~F.col("direction").eqNullSafe(said), "wrong direction")
    return rows.select("item_id", problem.alias("problem"))
