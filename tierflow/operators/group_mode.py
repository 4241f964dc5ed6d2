"""Difficulty in the group mode, where attempts have no comparable value: scores adjusted to the median ability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from .difficulty import first_by
from .lineage import written
from .quantiles import large_keys, percentiles

TERMS = ("x1", "x2", "x3", "x4")


def catalog(items: DataFrame) -> DataFrame:
    """Group items for two to five."""
    return items.filter((F.col("mode") == P.GROUP) & F.col("level").between(2, 5)).withColumn("folder", F.concat(F.col("level").cast("string"), F.lit("x")))


def observations(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """The best attempt of each entity at each group item, of the archive only where the current source has none.

    Order: score (whole, at most a million), its rating, time as text, arrival. Values may be zero here; scores without a grade or medal are left out.
    Rows are written with their score, so that grades are told from a column and not from all that a score is made of, and one exchange by entity and item does the rest.
    """
    known = catalog(items).select("item_id", "notes_archive", "notes_current")
    rows = attempts.filter(~F.coalesce("is_broken", F.lit(False))).join(known, "item_id")
    score = F.when(F.col("source") == "archive", fx.normal_score(F.col("score"), F.col("notes_archive"), F.col("notes_current"))).otherwise(F.col("score"))
    rows = written(rows.withColumn("score", F.least(score.cast("long"), F.lit(1_000_000))).select("entity_id", "item_id", "source", "score", "medal", "recorded_at", "seq"))
    rows = rows.withColumns({"grade": fx.grade(F.col("score")), "medal": fx.medal_name(F.col("medal"))}).filter("grade is not null and medal is not null and source in ('current', 'archive')")
    rows = rows.withColumn("rating", fx.group_rating(F.col("grade"), F.col("medal"))).repartition("entity_id", "item_id")
    order = [F.col("score").desc(), F.col("rating").desc(), F.col("recorded_at").desc_nulls_last(), F.col("seq")]
    rows = first_by(rows, ["source", "entity_id", "item_id"], order).select("entity_id", "item_id", "source", "score", "grade", "medal", "rating", "recorded_at", "seq")
    current = F.max(F.col("source") == "current").over(Window.partitionBy("entity_id", "item_id")) & F.col("entity_id").isNotNull()
    return rows.withColumn("has_current", current).filter((F.col("source") == "current") | ~F.col("has_current")).drop("has_current")


def totals(observed: DataFrame) -> DataFrame:
    """(entity_id, total, n): the group rating of an entity is the sum over its items."""
    return observed.groupBy("entity_id").agg(F.sum("rating").alias("total"), F.count("*").alias("n"))


def with_ability(observed: DataFrame, abilities: DataFrame) -> DataFrame:
    """``ability`` from (source, entity_id, percentile): of the same source, else of the other, else a half; and which of them it is."""
    same = abilities.select("source", "entity_id", F.col("percentile").alias("same"))
    other = abilities.select(F.when(F.col("source") == "archive", "current").otherwise("archive").alias("source"), "entity_id", F.col("percentile").alias("other"))
    rows = observed.join(same, ["source", "entity_id"], "left").join(other, ["source", "entity_id"], "left")
    origin = F.when(F.col("same").isNotNull(), "same").when(F.col("other").isNotNull(), "other").otherwise("median")
    return rows.withColumns({"ability": F.coalesce("same", "other", F.lit(0.5)), "ability_from": origin}).drop("same", "other")


def design(rows: DataFrame) -> DataFrame:
    """The response y (log of the miss) and the terms: ability around a half, its square and cube, and whether the row is current."""
    a = F.col("ability") - 0.5
    return rows.withColumns({"y": fx.log_miss(F.col("score")), "x1": a, "x2": a * a, "x3": a * a * a, "x4": F.when(F.col("source") == "current", 1.0).otherwise(0.0)})


def coefficients(rows: DataFrame) -> list[float]:
    """Least squares of y on the terms within items. The driver gets one row of 14 sums and solves four equations.

    Sums go around each item's means, which come from one grouping; a design of zeros gives zeros.
    """
    names = ("y", *TERMS)
    means = rows.groupBy("item_id").agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    off = rows.join(means, "item_id").select(*[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])
    pairs = [(a, b) for i, a in enumerate(TERMS) for b in TERMS[i:]] + [(a, "y") for a in TERMS]
    sums = off.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0.0)).alias(f"{a}{b}") for a, b in pairs]).first()
    gram = np.array([[sums[min(a, b) + max(a, b)] for b in TERMS] for a in TERMS])
    return [float(v) for v in np.linalg.pinv(gram, rcond=1e-14, hermitian=True) @ np.array([sums[f"{a}y"] for a in TERMS])]


def signals(rows: DataFrame, fitted: list[float]) -> DataFrame:
    """(item_id, signal, support): the lower quartile of each item's log miss, as of the median ability in the current source."""
    shift = sum((F.col(c) * v for c, v in zip(TERMS, fitted, strict=True)), F.lit(0.0))
    return percentiles(rows, ["item_id"], F.col("y") - shift + fitted[3], {"signal": 0.25}, [F.count("*").alias("support")], large=large_keys(rows, ["item_id"]))


def calibrated(signals: DataFrame) -> DataFrame:
    """``continuous``: signals between their least, middle and largest drawn onto the anchors. There is a row for each group item."""
    easy, middle, hard = P.GROUP_ANCHORS
    order = Window.orderBy("signal", "item_id")
    n = F.count("*").over(Window.partitionBy())
    spots = signals.select("signal", F.row_number().over(order).alias("r"), n.alias("n"))
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("signal")))
    ends = spots.agg(F.min("signal").alias("low"), at(F.floor((F.col("n") + 1) / 2)).alias("under"), at(F.floor(F.col("n") / 2) + 1).alias("over"), F.max("signal").alias("high"))
    rows = signals.join(F.broadcast(ends), how="cross")  # one row
    s = F.col("signal")
    below = F.when(F.col("under") > F.col("low"), (s - F.col("low")) / (F.col("under") - F.col("low")) * (middle - easy) + easy).otherwise(middle)
    above = F.when(F.col("high") > F.col("over"), (s - F.col("over")) / (F.col("high") - F.col("over")) * (hard - middle) + middle).otherwise(middle)
    out = F.when(F.col("low") == F.col("high"), middle).when(s <= F.col("under"), below).when(s <= F.col("over"), middle).otherwise(above)
    return rows.withColumn("continuous", F.greatest(F.lit(easy), F.least(F.lit(hard), out))).drop("low", "under", "over", "high")


def quantile_rows(observed: DataFrame, q: float = 0.75) -> DataFrame:
    """By item the row at the ``q`` nearest rank, whose score, grade and medal belong together.

    Scores are counted first, so that an item's rows of other scores aren't put in order.
    """
    counts = observed.groupBy("item_id", "score").agg(F.count("*").alias("c"))
    by = Window.partitionBy("item_id")
    run = F.sum("c").over(by.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    spots = counts.select("item_id", "score", "c", run.alias("run"), F.ceil(F.sum("c").over(by) * q).alias("want"))
    spots = spots.filter("run >= want and run - c < want").select("item_id", "score", (F.col("want") - F.col("run") + F.col("c")).alias("place"))
    tied = observed.join(spots, ["item_id", "score"])
    place = F.row_number().over(by.orderBy("rating", "entity_id", "source"))
    return tied.withColumn("r", place).filter("r = place").select("item_id", "score", "grade", "medal")


def difficulty(observed: DataFrame, abilities: DataFrame, items: DataFrame) -> DataFrame:
    """Every group item with its estimate, rank and percentile, and the row at three quarters of its scores."""
    rows = written(design(with_ability(observed, abilities)))
    observed = rows  # as many rows, with all their columns
    placed = calibrated(signals(rows, coefficients(rows)))
    counts = observed.groupBy("item_id").agg(F.count_if(F.col("source") == "archive").alias("archive_n"), F.count_if(F.col("source") == "current").alias("current_n"))
    tops = quantile_rows(observed)
    order = Window.orderBy("continuous", "signal", F.col("score").desc(), "item_id")
    n = F.count("*").over(Window.partitionBy())
    placed = placed.join(tops, "item_id").join(counts, "item_id").withColumn("mode_rank", F.row_number().over(order)).withColumn("percentile", (F.col("mode_rank") - 0.5) / n)
    placed = placed.withColumn("estimate", F.floor(F.col("continuous") + F.lit(1e-9)).cast("int"))
    return catalog(items).join(placed, "item_id", "left").fillna(0, ["support", "archive_n", "current_n"]).withColumn("status", fx.status(F.col("support")))


def goals(placed: DataFrame) -> DataFrame:
    """The score to aim at by an item's whole difficulty: the grade of the goal ladder and the least score that earns it."""
    whole = F.round("continuous").cast("int")
    grade = fx.ladder(whole, sorted(P.GROUP_GOALS.items(), reverse=True), None)
    return placed.withColumn("goal_grade", grade).withColumn("goal_score", fx.lookup(F.col("goal_grade"), {g: b for b, g, _ in P.GRADE_BANDS}))
