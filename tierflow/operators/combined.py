"""Difficulty from two sources at once: an archive and the current one, weighted by source and by nearness of ability.

Both sources run through the same windows, with ``source`` as a further key, so that the second one costs no stage of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from . import difficulty as df
from . import weighted as wt
from .lineage import dealt, written
from .quantiles import large_keys, percentiles

OWN = ["source", "mode", "entity_id"]
KEYS = ["mode", "item_id"]


def is_archive() -> Column:
    return F.col("source") == "archive"


def least_attempts() -> Column:
    """Attempts that an entity needs in a mode of its source."""
    return F.when(is_archive(), P.BASE_LAST).otherwise(P.MIN_ATTEMPTS)


def normalised(best: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Attempts at items of the catalog; archive scores follow changed note counts, and their values the changed scores.

    Adds ``level_archive``, the item's level when the archive was made. Without ``items``, attempts have that and the note counts already.
    """
    rows = best if items is None else best.join(items.select("item_id", "notes_archive", "notes_current", "level_archive"), "item_id")
    rows = rows.withColumn("old_score", F.col("score"))
    score = F.when(is_archive(), fx.normal_score(F.col("score"), F.col("notes_archive"), F.col("notes_current"))).otherwise(F.col("score"))
    rows = rows.withColumn("score", score)
    value = F.when(is_archive() & (F.col("score") != F.col("old_score")), fx.reband(F.col("value"), F.col("old_score"), F.col("score")))
    return rows.withColumn("value", F.coalesce(value, F.col("value"))).drop("old_score", "notes_archive", "notes_current")


def bests(attempts: DataFrame) -> DataFrame:
    """Best attempts by source with normalised scores and values, dealt by mode and entity. ``attempts`` have their items' note counts and former levels."""
    columns = ["source", "mode", "entity_id", "item_id", "level", "level_archive", "score", "value", "medal", "recorded_ts"]
    return dealt(df.unbroken(attempts), ["mode", "entity_id"], lambda rows: normalised(df.best_valid(rows, OWN)).select(*columns))


def rebased(rows: DataFrame) -> DataFrame:
    """Archive values move with their item's level by the archive's own slope; what falls to zero or has no slope goes."""
    return moved(rows, archive_slopes(rows))


def archive_slopes(rows: DataFrame) -> DataFrame:
    return df.slopes(rows.filter(is_archive()).withColumn("level", F.col("level_archive"))).select("mode", F.col("slope").alias("old_slope"))


def moved(rows: DataFrame, slopes: DataFrame) -> DataFrame:
    """``rebased`` by known slopes of the archive."""
    # slopes are a row for each mode: a join by mode would send all rows to as many tasks
    out = rows.join(F.broadcast(slopes), "mode", "left").withColumn(
        "value", F.when(is_archive(), F.col("value") + (F.col("level") - F.col("level_archive")) * F.col("old_slope")).otherwise(F.col("value"))
    )
    return out.filter("value > 0").drop("old_slope", "level_archive")


def eligible(rows: DataFrame) -> DataFrame:
    """Rebased rows of entities with enough attempts in a mode of their source, with that number as ``n``."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*OWN))).filter(F.col("n") >= least_attempts())


def source_slopes(rows: DataFrame) -> DataFrame:
    """Slopes by source and mode of eligible rows."""
    return df.slopes(rows, ["source", "mode"]).select("source", "mode", "slope").filter("slope is not null")


def selected(rows: DataFrame, slopes: DataFrame) -> DataFrame:
    """The selected ones of eligible rows, with residuals in levels."""
    chosen = df.selected(df.ranked(rows.drop("n"), OWN), least_attempts(), OWN).filter("selected")
    return chosen.join(F.broadcast(slopes), ["source", "mode"]).withColumn("residual", F.col("residual") / F.col("slope"))


def contributions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected rows with residuals in levels, slopes by source and mode) of rebased rows."""
    rows = eligible(rows)
    slopes = source_slopes(rows)
    return selected(rows, slopes), slopes


def rating_rows(rows: DataFrame) -> DataFrame:
    """Rows that ratings count: current ones of entities with enough attempts, archive ones as they would be worth now."""
    worth = fx.attempt_value(F.col("mode"), F.col("level"), fx.grade(F.col("score")), fx.medal_name(F.col("medal")))
    valued = rows.withColumn("value", F.when(is_archive(), worth).otherwise(F.col("value"))).filter("value > 0")
    return df.ranked(valued, OWN).filter(is_archive() | (F.col("n") >= P.MIN_ATTEMPTS))


def with_abilities(rows: DataFrame) -> DataFrame:
    """``ability``: the entity's rating in that source without the item.

    Ratings count current attempts of entities with enough of them, and archive ones as they would be worth now. Rows that don't count have the rating of the whole window.
    """
    worth = fx.attempt_value(F.col("mode"), F.col("level"), fx.grade(F.col("score")), fx.medal_name(F.col("medal")))
    worth, by = F.when(is_archive(), worth).otherwise(F.col("value")), Window.partitionBy(*OWN)
    rows = rows.withColumn("worth", worth).withColumn("worth", F.when(F.col("worth") > 0, F.col("worth")))
    value, rank, n = F.col("worth"), F.col("worth_rank"), F.col("worth_n")
    rows = rows.withColumns({"worth_rank": F.row_number().over(by.orderBy(value.desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("item_id"))), "worth_n": F.count(value).over(by)})
    inside = (rank >= P.BASE_FIRST) & (rank <= P.BASE_LAST)
    at = lambda r: F.max(F.when(rank == r, value)).over(by)
    rows = rows.withColumns({"worth_sum": F.sum(F.when(inside, value)).over(by), "worth_mean": F.avg(F.when(inside, value)).over(by), "worth_first": at(P.BASE_FIRST), "worth_next": at(P.BASE_LAST + 1)})
    total = F.when(rank < P.BASE_FIRST, F.col("worth_sum") - F.col("worth_first") + F.col("worth_next")).when(inside, F.col("worth_sum") - value + F.col("worth_next")).otherwise(F.col("worth_sum"))
    own = value.isNotNull() & F.col("item_id").isNotNull()
    # an own attempt's rating is that without it, which 31 attempts allow; the window of others is whole with 30
    mean = F.when(own, F.when(n > P.BASE_LAST, total / (P.BASE_LAST - P.BASE_FIRST + 1))).otherwise(F.when(n >= P.BASE_LAST, F.col("worth_mean")))
    counted = F.col("entity_id").isNotNull() & (is_archive() | (n >= P.MIN_ATTEMPTS))
    names = [f"worth{c}" for c in ("", "_rank", "_n", "_sum", "_mean", "_first", "_next")]
    return rows.withColumn("worth_mean", F.when(counted, mean)).withColumn("ability", fx.skill_rating(F.col("mode"), F.col("worth_mean"))).drop(*names)


def weighed(attempts: DataFrame) -> DataFrame:
    """All weighted contributions of both sources: those of the archive only where no eligible current attempt has their key, selected or not. Weights are of source and of ability, against the item's level.

    Rows are dealt by mode and entity once; slopes of the archive and of sources take a pass each over the dealt rows.
    """
    rows = bests(attempts)
    old = written(archive_slopes(rows))
    slopes = written(source_slopes(eligible(moved(rows, old))))
    current = F.max(~is_archive()).over(Window.partitionBy("mode", "entity_id", "item_id")) & F.col("entity_id").isNotNull() & F.col("item_id").isNotNull()
    chosen = selected(eligible(moved(with_abilities(rows), old)).withColumn("current_too", current), slopes).filter(~(is_archive() & F.col("current_too")))
    source = F.when(is_archive(), P.SOURCE_WEIGHTS["archive"]).otherwise(P.SOURCE_WEIGHTS["current"])
    chosen = chosen.withColumn("source_weight", source).withColumn("weight", F.col("source_weight") * fx.ability_weight(F.col("ability") - (F.col("level") + 0.5)))
    return chosen.select("source", *KEYS, "entity_id", "level", "score", "medal", "slope", "residual", "ability", "source_weight", "weight")


def observations(attempts: DataFrame) -> DataFrame:
    """``weighed``, written, as statistics and what-if levels read these rows several times."""
    return written(weighed(attempts))


def difficulty(observed: DataFrame, items: DataFrame) -> DataFrame:
    """Each item's estimate from weighted residuals: support is the effective size, the status goes by contributors."""
    stats = wt.weighted_stats(observed, KEYS, "residual", "weight", ready=True)
    sources = observed.groupBy(*KEYS).agg(F.count("*").alias("contributors"), F.count_if(is_archive()).alias("archive_n"), F.count_if(~is_archive()).alias("current_n"))
    rows = items.filter(F.col("mode").isin(*P.MODES) & (F.col("level") >= P.MIN_LEVEL)).withColumn("folder", fx.folder(F.col("mode"), F.col("level")))
    rows = written(rows.join(sources, KEYS, "left").join(stats, KEYS, "left").fillna(0, ["contributors", "archive_n", "current_n", "ess"]))
    folders = percentiles(rows, ["mode", "folder"], F.col("location"), {"reference": 0.5}, large=large_keys(rows, ["mode", "folder"]))
    rows = rows.join(folders, ["mode", "folder"]).join(df.shrinkage(rows, "ess"), "mode", "left")
    rows = rows.withColumn("k", F.coalesce("k", F.lit(P.DEFAULT_K))).withColumn("weight", F.col("ess") / (F.col("ess") + F.col("k")))
    shift = lambda c: F.col("weight") * (F.col(c) - F.col("reference")) * -P.SCALE
    rows = rows.withColumns({"delta": shift("location"), "delta_low": shift("high"), "delta_high": shift("low"), "status": fx.status(F.col("contributors"))})
    return written(df.placed(rows.withColumn("estimate", F.col("level") + 0.5 + F.col("delta"))))


def what_if(observed: DataFrame, placed: DataFrame) -> DataFrame:
    """(mode, item_id, target, estimate): what each item would be estimated at one level up or down, against that folder's reference.

    Items without observations and targets without a measured folder have no estimate.
    """
    around = F.explode(F.expr(f"filter(array(level - 1, level + 1), x -> x >= {P.MIN_LEVEL})")).alias("target")
    targets = placed.select(*KEYS, "level", "k", around)
    rows = observed.withColumns({"medal": fx.medal_name(F.col("medal")), "grade": fx.grade(F.col("score"))}).select("*", around)  # a row's level is its item's
    worth = lambda level: fx.attempt_value(F.col("mode"), F.col(level), F.col("grade"), F.col("medal"))
    plain = (F.col("target") - F.col("level")).cast("double")
    shift = F.when(is_archive(), plain).otherwise(F.coalesce((worth("target") - worth("level")) / F.col("slope"), plain))
    weight = F.col("source_weight") * fx.ability_weight(F.col("ability") - (F.col("target") + 0.5))
    rows = rows.withColumns({"moved": F.col("residual") + shift, "new_weight": weight})
    stats = wt.weighted_stats(rows, [*KEYS, "target"], "moved", "new_weight", ready=True, many=observed, by=KEYS).select(*KEYS, "target", F.col("ess").alias("new_ess"), F.col("location").alias("new_location"))
    folders = placed.select("mode", F.col("level").alias("target"), "reference").distinct()
    out = targets.join(stats, [*KEYS, "target"], "left").join(folders, ["mode", "target"], "left")
    reliability = F.col("new_ess") / (F.col("new_ess") + F.col("k"))
    return out.select(*KEYS, "target", (F.col("target") + 0.5 - P.SCALE * reliability * (F.col("new_location") - F.col("reference"))).alias("estimate"))
