"""Weighted statistics, ratings and medal distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from .difficulty import OWN
from .lineage import written
from .quantiles import large_keys, reached


def lower_quantile(rows: DataFrame, keys: list[str], value: str, weight: str, q: float, name: str, large: DataFrame | None = None, held: int = P.HELD) -> DataFrame:
    """By ``keys`` the smallest value whose cumulative weight reaches ``q`` of the whole; only positive weights count.

    Equal values are summed first. The values of keys in ``large`` (``large_keys``) aren't put in order: bins of them are counted, and only the one in which the weight is reached is looked into again.
    Weights are added up in another order there, which matters where sums aren't exact and just reach the share.
    """
    rows = rows.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    few = rows if large is None else rows.join(large, keys, "left_anti")
    sums = few.groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    by = Window.partitionBy(*keys)
    running = F.sum("w").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    reach = sums.select(*keys, value, running.alias("run"), F.sum("w").over(by).alias("total"))
    out = reach.filter(F.col("run") >= F.col("total") * q).groupBy(*keys).agg(F.min(value).alias(name))
    if large is None:
        return out
    many = rows.join(large, keys, "left_semi").select(*keys, value, F.col(weight).cast("double").alias("w"))
    goals = many.groupBy(*keys).agg((F.sum("w") * q).alias("goal"))
    return out.union(reached(many, keys, value, goals, F.col("w"), held).select(*keys, F.col(value).alias(name)))


def weighted_stats(rows: DataFrame, keys: list[str], value: str, weight: str, held: int = P.HELD, ready: bool = False, many: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """By ``keys``: rows n, effective size, mean, median, clipped location, deviation and 95 % interval of weighted values.

    Rows are written before, as they are read twice, unless they are ``ready``. Where ``many`` has no fewer rows for any value of ``by``, which are some of the keys, its counts tell which are large.
    """
    v, w = F.col(value), F.col(weight)
    rows = rows.filter(v.isNotNull() & (w > 0)).select(*keys, value, weight)
    rows = rows if ready else written(rows)
    by = keys if by is None else by
    large = large_keys(rows if many is None else many, by, held)
    out = _sums_in_order(rows if large is None else rows.join(large, by, "left_anti"), keys, v, w)
    if large is not None:
        rows = written(rows.join(large, by, "left_semi")) if ready else rows.join(large, by, "left_semi")
        large = large if by == keys else written(rows.select(*keys).distinct())
        out = out.unionByName(_sums_in_bins(rows, keys, value, weight, large, held))
    room = F.col("sw") - F.col("sww") / F.col("sw")
    deviation = F.when(F.col("ess") > 1, F.sqrt(F.col("sq") / room)).otherwise(0.0)
    location = F.when((F.col("n") < 3) | (F.col("mad") <= 0), F.col("mean")).otherwise(F.col("swh") / F.col("sw"))
    out = out.withColumns({"location": location, "std": deviation})
    half = F.when(F.col("ess") > 1, F.lit(1.96) * F.col("std") / F.sqrt("ess")).otherwise(0.0)
    return out.select(*keys, "n", "ess", "mean", "median", "location", "std", (F.col("location") - half).alias("low"), (F.col("location") + half).alias("high"))


def _sums_in_order(rows: DataFrame, keys: list[str], v: Column, w: Column) -> DataFrame:
    """Sums, median and deviation of keys whose rows are put in order by value and again by distance, in one exchange."""
    by = Window.partitionBy(*keys)

    def with_median(rows: DataFrame, c: Column, name: str) -> DataFrame:
        rows = rows.withColumns({"__run": F.sum(w).over(by.orderBy(c)), "__total": F.sum(w).over(by)})  # equal values count at once
        return rows.withColumn(name, F.min(F.when(F.col("__run") >= F.col("__total") * 0.5, c)).over(by))

    rows = with_median(rows.na.drop(subset=keys), v, "median").withColumn("mean", F.sum(w * v).over(by) / F.col("__total"))
    rows = with_median(rows.withColumn("off", F.abs(v - F.col("median"))), F.col("off"), "mad")
    clip = F.col("mad") * P.CLIP
    held = F.least(F.greatest(v, F.col("median") - clip), F.col("median") + clip)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), *[F.first(c).alias(c) for c in ("mean", "median", "mad")],
        F.sum(w * held).alias("swh"), F.sum(w * (v - F.col("mean")) * (v - F.col("mean"))).alias("sq"),
    )
    return out.withColumn("ess", F.col("sw") * F.col("sw") / F.col("sww"))


def _sums_in_bins(rows: DataFrame, keys: list[str], value: str, weight: str, large: DataFrame, held: int) -> DataFrame:
    """The same for keys in ``large``, whose rows aren't put in order."""
    v, w = F.col(value), F.col(weight)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * v).alias("swv"))
    out = sums.join(lower_quantile(rows, keys, value, weight, 0.5, "median", large, held), keys).withColumn("mean", F.col("swv") / F.col("sw")).withColumn("ess", F.col("sw") * F.col("sw") / F.col("sww"))
    out = written(out)  # a row by key, read three times
    around = rows.join(out.select(*keys, "median", "mean"), keys).withColumn("off", F.abs(v - F.col("median")))
    mads = lower_quantile(around, keys, "off", weight, 0.5, "mad", large, held)
    clip = F.col("mad") * P.CLIP
    held = F.least(F.greatest(v, F.col("median") - clip), F.col("median") + clip)
    more = around.join(mads, keys).groupBy(*keys).agg(
        F.first("mad").alias("mad"), F.sum(w * held).alias("swh"), F.sum(w * (v - F.col("mean")) * (v - F.col("mean"))).alias("sq")
    )
    return out.join(more, keys).drop("swv")


def without_item(ranked: DataFrame, own: list[str] = OWN) -> DataFrame:
    """Rating of each attempt's entity without that attempt: ranks 11 to 30 of the rest; null with fewer than 31 attempts."""
    by = Window.partitionBy(*own)  # the exchange that the ranks have made
    at = lambda r: F.max(F.when(F.col("rank_value") == r, F.col("value"))).over(by)
    inside = F.col("rank_value").between(P.BASE_FIRST, P.BASE_LAST)
    rows = ranked.na.drop(subset=own).withColumns({"s": F.sum(F.when(inside, F.col("value"))).over(by), "first": at(P.BASE_FIRST), "next": at(P.BASE_LAST + 1)})
    rank = F.col("rank_value")
    total = F.when(rank < P.BASE_FIRST, F.col("s") - F.col("first") + F.col("next")).when(inside, F.col("s") - F.col("value") + F.col("next")).otherwise(F.col("s"))
    rating = F.when(F.col("n") > P.BASE_LAST, fx.skill_rating(F.col("mode"), total / (P.BASE_LAST - P.BASE_FIRST + 1)))
    return rows.withColumn("rating_without", rating).drop("s", "first", "next")


def top_rating(ranked: DataFrame, own: list[str] = OWN) -> DataFrame:
    """Skill rating by entity and mode from its best twenty attempts, the sum of its best fifty, and the value at rank fifty."""
    rank = F.col("rank_value")
    out = ranked.groupBy(*own).agg(
        F.avg(F.when(rank <= P.RATING_TOP, F.col("value"))).alias("top_mean"), F.sum(F.when(rank <= P.TOP, F.col("value"))).alias("top_sum"),
        F.max(F.when(rank == P.TOP, F.col("value"))).alias("cutoff"), F.count("*").alias("n"),
    )
    return out.withColumn("rating", fx.skill_rating(F.col("mode"), F.col("top_mean")))


def top_totals(pool: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, n): the sum of the TOP best values of a ranked pool, and its size."""
    return pool.groupBy(*keys).agg(F.sum(F.when(F.col("rank_value") <= P.TOP, F.col("value"))).alias("total"), F.count("*").alias("n"))


def ability_percentile(best_by_score: DataFrame) -> DataFrame:
    """Share of entities under each one's mean of its twenty best scores; ties share their middle, and one alone has a half."""
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("score").desc(), "item_id", "seq"))
    means = best_by_score.select("entity_id", "score", rank.alias("r")).filter(F.col("r") <= P.RATING_TOP).groupBy("entity_id").agg(F.avg("score").alias("ability"), F.count("*").alias("n"))
    means = means.filter(F.col("n") == P.RATING_TOP)
    # counts by ability are put in order within bins of ABILITY_BIN points; a row for each bin, of which scores allow a few thousand, is summed in one task
    levels = means.groupBy("ability").agg(F.count("*").alias("ties")).withColumn("bin", F.floor(F.col("ability") / P.ABILITY_BIN))
    whole, inner = Window.orderBy("bin"), Window.partitionBy("bin").orderBy("ability")
    bins = levels.groupBy("bin").agg(F.sum("ties").alias("n"))
    bins = bins.select("bin", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    under = F.col("before") + F.coalesce(F.sum("ties").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    levels, total = levels.join(bins, "bin"), F.col("total")
    share = F.when(total == 1, F.lit(0.5)).otherwise((under + (F.col("ties") - 1) / 2) / (total - 1))
    return means.join(levels.select("ability", share.alias("percentile")), "ability").select("entity_id", "ability", "percentile")


def medal_distribution(attempts: DataFrame) -> DataFrame:
    """Smoothed share of each medal by mode and grade; a cell without attempts has the mode's shares. Medals that never occur are rows too."""
    session = attempts.sparkSession
    rows = attempts.filter("medal is not null and grade is not null")
    counts = rows.groupBy("mode", "grade", "medal").count()
    modes = counts.groupBy("mode", "medal").agg(F.sum("count").alias("mode_count"))
    medals = session.createDataFrame([(n, i) for i, (n, _, _) in enumerate(P.MEDALS)], "medal string, ord int")
    grades = session.createDataFrame([(g,) for _, g, _ in P.GRADE_BANDS], "grade string")
    spine = modes.select("mode").distinct().join(F.broadcast(grades), how="cross").join(F.broadcast(medals), how="cross")  # two fixed lists for each mode
    cell = Window.partitionBy("mode", "grade")
    full = spine.join(counts, ["mode", "grade", "medal"], "left").join(modes, ["mode", "medal"], "left").fillna(0, ["count", "mode_count"])
    total = F.sum("count").over(cell)
    used = F.when(total > 0, F.col("count")).otherwise(F.col("mode_count"))
    room = 0.25
    full = full.withColumn("used", used)
    return full.withColumn("p", (F.col("used") + room) / (F.sum("used").over(cell) + room * len(P.MEDALS))).select("mode", "grade", "medal", "ord", "used", "p")


def median_medal(distribution: DataFrame) -> DataFrame:
    """The first medal by mode and grade at which half of the probability is reached."""
    run = F.sum("p").over(Window.partitionBy("mode", "grade").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return distribution.withColumn("run", run).filter(F.col("run") + 1e-12 >= 0.5).groupBy("mode", "grade").agg(F.min_by("medal", "ord").alias("medal"))


def gains(candidates: DataFrame, ranked: DataFrame, totals: DataFrame, value: Column, own: list[str] = OWN) -> DataFrame:
    """``gain`` of each candidate (own, item_id) whose result would be worth ``value``, in the pool of attempts that ``own`` keys."""
    mine = ranked.select(*own, "item_id", F.col("value").alias("existing"), "rank_value")
    rows = candidates.join(mine, [*own, "item_id"], "left").join(totals.select(*own, "cutoff", F.col("n").alias("own_n")), own, "left")
    in_top = F.coalesce(F.col("rank_value") <= P.TOP, F.lit(False))
    return rows.withColumn("gain", fx.marginal_gain(value, F.col("existing"), in_top, F.coalesce("own_n", F.lit(0)), F.col("cutoff")))
