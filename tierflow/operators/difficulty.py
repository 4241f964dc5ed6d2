"""Standalone difficulty analysis: from attempts to items in units of levels. All steps work on both modes at once.

Rows are dealt by (mode, entity) for ranks, baselines and selection, and by (mode, item) for item statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from .lineage import written
from .ordering import numbered
from .quantiles import large_keys, percentiles

OWN = ["mode", "entity_id"]


def valid(attempts: DataFrame) -> DataFrame:
    """Attempts with a positive value, not broken, in a standard mode."""
    return unbroken(attempts).filter(F.col("value") > 0)


def unbroken(attempts: DataFrame) -> DataFrame:
    return attempts.filter(~F.coalesce("is_broken", F.lit(False)) & F.col("mode").isin(*P.MODES))


def best_valid(unbroken: DataFrame, own: list[str]) -> DataFrame:
    """``best`` of valid attempts: as it goes by value first, values are looked at afterwards. A filter before would make every value twice, and all that it is made of at every mention."""
    return best(unbroken, own).filter(F.col("value") > 0)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def ranked_in_bins(rows: DataFrame, keys: list[str], bin_: Column, order: list[Column], name: str) -> DataFrame:
    """``name``: each row's place among those of its keys, where ``bin_`` rises with ``order`` and isn't null; rows are put in order within bins, and bins are counted.

    So no task orders all rows of a key, only as many rows as it has bins.
    """
    marked = rows.withColumn("__bin", bin_)
    counts = marked.groupBy(*keys, "__bin").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy(*order))
    return marked.withColumn("__inner", inner).join(offsets, [*keys, "__bin"]).withColumn(name, (F.col("__before") + F.col("__inner")).cast("int")).drop("__bin", "__before", "__inner")


def best(attempts: DataFrame, own: list[str] = OWN) -> DataFrame:
    """The best attempt of each entity at each item: by value, score and time as text, then by arrival; nulls last."""
    order = [F.col(c).desc_nulls_last() for c in ("value", "score", "recorded_at")] + [F.col("seq")]
    return first_by(attempts, [*own, "item_id"], order)


def ranked(best: DataFrame, own: list[str] = OWN) -> DataFrame:
    """rank_value and rank_recent (of those with a time) within each entity and mode (``own``), and n, its attempts."""
    by = Window.partitionBy(*own)
    desc = lambda c: F.col(c).desc_nulls_last()
    recent = F.row_number().over(by.orderBy(desc("recorded_ts"), desc("value"), desc("score"), F.col("item_id")))
    return best.select(
        "*", F.row_number().over(by.orderBy(desc("value"), desc("score"), F.col("item_id"))).alias("rank_value"),
        F.when(F.col("recorded_ts").isNotNull(), recent).alias("rank_recent"), F.count("*").over(by).alias("n"),
    )


def ranked_best(attempts: DataFrame, own: list[str] = OWN) -> DataFrame:
    """``ranked`` of ``best``; rows are dealt by ``own`` once, which serves both."""
    return ranked(best(attempts.repartition(*own), own), own)


def baselines(ranked: DataFrame, least: int = P.MIN_ATTEMPTS) -> DataFrame:
    """Statistics of ranks 11 to 30 of entities with ``least`` attempts and all of those ranks."""
    window = ranked.filter((F.col("n") >= least) & F.col("rank_value").between(P.BASE_FIRST, P.BASE_LAST))
    out = window.groupBy(*OWN).agg(
        F.count("*").alias("window_n"), F.avg("value").alias("baseline"), F.stddev_samp("value").alias("baseline_std"), F.min("value").alias("baseline_min"), F.max("value").alias("baseline_max"),
    )
    return out.filter((F.col("window_n") == P.BASE_LAST - P.BASE_FIRST + 1) & (F.col("baseline") > 0))


def with_baseline(ranked: DataFrame, least: int | Column = P.MIN_ATTEMPTS, own: list[str] = OWN) -> DataFrame:
    """Every row with its entity's baseline (null for those without one), in the exchange that the ranks have made."""
    by = Window.partitionBy(*own)
    inside = F.col("rank_value").between(P.BASE_FIRST, P.BASE_LAST)
    mean = F.avg(F.when(inside, F.col("value"))).over(by)
    enough = (F.col("n") >= least) & (F.col("n") >= P.BASE_LAST) & (mean > 0)
    return ranked.withColumn("baseline", F.when(enough, mean))


def selected(ranked: DataFrame, least: int | Column = P.MIN_ATTEMPTS, own: list[str] = OWN) -> DataFrame:
    """Rows of entities with a baseline, and whether each is selected: in the top or recent fifth, or in the top 100 where those are under 100."""
    limit = F.ceil(F.col("n") * P.FRACTION)
    rows = with_baseline(ranked, least, own).filter("baseline is not null").withColumn("rank_limit", limit)
    window = (F.col("rank_value") <= F.col("rank_limit")) | F.coalesce(F.col("rank_recent") <= F.col("rank_limit"), F.lit(False))
    rows = rows.withColumn("in_window", window).withColumn("union_n", F.sum(F.col("in_window").cast("int")).over(Window.partitionBy(*own)))
    fallback = F.col("union_n") < P.FALLBACK
    return rows.withColumns({
        "uses_fallback": fallback, "selected": F.when(fallback, F.col("rank_value") <= P.FALLBACK).otherwise(F.col("in_window")), "residual": F.col("value") - F.col("baseline"),
    })


def robust(rows: DataFrame, keys: list[str], value: str = "residual", held: int = P.HELD, ready: bool = False) -> DataFrame:
    """Mean, median, deviation and clipped mean of ``value`` by ``keys``, for rows that are written before, unless they are ``ready``, as they are read several times.

    Keys of up to ``held`` rows are put in order by value and again by distance, in one exchange; the places of a larger one are found by counts of bins, so that no task gathers its values.
    """
    rows = rows.select(*keys, value) if ready else written(rows.select(*keys, value))
    large = large_keys(rows, keys, held)
    if large is None:
        return _robust_in_order(rows, keys, F.col(value))
    return _robust_in_order(rows.join(large, keys, "left_anti"), keys, F.col(value)).unionByName(_robust_in_bins(rows.join(large, keys, "left_semi"), keys, F.col(value), large, held))


def _robust_in_order(rows: DataFrame, keys: list[str], x: Column) -> DataFrame:
    by = Window.partitionBy(*keys)

    def with_median(rows: DataFrame, c: Column, name: str) -> DataFrame:
        rows = rows.withColumns({"__at": F.row_number().over(by.orderBy(c.asc_nulls_last())), "__n": F.count(c).over(by)})
        at = lambda f: F.max(F.when(F.col("__at") == f((F.col("__n") - 1) / 2) + 1, c)).over(by)
        rows = rows.withColumns({"__low": at(F.floor), "__high": at(F.ceil)})
        return rows.withColumn(name, F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(F.col("__low") * 0.5 + F.col("__high") * 0.5))

    rows = with_median(with_median(rows.na.drop(subset=keys), x, "median"), F.abs(x - F.col("median")), "mad")
    clip = F.lit(P.CLIP) * F.col("mad")
    kept = F.least(F.greatest(x, F.col("median") - clip), F.col("median") + clip)
    out = rows.groupBy(*keys).agg(
        F.first("median").alias("median"), F.count(x).alias("n_values"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.first("mad").alias("mad"), F.avg(kept).alias("clipped"),
    )
    return out.withColumn("location", F.when((F.col("n_values") < 3) | (F.col("mad") <= 0), F.col("mean")).otherwise(F.col("clipped"))).drop("clipped")


def _robust_in_bins(rows: DataFrame, keys: list[str], x: Column, large: DataFrame, held: int) -> DataFrame:
    first = percentiles(rows, keys, x, {"median": 0.5}, [F.count(x).alias("n_values"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std")], large=large, held=held)
    first = written(first)
    around = rows.join(first, keys)
    spread = percentiles(around, keys, F.abs(x - F.col("median")), {"mad": 0.5}, large=large, held=held)
    clip = F.lit(P.CLIP) * F.col("mad")
    kept = F.least(F.greatest(x, F.col("median") - clip), F.col("median") + clip)
    whole = around.join(spread, keys).groupBy(*keys).agg(F.avg(kept).alias("clipped"), F.first("mad").alias("mad"))
    out = first.join(whole, keys)
    return out.withColumn("location", F.when((F.col("n_values") < 3) | (F.col("mad") <= 0), F.col("mean")).otherwise(F.col("clipped"))).drop("clipped")


def draw(base: Column, b: Column, place: Column, n: Column) -> Column:
    """Place that resample ``b`` draws for ``place``, of n, by 32-bit mixing of the key's ``base``."""
    mask = F.lit(0xFFFFFFFF)
    x = (base + b.cast("long") * 2654435761 + place.cast("long") * 2246822519).bitwiseAND(mask)
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * 73244475).bitwiseAND(mask)
    return x.bitwiseXOR(F.shiftright(x, 16)) % n


def interval(values: np.ndarray, base: int, resamples: int) -> tuple[float, float]:
    """``bootstrap`` for the values of one key, in the order of their places, with draws as in ``draw``."""
    n, out, mask = len(values), [], np.uint64(0xFFFFFFFF)
    place = np.arange(n, dtype=np.uint64) * np.uint64(2246822519)
    step = max(1, (1 << 21) // n)
    for first in range(1, resamples + 1, step):
        b = np.arange(first, min(first + step, resamples + 1), dtype=np.uint64)
        x = (np.uint64(base) + b[:, None] * np.uint64(2654435761) + place[None, :]) & mask
        for _ in range(2):
            x = ((x ^ (x >> np.uint64(16))) * np.uint64(73244475)) & mask
        drawn = values[((x ^ (x >> np.uint64(16))) % np.uint64(n)).astype(np.int64)]
        mean, median = drawn.mean(1), np.median(drawn, axis=1)
        clip = P.CLIP * np.median(np.abs(drawn - median[:, None]), axis=1)
        held = np.clip(drawn, (median - clip)[:, None], (median + clip)[:, None]).mean(1)
        out.append(np.where((n < 3) | (clip <= 0), mean, held))
    low, high = np.percentile(np.concatenate(out), [2.5, 97.5])
    return float(low), float(high)


def bootstrap(rows: DataFrame, keys: list[str], row: str, resamples: int = P.RESAMPLES, seed: int = P.SEED, value: str = "residual", held: int = P.HELD) -> DataFrame:
    """(keys, low, high): 2.5 and 97.5 % of the clipped mean over resamples with replacement of each key's rows, which ``row`` tells apart.

    Draws come from a hash of seed, key, resample and place, so that reruns agree. A key of up to ``held`` rows is one array, resampled in numpy; the rows of a larger
    one are multiplied by ``resamples`` and never gathered, with the same draws. One row, or no resamples, give the location itself.
    """
    if not resamples:
        return robust(rows, keys, value).select(*keys, F.col("location").alias("low"), F.col("location").alias("high"))
    by = Window.partitionBy(*keys)
    mark = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    base = F.conv(F.substring(F.sha2(mark.cast("binary"), 256), 1, 8), 16, 10).cast("long").alias("base")
    placed = written(rows.select(*keys, base, F.col(value).cast("double").alias("x"), (F.row_number().over(by.orderBy(row)) - 1).alias("place"), F.count("*").over(by).alias("n")))
    names = [f"k{i}" for i in range(len(keys))]

    def resampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [interval(np.array([c["x"] for c in cells]), int(b), resamples) for cells, b in zip(batch["cells"], batch["base"], strict=True)]
            yield batch[names].assign(low=[x[0] for x in found], high=[x[1] for x in found])

    small = placed.filter(F.col("n") <= held).groupBy(*keys, "base").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("cells")).toDF(*names, "base", "cells")
    kinds = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, placed.select(*keys).dtypes, strict=True))
    out = small.mapInPandas(resampled, f"{kinds}, low double, high double").toDF(*keys, "low", "high")
    return out.union(_resampled_rows(placed.filter(F.col("n") > held), keys, resamples, held))


def _resampled_rows(placed: DataFrame, keys: list[str], resamples: int, held: int) -> DataFrame:
    """``bootstrap`` of large keys, whose rows stay apart, as do those of each resample."""
    draws = placed.select(*keys, "base", "place", "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("b"))
    draws = draws.select(*keys, "b", draw(F.col("base"), F.col("b"), F.col("place"), F.col("n")).alias("place"))
    times = draws.groupBy(*keys, "b", "place").agg(F.count("*").alias("times"))
    drawn = written(times.join(placed.select(*keys, F.col("place").cast("long").alias("place"), "x"), [*keys, "place"]))
    x, again, n = F.col("x"), [*keys, "b"], F.col("times")
    large = large_keys(drawn, again, held)
    first = percentiles(drawn, again, x, {"median": 0.5}, [(F.sum(x * n) / F.sum(n)).alias("mean"), F.sum(n).alias("n")], n, large, held)
    first = first if large is None else written(first)
    around = drawn.join(first, again)
    mads = percentiles(around, again, F.abs(x - F.col("median")), {"mad": 0.5}, None, n, large, held)
    clip = F.lit(P.CLIP) * F.col("mad")
    kept = F.least(F.greatest(x, F.col("median") - clip), F.col("median") + clip)
    clipped = around.join(mads, again).groupBy(*again).agg((F.sum(kept * n) / F.sum(n)).alias("clipped"), F.first("mad").alias("mad"), F.first("mean").alias("mean"), F.first("n").alias("n"))
    location = F.when((F.col("n") < 3) | (F.col("mad") <= 0), F.col("mean")).otherwise(F.col("clipped"))
    return clipped.select(*keys, location.alias("location")).groupBy(*keys).agg(F.percentile("location", F.lit(0.025)).alias("low"), F.percentile("location", F.lit(0.975)).alias("high"))


def item_stats(selected: DataFrame, resamples: int | None = None) -> DataFrame:
    """By item of level 16 and more: entities that scored it and were selected, and statistics of the selected residuals, with ``low`` and ``high`` of their location if resamples are asked for."""
    keys = ["mode", "item_id"]
    # written, as counts and statistics read them several times
    rows = written(selected.filter(F.col("level") >= P.MIN_LEVEL).select(*keys, *([] if resamples is None else ["entity_id"]), "selected", "baseline", "residual"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("scored"), F.count_if("selected").alias("contributors"), F.avg(F.when(F.col("selected"), F.col("baseline"))).alias("mean_baseline"))
    out = counts.join(robust(rows.filter("selected"), keys, ready=True).drop("n_values"), keys, "left")
    return out if resamples is None else out.join(bootstrap(rows.filter("selected"), keys, "entity_id", resamples), keys, "left")


def appearance(selected: DataFrame, items: DataFrame) -> DataFrame:
    """(mode, item_id, appearance) of the catalog's items: the share of those who scored it whose attempt is selected; null where nobody did."""
    counts = selected.filter(F.col("level") >= P.MIN_LEVEL).groupBy("mode", "item_id").agg(F.count("*").alias("scored"), F.count_if("selected").alias("contributors"))
    rows = items.filter(F.col("mode").isin(*P.MODES) & (F.col("level") >= P.MIN_LEVEL)).join(counts, ["mode", "item_id"], "left")
    return rows.select("mode", "item_id", (F.col("contributors") / F.col("scored")).alias("appearance"))


def slopes(best: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Value for a level by mode, within entities and narrow score bins; null where too few rows or levels compare.

    Sums of squares around a bin's means come from one grouping; bins with a single level add nothing.
    """
    keys = keys or ["mode"]
    rows = best.filter((F.col("score") >= P.BIN_SCORE) & (F.col("value") > 0)).withColumn("bin", F.floor(F.col("score") / P.BIN))
    x, y = F.col("level").cast("double"), F.col("value")
    bins = rows.groupBy(*keys, "entity_id", "bin").agg(
        F.count("*").alias("m"), F.count_distinct("level").alias("levels"), F.collect_set("level").alias("seen"),
        (F.sum(x * x) - F.sum(x) * F.sum(x) / F.count("*")).alias("xx"), (F.sum(x * y) - F.sum(x) * F.sum(y) / F.count("*")).alias("xy"),
    )
    used = bins.filter("levels >= 2")
    levels = used.select(*keys, F.explode("seen").alias("level")).groupBy(*keys).agg(F.count_distinct("level").alias("levels"))
    out = used.groupBy(*keys).agg(F.sum("m").alias("rows"), F.sum("xx").alias("xx"), F.sum("xy").alias("xy")).join(levels, keys)
    slope = F.col("xy") / F.col("xx")
    return out.select(*keys, "rows", "levels", F.when((F.col("rows") >= P.BIN_ROWS) & (F.col("levels") >= P.BIN_LEVELS) & (F.col("xx") > 0) & (slope > 0), slope).alias("slope"))


def shrinkage(measured: DataFrame, support: str = "contributors") -> DataFrame:
    """Prior strength k by mode from the ratio of variance within items to that between them, for rows (mode, folder, location, std, ``support``)."""
    rows = measured.filter(F.col("location").isNotNull() & (F.col(support) > 0))
    centre = percentiles(rows, ["mode", "folder"], F.col("location"), {"centre": 0.5}, large=large_keys(rows, ["mode", "folder"]))
    many = F.col(support) > 1
    square = F.col("std") * F.col("std")
    sums = rows.join(centre, ["mode", "folder"]).groupBy("mode").agg(
        F.count("*").alias("items"), F.count_if(many).alias("repeated"), F.var_samp(F.col("location") - F.col("centre")).alias("observed"),
        (F.sum(F.when(many, square * (F.col(support) - 1))) / F.sum(F.when(many, F.col(support) - 1))).alias("within"),
        F.avg(F.when(many, square / F.col(support))).alias("noise"),
    )
    ratio = F.col("within") / F.greatest(F.col("observed") - F.col("noise"), F.lit(1e-6))
    enough = (F.col("items") >= 10) & (F.col("repeated") >= 3) & (ratio > 0)
    k = F.least(F.lit(P.MOST_K), F.greatest(F.lit(P.LEAST_K), F.when(enough, ratio).otherwise(P.DEFAULT_K)))
    return sums.select("mode", "items", "repeated", k.alias("k"))


def compressions(df: DataFrame, n: str) -> DataFrame:
    """(n, compression) for the counts in ``df``, of a row for each folder."""
    found = [r[0] for r in df.select(n).distinct().collect()]
    return df.sparkSession.createDataFrame([(i, P.compression(i)) for i in found], f"{n} long, compression double")


def within_level(items: DataFrame, stats: DataFrame, slopes: DataFrame) -> DataFrame:
    """Each item's difference from its folder in levels, its estimate, ranks, percentile, decile and band; with ``low`` and ``high`` in ``stats``, also intervals.

    A larger residual is an easier item, so the ends of an interval change sides.
    """
    rows = items.filter(F.col("mode").isin(*P.MODES) & (F.col("level") >= P.MIN_LEVEL)).withColumn("folder", fx.folder(F.col("mode"), F.col("level")))
    # a row for each item of the catalog, which four steps read
    rows = written(rows.join(stats, ["mode", "item_id"], "left").fillna(0, ["scored", "contributors"]))
    folders = percentiles(rows, ["mode", "folder"], F.col("location"), {"reference": 0.5}, [F.count("location").alias("measured")], large=large_keys(rows, ["mode", "folder"]))
    folders = folders.join(compressions(folders, "measured"), "measured")
    ratio = F.when(F.col("scored") > 0, F.col("contributors") / F.col("scored"))
    rows = rows.join(folders, ["mode", "folder"]).join(shrinkage(rows), "mode", "left").join(slopes.select("mode", "slope"), "mode", "left")
    weight = F.col("contributors") / (F.col("contributors") + F.col("k"))
    delta = lambda c: weight * (F.col(c) - F.col("reference")) / F.col("slope") * F.col("compression") * -P.SCALE
    rows = rows.withColumns({"appearance": ratio, "status": fx.status(F.col("contributors")), "weight": weight, "delta": delta("location")}).withColumn("estimate", F.col("level") + 0.5 + F.col("delta"))
    if "low" in rows.columns:
        rows = rows.withColumns({"delta_low": delta("high"), "delta_high": delta("low")})
        rows = rows.withColumns({f"estimate_{end}": F.col("level") + 0.5 + F.col(f"delta_{end}") for end in ("low", "high")})
    return placed(rows)


def placed(rows: DataFrame) -> DataFrame:
    """Ranks by mode and folder, percentile, decile and band of rows (mode, folder, delta, contributors, title, item_id)."""
    known = F.col("delta").isNotNull()
    order = [F.col("delta").asc_nulls_last(), F.col("contributors").desc(), F.col("title"), F.col("item_id")]
    level = Window.partitionBy("mode", "folder")
    ties = F.count("*").over(Window.partitionBy("mode", "folder", "delta"))
    n = F.count("delta").over(level)
    percentile = (F.rank().over(level.orderBy(F.col("delta").asc_nulls_last())) + (ties - 1) / 2 - 0.5) / n
    rows = rows.withColumns({"level_rank": F.when(known, F.row_number().over(level.orderBy(*order))), "percentile": F.when(known, percentile)})
    rows = written(rows)  # read for those with and without a difference
    some = numbered(rows.filter(known), order, "mode_rank", ["mode"]).withColumn("mode_rank", F.col("mode_rank").cast("int"))
    rows = some.union(rows.filter(~known).withColumn("mode_rank", F.lit(None).cast("int")))
    return rows.withColumns({"decile": fx.decile(F.col("percentile")), "band": fx.band(F.col("delta"))}).withColumn("band_name", fx.band_name(F.col("band")))


def analysis(attempts: DataFrame, items: DataFrame, resamples: int | None = P.RESAMPLES) -> DataFrame:
    """The whole standalone analysis; without ``resamples`` (None) there are no intervals."""
    # written, as item statistics and slopes read them several times
    return analysis_of_ranked(written(ranked_best(valid(attempts))), items, resamples)


def analysis_of_ranked(rows: DataFrame, items: DataFrame, resamples: int | None = P.RESAMPLES) -> DataFrame:
    """The same from best attempts that are ranked already, a written table, for those who read them for other things too."""
    return within_level(items, item_stats(selected(rows), resamples), slopes(rows))
