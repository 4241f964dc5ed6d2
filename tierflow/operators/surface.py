"""Score by rating and difficulty: a smoothed, monotone surface for each mode, fitted on all entities and without each fold of them.

A surface is a long table of cells (mode, fit, r, d). Its size follows from the range of ratings and difficulties in steps of a tenth,
not from the number of attempts. ``fit`` is -1 for all entities, else the fold whose entities were left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from .lineage import written
from .recommend import offsets_of_sums, source_sums

#: Passes over both axes at most, and how far a score moves in the last one at most.
PASSES, STILL = 12, 0.01
FIT = ["mode", "fit"]
CELL = [*FIT, "r", "d"]
ALL = -1


def joined_scores(rated: DataFrame) -> DataFrame:
    """One row for each (mode, entity_id, item_id): the current attempt or else that of the archive, with its rating.

    ``rated`` has a row by source with its rating without the item, the whole window's (``full_rating``) and the source's attempts ``n``.
    The rating is that of the current source if it has a whole window, else of the archive; rows without any go.
    """
    of = lambda source, c: F.max(F.when(F.col("source") == source, F.col(c)))
    own = rated.groupBy("mode", "entity_id").agg(*[of(s, "full_rating").alias(f"{s}_full") for s in ("current", "archive")])
    rows = rated.groupBy("mode", "entity_id", "item_id").agg(
        F.max_by(F.struct("source", "score", "medal", "level"), "source").alias("own"),  # "current" comes after "archive"
        *[of(s, "rating").alias(f"{s}_rating") for s in ("current", "archive")],
    ).join(own, ["mode", "entity_id"])
    pick = lambda s: F.coalesce(f"{s}_rating", f"{s}_full")
    rating = F.when(F.col("current_full").isNotNull(), pick("current")).when(F.col("archive_full").isNotNull(), pick("archive"))
    return rows.select("mode", "entity_id", "item_id", "own.*", rating.alias("rating")).filter("rating is not null and score between 0 and 1000000")


def fits(rows: DataFrame) -> DataFrame:
    """Each row once for every fit that may learn from it: all but that of its ``fold``."""
    others = F.filter(F.array(*[F.lit(f) for f in range(P.FOLDS)]), lambda f: f != F.col("fold"))
    return rows.withColumn("fit", F.explode(F.concat(F.array(F.lit(ALL)), others)))


def calibrated(rows: DataFrame) -> DataFrame:
    """Rows of every fit with their score on the scale of the current source: archive scores move by their fit's offset.

    An entity's sums are the same in every fit, so those are what is repeated before the offsets. Rows are repeated as they are read.
    """
    offsets = written(offsets_of_sums(fits(written(source_sums(rows, ["mode", "fold"]))), FIT))  # a row by fit
    moved = F.col("score") + F.when(F.col("source") == "archive", F.coalesce("offset", F.lit(0.0))).otherwise(0.0)
    return fits(rows).join(F.broadcast(offsets.select(*FIT, "offset")), FIT, "left").withColumn("calibrated", F.least(F.lit(1e6), F.greatest(F.lit(0.0), moved))).drop("offset", "fold")


def axes(rows: DataFrame) -> DataFrame:
    """By fit the first tenth and the number of cells of both axes, which reach half a level over the rows, and the mean score."""
    first, last = lambda c: F.floor((F.min(c) - 0.5) * 10), lambda c: F.ceil((F.max(c) + 0.5) * 10)
    out = rows.groupBy(*FIT).agg(
        F.count("*").alias("rows"), (F.sum(F.col("weight") * F.col("calibrated")) / F.sum("weight")).alias("mean"),
        first("rating").alias("r0"), (last("rating") - first("rating") + 1).alias("nr"), first("difficulty").alias("d0"), (last("difficulty") - first("difficulty") + 1).alias("nd"),
    )
    radius = F.least(F.lit(P.SMOOTH), F.floor((F.col("nr") - 1) / 2), F.floor((F.col("nd") - 1) / 2)).cast("int")
    return out.filter((F.col("rows") >= P.LEAST_SUPPORT) & (F.col("nr") > 1) & (F.col("nd") > 1)).withColumn("radius", radius)


def histogram(rows: DataFrame, axis: DataFrame) -> DataFrame:
    """(mode, fit, r, d, num, den, n): weighted scores, weights and rows by cell. Sums merge in parts, so that a full cell is no hot group."""
    at = lambda c, first, n: F.least(F.greatest(F.rint((F.col(c) - F.col(first) / 10) / P.STEP).cast("int"), F.lit(0)), F.col(n).cast("int") - 1)
    cells = rows.join(F.broadcast(axis.drop("rows", "mean")), FIT).withColumns({"r": at("rating", "r0", "nr"), "d": at("difficulty", "d0", "nd")})  # a row by fit
    return cells.groupBy(*CELL).agg(F.sum(F.col("weight") * F.col("calibrated")).alias("num"), F.sum("weight").alias("den"), F.count("*").alias("n"))


def smoothed(cells: DataFrame, axis: DataFrame) -> DataFrame:
    """Every cell with its Gaussian-weighted ``score`` and the number of rows nearby (``support``); rows first, then columns, zeros outside."""
    shape = F.broadcast(axis.select(*FIT, "nr", "nd", "radius", "mean"))  # a row by fit
    off = F.col("off")
    gauss = F.exp(F.pow(off / F.greatest(F.lit(1.0), F.col("radius") / 2), 2) * -0.5)
    box = F.when(F.abs(off) <= F.least(F.lit(P.SUPPORT_RADIUS), F.col("radius")), F.col("n")).otherwise(0)

    def along(rows: DataFrame, c: str, size: str) -> DataFrame:
        moved = rows.join(shape, FIT).withColumn("off", F.explode(F.sequence(-F.col("radius"), F.col("radius")))).withColumn(c, F.col(c) + off)
        return moved.filter((F.col(c) >= 0) & (F.col(c) < F.col(size))).groupBy(*CELL).agg(F.sum(F.col("num") * gauss).alias("num"), F.sum(F.col("den") * gauss).alias("den"), F.sum(box).alias("n"))

    some = along(along(cells, "d", "nd"), "r", "nr")
    indexes = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    every = shape.withColumn("r", indexes("nr")).withColumn("d", indexes("nd")).select(*CELL, "mean")
    score = F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(F.col("mean"))
    return every.join(some, CELL, "left").select(*CELL, score.alias("score"), F.coalesce("n", F.lit(0)).cast("double").alias("support"))


def pooled(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest rising sequence in weighted squares: neighbours that fall are replaced by their mean."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(values.tolist(), np.maximum(weights, 1e-6).tolist()):
        mean, weight, length = v, w, 1
        while blocks and blocks[-1][0] > mean:
            m, u, n = blocks.pop()
            mean, weight, length = (m * u + mean * weight) / (u + weight), u + weight, length + n
        blocks.append([mean, weight, length])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def isotonic(rows: DataFrame, keys: list[str], at: str, value: str, weight: str, rising: bool = True, kept: list[str] | None = None) -> DataFrame:
    """(keys, at, fitted): by ``keys`` the monotone sequence along ``at`` nearest to ``value``, with the columns ``kept``.

    Each line of positions, which must be few, as bins are, becomes a row of arrays, and lines are fitted in batches of rows.
    """
    sign = 1.0 if rising else -1.0

    @F.pandas_udf("array<double>")
    def fit(values: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([(pooled(sign * np.asarray(v, float), np.asarray(w, float)) * sign).tolist() for v, w in zip(values, weights, strict=True)])

    cells = F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"), *[F.col(c).alias(f"_{c}") for c in kept or []])
    lines = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(cells)).alias("line")).withColumn("fitted", fit("line.v", "line.w"))
    return lines.select(*keys, F.inline(F.zip_with("line", "fitted", lambda x, f: F.struct(x["at"].alias(at), *[x[f"_{c}"].alias(c) for c in kept or []], f.alias("fitted")))))


def monotone(grid: DataFrame, passes: int = PASSES, still: float = STILL) -> DataFrame:
    """The surface with scores that rise with rating and fall with difficulty, weighted by support.

    Lines along both axes are fitted in turn, a row of arrays for each, until a pass moves no score of a surface by ``still``, at most ``passes`` times. Each pass is written, and the driver sees
    one number for each surface: how far its scores moved. Running extremes then remove what floating point left.
    """
    state, done = grid, []
    for k in range(passes):
        up = isotonic(state, [*FIT, "d"], "r", "score", "support", kept=["score", "support"])
        moved = written(isotonic(up.withColumnRenamed("fitted", "up"), [*FIT, "r"], "d", "up", "support", rising=False, kept=["score", "support"]))
        by = moved.groupBy(*FIT).agg(F.max(F.abs(F.col("fitted") - F.col("score"))).alias("by")).collect()
        ends = reduce(lambda a, b: a | b, [(F.col("mode") == r.mode) & (F.col("fit") == r.fit) for r in by if r["by"] < still], F.lit(False))
        state = moved.select(*CELL, F.col("fitted").alias("score"), "support").select(*grid.columns)
        done.append(state.filter(ends))
        state = state.filter(~ends)
        if all(r["by"] < still for r in by):
            break
    return extremes(reduce(DataFrame.union, done, state))


def extremes(grid: DataFrame) -> DataFrame:
    """The running maximum along ratings, then the running minimum along difficulties, within 0 and a million."""
    running = lambda f, key, by: f.over(Window.partitionBy(*FIT, key).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    out = grid.withColumn("score", running(F.max("score"), "d", "r")).withColumn("score", running(F.min("score"), "r", "d"))
    return out.withColumn("score", F.least(F.lit(1e6), F.greatest(F.lit(0.0), F.col("score"))))


def weighed(rows: DataFrame) -> DataFrame:
    """Rows with their weight: that of the source over the number of the entity's rows in the mode, which is the same in every fit."""
    own_n = F.count("*").over(Window.partitionBy("mode", "entity_id"))
    return rows.withColumn("weight", F.when(F.col("source") == "archive", P.SOURCE_WEIGHTS["archive"]).otherwise(P.SOURCE_WEIGHTS["current"]) / own_n)


def prepared(scores: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Calibrated and weighed rows for every fit, of joined scores at items with an estimate, or with a ``difficulty`` of their own.

    Several steps read them. They are written once, not once for each fit.
    """
    rows = scores if placed is None else scores.join(placed.filter("estimate is not null").select("mode", "item_id", F.col("estimate").alias("difficulty")), ["mode", "item_id"])
    return calibrated(written(weighed(rows.na.drop(subset=["mode", "entity_id"])).withColumn("fold", fx.fold(F.col("entity_id"), P.FOLDS))))


def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(axes, surface) of prepared rows."""
    axis = written(axes(rows))
    return axis, written(monotone(smoothed(histogram(rows, axis), axis)))


def looked_up(wanted: DataFrame, axis: DataFrame, surface: DataFrame) -> DataFrame:
    """``surface_score`` and ``surface_support`` between the four cells around (mode, fit, rating, difficulty).

    Null outside the axes or with too little support. Each cell carries its neighbours' values, so that one join finds all four.
    """
    after = lambda c, keys, by: F.lead(c).over(Window.partitionBy(*FIT, keys).orderBy(by))
    values = {"score": "cell_score", "support": "cell_support"}  # the asked rows may have such columns of their own
    cells = surface.withColumnsRenamed(values).withColumns({f"{c}_01": after(c, "r", "d") for c in values.values()})
    cells = cells.withColumns({f"{c}_1{j}": after(n, "d", "r") for c in values.values() for j, n in ((0, c), (1, f"{c}_01"))})
    at = lambda c, first: (F.col(c) - F.col(first) / 10) / P.STEP
    low = lambda c, first, n: F.least(F.greatest(F.floor(at(c, first) + 1e-9).cast("int"), F.lit(0)), F.col(n).cast("int") - 2)
    inside = lambda c, first, n: F.col(c).between(F.col(first) / 10 - 1e-9, (F.col(first) + F.col(n) - 1) / 10 + 1e-9)
    rows = wanted.join(F.broadcast(axis.select(*FIT, "r0", "nr", "d0", "nd")), FIT, "left")  # a row by fit
    rows = rows.withColumn("inside", inside("rating", "r0", "nr") & inside("difficulty", "d0", "nd"))
    rows = rows.withColumns({"r": F.when(F.col("inside"), low("rating", "r0", "nr")), "d": F.when(F.col("inside"), low("difficulty", "d0", "nd"))})
    share = lambda c, first, i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), at(c, first) - F.col(i)))
    rows = rows.withColumns({"rw": share("rating", "r0", "r"), "dw": share("difficulty", "d0", "d")}).join(cells, CELL, "left")
    mix = lambda a, b, w: F.col(a) * (1 - F.col(w)) + F.col(b) * F.col(w)
    between = lambda c: mix(c, f"{c}_01", "dw") * (1 - F.col("rw")) + mix(f"{c}_10", f"{c}_11", "dw") * F.col("rw")
    support = F.rint(F.greatest(F.lit(0.0), between("cell_support"))).cast("long")
    enough = support >= P.LEAST_SUPPORT
    return rows.withColumns({"surface_score": F.when(enough, between("cell_score")), "surface_support": F.when(enough, support)}).select(*wanted.columns, "surface_score", "surface_support")


def projections(wanted: DataFrame, known: DataFrame, axis: DataFrame, surface: DataFrame) -> DataFrame:
    """Projected score, its support, origin and confidence for (mode, entity_id, rating, difficulty, peer_score, support).

    Peers come first; else the surface, which hasn't learned from an entity that is among ``known`` ones.
    """
    mark = known.select("entity_id").distinct().withColumn("known", F.lit(True))
    rows = wanted.join(mark, "entity_id", "left").withColumn("fit", F.when(F.col("known"), fx.fold(F.col("entity_id"), P.FOLDS)).otherwise(ALL))
    rows = looked_up(rows, axis, surface)
    peer, from_surface = F.col("peer_score").isNotNull(), F.col("surface_score").isNotNull()
    n = F.col("surface_support")
    confidence = F.when(peer, fx.peer_confidence(F.col("support"))).when(from_surface, F.when(n >= 200, "high").when(n >= 50, "medium").otherwise("low")).otherwise("unavailable")
    either = F.coalesce("peer_score", "surface_score")
    score = F.when(either.isNotNull(), F.rint(F.least(F.lit(1e6), F.greatest(F.lit(0.0), either))))  # least and greatest pass over nulls
    origin = F.when(peer, "peers").when(from_surface, F.when(F.col("known"), "crossfit").otherwise("full"))
    rows = rows.withColumns({"projected": score, "origin": origin, "confidence": confidence, "support": F.coalesce("support", n, F.lit(0).cast("long"))})
    return rows.drop("fit", "known", "surface_score", "surface_support")
