"""What a reader sees of candidates: filters by mode and level, slices by label, and orders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx

#: Modes that a view can be of, by the mode of its rows; ``overall`` has all but the group mode.
VIEWS = {"singles": "Single", "doubles": "Double", "group": P.GROUP}
LABEL = r"[SD](1[6-9]|[2-9][0-9])"


def visible(view: str, rating: Column | None = None) -> Column:
    """Whether a row (mode, level) belongs to a view: overall has all but the group mode from the least level on, the group mode all of its own,
    and a single mode the levels around ``rating``, none where that is null."""
    if view == "overall":
        return (F.col("mode") != P.GROUP) & (F.col("level") >= P.MIN_LEVEL)
    if view not in VIEWS:
        raise ValueError(f"unknown view {view!r}")
    own = F.col("mode") == VIEWS[view]
    if view == "group":
        return own
    return own & F.coalesce(fx.level_window(F.col("level"), rating), F.lit(False)) if rating is not None else F.lit(False)


def difficulty_slice(rows: DataFrame, label: str) -> DataFrame:
    """Rows (mode, level) of one official label such as S18; one that isn't written so, or that no row has, is an error."""
    name = label.strip().upper()
    if not re.fullmatch(LABEL, name):
        raise ValueError(f"{label!r} isn't a label such as S16 or D17")
    found = rows.filter(F.col("mode").isin(*P.MODES) & (fx.folder(F.col("mode"), F.col("level")) == name))
    if found.isEmpty():
        raise ValueError(f"no row has the label {name}")
    return found


def view_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``place`` of each row (gain, edge, estimate, expected, title, item_id) in its view: by gain, those without one last, then by edge, easier first,
    by what is expected, title and id."""
    order = [F.col("gain").desc_nulls_last(), F.col("edge").desc(), F.col("estimate"), F.coalesce("expected", F.lit(0.0)).desc(), F.col("title"), F.col("item_id")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def matching(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with ``text`` in any of ``columns``, in any case."""
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def difficulty_options(items: DataFrame) -> DataFrame:
    """(label, ord): the official labels of items outside the group mode, singles first, then by level. There is a row for each folder."""
    rows = items.filter(F.col("mode") != P.GROUP).select(F.concat(F.substring("mode", 1, 1), F.col("level").cast("string")).alias("label"), "mode", "level").distinct()
    return rows.select("label", F.row_number().over(Window.orderBy(F.col("mode").desc(), "level")).alias("ord"))


def near_rating(rows: DataFrame, ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (level) within the levels around their key's rating."""
    return rows.join(ratings.select(*keys, "rating"), keys).filter(fx.level_window(F.col("level"), F.col("rating")))


def readiness(best: DataFrame, keys: list[str], required: int) -> DataFrame:
    """(keys, n, required, lacking, ready): how many attempts there are of those that are needed."""
    n = F.count("*")
    return best.groupBy(*keys).agg(n.alias("n"), F.lit(required).alias("required"), F.greatest(F.lit(0), required - n).alias("lacking"), (n >= required).alias("ready"))


def coverage(attempts: DataFrame) -> DataFrame:
    """By mode: attempts, those that no analysis counts, entities, items, and rows and entities of the archive."""
    archive = F.col("source") == "archive"
    return attempts.groupBy("mode").agg(
        F.count("*").alias("attempts"), F.count_if((F.col("value") <= 0) | F.col("is_broken")).alias("rejected"), F.count_distinct("entity_id").alias("entities"), F.count_distinct("item_id").alias("items"),
        F.count_if(archive).alias("archive_rows"), F.count_distinct(F.when(archive, F.col("entity_id"))).alias("archive_entities"),
    )
