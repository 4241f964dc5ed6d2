"""The medal that goes with a grade: an entity's own current medals, a capped share of its archive's, and the population's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P

CELL = ["entity_id", "mode", "grade"]


def own_counts(rows: DataFrame) -> DataFrame:
    """(entity_id, mode, grade, medal, old, new, olds, news): archive and current medals, and all those of the cell.

    ``rows`` are attempts with a grade and a medal, an item of which the archive has only where the current source hasn't.
    """
    counts = rows.groupBy(*CELL, "medal").agg(F.count_if(F.col("source") == "archive").alias("old"), F.count_if(F.col("source") == "current").alias("new"))
    cell = Window.partitionBy(*CELL)  # a row for each medal
    return counts.withColumns({"olds": F.sum("old").over(cell), "news": F.sum("new").over(cell)})


def share(prior: Column, old: Column, olds: Column, cap: Column) -> tuple[Column, Column]:
    """(weight of a medal, weight of all medals) of the prior and of archive medals of which at most ``cap`` count."""
    scale = F.least(F.lit(1.0), F.try_divide(cap, olds))
    return prior * P.MEDAL_PRIOR + F.coalesce(old * scale, F.lit(0.0)), F.lit(P.MEDAL_PRIOR) + F.coalesce(olds * scale, F.lit(0.0))


def cap_losses(counts: DataFrame, population: DataFrame) -> DataFrame:
    """(cap, n, loss): mean log loss of current medals for each cap on archive ones; ``population`` is (mode, grade, medal, p)."""
    rows = counts.filter("new > 0").join(population.select("mode", "grade", "medal", F.col("p").alias("prior")), ["mode", "grade", "medal"])
    rows = rows.withColumn("cap", F.explode(F.array(*map(F.lit, P.MEDAL_CAPS))))
    one, whole = share(F.col("prior"), F.col("old"), F.col("olds"), F.col("cap"))
    sums = rows.groupBy("cap").agg(F.sum("new").alias("n"), F.sum(-F.col("new") * F.log(F.greatest(one / whole, F.lit(1e-12)))).alias("total"))
    return sums.select("cap", "n", (F.col("total") / F.col("n")).alias("loss"))


def chosen_cap(losses: DataFrame) -> DataFrame:
    """One row (cap): that of the least loss, the smaller one of two; the default without any current medal."""
    return losses.agg(F.coalesce(F.min_by("cap", F.struct("loss", "cap")), F.lit(P.DEFAULT_CAP)).alias("cap"))


def projected(counts: DataFrame, population: DataFrame, cap: DataFrame) -> DataFrame:
    """(entity_id, mode, grade, medal, probability, medal_source) for each cell that an entity has: the first medal at which half is reached.

    ``population`` has every medal with its place ``ord``. Cells that an entity hasn't are the population's own.
    """
    cells = counts.select(*CELL, "olds", "news").distinct()
    full = cells.join(population.select("mode", "grade", "medal", "ord", F.col("p").alias("prior")), ["mode", "grade"])
    full = full.join(counts.select(*CELL, "medal", "old", "new"), [*CELL, "medal"], "left").fillna(0, ["old", "new"]).join(F.broadcast(cap), how="cross")  # one row
    one, whole = share(F.col("prior"), F.col("old"), F.col("olds"), F.col("cap"))
    full = full.withColumn("probability", (one + F.col("new")) / (whole + F.col("news")))
    run = F.sum("probability").over(Window.partitionBy(*CELL).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    origin = F.when(F.col("news") > 0, "current").when(F.col("olds") > 0, "archive").otherwise("population")
    reached = full.withColumns({"run": run, "medal_source": origin}).filter(F.col("run") + 1e-12 >= 0.5)
    return reached.groupBy(*CELL).agg(F.min_by(F.struct("medal", "probability", "medal_source"), "ord").alias("x")).select(*CELL, "x.*")
