"""Exact quantiles by key, whatever the number of a key's rows: values are counted by bins, and only the bin that holds the wanted place is looked into again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from .lineage import written

#: Bins in which the values between two bounds are counted.
BINS = 1024


def reached(rows: DataFrame, keys: list[str], value: str, goals: DataFrame, times: Column | None = None, held: int = P.HELD, bins: int = BINS) -> DataFrame:
    """(keys, goal, value): for each of ``goals`` (keys, goal) the smallest value at which the sum of ``times`` (1 for each row) over the key's rows with no larger value reaches the goal, or else the largest.

    Each turn counts the rows between a goal's bounds by bins, for all keys and goals at once and in partial sums, and narrows the bounds to the least and greatest value of the bin in which the goal is reached.
    Bins are as wide as each other in one turn and grow with the distance from the lower bound in the next, so that both dense places and wide ranges end soon: doubles allow some dozen turns at most, and two or three are usual.
    A goal with at most ``held`` rows between its bounds, or one value, is looked up among them. Rows with a null key, value or goal play no part, nor do values that are not numbers.
    """
    by, x = [*keys, "goal"], F.col("__x")
    rows = rows.select(*keys, F.col(value).cast("double").alias("__x"), (F.lit(1) if times is None else times).alias("__times")).filter(x.isNotNull() & ~F.isnan(x) & (F.col("__times") > 0))
    ends = rows.groupBy(*keys).agg(F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.count("*").alias("__inside"))
    state = written(goals.select(*by).filter("goal is not null").distinct().join(ends, keys).withColumn("__before", F.lit(0).cast("double" if dict(rows.dtypes)["__times"] == "double" else "long")))
    known, turn = None, 0
    while True:
        done = (F.col("__inside") <= held) | (F.col("__low") == F.col("__high"))
        ended = state.filter(done)
        known = ended if known is None else known.union(ended)
        state = state.filter(~done)
        if state.isEmpty():
            break
        # halves, so that the distance of two doubles is a double
        share = (x / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2)
        even = F.floor(share * bins)
        steep = F.when(share > 0, 1 + F.floor((1 + F.log2(F.greatest(share, F.lit(5e-324))) / 1075) * (bins - 2))).otherwise(0)
        at = F.least(F.greatest(steep if turn % 2 else even, F.lit(0)), F.lit(bins - 1)).cast("int")
        inside = rows.join(state, keys).filter(x.between(F.col("__low"), F.col("__high")))
        counts = inside.groupBy(*by, "__before", at.alias("__bin")).agg(F.sum("__times").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"), F.count("*").alias("__inside"))
        upto = Window.partitionBy(*by).orderBy("__bin")  # a row for each bin
        run = F.col("__before") + F.sum("__n").over(upto.rowsBetween(Window.unboundedPreceding, 0))
        place = F.struct((run < F.col("goal")).alias("short"), F.when(run < F.col("goal"), -F.col("__bin")).otherwise(F.col("__bin")).alias("bin"))  # the first that reaches it, or else the last
        found = counts.withColumns({"__place": place, "__upto": run - F.col("__n")}).groupBy(*by).agg(F.min_by(F.struct("__low", "__high", "__inside", F.col("__upto").alias("__before")), "__place").alias("__it"))
        state = written(found.select(*by, "__it.*").select(*state.columns))
        turn += 1
    one = known.filter(F.col("__low") == F.col("__high")).select(*by, F.col("__low").alias(value))
    few = rows.join(known.filter(F.col("__low") < F.col("__high")), keys).filter(x.between(F.col("__low"), F.col("__high")))
    few = few.groupBy(*by, "__before", "__x").agg(F.sum("__times").alias("__n"))
    run = F.col("__before") + F.sum("__n").over(Window.partitionBy(*by).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0))
    few = few.withColumn("__run", run).groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("__run") >= F.col("goal"), x)), F.max(x)).alias(value))
    return one.union(few)


def large_keys(rows: DataFrame, keys: list[str], held: int = P.HELD) -> DataFrame | None:
    """The keys with over ``held`` rows, of which there are at most rows / ``held``; None if there are none."""
    found = written(rows.groupBy(*keys).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > held).select(*keys))
    return None if found.isEmpty() else found


def percentiles(rows: DataFrame, keys: list[str], value: Column, wanted: dict[str, float], more: list[Column] | None = None, times: Column | None = None, large: DataFrame | None = None, held: int = P.HELD) -> DataFrame:
    """(keys, names): exact percentiles of ``value`` by ``keys``, between two places as the linear rule says, and the aggregates of ``more``; ``times`` is how often each row counts.

    The rows of keys in ``large`` (``large_keys``) aren't gathered: their places come from ``reached``. Those of other keys, of ``held`` at most, are counted by value in one aggregate.
    Both give the same. Keys whose values are all null have null percentiles.
    """
    once = F.lit(1) if times is None else times
    plain = lambda q, c: F.percentile(c, F.lit(q)) if times is None else F.percentile(c, F.lit(q), once)
    if large is None:
        return rows.groupBy(*keys).agg(*[plain(q, value).alias(n) for n, q in wanted.items()], *(more or []))
    marked = rows.join(large.withColumn("__large", F.lit(True)), keys, "left")
    few = F.when(F.col("__large").isNull(), value)
    out = marked.groupBy(*keys).agg(*[plain(q, few).alias(f"__{n}") for n, q in wanted.items()], *(more or []))
    many = rows.join(large, keys, "left_semi").select(*keys, value.cast("double").alias("__value"), once.alias("__once"))
    sums = many.filter("__value is not null").groupBy(*keys).agg(F.sum("__once").alias("__n"))
    place = lambda q: F.lit(q) * (F.col("__n") - 1)
    goals = sums.select(*keys, F.explode(F.array(*[f(place(q)).cast("long") + 1 for q in wanted.values() for f in (F.floor, F.ceil)])).alias("goal"))
    found = reached(many, keys, "__value", goals, F.col("__once"), held)
    values = sums.join(found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("goal", "__value"))).alias("__at")), keys)  # two places for each percentile
    low, high = (lambda q, f=f: F.col("__at")[f(place(q)).cast("long") + 1] for f in (F.floor, F.ceil))
    between = lambda q: F.when(low(q) == high(q), low(q)).otherwise((F.ceil(place(q)) - place(q)) * low(q) + (place(q) - F.floor(place(q))) * high(q))
    values = values.select(*keys, *[between(q).alias(f"__large_{n}") for n, q in wanted.items()])
    out = out.join(values, keys, "left")
    return out.withColumns({n: F.coalesce(f"__{n}", f"__large_{n}") for n in wanted}).drop(*[f"__{n}" for n in wanted], *[f"__large_{n}" for n in wanted])
