"""Places and running sums in an order over all rows, without a task that orders them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def _dealt(rows: DataFrame, order: list[Column], keys: list[str]) -> DataFrame:
    """The rows in ranges of keys and order, whose bounds Spark samples, and in order within each range, as a written table: ``__range``, and ``__mark``, which rises with the order.

    As it is written, places stay as they are when an executor is lost. A key that a third of all rows have is spread over as many ranges.
    """
    by = [*[F.col(k).asc() for k in keys], *order]
    mark = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    return written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__mark", mark)).withColumn("__range", F.shiftright("__mark", 33))


def _before(dealt: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """(__at, __keys, __add_names): sums of ``totals`` over the ranges before each range, of the same keys; only a row for each range and key that is in it is summed in order."""
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*keys, "__range").agg(*[c.alias(f"__{n}") for n, c in totals.items()], F.min("__mark").alias("__first"))
    sums = [F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__add_{n}") for n in totals]
    return parts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__at"), "__first", *sums)


def _joined(dealt: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    on = dealt["__range"] == starts["__at"]
    for k in keys:
        on = on & dealt[k].eqNullSafe(starts[f"__{k}"])
    return dealt.join(starts, on)


def numbered(rows: DataFrame, order: list[Column], name: str, keys: list[str] | None = None, spread: bool = True) -> DataFrame:
    """``name``: each row's place (from 1) in ``order``, within ``keys`` if there are any.

    Rows are numbered within ranges, and counts of ranges are added. Rows that are equal in all of ``order`` share a range, so the order should end in something that tells rows apart.
    Where no key has many rows, ``spread`` may be False: each key's rows are then put in order in one task.
    """
    keys = keys or []
    if not spread:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    dealt = _dealt(rows, order, keys)
    starts = _before(dealt, keys, {"n": F.count("*")})
    return _joined(dealt, starts, keys).withColumn(name, F.col("__mark") - F.col("__first") + 1 + F.col("__add_n")).select(*rows.columns, name)


def accumulated(rows: DataFrame, order: list[Column], sums: dict[str, Column], keys: list[str], spread: bool = True) -> DataFrame:
    """For each row, by name, the sums of columns over the rows of the same keys up to it in ``order``.

    As ``numbered``: sums run within ranges, and those of the ranges before are added. Nulls count as nothing.
    """
    if not spread:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(n) for n, c in sums.items()])
    dealt = _dealt(rows, order, keys)
    starts = _before(dealt, keys, {n: F.coalesce(F.sum(c), F.lit(0)) for n, c in sums.items()})
    upto = Window.partitionBy(*keys, "__range").orderBy("__mark").rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.select("*", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"__in_{n}") for n, c in sums.items()])
    return _joined(inner, starts, keys).select(*rows.columns, *[(F.col(f"__add_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums])
