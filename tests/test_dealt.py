"""Contributions of both sources are dealt by mode and entity once, and long formulas stay short enough to be compiled."""

import re

import pytest
from pyspark.sql import functions as F

from tierflow.functions import formulas as fx
from tierflow.operators import combined as cb
from tierflow.operators import lineage
from tierflow.plans import advice as ad
from tierflow.sources import tables as tb

DATA = "/root/testdata/sf0.001"


def longest_method(spark, made):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # code is only told of plans that don't change
    try:
        plan = made()._jdf.queryExecution()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", plan.explainString(mode))))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_dealt_rows_take_no_exchange(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    out = lineage.dealt(rows, ["k"], lambda r: r.filter("v > 9"))
    sums = out.groupBy("k").agg(F.sum("v").alias("s"))
    assert "Exchange" not in sums._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, rows.filter("v > 9").groupBy("k").agg(F.sum("v")).collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("step_")]


def test_weighed_rows_are_dealt_once(spark):
    """What follows the one exchange by mode and entity reads its table: windows, slopes, both sources' ranks and what current attempts replace."""
    found = cb.weighed(tb.attempts(spark, DATA, noted=True))
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0


@pytest.mark.parametrize("rows", [ad.worth, lambda s, d: tb.attempts(s, d).select(fx.attempt_value(F.col("mode"), F.col("level"), fx.grade(F.col("score")), fx.medal_name(F.col("medal"))))])
def test_values_are_compiled(spark, rows):
    """The JVM leaves methods of over 8,000 bytes to its interpreter."""
    assert longest_method(spark, lambda: rows(spark, DATA)) < 8000
