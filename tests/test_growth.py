"""Steps that are to grow no faster than their input: what they read, exchange and hold."""

import pytest
from pyspark.sql import functions as F

from tierflow.operators import group_mode as gm
from tierflow.plans import two_sources as ts

DATA = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_group_observations_need_one_exchange(spark):
    found = plan(ts.groups(spark, DATA))
    assert found.count("Exchange") == 1 and "Join" not in found and found.count("FileScan") == 1


def test_abilities_are_read_from_one_written_table(spark):
    found = plan(ts.abilities(spark, DATA))
    assert found.count("FileScan") == 1 and "Exchange" not in found


def test_current_rows_come_before_archive_ones(spark):
    items = spark.createDataFrame([("a", "CoOp", 3, 500, 500)], "item_id string, mode string, level int, notes_archive int, notes_current int")
    rows = [("x", "archive", 970_000.0), ("x", "current", 960_000.0), ("y", "archive", 950_000.0), (None, "archive", 940_000.0), (None, "current", 930_000.0), ("z", "other", 1e6)]
    attempts = spark.createDataFrame([(e, "a", s, v, "Fair Game", None, k, False) for k, (e, s, v) in enumerate(rows)], "entity_id string, item_id string, source string, score double, medal string, recorded_at string, seq long, is_broken boolean")
    got = {(r.entity_id, r.source, r.score) for r in gm.observations(attempts, items).collect()}
    assert got == {("x", "current", 960_000), ("y", "archive", 950_000), (None, "archive", 940_000), (None, "current", 930_000)}  # null is no entity that could have both


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_all_pairs_equal_join(spark, size):
    from tierflow.operators import recommend as rc

    one = spark.range(90).select((F.col("id") % 4).alias("k"), F.concat(F.lit("e"), "id").alias("e"), (F.col("id") / 7).alias("v"))
    other = spark.range(60).select((F.col("id") % 5).alias("k"), F.when(F.col("id") > 0, F.concat(F.lit("i"), "id")).alias("i"))
    got = rc.all_pairs(one, other, ["k"], size)
    want = one.join(other, "k")
    assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert rc.all_pairs(one.filter("false"), other, ["k"], size).isEmpty() and rc.all_pairs(one, other.filter("false"), ["k"], size).isEmpty()
