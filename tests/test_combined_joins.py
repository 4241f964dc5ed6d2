"""Slopes have a row for each mode and source, so nothing is dealt by those alone."""

import re

from tierflow.operators import combined as cb

ROWS = "source string, mode string, entity_id string, item_id string, level int, level_archive int, score double, value double, recorded_ts timestamp"


def test_slopes_are_broadcast(spark):
    """Otherwise all rows are read by as many tasks as there are modes; without a limit below which Spark broadcasts by itself."""
    rows = spark.createDataFrame([("archive", "Single", "e", "i", 16, 16, 950000.0, 10.0, None)], ROWS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found, keys in ((cb.rebased(rows), r"mode#\d+"), (cb.contributions(rows.drop("level_archive"))[0], r"source#\d+, mode#\d+")):
            assert re.search(rf"BroadcastHashJoin \[{keys}\]", found._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
