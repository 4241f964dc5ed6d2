"""Rows are dealt once for what needs the same deal, and steps that are read again aren't made again."""

from pyspark.sql import functions as F

from tierflow.operators import difficulty as df
from tierflow.operators import recommend as rc
from tierflow.operators import weighted as wt


def attempts(spark):
    rows = [(f"e{e}", f"i{i}", "Single", 16 + i % 3, float(100 + i * 7 % 90 + e), 9e5 + i, f"2026-01-{i % 28 + 1:02}", i, "current") for e in range(3) for i in range(60)]
    out = spark.createDataFrame(rows, "entity_id string, item_id string, mode string, level int, value double, score double, recorded_at string, seq int, source string")
    return out.withColumns({"recorded_ts": F.col("recorded_at").cast("timestamp"), "is_broken": F.lit(False)})


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_best_attempts_are_ranked_in_the_exchange_that_finds_them(spark):
    rows = attempts(spark)
    out = df.ranked_best(df.valid(rows))
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert sorted(map(str, out.collect())) == sorted(map(str, df.ranked(df.best(df.valid(rows))).collect()))
    assert plan(wt.without_item(out)).count("Exchange hashpartitioning") == 1


def test_statistics_take_one_exchange(spark):
    rows = attempts(spark).withColumn("w", F.lit(2.0))
    assert plan(df.robust(rows, ["mode", "item_id"], "value")).count("Exchange hashpartitioning") == 1
    assert plan(wt.weighted_stats(rows, ["mode", "item_id"], "value", "w")).count("Exchange hashpartitioning") == 1


def test_item_statistics_read_the_selection_once(spark):
    out = df.item_stats(df.selected(df.ranked_best(df.valid(attempts(spark)))))
    assert out.count() == 60
    assert "ExistingRDD" not in plan(out)


def test_appearance_of_items_that_nobody_scored_is_null(spark):
    items = spark.createDataFrame([("i1", "Single", 17), ("i2", "Single", 18), ("none", "Single", 20), ("low", "Single", 15)], "item_id string, mode string, level int")
    got = {r.item_id: r.appearance for r in df.appearance(df.selected(df.ranked_best(df.valid(attempts(spark)))), items).collect()}
    assert got == {"i1": 1.0, "i2": 1.0, "none": None}


def test_peer_scores_take_one_exchange_and_batches_may_cut_items(spark):
    rows = [("Single", f"e{e}", f"i{i}", 15 + (e * 7 + i) % 10 / 20, 9e5 + e * 37 % 11, 1.0 + e % 2) for e in range(12) for i in range(6)]
    peers = spark.createDataFrame(rows, "mode string, entity_id string, item_id string, rating double, score double, weight double")
    asked = peers.select("mode", "entity_id", "item_id", "rating")
    out = rc.peer_scores(asked, peers)
    assert plan(out).count("Exchange hashpartitioning") == 1
    want = sorted(map(tuple, rc.peer_scores(asked, peers, held=8).collect()))  # by ranges, without groups
    assert len(want) > 20
    for size in (3, 5, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(tuple, rc.peer_scores(asked, peers).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
