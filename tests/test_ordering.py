"""Places over ranges against plain sorting."""

import random

from pyspark.sql import functions as F

from tierflow.operators.ordering import accumulated, numbered


def test_places_over_all_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 2, 2, 3]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "x int, id long").repartition(7)
    got = {r.id: r.place for r in numbered(df, [F.col("x").desc_nulls_last(), F.col("id")], "place").collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert got == {r[1]: i for i, r in enumerate(want, 1)}


def test_places_within_keys_one_of_which_is_hot(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, x int, id long").repartition(5)
    got = {r.id: r.place for r in numbered(df, [F.col("x"), F.col("id")], "place", ["k"]).collect()}
    want = {}
    for k in ("a", "b", None):
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]), 1):
            want[r[2]] = i
    assert got == want


def test_places_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], "x int, id long")
    assert numbered(none, [F.col("x")], "place").collect() == []
    same = spark.createDataFrame([(1, 1)] * 20, "x int, id long")
    assert sorted(r.place for r in numbered(same, [F.col("x"), F.col("id")], "place").collect()) == list(range(1, 21))


def test_running_sums_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b"]), i, rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x int, n int").repartition(5)
    want, run = {}, {"a": 0, "b": 0}
    for k, x, n in rows:
        run[k] += n or 0
        want[x] = run[k]
    for spread in (True, False):
        assert {r.x: r.run for r in accumulated(df, [F.col("x").asc()], {"run": F.col("n")}, ["k"], spread).collect()} == want
