"""Exact quantiles by counts of bins, against numpy, with a key that has most of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow.operators import difficulty as df
from tierflow.operators import weighted as wt
from tierflow.operators.quantiles import large_keys, percentiles, reached

RNG = np.random.default_rng(8)
SHAPES = {
    "even": RNG.uniform(-5, 5, 3000), "ties": RNG.integers(0, 4, 3000).astype(float), "same": np.full(3000, 2.5), "dense": np.concatenate([1 + RNG.random(2900) * 1e-12, [-1e300, 1e308] * 50]),
    "steps": 2.0 ** -RNG.integers(0, 1000, 3000).astype(float), "halves": np.concatenate([RNG.random(1500), 1e9 + RNG.random(1500)]), "signs": np.concatenate([-np.exp(RNG.normal(0, 90, 1500)), np.exp(RNG.normal(0, 90, 1500))]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_places_of_a_key_with_most_rows(spark, shape):
    rows = [("hot", float(x)) for x in SHAPES[shape]] + [("cold", float(x)) for x in range(7)] + [("one", 1.0), ("none", None), ("hot", None)]
    t = spark.createDataFrame(rows, "k string, x double").repartition(5)
    wanted = {"low": 0.025, "half": 0.5, "high": 0.975, "first": 0.0, "last": 1.0}
    large = large_keys(t, ["k"], 60)
    assert [r.k for r in large.collect()] == ["hot"]
    got = {r.k: [r[n] for n in wanted] for r in percentiles(t, ["k"], F.col("x"), wanted, large=large, held=60).collect()}
    assert got["none"] == [None] * 5
    for k in ("hot", "cold", "one"):
        x = np.sort([v for key, v in rows if key == k and v is not None])
        for (_, q), v in zip(wanted.items(), got[k], strict=True):
            p = q * (len(x) - 1)
            a, b = x[int(np.floor(p))], x[int(np.ceil(p))]
            assert v == (a if a == b else (np.ceil(p) - p) * a + (p - np.floor(p)) * b)


def test_turns_leave_few_rows_between_the_bounds(spark):
    """Only rows of the last bin are looked up: with 4 bins and at most 3 rows in one, several turns are needed and all give the place."""
    t = spark.range(1000).selectExpr("'k' as k", "cast(id * id as double) as x")
    goals = spark.createDataFrame([("k", 1), ("k", 500), ("k", 1000), ("k", 5000), ("k", None), ("other", 3)], "k string, goal long")
    got = {r.goal: r.x for r in reached(t, ["k"], "x", goals, held=3, bins=4).collect()}
    assert got == {1: 0.0, 500: 499.0**2, 1000: 999.0**2, 5000: 999.0**2}


def test_times_and_two_keys(spark):
    rows = [(k % 2, "a" if k % 3 else "b", float(k % 17), k % 5) for k in range(600)]
    t = spark.createDataFrame(rows, "i int, j string, x double, n int")
    got = {(r.i, r.j): r.half for r in percentiles(t, ["i", "j"], F.col("x"), {"half": 0.5}, times=F.col("n"), large=large_keys(t, ["i", "j"], 90), held=90).collect()}
    for i in (0, 1):
        for j in "ab":
            assert got[i, j] == np.median(np.concatenate([[x] * n for a, b, x, n in rows if (a, b) == (i, j)]))


def test_robust_and_weighted_statistics_are_the_same_whatever_is_held(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", float(x), float(1 + i % 2)) for i, x in enumerate(RNG.normal(0, 1, 900))]
    t = spark.createDataFrame(rows, "k string, residual double, w double")
    once = lambda out: {r.k: tuple(round(v, 9) for v in r[1:]) for r in out.collect()}
    few, many = (once(df.robust(t, ["k"], held=h).select("k", "mean", "median", "mad", "std", "location")) for h in (10**6, 70))
    assert few == many
    few, many = (once(wt.weighted_stats(t, ["k"], "residual", "w", held=h)) for h in (10**6, 70))
    assert few == many


def test_nothing(spark):
    t = spark.createDataFrame([], "k string, x double")
    assert large_keys(t, ["k"]) is None
    assert percentiles(t, ["k"], F.col("x"), {"half": 0.5}).collect() == []
    assert reached(t, ["k"], "x", spark.createDataFrame([], "k string, goal long")).collect() == []
