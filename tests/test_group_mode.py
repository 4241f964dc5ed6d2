"""The group mode's regression and anchors against numpy on small rows."""

import numpy as np
import pytest

from tierflow.operators import group_mode as gm

SCHEMA = "item_id string, source string, score long, ability double"


def rows_of(spark, seed=1, items=6, each=12):
    rng = np.random.default_rng(seed)
    rows = [(f"i{i}", ("archive", "current")[int(rng.integers(2))], int(rng.integers(850_000, 1_000_000)), float(rng.random())) for i in range(items) for _ in range(each)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_coefficients_equal_least_squares_within_items(spark):
    rows, df = rows_of(spark)
    y = np.log1p([1e6 - r[2] for r in rows])
    a = np.array([r[3] - 0.5 for r in rows])
    x = np.stack([a, a**2, a**3, [float(r[1] == "current") for r in rows]], 1)
    for i in {r[0] for r in rows}:
        at = [r[0] == i for r in rows]
        y[at] -= y[at].mean()
        x[at] -= x[at].mean(0)
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert gm.coefficients(gm.design(df)) == pytest.approx(list(want), rel=1e-6)


def test_equal_rows_have_no_coefficients(spark):
    df = spark.createDataFrame([("a", "current", 900_000, 0.5)] * 3, SCHEMA)
    assert gm.coefficients(gm.design(df)) == [0.0] * 4
    assert gm.coefficients(gm.design(df.limit(0))) == [0.0] * 4


def anchors(spark, *signals):
    df = spark.createDataFrame([(f"i{k}", float(s)) for k, s in enumerate(signals)], "item_id string, signal double")
    return [r.continuous for r in gm.calibrated(df).orderBy("item_id").collect()]


def test_anchors(spark):
    assert anchors(spark, 1, 2, 4) == pytest.approx([10, 16, 24.9])
    assert anchors(spark, 1, 2, 3, 5) == pytest.approx([10, 16, 16, 24.9])
    assert anchors(spark, 3, 3) == [16, 16]
    assert anchors(spark, 2) == [16]


def test_ability_falls_back_to_the_other_source(spark):
    seen = spark.createDataFrame([("e1", "archive"), ("e2", "archive"), ("e3", "current")], "entity_id string, source string")
    known = spark.createDataFrame([("archive", "e1", 0.9), ("current", "e2", 0.2)], "source string, entity_id string, percentile double")
    got = {r.entity_id: (r.ability, r.ability_from) for r in gm.with_ability(seen, known).collect()}
    assert got == {"e1": (0.9, "same"), "e2": (0.2, "other"), "e3": (0.5, "median")}
