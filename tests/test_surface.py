"""The score surface, medals, ladders and published files on small rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierflow import params as P
from tierflow.functions import formulas as fx
from tierflow.operators import difficulty as df
from tierflow.operators import medals as md
from tierflow.operators import payload as pl
from tierflow.operators import surface as sf


def closed_form(values, weights):
    """max over i <= k of min over j >= k of the mean of i to j."""
    n = len(values)
    mean = lambda i, j: np.average(values[i : j + 1], weights=weights[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


@pytest.mark.parametrize("n", [1, 2, 7, 20])
def test_pooling_equals_the_closed_form(n):
    rng = np.random.default_rng(n)
    values, weights = rng.integers(0, 9, n).astype(float), rng.integers(1, 5, n).astype(float)
    assert sf.pooled(values, weights) == pytest.approx(closed_form(values, weights))


def test_lines_are_fitted_apart_and_may_fall(spark):
    rows = spark.createDataFrame([("a", 2, 5.0, 1), ("a", 1, 1.0, 3), ("b", 1, 4.0, 1)], "k string, at int, v double, w long")
    got = sorted((r.k, r["at"], r.fitted) for r in sf.isotonic(rows, ["k"], "at", "v", "w", rising=False).collect())
    assert got == [("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 4.0)]
    assert sf.isotonic(rows.limit(0), ["k"], "at", "v", "w").count() == 0


@pytest.fixture
def rows(spark):
    rng = random.Random(1)
    made = [("Single", -1, f"e{i % 7}", f"i{i}", rng.choice(["current", "archive"]), 18 + rng.random() * 1.7, 17 + rng.random(), 9e5 + rng.random() * 1e5, rng.choice([1.0, 2.0])) for i in range(60)]
    return spark.createDataFrame(made, "mode string, fit int, entity_id string, item_id string, source string, rating double, difficulty double, calibrated double, weight double")


def test_surface_equals_convolution_and_is_monotone(spark, rows):
    axis = sf.axes(rows)
    one = axis.first()
    cells = sf.histogram(rows, axis)
    num, den, n = (np.zeros((one.nr, one.nd)) for _ in range(3))
    for r in cells.collect():
        num[r.r, r.d], den[r.r, r.d], n[r.r, r.d] = r.num, r.den, r.n
    assert n.sum() == 60
    offsets = np.arange(-one.radius, one.radius + 1)
    kernels = np.exp(-0.5 * (offsets / max(1, one.radius / 2)) ** 2), (np.abs(offsets) <= 5).astype(float)
    spread = lambda grid, k: np.apply_along_axis(lambda c: np.convolve(c, k, "same"), 0, np.apply_along_axis(lambda r: np.convolve(r, k, "same"), 1, grid))
    smooth = sf.smoothed(cells, axis)
    want, support = spread(num, kernels[0]) / np.where(spread(den, kernels[0]) > 0, spread(den, kernels[0]), np.nan), spread(n, kernels[1])
    for r in smooth.collect():
        assert r.support == pytest.approx(support[r.r, r.d])
        assert r.score == pytest.approx(one["mean"] if np.isnan(want[r.r, r.d]) else want[r.r, r.d])
    grid = np.zeros((one.nr, one.nd))
    for r in sf.monotone(smooth).collect():
        grid[r.r, r.d] = r.score
    assert (np.diff(grid, axis=0) >= 0).all() and (np.diff(grid, axis=1) <= 0).all() and grid.min() > 0


def test_lookup_at_nodes_between_them_and_outside(spark):
    axis = spark.createDataFrame([("Single", -1, 180, 3, 170, 2)], "mode string, fit int, r0 long, nr long, d0 long, nd long")
    grid = spark.createDataFrame([("Single", -1, r, d, 1000.0 * r + 100 * d, 4.0 + 4 * r) for r in range(3) for d in range(2)], "mode string, fit int, r int, d int, score double, support double")
    wanted = [("Single", -1, 18.1, 17.0), ("Single", -1, 18.15, 17.05), ("Single", -1, 18.2, 17.1), ("Single", -1, 18.0, 17.0), ("Single", -1, 18.3, 17.0), ("Single", -1, None, 17.0), ("Double", -1, 18.1, 17.0)]
    got = sf.looked_up(spark.createDataFrame(wanted, "mode string, fit int, rating double, difficulty double"), axis, grid).collect()
    found = {(r.mode, r.rating): (r.surface_score and round(r.surface_score, 6), r.surface_support) for r in got}
    assert found == {
        ("Single", 18.1): (1000.0, 8), ("Single", 18.15): (1550.0, 10), ("Single", 18.2): (2100.0, 12),
        ("Single", 18.0): (None, None), ("Single", 18.3): (None, None), ("Single", None): (None, None), ("Double", 18.1): (None, None),
    }


def test_peers_come_before_the_surface(spark):
    axis = spark.createDataFrame([("Single", f, 180, 2, 170, 2) for f in range(-1, 5)], "mode string, fit int, r0 long, nr long, d0 long, nd long")
    grid = spark.createDataFrame([("Single", f, r, d, 5e5 + f, 60.0) for f in range(-1, 5) for r in range(2) for d in range(2)], "mode string, fit int, r int, d int, score double, support double")
    wanted = spark.createDataFrame([("Single", "a", 18.0, 17.0, 9e5, 12), ("Single", "b", 18.0, 17.0, None, None), ("Single", "c", 18.0, 17.0, None, None), ("Single", "d", 30.0, 17.0, None, None)], "mode string, entity_id string, rating double, difficulty double, peer_score double, support long")
    known = spark.createDataFrame([("b",), ("b",)], "entity_id string")
    got = {r.entity_id: (r.projected, r.origin, r.confidence, r.support) for r in sf.projections(wanted, known, axis, grid).collect()}
    fold = spark.createDataFrame([("b",)], "k string").select(fx.fold(F.col("k"))).first()[0]
    assert got == {"a": (9e5, "peers", "medium", 12), "b": (5e5 + fold, "crossfit", "medium", 60), "c": (5e5 - 1, "full", "medium", 60), "d": (None, None, "unavailable", 0)}


def test_ratings_of_joined_scores(spark):
    made = [
        ("Single", "a", "x", "current", 1.0, "M", 20, 19.0, 19.5), ("Single", "a", "x", "archive", 2.0, "M", 20, 18.0, None), ("Single", "a", "y", "archive", 3.0, "M", 20, 18.5, None),
        ("Single", "b", "x", "current", 4.0, "M", 20, None, None),
    ]
    rated = spark.createDataFrame(made, "mode string, entity_id string, item_id string, source string, score double, medal string, level int, rating double, full_rating double")
    got = sorted((r.entity_id, r.item_id, r.source, r.score, r.rating) for r in sf.joined_scores(rated).collect())
    assert got == [("a", "x", "current", 1.0, 19.0), ("a", "y", "archive", 3.0, 19.5)]


def test_cap_of_ties_and_without_current_medals(spark):
    losses = spark.createDataFrame([(20, 4, 0.5), (10, 4, 0.5), (5, 4, 0.7)], "cap int, n long, loss double")
    assert md.chosen_cap(losses).first().cap == 10 and md.chosen_cap(losses.limit(0)).first().cap == P.DEFAULT_CAP


def test_ladders(spark):
    rungs = P.rungs(P.TITLE_STEPS)
    df_ = spark.createDataFrame([(None,), (-5.0,), (5500.0,), (19000.0,), (float("nan"),)], "v double").select(fx.progress(F.col("v"), rungs).alias("x")).select("x.*")
    got = [tuple(r) for r in df_.collect()]
    assert got[0] == got[1] == got[4] == (0, "Beginner", "Intermediate 1", 5000.0, 0.0)
    assert got[2] == (1, "Intermediate 1", "Intermediate 2", 500.0, 50.0) and got[3] == (len(rungs) - 1, "Master", None, 0.0, 100.0)
    assert [t for _, t in P.rungs(P.RANK_STEPS)] == sorted({t for _, t in P.rungs(P.RANK_STEPS)})


def test_bootstrap_of_one_row_and_of_none(spark):
    rows = spark.createDataFrame([("a", "1", 2.0)] + [("b", str(i), float(i)) for i in range(9)], "k string, row string, residual double")
    got = {r.k: (r.low, r.high) for r in df.bootstrap(rows, ["k"], "row", 20).collect()}
    assert got["a"] == (2.0, 2.0) and 0 <= got["b"][0] <= got["b"][1] <= 8
    assert got == {r.k: (r.low, r.high) for r in df.bootstrap(rows, ["k"], "row", 20).collect()}
    assert {r.k: (r.low, r.high) for r in df.bootstrap(rows, ["k"], "row", 0).collect()}["b"] == (4.0, 4.0)


def test_published_files_and_lists(spark, tmp_path):
    placed = spark.createDataFrame([("Single", "S20", "1", "t", 20.25), ("Single", "S20", "2", "a", None), ("Double", "D21", "3", "b", 21.0)], "mode string, folder string, item_id string, title string, estimate double")
    pl.write_tree(placed, f"{tmp_path}/tree", ["item_id", "estimate"])
    assert {(r.mode, r.folder, r.estimate) for r in spark.read.option("header", True).csv(f"{tmp_path}/tree").collect()} == {("Single", "S20", "20.250000"), ("Single", "S20", None), ("Double", "D21", "21.000000")}
    nested = {r.mode: [i.item_id for i in r["items"]] for r in pl.nested(placed, ["item_id", "estimate"]).collect()}
    assert nested == {"Single": ["1", "2"], "Double": ["3"]}
    rows = spark.range(23).select("id", (F.col("id") % 3).alias("k"))
    manifest = pl.write_shards(rows.coalesce(1), f"{tmp_path}/shards", ["id", "k"], 10).collect()
    assert sorted(m.n for m in manifest) == [3, 10, 10] and len({m.digest for m in manifest}) == 3
    assert sorted(map(tuple, pl.unpacked(pl.packed(rows, "k", ["id"], "id"), "k").collect())) == sorted((i % 3, i) for i in range(23))


def test_bootstrap_of_arrays_and_of_rows_agree(spark):
    rows = spark.createDataFrame([("a", i, float((i * 37) % 11)) for i in range(40)] + [("b", i, float(i)) for i in range(2)], "k string, row int, residual double")
    ends = lambda held: {r.k: (round(r.low, 9), round(r.high, 9)) for r in df.bootstrap(rows, ["k"], "row", 60, held=held).collect()}
    assert ends(0) == ends(1000) == ends(10) and set(ends(10)) == {"a", "b"}


def test_interval_ends_change_sides(spark):
    """Residuals of 100 either way in a folder, no shrinkage: 0.8 levels, and from 0.72 to 0.88."""
    items = spark.createDataFrame([("e", "E", "Single", 20), ("h", "H", "Single", 20)], "item_id string, title string, mode string, level int")
    stats = spark.createDataFrame([("Single", "e", 10, 10, 100.0, 0.0, 100.0, 100.0), ("Single", "h", 10, 10, -100.0, 0.0, -110.0, -90.0)], "mode string, item_id string, scored long, contributors long, location double, std double, low double, high double")
    slopes = spark.createDataFrame([("Single", 50.0)], "mode string, slope double")
    got = {r.item_id: r for r in df.within_level(items, stats, slopes).collect()}
    # the prior of a small catalog takes a third away
    share = 10 / 15
    assert got["h"].delta == pytest.approx(0.8 * share) and got["h"].estimate == pytest.approx(20.5 + 0.8 * share)
    assert (got["h"].delta_low, got["h"].delta_high) == (pytest.approx(0.72 * share), pytest.approx(0.88 * share))
    assert got["e"].delta_low == got["e"].delta_high == pytest.approx(-0.8 * share)


def test_prepared_rows_are_repeated_for_fits_as_they_are_read(spark):
    rows = spark.createDataFrame([("Single", f"e{e}", f"i{i}", "current", 9e5 + i, 15.0 + e, 16.5) for e in range(4) for i in range(5)], "mode string, entity_id string, item_id string, source string, score double, rating double, difficulty double")
    out = sf.prepared(rows)
    assert out.count() == 4 * 5 * 5  # all fits but the entity's own fold, and that of all
    assert "Generate explode" in out._jdf.queryExecution().executedPlan().toString()
