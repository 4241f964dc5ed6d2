import pytest
from pyspark.sql import functions as F

from tierflow import params as P
from tierflow.functions import formulas as fx
from tierflow.operators import difficulty, upkeep, weighted
from tierflow.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("score", "want"), [(1_200_000, "SSS+"), (995_000, "SSS+"), (994_999.9, "SSS"), (900_000, "A+"), (899_999, "A"), (0, "F"), (-1, None), (None, None)])
def test_grade_edges(spark, score, want):
    assert one(spark, fx.grade(F.lit(score).cast("double"))) == want


def test_every_grade_begins_at_its_bound(spark):
    rows = spark.createDataFrame([(float(b), g) for b, g, _ in P.GRADE_BANDS], "s double, g string")
    assert all(r.x == r.g for r in rows.select(fx.grade(F.col("s")).alias("x"), "g").collect())


def test_attempt_value_by_hand(spark):
    # level 20 Single, S with the second medal: 7.5 * 47 * 726 / 750
    assert one(spark, fx.attempt_value(F.lit("Single"), F.lit(20), F.lit("S"), F.lit("Fair Game"))) == 341.22
    assert one(spark, fx.attempt_value(F.lit("Double"), F.lit(21), F.lit("S"), F.lit("Fair Game"))) == 341.22
    assert one(spark, fx.skill_rating(F.lit("Double"), F.lit(341.22))) == pytest.approx(21, abs=1e-9)


@pytest.mark.parametrize(("delta", "want"), [(-0.6, 1), (-0.5, 2), (-0.3, 3), (-0.1, 4), (0.1, 4), (0.3, 5), (0.5, 6), (0.51, 7), (None, None)])
def test_effect_bands(spark, delta, want):
    assert one(spark, fx.band(F.lit(delta).cast("double"))) == want


def test_medal_names_and_codes(spark):
    assert [one(spark, fx.medal_name(F.lit(m))) for m in (" ug ", "perfect game", "zz")] == ["Ultimate Game", "Perfect Game", None]


def test_gain_with_and_without_room(spark):
    gain = lambda *a: one(spark, fx.marginal_gain(*[F.lit(x) for x in a]))
    assert gain(10.0, 8.0, True, 60, 5.0) == 2.0
    assert gain(10.0, None, False, 49, None) == 10.0
    assert gain(10.0, 4.0, False, 60, 9.0) == 1.0
    assert gain(8.0, 4.0, False, 60, 9.0) == 0.0


def test_compression_is_one_up_to_thirty():
    assert P.compression(30) == 1.0 and 0.8 < P.compression(60) < 1.0


def attempts(spark, rows):
    return spark.createDataFrame(rows, "mode string, entity_id string, item_id string, level int, value double, score double, recorded_at string, recorded_ts timestamp, is_broken boolean, medal string, seq long")


def test_window_union_and_fallback(spark):
    from datetime import datetime, timedelta

    day = datetime(2026, 1, 1)
    rows = []
    for who, n, recent in (("wide", 500, range(51, 151)), ("small", 120, range(1, 25))):
        for r in range(1, n + 1):
            when = day + timedelta(days=1000 - r if r in recent else -r)
            rows.append(("Single", who, f"i{r:03d}", 20, 1000.0 - r, 950000.0, when.isoformat(), when, False, "Fair Game", r))
    out = difficulty.selected(difficulty.ranked(attempts(spark, rows)))
    got = {r.entity_id: (r.n, r.f) for r in out.groupBy("entity_id").agg(F.count_if("selected").alias("n"), F.max("uses_fallback").alias("f")).collect()}
    assert got == {"wide": (150, False), "small": (100, True)}


def test_rating_without_item_promotes_rank_31(spark):
    rows = [("Single", "a", f"i{r:02d}", 20, 400.0 - r, 950000.0, "", None, False, "Fair Game", r) for r in range(1, 32)]
    got = {r.rank_value: r.rating_without for r in weighted.without_item(difficulty.ranked(attempts(spark, rows))).collect()}
    values = [400.0 - r for r in range(1, 32)]
    for gone in (1, 20, 31):
        rest = values[: gone - 1] + values[gone:]
        want = one(spark, fx.skill_rating(F.lit("Single"), F.lit(sum(rest[10:30]) / 20)))
        assert got[gone] == pytest.approx(want, abs=1e-9)
    few = difficulty.ranked(attempts(spark, rows[:30]))
    assert {r.rating_without for r in weighted.without_item(few).collect()} == {None}


def test_slope_is_recovered(spark):
    rows = [("Single", f"e{e}", f"i{lv}", lv, 50.0 * e + 7.3 * lv + 100, 950000.0, "", None, False, "Fair Game", lv) for e in range(5) for lv in range(15, 23)]
    assert difficulty.slopes(attempts(spark, rows)).first().slope == pytest.approx(7.3, abs=1e-9)


def test_upsert_is_order_independent(spark):
    kind = "entity_id string, item_id string, value double, score double, recorded_at string, medal string, seq long"
    a = spark.createDataFrame([("e", "i", 0.0, 5.0, "2026", "x", 1), ("e", "j", 3.0, 5.0, "2026", None, 2)], kind)
    b = spark.createDataFrame([("e", "i", -1.0, 1.0, "2025", "x", 3), ("e", "j", 3.0, 5.0, "2026", "x", 4)], kind)
    one_way, other = ({(r.item_id, r.seq) for r in upkeep.upsert(*x).collect()} for x in ((a, b), (b, a)))
    assert one_way == other == {("i", 3), ("j", 4)}  # 0 counts as no value


def test_snapshot_files(spark, tmp_path):
    import gzip
    import json

    with gzip.open(tmp_path / "attempts.jsonl.gz", "wt") as f:
        f.write(json.dumps({"entity_id": "e", "item_id": "i", "value": 1.5, "is_broken": False}) + "\n")
    (tmp_path / "items.json").write_text(json.dumps([{"item_id": "i", "level": 20, "mode": "Single"}]))
    rows, items = tables.snapshot(spark, str(tmp_path))
    assert rows.first().value == 1.5 and items.first().level == 20
    with pytest.raises(ValueError, match="columns are missing: b"):
        tables.require_columns(rows.selectExpr("value as a"), "a", "b")
