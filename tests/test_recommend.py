"""Peers, sources of ratings, goals and offsets on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from tierflow.operators import recommend as rc

PEER = "mode string, entity_id string, item_id string, rating double, score double, weight double"


def brute(rows, me, rating):
    """Score and support of the first radius that reaches the largest reachable number of peers."""
    for target in (20, 10, 5):
        for radius in (0.2, 0.3, 0.4, 0.5):
            near = sorted((r[4], r[5]) for r in rows if r[1] != me and abs(r[3] - rating) <= radius + 1e-9)
            if len(near) >= target:
                run = 0.0
                for score, weight in near:
                    run += weight
                    if run >= sum(w for _, w in near) * 0.5:
                        return score, len(near)
    return None


@pytest.mark.parametrize("n", [4, 5, 11, 30])
def test_peers_equal_brute_force(spark, n):
    rng = random.Random(n)
    rows = [("Single", f"e{i}", "x", 20 + rng.random(), float(rng.randrange(900_000, 1_000_000)), rng.choice([1.0, 2.0])) for i in range(n)]
    df = spark.createDataFrame(rows, PEER)
    got = {r.entity_id: (r.peer_score, r.support) for r in rc.peer_scores(df.select("mode", "entity_id", "item_id", "rating"), df).collect()}
    want = {r[1]: b for r in rows if (b := brute(rows, r[1], r[3]))}
    assert got == want


@pytest.mark.parametrize("held", [50_000, 1])
def test_peers_of_an_item_with_a_third_of_all_rows(spark, held):
    """Many ties in ratings and scores, entities without a rating, and wanted ones that are no peers; three digits by a radix of 4, with and without ranges."""
    rng = random.Random(7)
    item = lambda i: "hot" if i % 3 == 0 else f"i{i % 11}"
    rows = {(f"e{i}", item(i + j)): (round(20 + rng.random() * 2, 1), float(rng.randrange(0, 30)), float(rng.choice([1, 2]))) for i in range(60) for j in range(3)}
    rows = [("Single", e, k, *v) for (e, k), v in rows.items()]
    df = spark.createDataFrame(rows, PEER)
    asked = df.select("mode", "entity_id", "item_id", "rating").union(spark.createDataFrame([("Single", "guest", "hot", 21.0), ("Single", "guest", "i1", 21.3), ("Double", "guest", "hot", 21.0), ("Single", "guest", "i2", None)], "mode string, entity_id string, item_id string, rating double"))
    got = {(r.mode, r.entity_id, r.item_id): (r.peer_score, r.support) for r in rc.peer_scores(asked, df, held, radix=4).collect()}
    want = {(m, e, k): b for m, e, k, rating in asked.collect() if rating is not None and (b := brute([r for r in rows if r[2] == k and r[0] == m], e, rating))}
    assert got == want and len(got) > 20


def test_bands_reach_over_bins_and_unknown_ratings_have_no_peers(spark):
    rows = [("Single", f"e{i}", "x", 19.99, 900_000.0 + i, 1.0) for i in range(5)] + [("Single", "me", "x", 20.01, 1.0, 1.0), ("Single", "odd", "x", None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, PEER)
    got = {r.entity_id: r.peer_score for r in rc.peer_scores(df.select("mode", "entity_id", "item_id", "rating"), df).collect()}
    assert got["me"] == 900_002.0 and "odd" not in got


def test_rating_source_switches_at_twenty_and_thirty(spark):
    rows = [(20, 99), (19, 20), (19, 19), (0, 19), (29, 30), (30, 30)]
    df = spark.createDataFrame(rows, "current_n int, archive_n int")
    got = [(r.rating_source, r.projection_source) for r in rc.rating_source(df).collect()]
    assert got == [("current", "archive"), ("archive", None), ("current", None), (None, None), ("current", "archive"), ("current", "current")]


def test_grade_floor(spark):
    df = spark.createDataFrame([(999_999.0,), (995_000.0,), (994_999.9,), (1.0,), (2e6,)], "s double")
    assert [r[0] for r in df.select(rc.grade_floor(F.col("s"))).collect()] == [995_000, 995_000, 990_000, 0, 995_000]


def test_offset_of_sources(spark):
    rows = [("Single", e, s, float(x), 950_000.0 - 1000 * x + (500 if s == "current" else 0) + 10 * i) for i, e in enumerate("abc") for s in ("archive", "current") for x in (16, 18, 21)]
    df = spark.createDataFrame(rows, "mode string, entity_id string, source string, difficulty double, score double")
    one = rc.source_offset(df).first()
    assert (one.n, one.offset) == (3, pytest.approx(500)) and one.slope == pytest.approx(1000)
    assert rc.source_offset(df.filter("source = 'archive'")).first().offset == 0
    assert rc.source_offset(df.limit(0)).first().n == 0


@pytest.mark.parametrize("seed", range(3))
def test_first_unseen_equals_brute_force(spark, seed):
    """Entities with nothing of their own, with scattered items, with the whole head of the order (past the broadcast places), and with all items; two modes whose orders differ in length."""
    rng = random.Random(seed)
    sizes, shown = {"Single": 60, "Double": 9}, 5
    items = [(m, f"{m[0]}{i}", i) for m, n in sizes.items() for i in range(1, n + 1)]
    held = {"none": lambda i, n: False, "some": lambda i, n: rng.random() < 0.4, "head": lambda i, n: i <= 30, "all": lambda i, n: True, "last": lambda i, n: i == n}
    own = [(m, e, k, i) for m, k, i in items for e, f in held.items() if f(i, sizes[m])]
    who = spark.createDataFrame([(m, e) for m in sizes for e in held], "mode string, entity_id string")
    got = rc.first_unseen(who, spark.createDataFrame(own, "mode string, entity_id string, item_id string, at long"), spark.createDataFrame(items, "mode string, item_id string, at long"), "at", ["mode", "entity_id"], ["mode"], shown)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    mine = {x[:3] for x in own}
    for m in sizes:
        for e in held:
            want = [k for x, k, _ in items if x == m and (m, e, k) not in mine][:shown]
            assert {k for x, y, k in rows if (x, y) == (m, e) and (m, e, k) not in mine} == set(want)
    assert len([r for r in rows if r[1] == "none"]) == 2 * shown  # what the order's head costs hangs on own items in it alone


def test_group_candidates_equal_all_pairs(spark):
    """Own goals and ratings of items with and without a ladder's goal, of entities that aren't asked for, and entities without any."""
    rng = random.Random(5)
    placed = [(f"g{i}", f"T{i % 7}", None if i % 11 == 0 else round(rng.uniform(10, 28), 1), rng.random()) for i in range(130)]
    entities = spark.createDataFrame([(f"e{i}",) for i in range(6)], "entity_id string")
    marks = [(b, g) for b, g, _ in rc.P.GRADE_BANDS]
    goals = [(f"e{e}", f"g{i}", *rng.choice(marks)) for e in range(1, 8) for i in range(130) if rng.random() < 0.3]
    seen = [(f"e{e}", f"g{i}", rng.choice(["current", "archive"]), round(rng.uniform(0, 140), 2)) for e in range(1, 8) for i in range(130) if rng.random() < (1.0 if e == 5 else 0.4)]
    placed = spark.createDataFrame(placed, "item_id string, title string, estimate double, continuous double")
    goals = spark.createDataFrame(goals, "entity_id string, item_id string, goal_score long, goal_grade string")
    seen = spark.createDataFrame(seen, "entity_id string, item_id string, source string, rating double")
    got = rc.group_candidates(placed, entities, seen, goals)
    # all pairs: every group item is one of the entity's own, with a goal or rating of nothing
    from tierflow.functions import formulas as fx

    pairs = entities.crossJoin(placed.filter("estimate is not null")).join(goals, ["entity_id", "item_id"], "left").join(seen.filter("source = 'current'"), ["entity_id", "item_id"], "left")
    grade = fx.lookup(F.col("estimate"), rc.P.GROUP_GOALS)
    score = fx.lookup(grade, {g: b for b, g, _ in rc.P.GRADE_BANDS})
    own = F.col("goal_score").isNotNull() & (score.isNull() | (F.col("goal_score") > score))
    pairs = pairs.withColumn("grade", F.when(own, F.col("goal_grade")).otherwise(grade)).filter("grade is not null").withColumn("expected", fx.group_rating(F.col("grade"), F.lit(rc.P.GROUP_MEDAL)))
    want = {}
    for r in pairs.collect():
        gain = max(0.0, round(r.expected - (r.rating or 0.0), 2))
        want.setdefault(r.entity_id, []).append((-gain, r.continuous, -r.expected, r.title.lower(), r.item_id))
    want = {(e, x[4]): (i + 1, -x[0]) for e, rows in want.items() for i, x in enumerate(sorted(rows)[:50])}
    assert {(r.entity_id, r.item_id): (r.place, r.gain) for r in got.collect()} == want and len(want) > 200
