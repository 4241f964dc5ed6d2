"""Recommendations of what an entity hasn't seen, without a row for each entity and item, held against all pairs."""

import numpy as np
import pytest

from tierflow import params as P
from tierflow.operators import difficulty as df
from tierflow.operators import recommend as rc
from tierflow.operators import shortlist as sl
from tierflow.operators import surface as sf
from tierflow.plans import advice as ad

ITEMS, ENTITIES, LEVELS = 600, 30, range(20, 25)


@pytest.fixture(scope="module")
def model(spark):
    rnd = np.random.default_rng(3)
    grades, medals = [g for _, g, _ in P.GRADE_BANDS], [m for m, *_ in P.MEDALS]
    mode = lambda i: P.MODES[i % 2]
    level = {i: int(rnd.integers(LEVELS.start, LEVELS.stop)) for i in range(ITEMS)}
    placed = [(mode(i), level[i], f"i{i}", "ABab"[i % 4], None if i % 40 == 0 else level[i] + 0.5 + round(float(rnd.normal(0, 0.3)), 1)) for i in range(ITEMS)]
    ratings = [(m, f"e{e}", float(rnd.uniform(21, 23.5)), None if e == 7 else float(rnd.uniform(21, 23.5))) for m in P.MODES for e in range(ENTITIES)]
    lent = [(mode(i), f"e{e}" if e < ENTITIES else f"p{e}", f"i{i}", float(rnd.uniform(20.5, 24)), float(rnd.integers(900_000, 1_000_001)), float(rnd.integers(1, 3)))
            for i in range(ITEMS) for e in rnd.choice(ENTITIES * 6, int(rnd.integers(0, 40)), replace=False)]
    goals = [(f"e{e}", f"i{i}", 960_000, "AAA+") for e in range(ENTITIES) for i in rnd.choice(ITEMS, 9, replace=False).tolist()]
    own = [(mode(i), f"e{e}", f"i{i}", level[i], float(rnd.uniform(200, 400)), 950_000.0, None) for e in range(ENTITIES) for i in rnd.choice(ITEMS, 10 + 4 * e, replace=False).tolist()]
    liked = [(m, f"e{e}", g, medals[int(rnd.integers(0, 8))]) for m in P.MODES for e in range(ENTITIES) for g in grades if rnd.random() < 0.5]
    usual = [(m, g, medals[3]) for m in P.MODES for g in grades]
    fits = [(m, f) for m in P.MODES for f in range(-1, P.FOLDS)]
    axis = [(m, f, 100, 960_000.0, 205, 28, 195, 58) for m, f in fits]
    surface = [(m, f, r, d, 1e6 - 900.0 * d + 1500.0 * r + f, float((r + d) % 9 + 1)) for m, f in fits for r in range(28) for d in range(58)]
    make = lambda rows, names: spark.createDataFrame(rows, names)
    return {
        "placed": make(placed, "mode string, level int, item_id string, title string, estimate double"), "ratings": make(ratings, "mode string, entity_id string, rating double, projection double"),
        "lent": make(lent, "mode string, entity_id string, item_id string, rating double, score double, weight double"), "goals": make(goals, "entity_id string, item_id string, goal_score int, goal_grade string"),
        "own": make(own, "mode string, entity_id string, item_id string, level int, value double, score double, recorded_ts timestamp"), "medals": make(liked, "mode string, entity_id string, grade string, medal string"),
        "usual": make(usual, "mode string, grade string, medal string"), "known": make([(f"e{e}",) for e in range(ENTITIES - 5)], "entity_id string"),
        "axis": make(axis, "mode string, fit int, rows long, mean double, r0 long, nr long, d0 long, nd long"), "surface": make(surface, "mode string, fit int, r int, d int, score double, support double"),
    }


def told(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows.select(*sorted(rows.columns)).collect())


@pytest.mark.parametrize("own", [["mode", "entity_id"], ["entity_id"]])
@pytest.mark.parametrize("held", [P.HELD, 240])
def test_shortlist_equals_all_pairs(spark, model, own, held, monkeypatch):
    m, ranked = model, df.ranked(model["own"], own).cache()
    project = lambda asked: sf.projections(asked, m["known"], m["axis"], m["surface"])
    every = rc.candidates(m["ratings"], m["lent"], m["placed"], m["goals"], m["medals"], m["usual"], project)
    want = told(rc.recommendations(every, ranked, own))
    monkeypatch.setattr(P, "HELD", held)  # with 240 the items of over 30 rows have no step function
    monkeypatch.setattr(sl.first_unseen, "__defaults__", (8, 7, P.SHOWN))
    assert told(ad.recommended(m, own)) == want
    assert {"'peers'", "'full'", "'crossfit'"} <= {o for o in ("'peers'", "'full'", "'crossfit'") for r in want if o in r}
    if held == P.HELD:
        assert len(want) == P.SHOWN * ENTITIES * (len(own))


def test_few_pairs_are_scored(spark, model):
    """Pairs are those with rows and the first of the others, not all."""
    rows = sl.pairs(model, df.ranked(model["own"]))
    unseen = rows.select(*df.OWN, "item_id").exceptAll(rows.select(*df.OWN, "item_id").join(model["own"], [*df.OWN, "item_id"], "left_semi"))
    unseen = unseen.join(model["lent"], [*df.OWN, "item_id"], "left_anti").join(model["goals"], ["entity_id", "item_id"], "left_anti")
    counts = [r["count"] for r in unseen.groupBy(*df.OWN).count().collect()]
    assert len(counts) == 2 * ENTITIES and max(counts) < 2 * P.SHOWN
    assert rows.count() < rc.near_levels(model["ratings"], model["placed"]).count()


def test_steps_equal_peers_of_each_rating():
    rnd = np.random.default_rng(5)
    score = np.sort(rnd.integers(880_000, 1_000_001, 40).astype(float))
    at, weight, asked = rnd.uniform(20, 23, 40), rnd.integers(0, 3, 40).astype(float), np.sort(rnd.uniform(19, 24, 3000))
    places, codes = sl.steps(at, score, weight, 18.0, 25.0)
    found, support = rc._group_scores(np.full(3000, -1), asked, np.arange(40), at, score, weight)
    want = np.where((support > 0) & ~np.isnan(found), sl.graded(np.nan_to_num(found)), sl.NONE)
    assert (codes[np.searchsorted(places, asked)] == want).all()
    assert len(set(want)) > 4
