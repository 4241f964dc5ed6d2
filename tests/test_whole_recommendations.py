"""Recommendations as a whole: every column of every row, made from the model's tables by plain loops."""

import collections
import hashlib
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tierflow import params as P
from tierflow.functions import formulas as fx
from tierflow.operators import difficulty as df
from tierflow.operators import recommend as rc
from tierflow.operators import surface as sf
from tierflow.plans import advice as ad

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def model(spark):
    return ad.model(spark, DATA)


def rows(t, *columns):
    return [tuple(r) for r in (t.select(*columns) if columns else t).collect()]


def peers_of(lent, me, rating):
    """Score and number of the peers within the first radius that reaches the largest reachable number."""
    for target in sorted(P.PEER_TARGETS, reverse=True):
        for radius in P.PEER_RADII:
            near = sorted((s, w) for e, r, s, w in lent if e != me and abs(r - rating) <= radius + 1e-9)
            if len(near) >= target:
                run = 0.0
                for score, weight in near:
                    run += weight
                    if run >= sum(w for _, w in near) * 0.5:
                        return score, len(near)
    return None, None


def between(cells, axis, rating, difficulty):
    """Score and support of the surface between the four cells around a place."""
    if axis is None or rating is None:
        return None, None
    r0, nr, d0, nd = axis
    if not (r0 / 10 - 1e-9 <= rating <= (r0 + nr - 1) / 10 + 1e-9 and d0 / 10 - 1e-9 <= difficulty <= (d0 + nd - 1) / 10 + 1e-9):
        return None, None
    x, y = (rating - r0 / 10) / P.STEP, (difficulty - d0 / 10) / P.STEP
    r, d = min(max(math.floor(x + 1e-9), 0), nr - 2), min(max(math.floor(y + 1e-9), 0), nd - 2)
    a, b = min(1.0, max(0.0, x - r)), min(1.0, max(0.0, y - d))
    mix = lambda k: (cells[r, d][k] * (1 - b) + cells[r, d + 1][k] * b) * (1 - a) + (cells[r + 1, d][k] * (1 - b) + cells[r + 1, d + 1][k] * b) * a
    n = round(max(0.0, mix(1)))
    return (mix(0), n) if n >= P.LEAST_SUPPORT else (None, None)


@pytest.fixture(scope="module")
def plain(spark, model):
    """All candidates, as dictionaries."""
    lent, own_rating = collections.defaultdict(list), {}
    for mode, entity, item, rating, score, weight in rows(model["lent"], "mode", "entity_id", "item_id", "rating", "score", "weight"):
        lent[mode, item].append((entity, rating, score, weight))
        own_rating[mode, entity, item] = rating
    cells, axes = collections.defaultdict(dict), {(m, f): tuple(x) for m, f, *x in rows(model["axis"], "mode", "fit", "r0", "nr", "d0", "nd")}
    for mode, fit, r, d, score, support in rows(model["surface"], *sf.CELL, "score", "support"):
        cells[mode, fit][r, d] = (score, support)
    known = {e for (e,) in rows(model["known"].select("entity_id").distinct())}
    goals = {(e, i): (s, g) for e, i, s, g in rows(model["goals"], "entity_id", "item_id", "goal_score", "goal_grade")}
    medals = {(m, e, g): x for m, e, g, x in rows(model["medals"], "mode", "entity_id", "grade", "medal")}
    usual = {(m, g): x for m, g, x in rows(model["usual"], "mode", "grade", "medal")}
    steps = [(b, g) for b, g, _ in P.GRADE_BANDS]
    graded = lambda score: next(((b, g) for b, g in sorted(steps, reverse=True) if min(int(score), 1_000_000) >= b), (None, None))
    spine = spark.createDataFrame([(m, v, g, x) for m in P.MODES for v in range(1, 30) for g in dict(map(reversed, steps)) for x, *_ in P.MEDALS], "mode string, level int, grade string, medal string")
    worth = {tuple(k): v for *k, v in rows(spine.withColumn("v", fx.attempt_value(*map(F.col, ("mode", "level", "grade", "medal")))))}  # the formula itself is held against SQL
    placed = collections.defaultdict(list)
    for mode, level, item, title, estimate in rows(model["placed"].filter("estimate is not null"), "mode", "level", "item_id", "title", "estimate"):
        placed[mode].append((level, item, title, estimate))
    out = []
    for mode, entity, rating, projection in rows(model["ratings"], "mode", "entity_id", "rating", "projection"):
        if rating is None:
            continue
        for level, item, title, estimate in placed[mode]:
            if not max(P.MIN_LEVEL, math.floor(rating) - 2) <= level <= math.floor(rating) + 2:
                continue
            wanted = own_rating.get((mode, entity, item))
            wanted = projection if wanted is None else wanted
            score, n = (None, None) if wanted is None else peers_of(lent[mode, item], entity, wanted)
            fold = int(hashlib.sha256(entity.encode()).hexdigest()[:8], 16) % P.FOLDS if entity in known else sf.ALL
            cell, near = between(cells[mode, fold], axes.get((mode, fold)), wanted, estimate)
            origin, confidence, support, projected = None, "unavailable", 0, None
            if score is not None:
                origin, confidence, support, projected = "peers", "high" if n >= 20 else "medium" if n >= 10 else "low", n, score
            elif cell is not None:
                origin, confidence, support, projected = "crossfit" if entity in known else "full", "high" if near >= 200 else "medium" if near >= 50 else "low", near, cell
            projected = None if projected is None else float(round(min(1e6, max(0.0, projected))))
            least, grade = (None, None) if projected is None else graded(projected)
            goal = goals.get((entity, item))
            archive = goal is not None and (least is None or goal[0] > least)
            if archive:
                (least, grade), confidence = goal, "high"
            medal = medals.get((mode, entity, grade)) or usual.get((mode, grade))
            expected = worth.get((mode, level, grade, medal))
            out.append({"mode": mode, "entity_id": entity, "item_id": item, "title": title, "level": level, "rating": rating, "estimate": estimate, "edge": level + 0.5 - estimate, "score": least, "grade": grade, "medal": medal, "from_archive": archive, "support": support, "origin": origin, "confidence": confidence, "expected": expected})
    return out


def recommended(candidates, attempts, own):
    """The 50 of most gain by the columns ``own``; ``attempts``: (key, item, value) of the pools."""
    pools = collections.defaultdict(dict)
    for key, item, value, rank in attempts:
        pools[key][item] = (value, rank)
    lists = collections.defaultdict(list)
    for c in candidates:
        pool = pools.get(key := tuple(c[k] for k in own), {})
        existing, rank = pool.get((c["mode"], c["item_id"]), (None, None))
        cut = next((v for v, r in pool.values() if r == P.TOP), None)
        gain = None
        if c["expected"] is not None:
            best = max(c["expected"], existing or 0.0)
            gain = max(0.0, c["expected"] - existing) if rank is not None and rank <= P.TOP else best if len(pool) < P.TOP else max(0.0, best - cut)
        if c["estimate"] <= c["rating"] + P.RADIUS or c["from_archive"] and (gain or 0) > 0:
            lists[key].append(c | {"gain": gain})
    order = lambda c: (c["gain"] is None, -(c["gain"] or 0), c["estimate"], c["expected"] is None, -(c["expected"] or 0), c["title"].lower(), c["item_id"])
    return [c | {"place": k} for found in lists.values() for k, c in enumerate(sorted(found, key=order)[: P.SHOWN], 1)]


COLUMNS = ["mode", "entity_id", "item_id", "place", "level", "rating", "estimate", "edge", "expected", "gain", "score", "grade", "medal", "from_archive", "support", "origin", "confidence"]


def told(found):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in found)


@pytest.mark.parametrize("own", [["mode", "entity_id"], ["entity_id"]])
def test_recommendations_equal_plain_loops(spark, model, plain, own):
    project = lambda asked: sf.projections(asked, model["known"], model["axis"], model["surface"])
    m = model
    candidates = rc.candidates(m["ratings"], m["lent"], m["placed"], m["goals"], m["medals"], m["usual"], project)
    ranked = df.ranked(m["own"], own)
    got = rc.recommendations(candidates, ranked, own).withColumns({"score": F.col("score").cast("long"), "support": F.col("support").cast("long")})
    attempts = [(tuple(r[k] for k in own), (r["mode"], r["item_id"]), r["value"], r["rank_value"]) for r in ranked.collect()]
    want = recommended(plain, attempts, own)
    assert told(map(tuple, got.select(*COLUMNS).collect())) == told([tuple(c[k] for k in COLUMNS) for c in want])
    assert len(want) > 100 and {c["origin"] for c in want} >= {"peers"} and any(c["from_archive"] for c in want)
