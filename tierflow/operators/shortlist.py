"""Which items an entity without any row at them could be recommended, found without a row for each entity and item.

Of such a pair only the grade depends on both. An item's grade is a step function of the asking rating, made once from its peers; where too few peers stand near, the surface tells it.
What a grade is worth to an entity is a table of its levels and grades. So entities of a block meet a level's items in numpy, where each keeps its first ones in the order of recommendations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from .difficulty import OWN
from .lineage import written
from .quantiles import large_keys
from .recommend import KEYS, _group_ends, _whole_groups, near_levels
from .surface import ALL, FIT

#: Codes of grades are their places in GRADE_BANDS; then no grade (or, in a step function, too few peers), then a pair that isn't looked at.
NONE, SKIPPED = len(P.GRADE_BANDS), len(P.GRADE_BANDS) + 1
#: Entities of one task at most, on average, and items that they meet at once.
BLOCK, CHUNK = 4096, 256
_BOUNDS = np.array(sorted(b for b, _, _ in P.GRADE_BANDS), float)


def graded(score: np.ndarray) -> np.ndarray:
    """Codes of the grades of projected scores, which are whole and within 0 and a million."""
    return (NONE - np.searchsorted(_BOUNDS, np.rint(np.clip(score, 0.0, 1e6)), side="right")).astype(np.uint8)


def steps(at: np.ndarray, score: np.ndarray, weight: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the step function of an item's peers, in the order of scores: the grade for every asking rating from ``low`` to ``high``, which changes where a peer comes into a radius or leaves it."""
    reach = np.array(P.PEER_RADII) + 1e-9
    order = np.argsort(at, kind="stable")
    placed, place = at[order], np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    ends = np.unique(np.concatenate([(at[:, None] - reach).ravel(), (at[:, None] + reach).ravel()]))
    ends = np.concatenate([[low], ends[(ends > low) & (ends < high)], [high]])
    middle = ends[:-1] / 2 + ends[1:] / 2
    first, last = (np.searchsorted(placed, middle[None, :] + side * reach[:, None], where) for side, where in ((-1, "left"), (1, "right")))  # by radius the peers' places by rating
    n, lower, upper = last - first, np.zeros(len(middle), np.int64), np.zeros(len(middle), np.int64)
    for target in sorted(P.PEER_TARGETS):  # as in _group_scores
        for i in reversed(range(len(reach))):
            enough = n[i] >= target
            lower, upper = np.where(enough, first[i], lower), np.where(enough, last[i], upper)
    codes = np.full(len(middle), NONE, np.uint8)
    some = np.flatnonzero(upper > lower)
    step = max(1, (1 << 20) // max(1, len(at)))
    for k in range(0, len(some), step):
        rows = some[k : k + step]
        run = np.cumsum(np.where((place >= lower[rows, None]) & (place < upper[rows, None]), weight, 0.0), axis=1)
        found = np.where(run[:, -1] > 0, score[(run >= run[:, -1:] * 0.5).argmax(1)], np.nan)
        known = ~np.isnan(found)
        codes[rows[known]] = graded(found[known])
    changes = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    return ends[changes], codes[np.concatenate([[0], changes])]


def item_steps(lent: DataFrame, low: float, high: float) -> DataFrame:
    """(mode, item_id, places, codes) of items that lend, after one exchange by item."""
    rows = lent.select(*KEYS, F.col("rating").cast("double").alias("at"), F.col("score").cast("double"), F.when(F.col("score").isNotNull() & (F.col("weight") > 0), F.col("weight")).otherwise(0).cast("double").alias("weight"))
    rows = rows.na.drop(subset=[*KEYS, "at"]).repartition(*KEYS).sortWithinPartitions(*KEYS, "score")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches, KEYS):
            at, score, weight = (part[c].to_numpy() for c in ("at", "score", "weight"))
            ends = _group_ends(part, KEYS)
            starts = np.append(0, ends[:-1])
            made = [steps(at[a:b], score[a:b], weight[a:b], low, high) for a, b in zip(starts, ends, strict=True)]
            out = part.select(KEYS).take(pa.array(starts))
            out = out.append_column("places", pa.array([p.tobytes() for p, _ in made], pa.binary())).append_column("codes", pa.array([c.tobytes() for _, c in made], pa.binary()))
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(found, "mode string, item_id string, places binary, codes binary")


def worths(askers: DataFrame, medals: DataFrame, usual: DataFrame, totals: DataFrame, own: list[str]) -> DataFrame:
    """(mode, entity_id, level, gains, values): what each grade would be worth at each level, by code, to an entity without an attempt at the item; -1 where that isn't known."""
    grades = F.posexplode(F.array(*[F.lit(g) for _, g, _ in P.GRADE_BANDS])).alias("code", "grade")
    kept = askers.select(*OWN, grades).join(medals.select(*OWN, "grade", F.col("medal").alias("own_medal")), [*OWN, "grade"], "left").join(usual, ["mode", "grade"], "left")
    kept = kept.groupBy(*OWN).agg(F.array_sort(F.collect_list(F.struct("code", "grade", F.coalesce("own_medal", "medal").alias("medal")))).alias("kept"))
    low, high = F.greatest(F.lit(P.MIN_LEVEL), F.floor("rating") - 2), F.floor("rating") + 2
    rows = askers.filter(high >= low).withColumn("level", F.explode(F.sequence(low, high))).withColumn("level", F.col("level").cast("int")).join(kept, OWN)
    rows = rows.join(totals.select(*own, "cutoff", F.col("n").alias("own_n")), own, "left")
    rows = rows.withColumn("expected", F.transform("kept", lambda k: fx.attempt_value(F.col("mode"), F.col("level"), k["grade"], k["medal"])))
    gain = lambda v: F.when(v.isNotNull(), fx.marginal_gain(v, F.lit(None).cast("double"), F.lit(False), F.coalesce("own_n", F.lit(0)), F.col("cutoff")))
    known = lambda v: F.coalesce(v, F.lit(-1.0))
    return rows.select(*OWN, "level", "rating", "projection", "fit", F.transform("expected", lambda v: known(gain(v))).alias("gains"), F.transform("expected", known).alias("values"))


def grids(axis: DataFrame, surface: DataFrame) -> dict:
    """The surface by (mode, fit) as arrays: first tenths, scores and supports. Its size is bounded by the range of ratings and difficulties, whatever the number of attempts."""
    out = {(a.mode, a.fit): (int(a.r0), int(a.d0), np.full((2, int(a.nr), int(a.nd)), np.nan)) for a in axis.select(*FIT, "r0", "nr", "d0", "nd").collect()}
    for c in surface.select(*FIT, "r", "d", "score", "support").collect():
        out[c.mode, c.fit][2][:, c.r, c.d] = c.score, c.support
    return out


def surface_codes(grid: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Codes of the grades between the four cells around (rating, difficulty), as ``surface.looked_up`` tells scores."""
    r0, d0, cells = grid
    _, nr, nd = cells.shape
    inside = (x >= r0 / 10 - 1e-9) & (x <= (r0 + nr - 1) / 10 + 1e-9) & (y >= d0 / 10 - 1e-9) & (y <= (d0 + nd - 1) / 10 + 1e-9)
    out, which = np.full(len(x), NONE, np.uint8), np.flatnonzero(inside)
    across, along = (x[which] - r0 / 10) / P.STEP, (y[which] - d0 / 10) / P.STEP
    r, d = (np.clip(np.floor(v + 1e-9).astype(int), 0, n - 2) for v, n in ((across, nr), (along, nd)))
    rw, dw = np.clip(across - r, 0.0, 1.0), np.clip(along - d, 0.0, 1.0)
    between = lambda c: (c[r, d] * (1 - dw) + c[r, d + 1] * dw) * (1 - rw) + (c[r + 1, d] * (1 - dw) + c[r + 1, d + 1] * dw) * rw
    enough = np.rint(np.maximum(0.0, between(cells[1]))) >= P.LEAST_SUPPORT
    out[which] = np.where(enough, graded(np.where(enough, between(cells[0]), 0.0)), NONE)
    return out


class Block:
    """Entities of one level and the best items that they met so far. Items come in the order of estimate, title and id."""

    def __init__(self, rows: pa.Table, surfaces: dict, shown: int):
        rating = rows["projection"].to_numpy()
        order = np.argsort(rating)  # those without a rating (NaN) come last
        self.rows, self.x, self.shown, n = rows.take(pa.array(order)), rating[order], shown, len(order)
        self.asks = int((~np.isnan(self.x)).sum())
        wide = lambda c: self.rows[c].combine_chunks().flatten().to_numpy().reshape(n, NONE)
        self.gains, self.values = (np.concatenate([wide(c), np.full((n, 1), -1.0), np.full((n, 1), -np.inf)], axis=1).ravel() for c in ("gains", "values"))
        self.base = np.arange(n) * (SKIPPED + 1)
        self.ceiling = self.rows["rating"].to_numpy() + P.RADIUS
        mode, fit = rows["mode"][0].as_py(), self.rows["fit"].to_numpy()
        self.grids = [(np.flatnonzero(fit == f), surfaces.get((mode, f))) for f in np.unique(fit)]
        self.seen: dict[str, list[int]] = {}
        for i, items in enumerate(self.rows["seen"].to_pylist()):
            for item in items or ():
                self.seen.setdefault(item, []).append(i)
        self.least, self.last = np.full(n, -np.inf), np.full(n, np.nan)  # gain and estimate of the last one that is kept of a full list
        self.kept, self.pending, self.many, self.met, self.names = [], [], 0, 0, []

    def meet(self, items: pa.Table) -> None:
        names, estimate, m = items["item_id"].to_pylist(), items["estimate"].to_numpy(), self.asks
        codes = np.full((len(names), len(self.x)), NONE, np.uint8)
        for i, (p, c) in enumerate(zip(items["places"].to_pylist(), items["codes"].to_pylist(), strict=True)):
            if p:
                at = np.searchsorted(self.x[:m], np.frombuffer(p), side="left")
                codes[i, :m] = np.repeat(np.frombuffer(c, np.uint8), np.diff(at, prepend=0, append=m))
            elif c:
                codes[i, :m] = c[0]
        for who, grid in self.grids:
            if grid is not None and len(who := who[who < m]):
                i, e = np.nonzero(codes[:, who] == NONE)
                codes[i, who[e]] = surface_codes(grid, self.x[who[e]], estimate[i])
        for i, name in enumerate(names):
            if name in self.seen:
                codes[i, self.seen[name]] = SKIPPED
        at = codes + self.base[None, :]
        gain = self.gains[at]
        better = ((gain > self.least) | ((gain == self.least) & (estimate[:, None] == self.last))) & (estimate[:, None] <= self.ceiling)
        i, e = np.nonzero(better)
        self.pending.append((e, gain[i, e], estimate[i], self.values[at[i, e]], self.met + i))
        self.met, self.many = self.met + len(names), self.many + len(i)
        self.names += names
        if self.many > self.shown * len(self.x) // 2:
            self.cut()

    def cut(self) -> None:
        e, gain, estimate, value, place = (np.concatenate(c) for c in zip(*self.kept, *self.pending, strict=True))
        order = np.lexsort((place, -value, estimate, -gain, e))
        e = e[order]
        first = np.searchsorted(e, np.arange(len(self.x)))
        rank = np.arange(len(e)) - first[e]
        full = np.flatnonzero(rank == self.shown - 1)
        self.least[e[full]], self.last[e[full]] = gain[order[full]], estimate[order[full]]
        keep, e = order[rank < self.shown], e[rank < self.shown]
        self.kept, self.pending, self.many = [(e, gain[keep], estimate[keep], value[keep], place[keep])], [], 0

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.kept or self.pending:
            self.cut()
            e, gain, estimate, value, place = self.kept[0]
            out = self.rows.select(OWN).take(pa.array(e))
            columns = {"item_id": pa.array(self.names, pa.string()).take(pa.array(place)), "gain": pa.array(gain), "estimate": pa.array(estimate), "expected": pa.array(value)}
            for name, column in columns.items():
                out = out.append_column(name, column)
            yield from out.combine_chunks().to_batches()


def first_unseen(askers: DataFrame, items: DataFrame, seen: DataFrame, surfaces: dict, own: list[str], block: int = BLOCK, chunk: int = CHUNK, shown: int = P.SHOWN) -> DataFrame:
    """(mode, entity_id, item_id): at least the first ``shown`` items by ``own`` in the order of recommendations which the entity hasn't ``seen`` (mode, level, entity_id, item_id); more where places tie.

    ``askers`` are rows of ``worths`` with ``fit``, ``items`` (mode, level, item_id, title, estimate, places, codes). A task has a block of entities, and a level's items come to it in their order, a chunk at a time.
    """
    blocks = max(4, math.ceil(askers.select(*OWN).distinct().count() / len(P.MODES) / block))
    unit = ["mode", "level", "block"]
    had = seen.groupBy("mode", "level", "entity_id").agg(F.collect_set("item_id").alias("seen"))
    asks = askers.join(had, ["mode", "level", "entity_id"], "left").withColumn("block", F.pmod(F.xxhash64("entity_id"), F.lit(blocks)).cast("int"))
    used = F.broadcast(asks.select(*unit).distinct())  # a row for each block of a level
    comes = items.withColumn("title", F.lower("title")).join(used, ["mode", "level"])
    rows = asks.withColumn("kind", F.lit(0)).unionByName(comes.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.select(*unit, "kind", "estimate", "title", "item_id", "places", "codes", "entity_id", "rating", "projection", "fit", "gains", "values", "seen")
    rows = rows.repartition(16 * blocks, *unit).sortWithinPartitions(*unit, "kind", "estimate", "title", "item_id")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, one = [], None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if not part.num_rows:
                continue
            ends = _group_ends(part, [*unit, "kind"])
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                piece = part.slice(a, b - a)
                if piece["kind"][0].as_py() == 0:
                    if one is not None:
                        yield from one.found()
                        one = None
                    if asked and any(asked[-1][c][0] != piece[c][0] for c in unit):  # no items came to those before
                        asked = []
                    asked.append(piece)
                    continue
                if asked:
                    one, asked = Block(pa.concat_tables(asked), surfaces, shown), []
                for i in range(0, piece.num_rows, chunk):
                    one.meet(piece.slice(i, chunk))
        if one is not None:
            yield from one.found()

    out = rows.mapInArrow(found, "mode string, entity_id string, item_id string, gain double, estimate double, expected double")
    place = F.rank().over(Window.partitionBy(*own).orderBy(F.col("gain").desc(), "estimate", F.col("expected").desc()))
    return out.withColumn("place", place).filter(F.col("place") <= shown).select(*OWN, "item_id")


def pairs(m: dict[str, DataFrame], ranked: DataFrame, own: list[str] = OWN) -> DataFrame:
    """Items near an entity's rating that may be among the 50 of most gain by ``own``, as ``near_levels`` has them: those of which it has a row, a goal or an attempt, and the first of all others.

    ``m`` are the model's tables, ``ranked`` own current attempts in the pool. An item with very many rows has no step function; its pairs are all looked at.
    """
    placed = m["placed"].filter("estimate is not null").select("mode", "level", "item_id", "title", "estimate")
    large = large_keys(m["lent"].select(*KEYS), KEYS, P.HELD // 2 // len(P.PEER_RADII))
    few, lent = (placed, m["lent"]) if large is None else (t.join(large, KEYS, "left_anti") for t in (placed, m["lent"]))
    mark = m["known"].select("entity_id").distinct().withColumn("known", F.lit(True))
    askers = m["ratings"].filter("rating is not null").join(mark, "entity_id", "left").withColumn("fit", F.when(F.col("known"), fx.fold(F.col("entity_id"), P.FOLDS)).otherwise(ALL)).drop("known")
    askers = written(askers.withColumns({c: F.col(c).cast("double") for c in ("rating", "projection")}))
    ends = askers.agg(F.min("projection").alias("low"), F.max("projection").alias("high")).first()
    low, high = (0.0, 1.0) if ends.low is None else (ends.low - 1.0, ends.high + 1.0)
    items = written(few.join(item_steps(lent, low, high), KEYS, "left"))
    had = m["own"].select(*KEYS, "entity_id").union(m["lent"].select(*KEYS, "entity_id")).union(m["goals"].join(placed.select(*KEYS), "item_id").select(*KEYS, "entity_id"))
    seen = written(had.distinct().join(placed.select(*KEYS, "level"), KEYS))
    totals = ranked.groupBy(*own).agg(F.max(F.when(F.col("rank_value") == P.TOP, F.col("value"))).alias("cutoff"), F.count("*").alias("n"))
    first = first_unseen(written(worths(askers, m["medals"], m["usual"], totals, own)), items, seen, grids(m["axis"], m["surface"]), own)
    chosen = first.union(seen.select(*OWN, "item_id")).distinct()
    level, floor = F.col("level"), F.floor("rating")
    rows = chosen.join(placed, KEYS).join(m["ratings"].filter("rating is not null"), OWN).filter((level >= P.MIN_LEVEL) & level.between(floor - 2, floor + 2))
    rows = rows.withColumn("level", level.cast("int"))
    return rows if large is None else rows.unionByName(near_levels(m["ratings"], placed.join(large, KEYS, "left_semi"))).distinct()
