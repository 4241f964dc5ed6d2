"""What an entity should try next: scores of peers of like rating, goals, what they would be worth, and the gain."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from . import weighted as wt
from .difficulty import OWN, ranked_in_bins
from .lineage import written
from .ordering import accumulated, numbered
from .quantiles import large_keys, percentiles

KEYS = ["mode", "item_id"]
#: Digits of a place by score that are told apart at once.
RADIX = 16


def rating_source(counts: DataFrame) -> DataFrame:
    """Which source rates (mode, entity_id) with counts (current_n, archive_n): enough current attempts, else enough of the archive, else any current ones."""
    c, a = F.col("current_n"), F.col("archive_n")
    rating = F.when(c >= P.RATING_TOP, "current").when(a >= P.RATING_TOP, "archive").when(c > 0, "current")
    projection = F.when(c >= P.BASE_LAST, "current").when(a >= P.BASE_LAST, "archive")
    return counts.withColumns({"rating_source": rating, "projection_source": projection})


def chosen_ratings(by_source: DataFrame) -> DataFrame:
    """(mode, entity_id, rating, projection) from (source, mode, entity_id, n, rating, full_rating), of the source that rating_source names."""
    of = lambda source, c: F.max(F.when(F.col("source") == source, F.col(c)))
    names = [(c, s) for c in ("n", "rating", "full_rating") for s in ("current", "archive")]
    wide = by_source.groupBy(*OWN).agg(*[of(s, c).alias(f"{s}_{c}") for c, s in names]).fillna(0, ["current_n", "archive_n"])
    pick = lambda by, c: F.when(F.col(by) == "current", F.col(f"current_{c}")).when(F.col(by) == "archive", F.col(f"archive_{c}"))
    return rating_source(wide).select(*OWN, pick("rating_source", "rating").alias("rating"), pick("projection_source", "full_rating").alias("projection"))


def own_ratings(ranked: DataFrame, own: list[str] = OWN) -> DataFrame:
    """Each row's rating: without its item where 31 attempts allow it, else of the whole window, null under 30."""
    inside = F.col("rank_value").between(P.BASE_FIRST, P.BASE_LAST)
    by = Window.partitionBy(*own)
    rows = wt.without_item(ranked, own).withColumns({"mean": F.avg(F.when(inside, F.col("value"))).over(by), "m": F.count("*").over(by)})
    rows = rows.withColumn("full_rating", F.when(F.col("m") >= P.BASE_LAST, fx.skill_rating(F.col("mode"), F.col("mean")))).drop("mean", "m")
    return rows.withColumn("rating", F.coalesce("rating_without", "full_rating"))


def peer_scores(wanted: DataFrame, peers: DataFrame, held: int = P.HELD, radix: int = RADIX) -> DataFrame:
    """(mode, entity_id, item_id, peer_score, support) of wanted (mode, entity_id, item_id, rating), each once: the weighted lower median of other entities' scores.

    ``peers`` are rows (mode, entity_id, item_id, rating, score, weight). The radius is the first that has the largest number of peers which any of them has;
    with fewer than the least number there is no row. Every peer in the band counts.

    Up to ``held`` edges of an item's bands are looked at in one task, by numpy. Of items with more no pairs are made. Their peers stand in the order of their ratings, and what a band holds is the difference of two running sums, at its upper and its lower edge: of rows for the radius, then of
    weights. The median is found digit by digit of the peers' places by score: the weights of the ``radix`` next digits in the band tell which one it lies in, and all is summed over ranges. So rows grow with peers and wanted ones, and digits
    with the logarithm of an item's peers. Weights should be such that their sums are exact, as whole numbers are.
    """
    own_key = [*OWN, "item_id"]
    asked = wanted.filter("rating is not null").select(*own_key, "rating").na.drop(subset=own_key)
    lent = peers.filter("rating is not null").select(*KEYS, F.col("entity_id").alias("peer"), F.col("rating").alias("at"), "score", F.when(F.col("score").isNotNull() & (F.col("weight") > 0), F.col("weight")).otherwise(0).cast("double").alias("weight"))
    lent = lent.na.drop(subset=KEYS)
    large = large_keys(asked.select(*KEYS).union(lent.select(*KEYS)), KEYS, max(1, held // 2 // len(P.PEER_RADII)))  # a wanted row has two edges for each radius
    if large is None:
        return _scores_in_groups(asked, lent)
    few = _scores_in_groups(asked.join(large, KEYS, "left_anti"), lent.join(large, KEYS, "left_anti"))
    return few.unionByName(_scores_in_ranges(asked.join(large, KEYS, "left_semi"), lent.join(large, KEYS, "left_semi"), radix))


def _group_scores(me: np.ndarray, rating: np.ndarray, peer: np.ndarray, at: np.ndarray, score: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, support) for each asked row of one item: entity ``me`` and ``rating``; peers in the order of their scores. Support is zero without enough of them, the score NaN without weight."""
    found, support = np.full(len(me), np.nan), np.zeros(len(me), np.int64)
    step = max(1, (1 << 20) // max(1, len(peer)))
    for i in range(0, len(me), step):
        rows = slice(i, i + step)
        off = np.abs(rating[rows, None] - at[None, :])
        off[me[rows, None] == peer[None, :]] = np.inf  # an entity is no peer of its own
        n = np.stack([(off <= r + 1e-9).sum(1) for r in P.PEER_RADII])
        radius, count = np.full(n.shape[1], -1.0), np.zeros(n.shape[1], np.int64)
        for target in sorted(P.PEER_TARGETS):  # the largest target that is met wins, and the least radius that meets it
            for r, m in reversed(list(zip(P.PEER_RADII, n, strict=True))):
                radius, count = np.where(m >= target, r, radius), np.where(m >= target, m, count)
        run = np.cumsum(np.where(off <= radius[:, None] + 1e-9, weight[None, :], 0.0), axis=1)
        if run.shape[1]:
            first = (run >= run[:, -1:] * 0.5).argmax(1)
            found[rows] = np.where(run[:, -1] > 0, score[first], np.nan)
        support[rows] = count
    return found, support


def _scores_in_groups(asked: DataFrame, lent: DataFrame) -> DataFrame:
    """``peer_scores`` for items with few rows: one exchange by item, then an item's rows are compared in numpy, in the order of scores."""
    peers = lent.select(*KEYS, F.col("peer").alias("entity_id"), "at", "score", "weight")
    rows = peers.unionByName(asked.select(*KEYS, "entity_id", F.col("rating").alias("at")), allowMissingColumns=True)
    rows = rows.select(*KEYS, "entity_id", F.col("at").cast("double"), F.col("score").cast("double"), "weight").repartition(*KEYS).sortWithinPartitions(*KEYS, "score", "entity_id")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches, KEYS):
            me = rows["entity_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            at, score, weight = (rows[c].to_numpy() for c in ("at", "score", "weight"))
            asks = rows["weight"].is_null().to_numpy()
            ends = _group_ends(rows, KEYS)
            found, support = np.full(len(me), np.nan), np.zeros(len(me), np.int64)
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                who, of = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                found[who], support[who] = _group_scores(me[who], at[who], me[of], at[of], score[of], weight[of])
            kept = np.flatnonzero((support > 0) & ~np.isnan(found))
            out = rows.select([*OWN, "item_id"]).take(pa.array(kept)).append_column("peer_score", pa.array(found[kept])).append_column("support", pa.array(support[kept]))
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(scored, "mode string, entity_id string, item_id string, peer_score double, support long")


def _group_ends(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each run of rows with the same keys ends."""
    codes = [rows[k].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys]
    return np.append(np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1, rows.num_rows)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of rows in the order of ``keys`` as tables that end where a key does: a batch's last key waits for the next batch."""
    parts: list[pa.Table] = []
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if not rows.num_rows:
            continue
        ends = _group_ends(rows, keys)
        start = int(ends[-2]) if len(ends) > 1 else 0
        if parts and (start or any(parts[-1][k][-1] != rows[k][0] for k in keys)):
            same = all(parts[-1][k][-1] == rows[k][0] for k in keys)
            done = pa.concat_tables([*parts, rows.slice(0, start)]) if start else pa.concat_tables(parts)
            yield done
            parts = [rows.slice(start)] if start or not same else [*parts, rows]
        elif start:
            yield rows.slice(0, start)
            parts = [rows.slice(start)]
        else:
            parts.append(rows)
    if parts:
        yield pa.concat_tables(parts)


def _scores_in_ranges(asked: DataFrame, lent: DataFrame, radix: int) -> DataFrame:
    """``peer_scores`` for items with many rows, none of which is gathered."""
    own_key = [*OWN, "item_id"]
    asked = written(asked)
    lent = written(numbered(lent, [F.col("score").asc(), F.col("peer").asc()], "rank", KEYS).withColumn("rank", F.col("rank") - 1))
    mine = written(asked.join(lent.withColumnRenamed("peer", "entity_id"), own_key))  # an entity is no peer of its own
    reach = lambda r: F.lit(r) + 1e-9
    edge = lambda k, r, side: F.struct(F.lit(k).alias("edge"), (F.col("rating") + (2 * side - 1) * reach(r)).alias("at"), F.lit(2 * side).alias("kind"))
    order = [F.col("at").asc(), F.col("kind").asc()]  # of equal ratings the lower edge comes first, then peers, then the upper edge
    sides = [(i, side) for i in range(len(P.PEER_RADII)) for side in (0, 1)]
    edges = asked.select(*own_key, F.explode(F.array(*[edge(2 * i + side, P.PEER_RADII[i], side) for i, side in sides])).alias("e")).select(*own_key, "e.*", F.lit(0).alias("one"))
    lent_rows = lent.select("mode", F.lit(None).cast("string").alias("entity_id"), "item_id", F.lit(None).cast("int").alias("edge"), "at", F.lit(1).alias("kind"), F.lit(1).alias("one"))
    run = accumulated(lent_rows.union(edges), order, {"run": F.col("one")}, KEYS).filter("edge is not null")
    within = run.groupBy(*own_key).agg(*[F.sum(F.when(F.col("edge") == 2 * i + 1, F.col("run")).when(F.col("edge") == 2 * i, -F.col("run"))).alias(f"n{i}") for i in range(len(P.PEER_RADII))])
    off = F.abs(F.col("rating") - F.col("at"))
    selves = mine.groupBy(*own_key).agg(*[F.count_if(off <= reach(r)).alias(f"o{i}") for i, r in enumerate(P.PEER_RADII)])
    counts = within.join(selves, own_key, "left").fillna(0).select(*own_key, *[(F.col(f"n{i}") - F.col(f"o{i}")).alias(f"n{i}") for i in range(len(P.PEER_RADII))])
    radius, support = F.lit(None).cast("double"), F.lit(None).cast("long")
    for target in sorted(P.PEER_TARGETS):  # the largest target is asked first, so it is put on top last
        for i in reversed(range(len(P.PEER_RADII))):
            enough = F.col(f"n{i}") >= target
            radius, support = F.when(enough, P.PEER_RADII[i]).otherwise(radius), F.when(enough, F.col(f"n{i}")).otherwise(support)
    chosen = counts.select(*own_key, radius.alias("radius"), support.alias("support")).filter("radius is not null").join(asked, own_key)
    state = chosen.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0.0), "goal": F.lit(None).cast("double")})
    last = lent.agg(F.max("rank")).first()[0] or 0
    digits = 1
    while radix**digits <= last:
        digits += 1
    cells = range(radix)
    for k in range(digits):
        state = written(state)
        unit = radix ** (digits - 1 - k)
        prefix, digit = F.floor(F.col("rank") / (unit * radix)), F.floor(F.col("rank") / unit) % radix
        sides = state.select(*own_key, "prefix", F.explode(F.array(*[edge(side, F.col("radius"), side) for side in (0, 1)])).alias("e")).select(*own_key, "prefix", "e.*", F.lit(None).cast("long").alias("digit"), F.lit(0.0).alias("weight"))
        stand = lent.select("mode", F.lit(None).cast("string").alias("entity_id"), "item_id", prefix.alias("prefix"), F.lit(None).cast("int").alias("edge"), "at", F.lit(1).alias("kind"), digit.alias("digit"), "weight")
        sums = accumulated(stand.union(sides), order, {f"w{v}": F.when(F.col("digit") == v, F.col("weight")).otherwise(0.0) for v in cells}, [*KEYS, "prefix"]).filter("edge is not null")
        own = mine.join(state.select(*own_key, "prefix", "radius"), own_key).filter((off <= reach(F.col("radius"))) & (F.col("prefix") == prefix))
        parts = sums.select(*own_key, *[(F.col(f"w{v}") * (F.col("edge") * 2 - 1)).alias(f"w{v}") for v in cells])
        parts = parts.union(own.select(*own_key, *[F.when(digit == v, -F.col("weight")).otherwise(0.0).alias(f"w{v}") for v in cells])).groupBy(*own_key).agg(*[F.sum(f"w{v}").alias(f"w{v}") for v in cells])
        upto = [F.col("before")]
        for v in cells:
            upto.append(upto[-1] + F.col(f"w{v}"))
        rows = state.join(parts, own_key).withColumn("goal", F.coalesce("goal", upto[-1] * 0.5)).filter("goal > 0")
        ladder = F.array(*upto[1:])
        first = F.array_position(F.transform(ladder, lambda x: x >= F.col("goal")), F.lit(True)).cast("int")
        at = F.when(first > 0, first).otherwise(F.array_position(ladder, F.array_max(ladder)).cast("int"))  # the latter where sums aren't exact
        rows = rows.withColumns({"at": at, "ladder": F.concat(F.array(F.col("before")), ladder)})
        state = rows.select(*own_key, "radius", "support", "rating", (F.col("prefix") * radix + F.col("at") - 1).alias("prefix"), F.element_at("ladder", F.col("at")).alias("before"), "goal")
    return state.join(lent.select(*KEYS, F.col("rank").alias("prefix"), "score"), [*KEYS, "prefix"]).select(*own_key, F.col("score").alias("peer_score"), "support")


def grade_floor(score: Column) -> Column:
    """The least score that earns the same grade; null for a null one."""
    return F.when(score.isNotNull(), fx.ladder(F.least(score.cast("long"), F.lit(1_000_000)), [(b, b) for b, _, _ in P.GRADE_BANDS]))


def archive_goals(rows: DataFrame) -> DataFrame:
    """Goal by entity and item of archive rows with normalised scores: the grade floor of the best one."""
    best = rows.groupBy("entity_id", "item_id").agg(F.max("score").alias("best"))
    return best.select("entity_id", "item_id", grade_floor(F.col("best")).alias("goal_score"), fx.grade(F.col("best")).alias("goal_grade")).filter("goal_grade is not null")


def first_unseen(who: DataFrame, own: DataFrame, items: DataFrame, place: str, by: list[str], common: list[str], shown: int = P.SHOWN) -> DataFrame:
    """(by, item_id): at least the first ``shown`` items in the catalog's order ``place`` (from 1, within ``common``) that each of ``who`` (by) has no row in ``own`` (by, item_id, place) of; own ones among them come along.

    The i-th own item in that order stands before the last one wanted if fewer than ``shown`` others do, which are its place less i; so the places wanted are ``shown`` and as many
    as there are such own items. Rows don't grow with the catalog, and hardly with what an entity has. Places that all ask for are in a table of ``2 * shown`` rows for each of ``common``, which is broadcast.
    """
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(place))
    before = own.withColumn("__nth", nth).filter(F.col(place) - F.col("__nth") < shown).groupBy(*by).agg(F.count("*").alias("__before"))
    most = shown + F.coalesce("__before", F.lit(0).cast("long"))
    places = who.join(before, by, "left").select(*by, F.explode(F.sequence(F.lit(1).cast("long"), most)).alias(place))
    on, head = [*common, place], F.col(place) <= 2 * shown
    items = items.select(*on, "item_id")
    found = places.filter(head).join(F.broadcast(items.filter(head)), on).union(places.filter(~head).join(items.filter(~head), on))
    return found.select(*by, "item_id")


def group_candidates(placed: DataFrame, entities: DataFrame, observed: DataFrame, goals: DataFrame) -> DataFrame:
    """Group items for each entity: the ladder's goal or a better own one of the archive, its rating and gain; the 50 of most gain.

    ``placed`` has (item_id, title, estimate, continuous). An item of which an entity has neither goal nor rating gains what the ladder's goal is worth, for all alike; so of those each entity only gets the first 50 of one order.
    """
    grade = fx.lookup(F.col("estimate"), P.GROUP_GOALS)
    worth = lambda c: fx.group_rating(F.col(c), F.lit(P.GROUP_MEDAL))
    gain = lambda existing: F.greatest(F.lit(0.0), F.round(F.col("expected") - existing, 2))
    order = [F.col("gain").desc(), F.col("continuous"), F.col("expected").desc(), F.lower("title"), F.col("item_id")]
    ladder = placed.filter("estimate is not null").select("item_id", "title", "continuous", grade.alias("ladder_grade"), fx.lookup(grade, {g: b for b, g, _ in P.GRADE_BANDS}).alias("ladder_score"))
    alike = ladder.filter("ladder_grade is not null").withColumn("expected", worth("ladder_grade")).withColumn("gain", gain(F.lit(0.0)))
    alike = written(numbered(alike, order, "ladder_place").select("item_id", "ladder_place"))
    current = observed.filter("source = 'current'").select("entity_id", "item_id", F.col("rating").alias("existing"))
    who = entities.select("entity_id").distinct()
    own = written(goals.select("entity_id", "item_id").union(current.select("entity_id", "item_id")).distinct().join(who, "entity_id", "left_semi"))
    rows = first_unseen(who, own.join(alike, "item_id"), alike, "ladder_place", ["entity_id"], []).union(own).distinct()
    rows = rows.join(ladder, "item_id").join(goals, ["entity_id", "item_id"], "left").join(current, ["entity_id", "item_id"], "left")
    better = F.col("goal_score").isNotNull() & (F.col("ladder_score").isNull() | (F.col("goal_score") > F.col("ladder_score")))
    rows = rows.withColumns({"score": F.when(better, F.col("goal_score")).otherwise(F.col("ladder_score")), "grade": F.when(better, F.col("goal_grade")).otherwise(F.col("ladder_grade"))})
    rows = rows.filter("grade is not null").withColumn("expected", worth("grade")).withColumn("gain", gain(F.coalesce("existing", F.lit(0.0))))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).filter(F.col("place") <= P.SHOWN)


def gain_order() -> list[Column]:
    return [F.col("gain").desc_nulls_last(), F.col("estimate"), F.col("expected").desc_nulls_last(), F.lower("title"), F.col("item_id")]


def all_pairs(one: DataFrame, other: DataFrame, keys: list[str], size: int = 2000) -> DataFrame:
    """Every row of ``one`` with every row of ``other`` at equal ``keys``, of which there may be few with very many rows. Each side's rows differ.

    Both sides are packed into blocks of some ``size`` rows, and blocks meet; pairs only come up as they are read. So what is exchanged is a side's blocks for each of the other's, and no key's rows go to one task.
    """
    mine, theirs = ([c for c in t.columns if c not in keys] for t in (one, other))
    groups = other.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.max("n").alias("most")).first()
    asking = one.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()
    chunks, blocks = (max(1, -(-(r.most or 0) // size)) for r in (groups, asking))
    tasks = max(1, min(4096, groups["keys"] * chunks))
    part = lambda columns, n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    packed = lambda t, columns, n, at, name: t.groupBy(*keys, part(columns, n).alias(at)).agg(F.collect_list(F.struct(*columns)).alias(name))
    asked = packed(one, mine, blocks, "block", "ones").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(tasks, *keys, "chunk")
    rows = asked.join(packed(other, theirs, chunks, "chunk", "others").repartition(tasks, *keys, "chunk"), [*keys, "chunk"])
    rows = rows.select(*keys, F.explode("ones").alias("one"), "others").select(*keys, "one", F.explode("others").alias("other"))
    return rows.select(*keys, *[F.col(f"one.{c}").alias(c) for c in mine], *[F.col(f"other.{c}").alias(c) for c in theirs])


def near_levels(ratings: DataFrame, placed: DataFrame) -> DataFrame:
    """Items with an estimate within two levels of each entity's rating; levels are exploded, so that the range is an equi-join."""
    low, high = F.greatest(F.lit(P.MIN_LEVEL), F.floor("rating") - 2), F.floor("rating") + 2
    levels = ratings.filter(high >= low).withColumn("level", F.explode(F.sequence(low, high))).withColumn("level", F.col("level").cast("int"))
    return levels.join(placed.filter("estimate is not null").select("mode", "level", "item_id", "title", "estimate"), ["mode", "level"])


def candidates(ratings: DataFrame, peers: DataFrame, placed: DataFrame, goals: DataFrame, medals: DataFrame, usual: DataFrame, project: Callable[[DataFrame], DataFrame], pairs: DataFrame | None = None) -> DataFrame:
    """Every item near each entity's rating, or those of ``pairs`` among them, with its projected score, grade and medal and what that would be worth.

    ``ratings``: (mode, entity_id, rating, projection); ``peers`` as above, with whose rows leave-one-out ratings come; ``placed``: items with an estimate;
    ``goals`` of the archive; ``medals``: the entity's own (mode, grade, medal), ``usual``: the population's. ``project`` adds ``projected``, ``support``, ``origin``
    and ``confidence`` to rows with a rating, a difficulty and a peer score, whose other columns it keeps. A goal above the projection replaces it.
    """
    rows = near_levels(ratings, placed) if pairs is None else pairs
    without = peers.select(*OWN, "item_id", F.col("rating").alias("own_rating"))
    rows = written(rows.join(without, [*OWN, "item_id"], "left").withColumn("wanted", F.coalesce("own_rating", "projection")).drop("own_rating"))
    near = peer_scores(rows.select(*OWN, "item_id", F.col("wanted").alias("rating")), peers)
    asked = rows.withColumnRenamed("rating", "own_rating").withColumns({"rating": F.col("wanted"), "difficulty": F.col("estimate")}).join(near, [*OWN, "item_id"], "left")
    rows = project(asked).drop("rating", "difficulty").withColumnRenamed("own_rating", "rating").join(goals, ["entity_id", "item_id"], "left")
    model, model_grade = grade_floor(F.col("projected")), fx.grade(F.col("projected"))
    own = F.col("goal_score").isNotNull() & (model.isNull() | (F.col("goal_score") > model))
    rows = rows.withColumns({
        "score": F.when(own, F.col("goal_score")).otherwise(model), "grade": F.when(own, F.col("goal_grade")).otherwise(model_grade),
        "from_archive": own, "confidence": F.when(own, "high").otherwise(F.col("confidence")),
    })
    rows = rows.join(medals.select(*OWN, "grade", F.col("medal").alias("own_medal")), [*OWN, "grade"], "left").join(usual, ["mode", "grade"], "left").withColumn("medal", F.coalesce("own_medal", "medal"))
    rows = rows.withColumn("expected", F.when(F.col("grade").isNotNull(), fx.attempt_value(F.col("mode"), F.col("level"), F.col("grade"), F.col("medal"))))
    return rows.withColumn("edge", F.col("level") + 0.5 - F.col("estimate"))


def recommendations(rows: DataFrame, ranked: DataFrame, own: list[str] = OWN) -> DataFrame:
    """The 50 candidates of most gain by ``own``, which is (mode, entity_id), or (entity_id) for one pool of both modes; ``ranked``: own current attempts in that pool."""
    rank = F.col("rank_value")
    totals = ranked.groupBy(*own).agg(F.max(F.when(rank == P.TOP, F.col("value"))).alias("cutoff"), F.count("*").alias("n"))
    rows = wt.gains(rows, ranked, totals, F.col("expected"), own).withColumn("gain", F.when(F.col("expected").isNotNull(), F.col("gain")))
    rows = rows.filter((F.col("estimate") <= F.col("rating") + P.RADIUS) | (F.col("from_archive") & (F.col("gain") > 0)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*own).orderBy(*gain_order()))).filter(F.col("place") <= P.SHOWN)


def edge_order() -> list[Column]:
    """Order where no gain is known: easiest for its level first."""
    return [F.col("edge").desc(), F.col("estimate"), F.lower("title"), F.col("item_id")]


def by_rating(asked: DataFrame, placed: DataFrame) -> DataFrame:
    """The 50 easiest items for their level for each (mode, entity_id, rating) that is only stated, without attempts, up to a level over it."""
    rows = near_levels(asked, placed).withColumns({"edge": F.round(F.col("level") + 0.5 - F.col("estimate"), 6), "distance": F.round(F.col("estimate") - F.col("rating"), 6)})
    rows = rows.filter(F.col("estimate") <= F.col("rating") + P.RADIUS)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*OWN).orderBy(*edge_order()))).filter(F.col("place") <= P.SHOWN)


def short_baselines(ranked: DataFrame, placed: DataFrame) -> DataFrame:
    """By (mode, entity_id) the mean value and edge of ranks 11 to 30, or of the better half under 30 attempts, and the mean estimate as rating."""
    rank, n = F.col("rank_value"), F.col("n")
    inside = F.when(n >= P.BASE_LAST, rank.between(P.BASE_FIRST, P.BASE_LAST)).otherwise(rank <= F.greatest(F.lit(1), F.ceil(n * 0.5)))
    rows = ranked.filter(inside).join(placed.select(*KEYS, "estimate"), KEYS, "left").withColumn("estimate", F.coalesce("estimate", F.col("level") + 0.5))
    return rows.groupBy(*OWN).agg(F.avg("value").alias("base"), F.avg("estimate").alias("rating"), F.avg(F.col("level") + 0.5 - F.col("estimate")).alias("base_edge"))


def single_source(ranked: DataFrame, placed: DataFrame, slopes: DataFrame) -> DataFrame:
    """The 50 items of most gain from one source alone: expected is the baseline moved by the mode's slope and the edge over the baseline's.

    Every item of level 16 and more with an estimate may be among them, but what is expected of an item depends on its edge alone. So of the items that an entity has
    no attempt at only the first 50 in the order of edges can have a gain, and only the first 50 in the order of estimates can follow without one. Those and the own items are looked at.
    """
    base = short_baselines(ranked, placed).join(slopes.filter("slope > 0").select("mode", "slope"), "mode")
    items = placed.filter((F.col("level") >= P.MIN_LEVEL) & F.col("estimate").isNotNull()).select("mode", "item_id", "title", "level", "estimate", (F.col("level") + 0.5 - F.col("estimate")).alias("edge"))
    ties = [F.lower("title"), F.col("item_id")]
    items = ranked_in_bins(items, ["mode"], F.floor(F.col("edge") * -100), [F.col("edge").desc(), F.col("estimate"), *ties], "by_edge")
    items = written(ranked_in_bins(items, ["mode"], F.floor(F.col("estimate") * 100), [F.col("estimate"), F.col("edge").desc(), *ties], "by_estimate"))
    totals = ranked.groupBy(*OWN).agg(F.max(F.when(F.col("rank_value") == P.TOP, F.col("value"))).alias("cutoff"), F.count("*").alias("n"))
    who, own = base.select(*OWN), written(ranked.select(*OWN, "item_id").join(items, KEYS).select(*OWN, "item_id", "by_edge", "by_estimate"))
    first = [first_unseen(who, own, items, by, OWN, ["mode"]) for by in ("by_edge", "by_estimate")]
    rows = first[0].union(first[1]).union(own.select(*OWN, "item_id")).distinct().join(base, OWN).join(items, KEYS)
    rows = rows.withColumn("expected", F.greatest(F.lit(0.0), F.col("base") + F.col("slope") * (F.col("edge") - F.col("base_edge"))))
    rows = wt.gains(rows, ranked, totals, F.col("expected"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*OWN).orderBy(*gain_order()))).filter(F.col("place") <= P.SHOWN)


def clipped(lists: DataFrame, ratings: DataFrame) -> DataFrame:
    """Stored lists (mode, entity_id, item_id, level, place) cut to the levels near today's rating and to 50 rows, numbered anew."""
    rows = lists.join(ratings.select(*OWN, "rating"), OWN).filter((F.col("level") >= P.MIN_LEVEL) & fx.level_window(F.col("level"), F.col("rating")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*OWN).orderBy("place", "item_id"))).filter(F.col("place") <= P.SHOWN)


def source_offsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """By ``keys`` (slope, n, offset): how much higher scores are in the current source for entities with both, at equal difficulty.

    ``rows``: (keys, entity_id, source, difficulty, score). The slope is within entities and sources; a rising one counts as flat.
    """
    return offsets_of_sums(source_sums(rows, keys), keys)


def source_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What ``source_offsets`` needs of each entity and source."""
    x, y = F.col("difficulty"), F.col("score")
    return rows.groupBy(*keys, "entity_id", "source").agg(
        F.avg(y).alias("my"), F.avg(x).alias("mx"), (F.sum(x * y) - F.sum(x) * F.sum(y) / F.count("*")).alias("xy"), (F.sum(x * x) - F.sum(x) * F.sum(x) / F.count("*")).alias("xx"),
    )


def offsets_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """``source_offsets`` from the sums."""
    slope = sums.groupBy(*keys).agg(F.when(F.sum("xx") > 0, -F.sum("xy") / F.sum("xx")).otherwise(0.0).alias("slope"))
    level = F.col("my") + F.greatest(F.lit(0.0), F.col("slope")) * F.col("mx")
    levels = (sums.join(slope, keys) if keys else sums.join(F.broadcast(slope), how="cross")).select(*keys, "entity_id", "source", "slope", level.alias("level"))  # one row without keys
    both = levels.groupBy(*keys, "entity_id").agg(F.max(F.when(F.col("source") == "current", F.col("level"))).alias("c"), F.max(F.when(F.col("source") == "archive", F.col("level"))).alias("a"), F.max("slope").alias("slope"))
    return both.groupBy(*keys).agg(F.max("slope").alias("slope"), F.count(F.col("c") - F.col("a")).alias("n"), F.coalesce(F.percentile(F.col("c") - F.col("a"), F.lit(0.5)), F.lit(0.0)).alias("offset"))


def source_offset(rows: DataFrame) -> DataFrame:
    """The same over all rows, as one row."""
    return source_offsets(rows, [])


def top_scores(ranked: DataFrame, placed: DataFrame) -> DataFrame:
    """The first 50 attempts of each entity and mode by value, with their items' estimates."""
    return ranked.filter(F.col("rank_value") <= P.SHOWN).join(placed.select(*KEYS, "title", "estimate"), KEYS, "left")
