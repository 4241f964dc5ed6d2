"""Scalar formulas as functions from columns to a column; nulls give null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import params as P


def ladder(value: Column, steps: list[tuple[float, object]], otherwise: object = None) -> Column:
    """The result of the first step whose bound ``value`` reaches; steps go down."""
    out = reduce(lambda w, s: w.when(value >= s[0], F.lit(s[1])), steps, F.when(F.lit(False), F.lit(None)))
    return out.otherwise(F.lit(otherwise))


def grade(score: Column) -> Column:
    """Letter grade: the score is cut to an integer and capped at a million; a negative one has none.

    It is the place of the band in a list, as a branch for each band makes methods too long to be compiled where the grade comes up twice.
    """
    whole = score.cast("long")
    at = reduce(lambda n, b: n - (whole >= b[0]).cast("int"), P.GRADE_BANDS, F.lit(len(P.GRADE_BANDS)))
    return F.when(score >= 0, F.get(F.array(*[F.lit(g) for _, g, _ in P.GRADE_BANDS]), at))


def lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def lookup_by_mode(mode: Column, key: Column, single: dict, other: dict) -> Column:
    """``lookup`` in the table of mode Single or in the other. The key, which may be a long expression, is in the plan once: methods that get too long aren't compiled."""
    table = lambda t: F.create_map(*[F.lit(x) for pair in t.items() for x in pair])
    return F.element_at(F.when(mode == "Single", table(single)).otherwise(table(other)), key)


def medal_name(medal: Column) -> Column:
    """The medal's full name from its name or code in any case; null if unknown."""
    names = {n.lower(): n for n, _, _ in P.MEDALS} | {c.lower(): n for n, c, _ in P.MEDALS}
    return lookup(F.lower(F.trim(medal)), names)


def penalty(mode: Column, grade: Column) -> Column:
    single = {g: float(u) for _, g, u in P.GRADE_BANDS}
    return lookup_by_mode(mode, grade, single, single | {g: float(u) for g, u in P.DOUBLE_PENALTIES.items()})


def bonus(mode: Column, medal: Column) -> Column:
    single = {n: float(u) for n, _, u in P.MEDALS}
    return lookup_by_mode(mode, medal, single, single | {n: float(u) for n, u in P.DOUBLE_BONUSES.items()})


def cents(x: Column) -> Column:
    """Cut to two decimals, with room for what floating point lost."""
    return F.floor((x + F.lit(1e-9)) * 100) / 100.0


def attempt_value(mode: Column, level: Column, grade: Column, medal: Column) -> Column:
    """What an attempt is worth in mode Single or Double."""
    effective = level - F.when(mode == "Double", 1).otherwise(0)
    base = F.when(effective <= 23, (effective + 27) * 7.5).otherwise((effective - 23) * 15.0 + 375.0)
    return cents(F.greatest(F.lit(0.0), base * ((F.lit(750.0) - penalty(mode, grade) * 5 + bonus(mode, medal)) / 750.0)))


def group_rating(grade: Column, medal: Column) -> Column:
    """What an attempt is worth in the group mode."""
    double = F.lit("Double")
    return cents(F.lit(120.0) - penalty(double, grade) * 0.8 + bonus(double, medal) * 0.16)


def skill_rating(mode: Column, value: Column) -> Column:
    """The level at which the reference result is worth ``value``."""
    base = value / F.lit(P.REFERENCE)
    return F.when(base <= 375, base / 7.5 - 27.0).otherwise((base - 375.0) / 15.0 + 23.0) + F.when(mode == "Double", 1.0).otherwise(0.0)


def folder(mode: Column, level: Column) -> Column:
    """Mode letter and level; null under the least level and in other modes."""
    letter = F.when(mode == "Single", "S").when(mode == "Double", "D")
    return F.when(level >= P.MIN_LEVEL, F.concat(letter, level.cast("string")))


def band(delta: Column) -> Column:
    """Effect band 1 to 7 of a difference in levels; bounds belong to the band nearer the middle."""
    low = reduce(lambda w, s: w.when(delta < s[0], s[1]), ((-0.5, 1), (-0.3, 2), (-0.1, 3)), F.when(delta.isNull(), F.lit(None).cast("int")))
    return reduce(lambda w, s: w.when(delta <= s[0], s[1]), ((0.1, 4), (0.3, 5), (0.5, 6)), low).otherwise(7)


def band_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*map(F.lit, P.BANDS)), rank))


def decile(percentile: Column) -> Column:
    return F.when(percentile.isNotNull(), F.least(F.lit(10), F.floor(percentile * 10) + 1).cast("int"))


def status(n: Column) -> Column:
    return F.when(n >= P.PUBLISHED, "Published").when(n >= P.PROVISIONAL, "Provisional").when(n > 0, "Insufficient").otherwise("Unrated")


def ability_weight(distance: Column) -> Column:
    """One for no distance or an unknown one, a half at a distance of one level."""
    return F.coalesce(F.lit(1.0) / (distance * distance + 1.0), F.lit(1.0))


def level_window(level: Column, rating: Column, radius: int = 2) -> Column:
    return level.between(F.greatest(F.lit(P.MIN_LEVEL), F.floor(rating) - radius), F.floor(rating) + radius)


def marginal_gain(candidate: Column, existing: Column, in_top: Column, n: Column, cutoff: Column) -> Column:
    """How much a result adds to the sum of the TOP best."""
    new = F.greatest(F.coalesce(existing, F.lit(0.0)), candidate)
    over = lambda x: F.greatest(F.lit(0.0), new - F.coalesce(x, F.lit(0.0)))
    return F.when(in_top, over(existing)).when(n < P.TOP, new).otherwise(over(cutoff))


def archive_factor(score: Column) -> Column:
    return ladder(score, list(P.ARCHIVE_FACTORS))


def reband(value: Column, old: Column, new: Column) -> Column:
    """An archive value after its score changed; as it is where a band has no factor."""
    return F.coalesce(value * archive_factor(new) / archive_factor(old), value)


def normal_score(score: Column, old_notes: Column, new_notes: Column) -> Column:
    """A score after the item's note count changed from ``old_notes`` to ``new_notes``; as it is where either is unknown."""
    to = (score / 1e6 * old_notes - (old_notes - new_notes)) / new_notes * 1e6
    return F.when(old_notes.isNull() | new_notes.isNull() | (old_notes == new_notes), score).otherwise(F.least(F.lit(1e6), F.greatest(F.lit(0.0), to)))


def short_hash(key: Column) -> Column:
    return F.substring(F.sha2(key.cast("binary"), 256), 1, 16)


def public_key(namespace: str, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{namespace}:"), key).cast("binary"), 256), 1, 20)


def fold(key: Column, folds: int = 5) -> Column:
    return (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long") % folds).cast("int")


def peer_confidence(n: Column) -> Column:
    return F.when(n >= 20, "high").when(n >= 10, "medium").when(n >= 5, "low").otherwise("none")


def one_decimal(x: Column) -> Column:
    return F.floor(x * 10 + F.lit(1e-9)) / 10.0


def log_miss(score: Column) -> Column:
    return F.log1p(F.lit(1_000_000.0) - score)


def progress(value: Column, rungs: list[tuple[str, int]]) -> Column:
    """Where a value stands on a ladder of (label, threshold) that starts at 0: struct (rung, label, next_label, remaining, percent); nothing or less counts as 0."""
    v = F.greatest(F.lit(0.0), F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0)))
    labels, steps = F.array(*[F.lit(n) for n, _ in rungs]), F.array(*[F.lit(float(t)) for _, t in rungs])
    at = F.size(F.filter(steps, lambda t: t <= v))
    low, high = F.get(steps, at - 1), F.get(steps, at)
    last = high.isNull()
    return F.struct(
        (at - 1).alias("rung"), F.get(labels, at - 1).alias("label"), F.get(labels, at).alias("next_label"),
        F.when(last, 0.0).otherwise(high - v).alias("remaining"), F.when(last, 100.0).otherwise((v - low) / (high - low) * 100).alias("percent"),
    )
