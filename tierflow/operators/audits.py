"""Checks of tables and of events against what is expected; all are groupings or outer joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resume(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows of keys that have no fresh ones, and all fresh ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def soft_upsert(stored: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Dimension rows after ``fresh``: its values where it has the key, else the stored ones, which turn inactive."""
    new = fresh.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("active"))
    pick = lambda c: F.when(F.col("active"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return stored.select(key, *columns).join(new, key, "full_outer").select(key, *map(pick, columns), F.coalesce("active", F.lit(False)).alias("active"))


def explained_diff(left: DataFrame, right: DataFrame, notes: DataFrame) -> DataFrame:
    """(verdict, n) over (path, value) tables: exact, explained, unexplained, and explanations that nothing uses."""
    both = left.select("path", F.struct("value").alias("l")).join(right.select("path", F.struct("value").alias("r")), "path", "full_outer")
    both = both.join(notes.select("path", F.lit(True).alias("noted")).distinct(), "path", "full_outer")
    same = F.col("l").eqNullSafe(F.col("r"))
    verdict = F.when(same & F.col("noted"), "unused").when(same, "exact").when(F.col("noted"), "explained").otherwise("unexplained")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def numeric_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str, within: float) -> DataFrame:
    """One row: cells missing on either side, cells further apart than ``within``, and the largest distance."""
    both = left.select(*keys, F.col(value).alias("l"), F.lit(1).alias("in_l")).join(right.select(*keys, F.col(value).alias("r"), F.lit(1).alias("in_r")), keys, "full_outer")
    off = F.abs(F.col("l") - F.col("r"))
    return both.agg(F.count_if(F.col("in_l").isNull() | F.col("in_r").isNull()).alias("missing"), F.count_if(off > within).alias("changed"), F.max(off).alias("most"))


def field_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(field, n): in how many keys of both tables a field differs."""
    both = left.alias("l").join(right.alias("r"), keys)
    sums = both.agg(*[F.count_if(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*")


def retention(generations: DataFrame, now: Column, newest: int = 2, hours: int = 48) -> DataFrame:
    """Generations (family, generation, created, is_current) with ``keep``: current ones, the newest, and young ones."""
    place = F.row_number().over(Window.partitionBy("family").orderBy(F.col("created").desc(), F.col("generation").desc()))
    young = F.col("created") > now - F.expr(f"interval {hours} hours")
    return generations.withColumn("keep", F.col("is_current") | (place <= newest) | young)


def outcome_audit(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by ``keys`` against expected ones (keys, want): each key with seen, want and whether they agree."""
    seen = observed.groupBy(*keys).agg(F.count("*").alias("seen"))
    both = seen.join(expected.select(*keys, "want"), keys, "full_outer").fillna(0, ["seen", "want"])
    return both.withColumn("ok", F.col("seen") == F.col("want"))


def lifecycle_audit(events: DataFrame) -> DataFrame:
    """By topic: identities, those whose life is whole (published once, consumed, one effect, no error), and those consumed again."""
    of = lambda kind: F.count_if(F.col("kind") == kind)
    lives = events.groupBy("topic", "identity").agg(of("published").alias("p"), of("consumed").alias("c"), of("effect").alias("e"), of("error").alias("x"))
    whole = (F.col("p") == 1) & (F.col("c") >= 1) & (F.col("e") == 1) & (F.col("x") == 0)
    return lives.groupBy("topic").agg(F.count("*").alias("identities"), F.count_if(whole).alias("whole"), F.count_if(F.col("c") > 1).alias("redelivered"))


def headroom_audit(samples: DataFrame, keys: list[str], share: float = 0.75, least: int = 30) -> DataFrame:
    """By ``keys`` of (used, limit): samples, the peak, and whether there are enough, one limit, and a peak under its share."""
    out = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.max("used").alias("peak"), F.min("limit").alias("low"), F.max("limit").alias("high"))
    return out.select(*keys, "n", "peak", ((F.col("n") >= least) & (F.col("low") == F.col("high")) & (F.col("peak") <= F.floor(F.col("high") * share))).alias("ok"))


def change_gate(before: DataFrame, after: DataFrame, keys: list[str], limits: dict[str, float]) -> DataFrame:
    """By ``keys`` the change of each figure in per cent and its verdict: passed, failed, or not-scored where one is missing or zero."""
    both = before.join(after.select(*keys, *[F.col(c).alias(f"{c}_after") for c in limits]), keys, "left")
    for c, limit in limits.items():
        both = both.withColumn(f"{c}_change", F.try_divide(F.col(f"{c}_after") - F.col(c), F.col(c)) * 100)
        change = F.col(f"{c}_change")
        both = both.withColumn(f"{c}_verdict", F.when(change.isNull(), "not-scored").when(change > limit, "failed").otherwise("passed"))
    return both.select(*keys, *[f"{c}_{x}" for c in limits for x in ("change", "verdict")])


def rank_recovery(rows: DataFrame, key: str, truth: str, estimate: str) -> DataFrame:
    """Spearman correlation of two columns by ``key``, with the mean rank for ties."""
    def rank(c: str) -> Column:
        ties = F.count("*").over(Window.partitionBy(key, c))
        return F.rank().over(Window.partitionBy(key).orderBy(c)) + (ties - 1) / 2

    ranks = rows.filter(F.col(truth).isNotNull() & F.col(estimate).isNotNull()).select(key, rank(truth).alias("a"), rank(estimate).alias("b"))
    return ranks.groupBy(key).agg(F.count("*").alias("n"), F.corr("a", "b").alias("rho"))


def failed_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule; a rule that is null counts as broken. All rules are read in one pass."""
    sums = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules])
    return sums.select(F.explode(pairs).alias("x")).select("x.*").filter("n > 0")


def paired_responses(left: DataFrame, right: DataFrame, group: str, keys: list[str], body: str) -> DataFrame:
    """By ``group``: pairs of responses by (group, keys) that are exact, differ or miss a side, and keys that a side has twice."""
    side = lambda df, name: df.groupBy(group, *keys).agg(F.count("*").alias(f"n_{name}"), F.min(body).alias(name))
    both = side(left, "l").join(side(right, "r"), [group, *keys], "full_outer")
    paired = F.col("n_l").isNotNull() & F.col("n_r").isNotNull()
    same = F.col("l").eqNullSafe(F.col("r"))
    return both.groupBy(group).agg(
        F.count_if(paired & same).alias("exact"), F.count_if(paired & ~same).alias("mismatches"), F.count_if(~paired).alias("missing"),
        F.count_if((F.coalesce("n_l", F.lit(0)) > 1) | (F.coalesce("n_r", F.lit(0)) > 1)).alias("duplicates"),
    )


def drift(candidate: DataFrame, active: DataFrame, key: str, within: int) -> DataFrame:
    """One row: how many keys each table has, by how many they differ, keys of one table only, and whether both are within the bound."""
    sides = candidate.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(active.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    keys = sides.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    out = keys.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("candidates"), F.coalesce(F.sum("b"), F.lit(0)).alias("actives"), F.count_if((F.col("a") == 0) | (F.col("b") == 0)).alias("odd_keys"))
    out = out.withColumn("difference", F.abs(F.col("candidates") - F.col("actives")))
    return out.withColumn("ok", (F.col("difference") <= within) & (F.col("odd_keys") <= within))


def correlated_sources(events: DataFrame, label: str, source: str, identity: str, two: tuple[str, str]) -> DataFrame:
    """By label: identities, and whether there is exactly one, seen once by each of ``two`` sources and by no other."""
    of = lambda s: F.count_if(F.col(source) == s)
    ids = events.groupBy(label, identity).agg(of(two[0]).alias("a"), of(two[1]).alias("b"), F.count("*").alias("m"))
    good = (F.col("a") == 1) & (F.col("b") == 1) & (F.col("m") == 2)
    return ids.groupBy(label).agg(F.count("*").alias("identities"), F.sum("a").alias("first"), F.sum("b").alias("second"), F.sum(F.col("m") - F.col("a") - F.col("b")).alias("others"), ((F.count("*") == 1) & F.bool_and(good)).alias("ok"))


def typed_events(raw: DataFrame, column: str, kinds: list[str], allowed: list[str]) -> DataFrame:
    """``raw`` with ``kind`` and ``problem``: the kind from JSON, or else from a text kind=...; null problem for known kinds without further fields."""
    keys = F.json_object_keys(column)
    kind = F.coalesce(F.get_json_object(column, "$.kind"), F.nullif(F.regexp_extract(column, r"\bkind=([A-Za-z_-]+)", 1), F.lit("")))
    extra = F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0
    rows = raw.withColumn("kind", kind)
    return rows.withColumn("problem", F.when(F.col("kind").isNull(), "no event").when(~F.col("kind").isin(*kinds), "unknown kind").when(keys.isNotNull() & extra, "unknown field"))


def same_sources(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, reuse): whether the checkpoint of each source (name, n, digest) may be used again, as the stored digest is the same."""
    was = stored.select("name", F.struct("n", "digest").alias("was"))
    return now.join(was, "name", "left").select("name", F.coalesce(F.struct("n", "digest") == F.col("was"), F.lit(False)).alias("reuse"))
