"""Upkeep of tables: upserts, history, digests, reconciliation, checks and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .difficulty import first_by
from .lineage import written


def sync_order() -> list[Column]:
    """Order in which attempts at one item win: by value (0 counts as none), score, time as text, completeness and arrival."""
    real = lambda c: F.when(F.col(c) != 0, F.col(c)).desc_nulls_last()
    full = F.col("medal").isNotNull().cast("int")
    return [real("value"), real("score"), F.col("recorded_at").desc_nulls_last(), full.desc(), F.col("seq")]


def upsert(state: DataFrame, incoming: DataFrame) -> DataFrame:
    """The winner of each (entity, item) of both tables; in whatever order and how often rows arrive, it is the same."""
    return first_by(state.unionByName(incoming), ["entity_id", "item_id"], sync_order())


def due(entities: DataFrame, days: int = 7, hours: int = 24) -> DataFrame:
    """What to fetch for rows (entity_id, n, last_ts, checked_ts, now): all, all since ``days`` before the last, or nothing for now."""
    action = F.when(F.col("checked_ts").isNull(), "full").when(F.col("n") > 0, "incremental")
    action = action.when(F.col("checked_ts") > F.col("now") - F.expr(f"interval {hours} hours"), "skip").otherwise("full")
    return entities.withColumn("action", action).withColumn("since", F.when(F.col("action") == "incremental", F.col("last_ts") - F.expr(f"interval {days} days")))


def merged_states(base: DataFrame, live: DataFrame) -> DataFrame:
    """A row for each entity of ``base`` (entity_id, synced, ...): that of the state synced later; the live one at the same time, the base one if only it has a time or none has."""
    rows = base.withColumn("side", F.lit(0)).unionByName(live.join(base.select("entity_id"), "entity_id", "left_semi").filter("synced is not null").withColumn("side", F.lit(1)))
    return first_by(rows, ["entity_id"], [F.col("synced").desc_nulls_last(), F.col("side").desc()]).drop("side")


def cross_references(source: DataFrame, target: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source_item, target_item, source_level, target_level): items (item_id, upstream, level) of two catalogs with the same upstream id, whose levels replace those of ``known`` pairs."""
    left = source.select(F.col("item_id").alias("source_item"), "upstream", F.col("level").alias("source_level"))
    found = left.join(target.select(F.col("item_id").alias("target_item"), "upstream", F.col("level").alias("target_level")), "upstream").drop("upstream")
    found = found.select("source_item", "target_item", "source_level", "target_level")
    keys = ["source_item", "target_item"]
    return found if known is None else found.unionByName(known.join(found, keys, "left_anti").select(*found.columns))


def overlapping(attempts: DataFrame, days: int = 7) -> DataFrame:
    """Attempts from ``days`` before the last of their entity on, which an incremental run reads again."""
    last = attempts.groupBy("entity_id").agg(F.max("recorded_ts").alias("last"))
    return attempts.join(last, "entity_id").filter(F.col("recorded_ts") >= F.col("last") - F.expr(f"interval {days} days")).drop("last")


def keep_known(attempts: DataFrame, entities: DataFrame, items: DataFrame) -> DataFrame:
    """Attempts whose entity still consents and whose item is still in the catalog."""
    return attempts.join(entities.select("entity_id"), "entity_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi")


def precedence(current: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows, and those archive rows whose key no current row has."""
    return current.unionByName(archive.join(current.select(*keys), keys, "left_anti"))


def row_hash(*columns: str) -> Column:
    """Digest of a row that doesn't depend on the order in which columns are named; numbers go as doubles."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in sorted(columns)]).cast("binary"), 256)


#: Rows that a leaf of a table's tree is meant to have, at most.
LEAF = 1000


def tree_depth(rows: int, leaf: int = LEAF) -> int:
    """Hex digits that part ``rows`` hashes into leaves of about ``leaf`` or fewer."""
    depth = 0
    while leaf * 16**depth < rows:
        depth += 1
    return depth


def _leaves(hashes: DataFrame, depth: int) -> DataFrame:
    """(prefix, n, digest): by the first digits of ``h`` the digest of the hashes and how often each is there. Hashes are spread evenly, and equal ones are counted first, so the lists stay near LEAF."""
    once = hashes.groupBy("h").agg(F.count("*").alias("m"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("h", "m"))), lambda x: F.concat_ws(":", x["h"], x["m"]))
    return once.groupBy(F.substring("h", 1, depth).alias("prefix")).agg(F.sum("m").alias("n"), F.sha2(F.array_join(cells, ",").cast("binary"), 256).alias("digest"))


def _parents(nodes: DataFrame) -> DataFrame:
    """The nodes above: each the digest of its children, of which there are sixteen at most."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat_ws(":", x["prefix"].substr(F.length(x["prefix"]), F.lit(1)), x["digest"]))
    above = F.col("prefix").substr(F.lit(1), F.length("prefix") - 1)
    return nodes.groupBy(above.alias("above")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(cells, ",").cast("binary"), 256).alias("digest")).withColumnRenamed("above", "prefix")


def table_tree(hashes: DataFrame, depth: int) -> list[DataFrame]:
    """Nodes (prefix, n, digest) by depth, from the root to the leaves, of a table of hashes (h); each level is written, as the next one and comparisons read it.

    A node's digest follows from its children's, so trees of the same depth agree in a node just where they hold the same hashes, as often, under its prefix.
    """
    levels = [written(_leaves(hashes, depth))]
    for _ in range(depth):
        levels.append(written(_parents(levels[-1])))
    return levels[::-1]


def table_digest(df: DataFrame, *columns: str, leaf: int = LEAF) -> DataFrame:
    """One row (n, digest) that doesn't depend on the order of rows: the root of the tree over the rows' hashes, whose depth follows from their number."""
    hashes = df.select(row_hash(*columns).alias("h"))
    depth = tree_depth(df.count(), leaf)
    nodes = _leaves(hashes, depth)
    for _ in range(depth):
        nodes = _parents(nodes)
    return nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("digest"), F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))


def differing(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(prefix) of the leaves in which two trees of the same depth differ: from the root on, only the children of nodes that differ are compared."""
    asked = None
    for a, b in zip(left, right, strict=True):
        if asked is not None:
            under = F.col("prefix").substr(F.lit(1), F.length("prefix") - 1)
            a, b = (x.withColumn("above", under).join(asked, "above", "left_semi").drop("above") for x in (a, b))
        both = a.join(b.select("prefix", F.col("n").alias("other_n"), F.col("digest").alias("other")), "prefix", "full_outer")
        found = written(both.filter(~F.col("digest").eqNullSafe(F.col("other"))).select("prefix"))
        asked = found.withColumnRenamed("prefix", "above")
    return found


def revisions(history: DataFrame, now: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """History (keys, row_hash, revision, valid_from, valid_to) after ``now`` (keys, row_hash): changed or vanished rows close, new ones open."""
    open_rows = history.filter("valid_to is null")
    new = now.select(*keys, F.col("row_hash").alias("new_hash"))
    both = open_rows.join(new, keys, "full_outer")
    same = F.col("row_hash").eqNullSafe(F.col("new_hash"))
    kept = both.filter(F.col("row_hash").isNotNull()).select(*keys, "row_hash", "revision", "valid_from", F.when(~same, at).alias("valid_to"))
    opened = both.filter(F.col("new_hash").isNotNull() & ~same).select(
        *keys, F.col("new_hash").alias("row_hash"), (F.coalesce("revision", F.lit(0)) + 1).alias("revision"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to")
    )
    return history.filter("valid_to is not null").select(*kept.columns).unionByName(kept).unionByName(opened)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], hash_name: str = "row_hash", ledger: DataFrame | None = None, leaf: int = LEAF) -> DataFrame:
    """Rows by verdict: exact, explained (its key is in the ledger), changed, missing on the right, or extra.

    Keys and hashes of both tables go into trees by the hashes of the keys, so that both rows of a key are in one leaf. Leaves that agree hold exact rows alone and are only counted; the rows of the others are joined.
    """
    named = lambda t, name: t.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]).cast("binary"), 256).alias("k"), *keys, F.col(hash_name).alias(name))
    l, r = named(left, "l"), named(right, "r")
    depth = tree_depth(max(left.count(), right.count()), leaf)
    hashed = lambda t, name: t.select(F.concat("k", F.lit("="), F.coalesce(F.col(name).cast("string"), F.lit("null"))).alias("h"))
    trees = [table_tree(hashed(l, "l"), depth), table_tree(hashed(r, "r"), depth)]
    apart = differing(*trees)
    same = trees[0][-1].join(apart, "prefix", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("exact").alias("verdict"), "n")
    l, r = (t.withColumn("prefix", F.substring("k", 1, depth)).join(apart, "prefix", "left_semi").drop("k", "prefix") for t in (l, r))
    both = l.join(r, keys, "full_outer")
    if ledger is not None:
        both = both.join(ledger.select(*keys, F.lit(True).alias("known")), keys, "left")
    else:
        both = both.withColumn("known", F.lit(None).cast("boolean"))
    verdict = F.when(F.col("l").eqNullSafe(F.col("r")), "exact").when(F.col("known"), "explained").when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("changed")
    rows = both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
    return same.union(rows).groupBy("verdict").agg(F.sum("n").alias("n")).filter("n > 0")


def violations(attempts: DataFrame, items: DataFrame) -> DataFrame:
    """(rule, n): keys that break a rule of integrity, by rule; rules that nothing breaks are left out."""
    rule = lambda df, name: df.select(F.lit(name).alias("rule"))
    twice = lambda df, *keys: df.groupBy(*keys).count().filter("count > 1")
    found = rule(twice(items, "item_id"), "item twice").union(rule(twice(attempts, "entity_id", "item_id"), "attempt twice"))
    found = found.union(rule(attempts.join(items, "item_id", "left_anti"), "attempt without item"))
    found = found.union(rule(attempts.filter("is_broken"), "broken attempt")).union(rule(attempts.filter("value is null or isnan(value)"), "value not finite"))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


def duplicate_events(events: DataFrame) -> DataFrame:
    """By event id: how often it came, and whether with different bodies."""
    return events.groupBy("event_id").agg(F.count("*").alias("n"), (F.count_distinct("body") > 1).alias("conflict"))


def minute_requests(events: DataFrame) -> DataFrame:
    """Requests of a user that no other within 60 seconds before makes unnecessary, by minute."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.withColumn("before", before).filter(F.col("before").isNull() | (F.col("ts") >= F.col("before") + F.expr("interval 60 seconds")))
    return rows.select("user_id", "event_id", F.date_trunc("minute", "ts").alias("minute"))


def latency_summary(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank p50, p95, p99 (from 100 samples on) and the largest of ``value`` by ``keys``."""
    by = Window.partitionBy(*keys)
    rows = samples.filter(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(by.orderBy(value)).alias("r"), F.count("*").over(by).alias("n"))
    at = lambda p: F.max(F.when(F.col("r") == F.ceil(F.col("n") * p), F.col(value)))
    return rows.groupBy(*keys).agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.when(F.max("n") >= 100, at(0.99)).alias("p99"), F.max(value).alias("most"))


def semantic_digest(df: DataFrame, *volatile: str) -> DataFrame:
    """The digest of a table without its volatile columns, as times of generation are."""
    return table_digest(df, *[c for c in df.columns if c not in volatile])


def publish(tables: dict[str, DataFrame], folder: str, generation: str, expected: dict[str, int] | None = None) -> DataFrame:
    """Write tables under a new generation, check their row counts, and append the pointer last; a failed check leaves the old generation in use.

    Returns the counts (name, n). Readers take the generation of the newest pointer.
    """
    session = next(iter(tables.values())).sparkSession
    counts = {}
    for name, df in tables.items():
        path = f"{folder}/generation={generation}/{name}"
        df.write.parquet(path)
        counts[name] = session.read.schema(df.schema).parquet(path).count()
    if wrong := {n: (counts[n], want) for n, want in (expected or {}).items() if counts.get(n) != want}:
        raise ValueError(f"row counts differ: {wrong}")
    session.createDataFrame([(generation,)], "generation string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{folder}/pointer")
    return session.createDataFrame(sorted(counts.items()), "name string, n long")


def current_generation(session, folder: str) -> str:
    return session.read.schema("generation string, at timestamp").parquet(f"{folder}/pointer").agg(F.max_by("generation", F.struct("at", "generation"))).first()[0]


def freshness(rows: DataFrame, generation: str, current: Column, synced: str, now: Column, seconds: int = 60) -> DataFrame:
    """``fresh``: of the current generation and synced within ``seconds``; nulls aren't fresh."""
    young = F.col(synced) >= now - F.expr(f"interval {seconds} seconds")
    return rows.withColumn("fresh", F.coalesce((F.col(generation) == current) & young, F.lit(False)))


def alias(name: Column, names: dict[str, str]) -> Column:
    """The source that a name in any case, with blanks around, stands for; null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(F.trim(name)))
