"""Queries of views, imports, links and of what is written to files and read again, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from ..operators import combined as cb
from ..operators import difficulty as df
from ..operators import linking as ln
from ..operators import payload as pl
from ..operators import upkeep as up
from ..operators import views as vw
from ..operators.lineage import shared_folder, written
from ..sources import tables as tb
from . import registry as rg
from .registry import query, six
from .two_sources import COMBINED

_label = lambda level: f"CASE WHEN mode = 'Single' THEN 'S' ELSE 'D' END || {level}"
_normal = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


def labels(items: DataFrame, level: str = "level") -> DataFrame:
    return items.withColumn("label", F.concat(F.when(F.col("mode") == "Single", "S").otherwise("D"), F.col(level).cast("string")))


@query("f10_overall_view", "SELECT mode, item_id FROM items WHERE mode <> 'CoOp' AND level >= 16")
def _(s, d):
    return tb.items(s, d).filter(vw.visible("overall")).select("mode", "item_id")


@query("f14_difficulty_slice", "SELECT entity_id, item_id, rank_value FROM ranked WHERE mode = 'Single' AND level = 18")
def _(s, d):
    return vw.difficulty_slice(rg.ranked(s, d), "s18").select("entity_id", "item_id", F.col("rank_value").cast("long").alias("rank_value"))


@query("t3_view_order", """, vo AS (SELECT mode, entity_id, r.item_id, title, CASE WHEN rank_value > 10 THEN floor(value / 10) END AS gain, r.level % 3 AS edge, r.level AS estimate, CASE WHEN r.level % 2 = 0 THEN score END AS expected FROM ranked r JOIN items i USING (mode, item_id))
    SELECT mode, entity_id, item_id, row_number() OVER (PARTITION BY mode, entity_id ORDER BY gain DESC NULLS LAST, edge DESC, estimate, coalesce(expected, 0) DESC, title, item_id) AS place FROM vo""")
def _(s, d):
    rows = rg.ranked(s, d).join(tb.items(s, d).select("mode", "item_id", "title"), ["mode", "item_id"])
    rows = rows.withColumns({"gain": F.when(F.col("rank_value") > 10, F.floor(F.col("value") / 10)), "edge": F.col("level") % 3, "estimate": F.col("level"), "expected": F.when(F.col("level") % 2 == 0, F.col("score"))})
    return vw.view_order(rows, ["mode", "entity_id"]).select("mode", "entity_id", "item_id", F.col("place").cast("long").alias("place"))


@query("j14_cross_references", "SELECT 'a' || item_id AS source_item, 'c' || item_id AS target_item, level_archive AS source_level, level AS target_level FROM items WHERE level <> level_archive UNION ALL SELECT 'a0', 'c0', 1, 2")
def _(s, d):
    moved = tb.items(s, d).filter("level <> level_archive").withColumn("upstream", F.col("item_id"))
    side = lambda mark, level: moved.select(F.concat(F.lit(mark), "item_id").alias("item_id"), "upstream", F.col(level).alias("level"))
    stale = side("a", "level_archive").select(F.col("item_id").alias("source_item"), F.concat(F.lit("c"), "upstream").alias("target_item"), F.lit(0).alias("source_level"), F.lit(0).alias("target_level"))
    known = stale.union(s.createDataFrame([("a0", "c0", 1, 2)], stale.schema))
    return up.cross_references(side("a", "level_archive"), side("c", "level"), known)


def _moves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Announced moves: a row for each two items of neighbouring keys whose titles are alike but for blanks, one of them announced twice."""
    rows = tb.items(s, d).filter("mode <> 'CoOp'").withColumns({"old": F.concat(F.lit("was s"), "level_archive", F.lit(", d"), "level_archive"), "new": F.concat(F.lit("S"), "level", F.lit(" and D"), "level")})
    rows = rows.select(F.col("item_id").cast("long").alias("source_row"), F.concat(F.upper("title"), F.lit("!")).alias("title"), "old", "new")
    again = rows.filter("source_row % 50 = 0").withColumn("source_row", -F.col("source_row"))
    return ln.rerates(rows.union(again), labels(tb.items(s, d).filter("mode <> 'CoOp'"), "level_archive"))


MOVES = f""", ct AS (SELECT item_id, mode, level, level_archive, {_normal("title")} AS n, {_label("level_archive")} AS label FROM items WHERE mode <> 'CoOp'),
    an AS (SELECT CAST(item_id AS BIGINT) AS source_row, n, level, level_archive FROM ct UNION ALL SELECT -CAST(item_id AS BIGINT), n, level, level_archive FROM ct WHERE CAST(item_id AS BIGINT) % 50 = 0),
    ap AS (SELECT source_row, n, l || level_archive AS label, l || level AS new, level - level_archive AS delta FROM an, (VALUES ('S'), ('D')) x(l) WHERE level <> level_archive AND level_archive >= 16),
    one AS (SELECT n, label, min(item_id) AS item_id FROM ct GROUP BY ALL HAVING count(*) = 1),
    mt AS (SELECT ap.*, item_id, count(*) OVER (PARTITION BY item_id) AS m FROM ap JOIN one USING (n, label))"""


@query("m26_rerates", MOVES + " SELECT item_id, source_row, label AS from_label, new AS to_label, delta, CASE WHEN delta > 0 THEN 'uprated' ELSE 'downrated' END AS direction FROM mt WHERE m = 1")
def _(s, d):
    return _moves(s, d)[0]


@query("m26_rerate_problems", MOVES + " SELECT source_row, label AS from_label, 'twice' AS problem FROM mt WHERE m > 1 UNION ALL SELECT source_row, label, 'unmatched' FROM ap WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.n = ap.n AND one.label = ap.label)")
def _(s, d):
    return _moves(s, d)[1].select("source_row", "from_label", "problem")


@query("m25_linked_items", f""", ct AS (SELECT item_id, author AS label, {_normal("title")} AS name FROM items),
    tx AS (SELECT 't' || item_id AS text_id, label, ' see ' || name || ' here ' AS text, CAST(item_id AS BIGINT) % 2 AS rank FROM ct WHERE CAST(item_id AS BIGINT) % 3 > 0),
    cd AS (SELECT item_id, text_id, rank FROM ct JOIN tx ON ct.label = tx.label AND contains(text, ' ' || name || ' ')),
    bs AS (SELECT item_id, count(DISTINCT text_id) AS n, min(text_id) AS text_id FROM cd JOIN (SELECT item_id, min(rank) AS rank FROM cd GROUP BY item_id) USING (item_id, rank) GROUP BY item_id)
    SELECT item_id, CASE WHEN CAST(item_id AS BIGINT) % 100 = 1 THEN 'override' WHEN bs.n IS NULL THEN 'missing' WHEN bs.n > 1 THEN 'ambiguous' ELSE 'mapped' END AS status,
      CASE WHEN CAST(item_id AS BIGINT) % 100 = 1 THEN 't1' WHEN bs.n = 1 THEN text_id END AS text_id FROM ct LEFT JOIN bs USING (item_id)""")
def _(s, d):
    catalog = tb.items(s, d).select("item_id", F.col("author").alias("label"), ln.normal_title(F.col("title")).alias("name"))
    key = F.col("item_id").cast("long")
    texts = catalog.filter(key % 3 > 0).select(F.concat(F.lit("t"), "item_id").alias("text_id"), "label", F.concat(F.lit("see "), "name", F.lit(" here")).alias("normal"), (key % 2).alias("rank"))
    return ln.linked_items(catalog, texts, catalog.filter(key % 100 == 1).select("item_id", F.lit("t1").alias("text_id")))


@query("i6_two_states", raw="""SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, CASE WHEN s_suppkey % 3 > 0 AND s_nationkey % 4 > 0 AND (s_suppkey % 7 = 0 OR s_nationkey >= 10) THEN 'live' ELSE 'base' END AS origin FROM supplier""")
def _(s, d):
    rows = s.read.parquet(f"{d}/supplier.parquet").withColumn("entity_id", F.col("s_suppkey").cast("string"))
    at = lambda c: F.timestamp_seconds(c.cast("long"))
    base = rows.select("entity_id", F.when(F.col("s_suppkey") % 7 != 0, at(F.lit(10))).alias("synced"), F.lit("base").alias("origin"))
    live = rows.filter("s_suppkey % 3 > 0").select("entity_id", F.when(F.col("s_nationkey") % 4 > 0, at(F.col("s_nationkey"))).alias("synced"), F.lit("live").alias("origin"))
    return up.merged_states(base, live).select("entity_id", "origin")


@query("i3_due", """, st AS (SELECT entity_id, count(*) FILTER (level >= 24) AS n, max(recorded_ts) AS last_ts, (SELECT max(recorded_ts) FROM attempts) AS now, CAST(entity_id AS BIGINT) % 5 AS k FROM attempts GROUP BY entity_id)
    SELECT entity_id, CASE WHEN k = 0 THEN 'full' WHEN n > 20 THEN 'incremental' WHEN k < 3 THEN 'skip' ELSE 'full' END AS action, CASE WHEN k > 0 AND n > 20 THEN last_ts - INTERVAL 7 DAY END AS since FROM st""")
def _(s, d):
    rows = tb.attempts(s, d)
    now = F.broadcast(rows.agg(F.max("recorded_ts").alias("now")))  # one row
    state = rows.groupBy("entity_id").agg(F.count_if(F.col("level") >= 24).alias("m"), F.max("recorded_ts").alias("last_ts")).join(now, how="cross")
    key = F.col("entity_id").cast("long") % 5
    checked = F.when(key == 0, F.lit(None)).when(key < 3, F.col("now") - F.expr("interval 2 hours")).otherwise(F.col("now") - F.expr("interval 3 days"))
    return up.due(state.withColumns({"n": F.when(F.col("m") > 20, F.col("m")).otherwise(0), "checked_ts": checked})).select("entity_id", "action", "since")


@query("m17_archive_ratings", COMBINED + " SELECT mode, entity_id, item_id, round(value + 1e-9, 6) AS value, r AS rank_value FROM rr WHERE source = 'archive'")
def _(s, d):
    rows = cb.rating_rows(cb.normalised(df.best(df.valid(tb.attempts(s, d)), cb.OWN), tb.items(s, d)))
    return rows.filter(cb.is_archive()).select("mode", "entity_id", "item_id", *six("value"), F.col("rank_value").cast("long").alias("rank_value"))


@query("a3_appearance", "SELECT mode, item_id, CASE WHEN scored > 0 THEN round(contributors::DOUBLE / scored + 1e-9, 6) END AS appearance FROM catalog")
def _(s, d):
    return df.appearance(df.selected(rg.ranked(s, d)), tb.items(s, d)).select("mode", "item_id", *six("appearance"))


_snapshot = "entity_id, item_id, value, score, medal, recorded_at, is_broken, source"


@query("s1_snapshot", f"SELECT {_snapshot}, i.title, i.level FROM (SELECT {_snapshot} FROM attempts) JOIN items i USING (item_id)")
def _(s, d):
    """Snapshot files written from the tables and scanned again."""
    at, own = folder(s, "snapshot"), _snapshot.split(", ")
    tb.attempts(s, d).select(*own).write.option("compression", "gzip").json(f"{at}/attempts.jsonl.gz")
    # one array, as large as the catalog
    tb.items(s, d).agg(F.to_json(F.collect_list(F.struct("item_id", "title", "mode", "level", "author"))).alias("value")).write.text(f"{at}/items.json")
    attempts, items = tb.snapshot(s, at)
    return attempts.select(*own).join(items.select("item_id", "title", "level"), "item_id")


@query("s13_csv_tree", f"SELECT mode, {rg._folder} AS folder, item_id, printf('%.6f', notes_current::DOUBLE / notes_archive) AS ratio FROM items WHERE mode <> 'CoOp' AND level >= 16")
def _(s, d):
    rows = tb.items(s, d).withColumn("folder", fx.folder(F.col("mode"), F.col("level"))).filter("folder is not null").withColumn("ratio", F.col("notes_current").cast("double") / F.col("notes_archive"))
    pl.write_tree(rows, at := folder(s, "tree"), ["item_id", "ratio"])
    return s.read.schema("item_id string, ratio string, mode string, folder string").option("header", True).csv(at).select("mode", "folder", "item_id", "ratio")


@query("s14_nested_payload", "SELECT mode, item_id, row_number() OVER (PARTITION BY mode ORDER BY estimate NULLS LAST, title, item_id) AS place, round(estimate + 1e-9, 5) AS estimate FROM final")
def _(s, d):
    placed = df.analysis(tb.attempts(s, d), tb.items(s, d), resamples=None)
    pl.nested(placed, ["item_id", "estimate"]).write.json(at := folder(s, "payload"))
    back = s.read.schema("mode string, items array<struct<place: long, item_id: string, estimate: double>>").json(at)
    return back.select("mode", F.inline("items")).select("mode", "item_id", "place", F.round(F.col("estimate") + 1e-9, 5).alias("estimate"))


@query("s15_bounded_shards", "SELECT count(*) AS n, true AS bounded, count(DISTINCT entity_id) AS entities FROM ranked")
def _(s, d):
    rows = written(rg.ranked(s, d).select("mode", "entity_id", "item_id", "value"))
    manifest = pl.write_shards(rows, at := folder(s, "shards"), ["mode", "entity_id", "item_id", "value"])
    shards = manifest.agg(F.sum("n").alias("n"), (F.max("n") <= 5000).alias("bounded"))
    return shards.join(s.read.schema(rows.schema).parquet(at).agg(F.count_distinct("entity_id").alias("entities")), how="cross")  # one row each


@query("s17_lists", "SELECT mode, entity_id, item_id, value FROM ranked WHERE rank_value <= 50")
def _(s, d):
    """The best of each entity as one list a row, written and unpacked again."""
    rows = rg.ranked(s, d).filter(F.col("rank_value") <= P.TOP)
    return pl.unpacked(written(pl.packed(rows, "entity_id", ["mode", "item_id", "value"], "rank_value")), "entity_id").select("mode", "entity_id", "item_id", "value")


@query("i18_generations", "SELECT 'best' AS name, count(*) AS n FROM best UNION ALL SELECT 'items', count(*) FROM items")
def _(s, d):
    """Two generations of tables, the second with a count that fails; what readers get is the first."""
    at, tables = folder(s, "generations"), {"items": tb.items(s, d), "best": df.best(rg.valid(s, d))}
    up.publish(tables, at, "1")
    try:
        up.publish({"items": tables["items"].filter("level > 20")}, at, "2", {"items": -1})
    except ValueError:
        pass
    found = up.current_generation(s, at)
    read = lambda name: s.read.schema(tables[name].schema).parquet(f"{at}/generation={found}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return read("items").union(read("best"))
