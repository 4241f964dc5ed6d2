"""Queries of audits, upkeep and titles, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from ..operators import audits as au
from ..operators import linking as ln
from ..operators import payload as pl
from ..sources import tables as tb
from . import registry as rg
from .registry import query, r6, six, valid


@query("i5_resume", "SELECT seq, source FROM attempts WHERE source = 'current' OR entity_id NOT IN (SELECT entity_id FROM attempts WHERE source = 'current')")
def _(s, d):
    rows = tb.attempts(s, d)
    return au.resume(rows.filter("source = 'archive'"), rows.filter("source = 'current'"), "entity_id").select("seq", "source")


@query("i8_soft_upsert", "SELECT item_id, CASE WHEN level > 13 THEN author || '+' ELSE author END AS author, level > 13 AS active FROM items")
def _(s, d):
    rows = tb.items(s, d)
    return au.soft_upsert(rows.filter("mode <> 'CoOp' or level <= 13"), rows.filter("level > 13").withColumn("author", F.concat("author", F.lit("+"))), "item_id", ["author"])


@query("i11_explained_diff", """, l AS (SELECT item_id AS path, level AS value FROM items), r AS (SELECT item_id AS path, CASE WHEN level = 20 THEN 0 ELSE level END AS value FROM items), x AS (SELECT item_id AS path FROM items WHERE level IN (19, 20) AND mode = 'Single')
    SELECT CASE WHEN l.value IS NOT DISTINCT FROM r.value THEN CASE WHEN x.path IS NULL THEN 'exact' ELSE 'unused' END WHEN x.path IS NULL THEN 'unexplained' ELSE 'explained' END AS verdict, count(*) AS n FROM l FULL JOIN r USING (path) LEFT JOIN x USING (path) GROUP BY 1""")
def _(s, d):
    rows = tb.items(s, d)
    right = rows.select(F.col("item_id").alias("path"), F.when(F.col("level") == 20, 0).otherwise(F.col("level")).alias("value"))
    return au.explained_diff(rows.select(F.col("item_id").alias("path"), F.col("level").alias("value")), right, rows.filter("level in (19, 20) and mode = 'Single'").select(F.col("item_id").alias("path")))


@query("i13_numeric_diff", """, l AS (SELECT entity_id, item_id, avg(value) AS v FROM attempts WHERE source = 'archive' GROUP BY ALL), r AS (SELECT entity_id, item_id, avg(value) AS v FROM attempts WHERE source = 'current' GROUP BY ALL)
    SELECT count(*) FILTER (l.v IS NULL OR r.v IS NULL) AS missing, count(*) FILTER (abs(l.v - r.v) > 1.005) AS changed, round(max(abs(l.v - r.v)) + 1e-9, 6) AS most FROM l FULL JOIN r USING (entity_id, item_id)""")  # fmt: skip
def _(s, d):
    means = tb.attempts(s, d).groupBy("source", "entity_id", "item_id").agg(F.avg("value").alias("v"))
    out = au.numeric_diff(means.filter("source = 'archive'"), means.filter("source = 'current'"), ["entity_id", "item_id"], "v", 1.005)
    return out.select("missing", "changed", *six("most"))


@query("i19_retention", raw="""SELECT event_type AS family, event_id AS generation, event_id % 1000 = 0 OR row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 2 OR ts > (SELECT max(ts) FROM events) - INTERVAL 48 HOUR AS keep FROM events""")
def _(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    last = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    rows = events.select(F.col("event_type").alias("family"), F.col("event_id").alias("generation"), F.col("ts").alias("created"), (F.col("event_id") % 1000 == 0).alias("is_current"))
    return au.retention(rows.join(last, how="cross"), F.col("now")).select("family", "generation", "keep")


@query("i21_lifecycle", raw="""SELECT topic, count(*) AS identities, count(*) FILTER (p = 1 AND c >= 1 AND e = 1) AS whole, count(*) FILTER (c > 1) AS redelivered FROM (SELECT o_orderpriority AS topic, l_orderkey, count(*) FILTER (l_linenumber = 1) AS p,
    count(*) FILTER (l_linenumber <> 1 AND l_linestatus = 'F') AS c, count(*) FILTER (l_linenumber <> 1 AND l_linestatus <> 'F') AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY topic""")
def _(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet").join(s.read.parquet(f"{d}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_linenumber") == 1, "published").when(F.col("l_linestatus") == "F", "consumed").otherwise("effect")
    return au.lifecycle_audit(lines.select(F.col("o_orderpriority").alias("topic"), F.col("l_orderkey").alias("identity"), kind.alias("kind")))


@query("i22_expected_counts", raw="SELECT event_type, user_id, count(*) AS seen, 2 AS want, count(*) = 2 AS ok FROM events GROUP BY event_type, user_id")
def _(s, d):
    events = s.read.parquet(f"{d}/events.parquet")
    want = events.select("event_type", "user_id").distinct().withColumn("want", F.lit(2))
    return au.outcome_audit(events, want, ["event_type", "user_id"])


@query("i23_headroom", raw="SELECT l_suppkey, count(*) AS n, max(l_quantity) AS peak, count(*) >= 30 AND max(l_quantity) <= floor(50 * 0.99::DOUBLE) AS ok FROM lineitem GROUP BY l_suppkey")
def _(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.col("l_quantity").alias("used"), F.lit(50).alias("limit"))
    return au.headroom_audit(rows, ["l_suppkey"], 0.99)


@query("i25_field_diff", "SELECT 'author' AS field, count(*) FILTER (CASE WHEN level > 20 THEN author || '*' ELSE author END <> author) AS n FROM items UNION ALL SELECT 'level', count(*) FILTER (level <> level_archive) FROM items UNION ALL SELECT 'notes', count(*) FILTER (notes_archive <> notes_current) FROM items")
def _(s, d):
    rows = tb.items(s, d)
    old = rows.select("item_id", F.when(F.col("level") > 20, F.concat("author", F.lit("*"))).otherwise(F.col("author")).alias("author"), F.col("level_archive").alias("level"), F.col("notes_archive").alias("notes"))
    return au.field_diff(old, rows.select("item_id", "author", "level", F.col("notes_current").alias("notes")), ["item_id"], ["author", "level", "notes"])


@query("a32_change_gate", raw="""SELECT o_orderpriority, round((c - a) / a * 100 + 1e-9, 6) AS mean_change, CASE WHEN (c - a) / a * 100 > 1 THEN 'failed' ELSE 'passed' END AS mean_verdict FROM (SELECT o_orderpriority,
    avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS c FROM orders GROUP BY ALL)""")
def _(s, d):
    means = s.read.parquet(f"{d}/orders.parquet").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("mean"))
    side = lambda x: means.filter(F.col("o_orderstatus") == x).drop("o_orderstatus")
    return au.change_gate(side("F"), side("O"), ["o_orderpriority"], {"mean": 1.0}).select("o_orderpriority", *six("mean_change"), "mean_verdict")


@query("a33_rank_recovery", """, rr AS (SELECT entity_id, rank() OVER (PARTITION BY entity_id ORDER BY level) + (count(*) OVER (PARTITION BY entity_id, level) - 1) / 2 AS a, rank() OVER (PARTITION BY entity_id ORDER BY value) + (count(*) OVER (PARTITION BY entity_id, value) - 1) / 2 AS b FROM valid)
    SELECT entity_id, count(*) AS n, round(corr(a, b) + 1e-9, 6) AS rho FROM rr GROUP BY entity_id""")  # fmt: skip
def _(s, d):
    return au.rank_recovery(valid(s, d), "entity_id", "level", "value").select("entity_id", "n", *six("rho"))


@query("a29_summary", f"""SELECT mode, folder, count(*) AS catalog, count(location) AS measured, count(*) FILTER (contributors >= 10) AS published, median(contributors) FILTER (contributors > 0) AS median_contributors FROM catalog GROUP BY GROUPING SETS ((mode), (mode, folder))""")
def _(s, d):
    from ..operators import difficulty as df

    stats = df.item_stats(df.selected(rg.ranked(s, d)))
    rows = tb.items(s, d).filter(F.col("mode").isin(*P.MODES) & (F.col("level") >= P.MIN_LEVEL)).withColumn("folder", fx.folder(F.col("mode"), F.col("level")))
    rows = rows.join(stats, ["mode", "item_id"], "left").fillna(0, ["contributors"])
    seen = F.when(F.col("contributors") > 0, F.col("contributors"))
    sets = rows.groupingSets([[F.col("mode")], [F.col("mode"), F.col("folder")]], F.col("mode"), F.col("folder"))
    return sets.agg(F.count("*").alias("catalog"), F.count("location").alias("measured"), F.count_if(F.col("contributors") >= P.PUBLISHED).alias("published"), F.percentile(seen, F.lit(0.5)).alias("median_contributors"))


@query("s19_result_rules", "SELECT 'level' AS rule, count(*) FILTER (NOT (level > 2)) AS n FROM items HAVING count(*) FILTER (NOT (level > 2)) > 0 UNION ALL SELECT 'mode', count(*) FILTER (mode = 'CoOp') FROM items HAVING count(*) FILTER (mode = 'CoOp') > 0")
def _(s, d):
    return au.failed_rules(tb.items(s, d), {"level": F.col("level") > 2, "mode": F.col("mode").isin(*P.MODES), "id": F.col("item_id") != ""})


@query("s16_entity_shards", "SELECT entity_id, (row_number() OVER (PARTITION BY f ORDER BY username, entity_id) - 1) // 10 AS shard, f FROM (SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, lower(s_name) AS username, " + rg._fold("CAST(s_suppkey AS VARCHAR)") + " AS f FROM supplier)")
def _(s, d):
    rows = tb.entities(s, d).select("entity_id", F.lower("username").alias("name"), fx.fold(F.col("entity_id")).alias("f"))
    return pl.model_shards(rows, ["f"], [F.col("name").asc(), F.col("entity_id").asc()], 10).select("entity_id", "shard", "f")


@query("c32_titles", raw="SELECT p_partkey, trim(regexp_replace(lower(replace(p_name, '&', ' and ')), '[^a-z0-9]+', ' ', 'g')) AS normal, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS compact FROM part")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", ln.normal_title(F.col("p_name")).alias("normal"), ln.compact_title(F.col("p_name")).alias("compact"))


@query("j10_title_links", """, c AS (SELECT item_id, author AS label, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS name FROM items), t AS (SELECT item_id AS text_id, label, 'play ' || name || ' now' AS text FROM c)
    SELECT text_id, label, item_id FROM (SELECT text_id, t.label, c.item_id, row_number() OVER (PARTITION BY text_id, t.label ORDER BY length(name) DESC, c.item_id) AS r FROM t JOIN c ON t.label = c.label AND contains(' ' || text || ' ', ' ' || name || ' ')) WHERE r = 1""")
def _(s, d):
    catalog = tb.items(s, d).select("item_id", F.col("author").alias("label"), ln.normal_title(F.col("title")).alias("normal"))
    texts = catalog.select(F.col("item_id").alias("text_id"), "label", F.concat(F.lit("play "), "normal", F.lit(" now")).alias("normal"))
    return ln.title_links(texts, catalog)


@query("j11_unique_matches", "SELECT i.item_id AS asked, m.item_id FROM items i JOIN (SELECT author, level, mode, min(item_id) AS item_id FROM items GROUP BY ALL HAVING count(*) = 1) m USING (author, level, mode)")
def _(s, d):
    rows = tb.items(s, d)
    return ln.unique_matches(rows.select(F.col("item_id").alias("asked"), "author", "level", "mode"), rows, ["author", "level", "mode"])[0].select("asked", "item_id")
