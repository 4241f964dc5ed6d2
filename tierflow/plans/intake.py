"""Queries of intake checks and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from ..operators import audits as au
from ..operators import difficulty as df
from ..operators import group_mode as gm
from ..operators import intake as it
from ..operators import linking as ln
from ..operators import upkeep as up
from ..operators import views as vw
from ..operators import weighted as wt
from ..sources import tables as tb
from . import registry as rg
from .registry import query, six, valid


@query("s3_schema_gate", raw="SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS urgency, TRY_CAST(o_orderstatus AS DOUBLE) AS state, false AS is_broken FROM orders")
def _(s, d):
    rows = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("urgency"), F.col("o_orderstatus").alias("state"))
    rows = tb.with_defaults(tb.require_columns(rows, "o_orderkey", "urgency"), is_broken=F.lit(False), state=F.lit("0"))
    return rows.withColumns({"urgency": tb.number(F.col("urgency")), "state": tb.number(F.col("state"))})


@query("s4_clean_items", raw="""SELECT item_id, CASE WHEN a > b THEN b ELSE a END AS bpm_min, CASE WHEN a > b THEN a ELSE b END AS bpm_max FROM (SELECT CASE WHEN p_size = 1 THEN ' ' ELSE CAST(p_partkey AS VARCHAR) END AS item_id,
    CASE WHEN p_size > 10 THEN (p_size - 10)::DOUBLE END AS a, CASE WHEN p_size % 5 > 0 THEN 20.0::DOUBLE END AS b FROM part) WHERE trim(item_id) <> ''""")
def _(s, d):
    size = F.col("p_size")
    rows = s.read.parquet(f"{d}/part.parquet").select(F.when(size == 1, " ").otherwise(F.col("p_partkey").cast("string")).alias("item_id"), (size - 10).cast("string").alias("bpm_min"), F.when(size % 5 > 0, "20").otherwise("fast").alias("bpm_max"), "p_name")
    return it.clean_items(rows, ["item_id", "bpm_min", "bpm_max"])


@query("s5_clean_attempts", "SELECT seq, CASE WHEN medal LIKE 'M%' THEN NULL ELSE medal END AS medal, value FROM attempts WHERE NOT is_broken AND value < 200 AND entity_id <> '1'")
def _(s, d):
    rows = tb.attempts(s, d).withColumns({
        "medal": F.when(F.col("medal").startswith("M"), "  ").otherwise(F.concat(F.lit(" "), "medal")), "grade": F.lit(" S "), "value": F.when(F.col("value") < 200, F.col("value")).otherwise(float("inf")),
        "entity_id": F.when(F.col("entity_id") == "1", " ").otherwise(F.col("entity_id")),
    })
    return it.clean_attempts(rows).select("seq", "medal", "value")


@query("s6_entity_dedup", raw="SELECT CAST(o_custkey AS VARCHAR) AS entity_id, min(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def _(s, d):
    key = F.col("o_custkey").cast("string")
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(key).alias("entity_id"), key.alias("user_id"), F.col("o_orderkey").alias("seq"))
    return it.clean_entities(rows, "seq")


@query("s7_tempo", ", so AS (SELECT p_name AS title, arg_max(p_size, p_partkey) AS size FROM part WHERE p_size > 5 GROUP BY p_name) SELECT item_id, title, size AS bpm_min, size + 10 AS bpm_max FROM items LEFT JOIN so USING (title)")
def _(s, d):
    songs = s.read.parquet(f"{d}/part.parquet").filter("p_size > 5").select(F.col("p_name").alias("title"), F.struct(F.col("p_size").alias("min"), (F.col("p_size") + 10).alias("max")).alias("bpm"), F.col("p_partkey").alias("seq"))
    return it.with_tempo(tb.items(s, d).select("item_id", "title"), songs)


@query("s10_field_names", raw="SELECT 'person' AS path, count(*) AS n FROM events UNION ALL SELECT 'person.name', count(*) FILTER (user_id % 2 = 0) FROM events HAVING count(*) FILTER (user_id % 2 = 0) > 0")
def _(s, d):
    name = F.when(F.col("user_id") % 2 == 0, F.col("event_type"))
    rows = s.read.parquet(f"{d}/events.parquet").select(F.to_json(F.struct("event_id", F.struct(name.alias("name"), F.col("user_id").alias("id")).alias("person"))).alias("raw"))
    return it.field_names(rows, "raw", ["event_id", "person.id"])


@query("s12_manifest", """, h AS (SELECT mode AS name, count(*) AS n, max(sha256(concat_ws('|', entity_id, item_id, CAST(seq AS VARCHAR)))) AS digest FROM attempts GROUP BY mode), w AS (SELECT name, n + (name = 'Double')::INT AS n, digest FROM h)
    SELECT name, CASE WHEN h.n IS NULL THEN 'missing' WHEN h.n = w.n AND h.digest = w.digest THEN 'exact' ELSE 'changed' END AS verdict FROM w LEFT JOIN (SELECT * FROM h WHERE name <> 'CoOp') h USING (name)""")
def _(s, d):
    rows = tb.attempts(s, d)
    counts = rows.groupBy(F.col("mode").alias("name")).agg(F.count("*").alias("n"), F.max(up.row_hash("entity_id", "item_id", "seq")).alias("digest"))
    want = counts.withColumn("n", F.col("n") + F.when(F.col("name") == "Double", 1).otherwise(0))
    return it.manifest_check(counts.filter("name <> 'CoOp'"), want)


@query("s18_unresolved", "SELECT 'unknown entity' AS rule, count(*) FILTER (entity_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0)) AS n FROM attempts UNION ALL SELECT 'unknown item', count(*) FILTER (level <= 13) FROM attempts UNION ALL SELECT 'shared hash', (SELECT count(*) FROM (SELECT 1 FROM (SELECT substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 16) AS k FROM supplier WHERE s_acctbal > 0) GROUP BY k HAVING count(*) > 1))")
def _(s, d):
    people = s.read.parquet(f"{d}/supplier.parquet").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("entity_id"))
    derived = tb.attempts(s, d).select(fx.short_hash(F.col("entity_id")).alias("entity_hash"), "item_id")
    return it.unresolved(derived, people.withColumn("entity_hash", fx.short_hash(F.col("entity_id"))), tb.items(s, d).filter("level > 13"))


@query("s20_identifier_scan", raw="SELECT 'key' AS \"column\", count(*) AS n FROM customer")
def _(s, d):
    key = F.col("c_custkey").cast("string")
    return it.shaped_values(s.read.parquet(f"{d}/customer.parquet").select(fx.public_key("tier", key).alias("key"), fx.short_hash(key).alias("short"), "c_mktsegment"), it.IDENTIFIER)


@query("j12_annotations", "SELECT item_id, CASE WHEN level = 13 THEN 'other level' WHEN level <= 15 THEN 'no change' WHEN mode = 'CoOp' THEN 'wrong direction' END AS problem FROM (SELECT * REPLACE (CASE WHEN mode = 'CoOp' THEN 16 + level ELSE level END AS level) FROM items)")
def _(s, d):
    rows = tb.items(s, d).withColumn("level", F.when(F.col("mode") == "CoOp", F.col("level") + 16).otherwise(F.col("level")))
    delta = F.when(F.col("level").between(14, 15) | (F.col("level") == 12), 0).otherwise(1)
    notes = rows.select("item_id", F.when(F.col("level") == 13, 14).otherwise(F.col("level")).alias("from_level"), delta.alias("delta"), F.when(F.col("mode") == "CoOp", "downrated").otherwise("uprated").alias("direction"))
    return it.annotations(notes, rows)


@query("j13_close_titles", """, c AS (SELECT item_id, author AS label, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS name FROM items), q AS (SELECT item_id AS text_id, label, substr(name, 2) AS name FROM c),
    p AS (SELECT text_id, c.item_id, 1 - levenshtein(q.name, c.name)::DOUBLE / greatest(length(q.name), length(c.name)) AS similarity FROM q JOIN c ON q.label = c.label)
    SELECT text_id, item_id, round(similarity + 1e-9, 6) AS alike FROM p WHERE similarity >= 0.45 QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY similarity DESC, item_id) <= 3""")  # fmt: skip
def _(s, d):
    catalog = tb.items(s, d).select("item_id", F.col("author").alias("label"), ln.normal_title(F.col("title")).alias("normal"))
    asked = catalog.select(F.col("item_id").alias("text_id"), "label", F.expr("substr(normal, 2)").alias("normal"))
    return ln.close_titles(asked, catalog).select("text_id", "item_id", *six("alike"))


@query("i12_paired_responses", """, l AS (SELECT mode, entity_id, item_id, count(*) AS n, min(medal) AS v FROM attempts WHERE source = 'archive' GROUP BY ALL), r AS (SELECT mode, entity_id, item_id, count(*) AS n, min(medal) AS v FROM attempts WHERE source = 'current' GROUP BY ALL)
    SELECT mode, count(*) FILTER (l.v = r.v) AS exact, count(*) FILTER (l.v <> r.v) AS mismatches, count(*) FILTER (l.v IS NULL OR r.v IS NULL) AS missing, count(*) FILTER (l.n > 1 OR r.n > 1) AS duplicates FROM l FULL JOIN r USING (mode, entity_id, item_id) GROUP BY mode""")  # fmt: skip
def _(s, d):
    rows = tb.attempts(s, d)
    return au.paired_responses(rows.filter("source = 'archive'"), rows.filter("source = 'current'"), "mode", ["entity_id", "item_id"], "medal")


@query("i14_drift", "SELECT count(*) FILTER (level > 13) AS candidates, count(*) FILTER (mode <> 'CoOp') AS actives, count(*) FILTER ((level > 13) <> (mode <> 'CoOp')) AS odd_keys, abs(count(*) FILTER (level > 13) - count(*) FILTER (mode <> 'CoOp')) AS difference, count(*) FILTER ((level > 13) <> (mode <> 'CoOp')) <= 5 AND abs(count(*) FILTER (level > 13) - count(*) FILTER (mode <> 'CoOp')) <= 5 AS ok FROM items")
def _(s, d):
    rows = tb.items(s, d)
    return au.drift(rows.filter("level > 13"), rows.filter("mode <> 'CoOp'"), "item_id", 5)


@query("i15_typed_events", raw="SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 5 = 0 THEN 'no event' WHEN event_type NOT IN ('click', 'view') THEN 'unknown kind' WHEN event_id % 5 IN (1, 2) AND user_id % 2 = 0 THEN 'unknown field' END AS problem FROM events")
def _(s, d):
    key, kind = F.col("event_id"), F.col("event_type")
    body = F.to_json(F.struct(kind.alias("kind"), F.when(F.col("user_id") % 2 == 0, 1).alias("secret")))
    rows = s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(key % 5 == 0, "nothing").when(key % 5 <= 2, body).otherwise(F.concat(F.lit("at=1 kind="), kind, F.lit(" end"))).alias("line"))
    return au.typed_events(rows, "line", ["click", "view"], ["kind"]).select("event_id", "kind", "problem")


@query("i20_same_sources", """, h AS (SELECT mode AS name, count(*) AS n, max(sha256(concat_ws('|', item_id, CAST(level AS VARCHAR), title))) AS digest FROM items GROUP BY mode), w AS (SELECT name, n - (name = 'Double')::INT AS n, digest FROM h)
    SELECT name, h.n = w.n AND h.digest = w.digest AS reuse FROM h JOIN w USING (name)""")
def _(s, d):
    rows = tb.items(s, d).withColumn("h", up.row_hash("item_id", "title", "level"))
    now = rows.groupBy(F.col("mode").alias("name")).agg(F.count("*").alias("n"), F.max("h").alias("digest"))
    return au.same_sources(now, now.withColumn("n", F.col("n") - F.when(F.col("name") == "Double", 1).otherwise(0)))


@query("i24_correlated_sources", """, c AS (SELECT entity_id, item_id, count(*) FILTER (source = 'archive') AS a, count(*) FILTER (source = 'current') AS b FROM attempts GROUP BY ALL)
    SELECT entity_id, count(*) AS identities, CAST(sum(a) AS BIGINT) AS "first", CAST(sum(b) AS BIGINT) AS "second", 0 AS others, count(*) = 1 AND bool_and(a = 1 AND b = 1) AS ok FROM c GROUP BY entity_id""")
def _(s, d):
    return au.correlated_sources(tb.attempts(s, d), "entity_id", "source", "item_id", ("archive", "current"))


@query("i26_semantic_digest", rg.DIGEST)
def _(s, d):
    rows = tb.attempts(s, d).select("entity_id", "item_id", "seq").withColumn("generated_at", F.current_timestamp())
    return up.semantic_digest(rows, "generated_at")


@query("f8_group_catalog", "SELECT item_id, level || 'x' AS label FROM items WHERE mode = 'CoOp' AND level IN (2, 3, 4, 5)")
def _(s, d):
    return gm.catalog(tb.items(s, d)).select("item_id", F.col("folder").alias("label"))


@query("f9_level_window", """, tt AS (SELECT mode, entity_id, avg(level) FILTER (rank_value <= 20) - 2 AS rating FROM ranked GROUP BY mode, entity_id)
    SELECT mode, entity_id, item_id FROM ranked JOIN tt USING (mode, entity_id) WHERE level BETWEEN greatest(16, floor(rating) - 2) AND floor(rating) + 2""")
def _(s, d):
    rows = rg.ranked(s, d)
    ratings = rows.groupBy("mode", "entity_id").agg((F.avg(F.when(F.col("rank_value") <= P.RATING_TOP, F.col("level"))) - 2).alias("rating"))
    return vw.near_rating(rows, ratings, ["mode", "entity_id"]).select("mode", "entity_id", "item_id")


@query("f12_unrated", "SELECT item_id, folder, contributors < 20 AS limited FROM final WHERE delta IS NULL OR contributors < 20")
def _(s, d):
    out = df.analysis(tb.attempts(s, d), tb.items(s, d), resamples=None)
    return out.filter(F.col("delta").isNull() | (F.col("contributors") < P.LIMITED)).select("item_id", "folder", (F.col("contributors") < P.LIMITED).alias("limited"))


@query("a20_top_totals", """, sp AS (SELECT entity_id, value, row_number() OVER (PARTITION BY entity_id ORDER BY value DESC, score DESC, item_id) AS r FROM best)
    SELECT entity_id, round(sum(value) FILTER (r <= 50) + 1e-9, 6) AS total, count(*) AS n FROM sp GROUP BY entity_id""")
def _(s, d):
    pool = df.ranked(df.best(valid(s, d)), ["entity_id"])
    return wt.top_totals(pool, ["entity_id"]).select("entity_id", *six("total"), "n")


@query("a28_coverage", """SELECT mode, count(*) AS attempts, count(*) FILTER (value <= 0 OR is_broken) AS rejected, count(DISTINCT entity_id) AS entities, count(DISTINCT item_id) AS items, count(*) FILTER (source = 'archive') AS archive_rows, count(DISTINCT entity_id) FILTER (source = 'archive') AS archive_entities FROM attempts GROUP BY mode""")
def _(s, d):
    return vw.coverage(tb.attempts(s, d))


@query("c34_core_names", raw=r"""SELECT p_partkey, CASE WHEN contains(n, 'full song') THEN 'full-song' ELSE 'normal' END AS variant, b AS base, CASE WHEN c <> '' AND c <> b THEN b || '|' || c ELSE b END AS cores FROM (SELECT *, trim(regexp_replace(regexp_replace(b, '\s+ft\b.*$', ''), '\s+(bolt|ring)$', '')) AS c
    FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN replace(n, ' full song', '') ELSE n END AS b FROM (SELECT p_partkey, p_size, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || CASE WHEN p_size % 3 = 0 THEN ' ft x' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ' full song' ELSE '' END AS n FROM part)))""")
def _(s, d):
    extra = F.concat(F.when(F.col("p_size") % 3 == 0, " ft x").otherwise(""), F.when(F.col("p_size") % 2 == 0, " (Full Song)").otherwise(""))
    normal = ln.normal_title(F.concat("p_name", extra))
    rows, n = s.read.parquet(f"{d}/part.parquet").select("p_partkey", normal.alias("normal")), F.col("normal")
    return rows.select("p_partkey", ln.variant(n).alias("variant"), ln.base_name(n).alias("base"), F.array_join(ln.core_names(n, ["bolt|ring"]), "|").alias("cores"))


@query("c36_pattern_rank", raw=r"SELECT doc_id, CASE WHEN regexp_matches(text, 'https?://') THEN 3 WHEN regexp_matches(text, '@') THEN 2 WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS place FROM documents")
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", ln.pattern_rank(F.coalesce("text", F.lit("")), [("https?://", 3), ("@", 2), ("[0-9]", 1)]).alias("place"))


@query("c37_paired_tokens", "SELECT item_id, CASE WHEN level <> level_archive THEN 'L' || level_archive || '>L' || level ELSE '' END AS moves FROM items WHERE mode <> 'CoOp'")
def _(s, d):
    rows = tb.items(s, d).filter("mode <> 'CoOp'")
    text = lambda c: F.concat(F.lit("was L"), F.col(c).cast("string"), F.lit(" ."))
    moved = F.filter(ln.paired_tokens(text("level_archive"), text("level"), "L[0-9]+"), lambda x: x["old"] != x["new"])
    return rows.select("item_id", F.array_join(F.transform(moved, lambda x: F.concat(x["old"], F.lit(">"), x["new"])), ",").alias("moves"))


@query("c41_readiness", "SELECT mode, entity_id, count(*) AS n, 100 AS required, greatest(0, 100 - count(*)) AS lacking, count(*) >= 100 AS ready FROM best GROUP BY mode, entity_id")
def _(s, d):
    return vw.readiness(df.best(valid(s, d)), ["mode", "entity_id"], 100)


@query("c11_grade_floor", f"SELECT seq, {rg._case('least(CAST(trunc(score) AS BIGINT), 1000000)', [(b, b) for b, _, _ in P.GRADE_BANDS])} AS least_score, {rg._grade('score')} AS grade FROM attempts")
def _(s, d):
    from ..operators import recommend as rc

    return tb.attempts(s, d).select("seq", rc.grade_floor(F.col("score")).alias("least_score"), fx.grade(F.col("score")).alias("grade"))


@query("c29_times", "SELECT seq, recorded_at, CAST(recorded_ts AS TIMESTAMP) AS parsed FROM attempts")
def _(s, d):
    return tb.attempts(s, d).select("seq", "recorded_at", F.try_to_timestamp("recorded_at").cast("timestamp_ntz").alias("parsed"))


@query("c30_freshness", raw="SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 60 SECOND OR event_type <> 'click' AS stale FROM events")
def _(s, d):
    rows = s.read.parquet(f"{d}/events.parquet")
    last = F.broadcast(rows.agg(F.max("ts").alias("now")))  # one row
    return up.freshness(rows.join(last, how="cross"), "event_type", F.lit("click"), "ts", F.col("now")).select("event_id", (~F.col("fresh")).alias("stale"))


@query("c31_source_alias", "SELECT source, CASE source WHEN 'archive' THEN 'archive' END AS resolved, count(*) AS n FROM attempts GROUP BY source")
def _(s, d):
    rows = tb.attempts(s, d).groupBy("source").agg(F.count("*").alias("n"))
    return rows.select("source", up.alias(F.concat(F.lit(" "), F.upper("source")), {"archive": "archive", "old": "archive"}).alias("resolved"), "n")
