"""All queries of the library by name, with their SQL. Keys begin with the operator that a query shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import formulas as fx
from ..operators import difficulty as df
from ..operators import recommend as rc
from ..operators import upkeep as up
from ..operators import views as vw
from ..operators import weighted as wt
from ..operators.lineage import written
from ..sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_case = lambda x, steps, end="NULL": "CASE " + " ".join(f"WHEN {x} >= {b} THEN {v!r}" for b, v in steps) + f" ELSE {end} END"
_map = lambda x, table: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in table.items()) + " END"
_grade = lambda x: f"CASE WHEN {x} < 0 THEN NULL ELSE " + _case(f"least(CAST(trunc({x}) AS BIGINT), 1000000)", [(b, g) for b, g, _ in P.GRADE_BANDS]) + " END"
_pen = {g: u for _, g, u in P.GRADE_BANDS}
_bon = {n: u for n, _, u in P.MEDALS}
_pick = lambda mode, one, two: f"CASE WHEN {mode} = 'Single' THEN {one} ELSE {two} END"
_value = lambda mode, level, grade, medal: (
    f"floor((greatest(0.0::DOUBLE, (CASE WHEN {level} - ({mode} = 'Double')::INT <= 23 THEN 7.5::DOUBLE * ({level} - ({mode} = 'Double')::INT + 27) "
    f"ELSE 375.0::DOUBLE + 15.0::DOUBLE * ({level} - ({mode} = 'Double')::INT - 23) END) * ((750.0::DOUBLE - 5 * "
    f"{_pick(mode, _map(grade, _pen), _map(grade, _pen | P.DOUBLE_PENALTIES))} + {_pick(mode, _map(medal, _bon), _map(medal, _bon | P.DOUBLE_BONUSES))}) / 750.0::DOUBLE)) + 1e-9::DOUBLE) * 100) / 100.0::DOUBLE"
)
_skill = lambda mode, v: (
    f"((CASE WHEN ({v}) / {P.REFERENCE!r}::DOUBLE <= 375 THEN ({v}) / {P.REFERENCE!r}::DOUBLE / 7.5::DOUBLE - 27 ELSE 23 + (({v}) / {P.REFERENCE!r}::DOUBLE - 375) / 15.0::DOUBLE END) + ({mode} = 'Double')::INT)"
)
_status = lambda n: f"CASE WHEN {n} >= 10 THEN 'Published' WHEN {n} >= 5 THEN 'Provisional' WHEN {n} > 0 THEN 'Insufficient' ELSE 'Unrated' END"
_folder = "CASE WHEN level >= 16 AND mode = 'Single' THEN 'S' || level WHEN level >= 16 AND mode = 'Double' THEN 'D' || level END"
_mode = "CASE WHEN p_partkey % 10 = 9 THEN 'CoOp' WHEN p_partkey % 2 = 0 THEN 'Single' ELSE 'Double' END"
_level = "CAST(CASE WHEN p_partkey % 10 = 9 THEN 2 + p_size % 4 ELSE 12 + p_size % 14 END AS INTEGER)"
_fold = lambda x: f"CAST(CAST('0x' || substr(sha256({x}), 1, 8) AS BIGINT) % 5 AS INTEGER)"
_norm = {n: f"{P.compression(n)!r}" for n in range(400)}

#: The SQL of each step, on those before it.
STEPS = {
    "attempts": f"""SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(l_partkey AS VARCHAR) AS item_id, {_mode} AS mode, {_level} AS level,
      1000000.0::DOUBLE - round(l_discount * 1e6::DOUBLE) - l_quantity * 40 AS score,
      round((12 + p_size % 14) * 7.3::DOUBLE + l_quantity * 0.8::DOUBLE + (p_retailprice - 950) * 0.1::DOUBLE, 2) AS value,
      strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, l_shipdate AS recorded_ts, l_tax >= 0.08::DOUBLE AS is_broken,
      CASE WHEN l_linestatus = 'F' THEN 'archive' ELSE 'current' END AS source, [{", ".join(f"'{n}'" for n, _, _ in P.MEDALS)}][l_linenumber] AS medal, l_orderkey * 10 + l_linenumber AS seq
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "items": f"SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, {_mode} AS mode, {_level} AS level, p_brand AS author, 500 + p_size AS notes_archive, 500 + p_size % 40 AS notes_current, {_level} - CASE WHEN p_partkey % 10 <> 9 AND p_size % 7 = 0 THEN 1 ELSE 0 END AS level_archive FROM part",
    "valid": "SELECT * FROM attempts WHERE value > 0 AND NOT is_broken AND mode IN ('Single', 'Double')",
    "best": "SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY mode, entity_id, item_id ORDER BY value DESC NULLS LAST, score DESC NULLS LAST, recorded_at DESC NULLS LAST, seq) = 1",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY mode, entity_id ORDER BY value DESC, score DESC, item_id) AS rank_value,
      row_number() OVER (PARTITION BY mode, entity_id ORDER BY recorded_ts DESC, value DESC, score DESC, item_id) AS rank_recent, count(*) OVER (PARTITION BY mode, entity_id) AS n FROM best""",
    "baselines": """SELECT mode, entity_id, count(*) AS window_n, avg(value) AS baseline, stddev_samp(value) AS baseline_std, min(value) AS baseline_min, max(value) AS baseline_max
      FROM ranked WHERE n >= 50 AND rank_value BETWEEN 11 AND 30 GROUP BY mode, entity_id HAVING count(*) = 20 AND avg(value) > 0""",
    "marked": """SELECT r.*, baseline, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS rank_limit, value - baseline AS residual,
      rank_value <= ceil(n * 0.2::DOUBLE) OR rank_recent <= ceil(n * 0.2::DOUBLE) AS in_window FROM ranked r JOIN baselines b USING (mode, entity_id)""",
    "chosen": """SELECT *, union_n < 100 AS uses_fallback, CASE WHEN union_n < 100 THEN rank_value <= 100 ELSE in_window END AS selected
      FROM (SELECT *, CAST(sum(in_window::INT) OVER (PARTITION BY mode, entity_id) AS BIGINT) AS union_n FROM marked)""",
    "medians": "SELECT mode, item_id, median(residual) AS median FROM chosen WHERE selected AND level >= 16 GROUP BY ALL",
    "mads": "SELECT mode, item_id, any_value(median) AS median, median(abs(residual - median)) AS mad FROM chosen JOIN medians USING (mode, item_id) WHERE selected AND level >= 16 GROUP BY ALL",
    "stats": f"""SELECT mode, item_id, count(*) AS contributors, avg(residual) AS mean, any_value(median) AS median, coalesce(stddev_samp(residual), 0) AS std, avg(baseline) AS mean_baseline,
      CASE WHEN count(*) < 3 OR any_value(mad) <= 0 THEN avg(residual) ELSE avg(least(greatest(residual, median - {P.CLIP!r}::DOUBLE * mad), median + {P.CLIP!r}::DOUBLE * mad)) END AS location
      FROM chosen JOIN mads USING (mode, item_id) WHERE selected AND level >= 16 GROUP BY mode, item_id""",
    "scored": "SELECT mode, item_id, count(*) AS scored FROM chosen WHERE level >= 16 GROUP BY ALL",
    "bins": "SELECT *, avg(level) OVER w AS ml, avg(value) OVER w AS mv, count(DISTINCT level) OVER w AS levels FROM (SELECT *, floor(score / 2500) AS bin FROM best WHERE score >= 900000) WINDOW w AS (PARTITION BY mode, entity_id, bin)",
    "slopes": """SELECT mode, count(*) AS rows, count(DISTINCT level) AS levels, CASE WHEN count(*) >= 30 AND count(DISTINCT level) >= 3 THEN sum((level - ml) * (value - mv)) / sum((level - ml) * (level - ml)) END AS slope
      FROM bins WHERE levels >= 2 GROUP BY mode""",
    "catalog": f"""SELECT i.*, {_folder.replace("level", "i.level").replace("mode", "i.mode")} AS folder, coalesce(scored, 0) AS scored, coalesce(contributors, 0) AS contributors, mean, median, std, location, mean_baseline
      FROM items i LEFT JOIN stats USING (mode, item_id) LEFT JOIN scored USING (mode, item_id) WHERE mode IN ('Single', 'Double') AND level >= 16""",
    "folders": f"SELECT mode, folder, median(location) AS reference, count(location) AS measured, CASE count(location) {' '.join(f'WHEN {n} THEN {c}' for n, c in _norm.items())} END AS compression FROM catalog GROUP BY mode, folder",
    "prior": """SELECT mode, count(*) AS items, count(*) FILTER (contributors > 1) AS repeated, least(20.0, greatest(0.5, CASE WHEN count(*) >= 10 AND count(*) FILTER (contributors > 1) >= 3 THEN
      (sum(std * std * (contributors - 1)) FILTER (contributors > 1) / sum(contributors - 1) FILTER (contributors > 1))
      / greatest(var_samp(location - reference) - avg(std * std / contributors) FILTER (contributors > 1), 1e-6) ELSE 5.0 END)) AS k
      FROM catalog JOIN folders USING (mode, folder) WHERE location IS NOT NULL GROUP BY mode""",
    "deltas": """SELECT *, contributors / (contributors + k) AS weight, -0.4::DOUBLE * contributors / (contributors + k) * (location - reference) / slope * compression AS delta
      FROM catalog JOIN folders USING (mode, folder) LEFT JOIN prior USING (mode) LEFT JOIN slopes USING (mode)""",
    "final": """SELECT *, level + 0.5 + delta AS estimate, CASE WHEN delta IS NOT NULL THEN (rank() OVER (PARTITION BY mode, folder ORDER BY delta NULLS LAST)
      + (count(*) OVER (PARTITION BY mode, folder, delta) - 1) / 2 - 0.5) / measured END AS percentile FROM deltas""",
}


def sql(select: str) -> str:
    """``select`` on the steps above."""
    steps = ",\n".join(f"{name} AS MATERIALIZED ({body})" if name in ("best", "ranked", "chosen", "catalog") else f"{name} AS ({body})" for name, body in STEPS.items())
    return f"WITH {steps}\n{select}"


def query(name: str, select: str | None = None, raw: str | None = None):
    """Register a query; ``select`` is its SQL on the steps, ``raw`` its whole SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if select or raw:
            SQL[name] = sql(select) if select else raw
        return f

    return put


def six(*names: str) -> list[Column]:
    """Six decimals; what lies between two goes up, whatever floating point made of it."""
    return [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]


def r6(*names: str) -> str:
    return ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in names)


def valid(s: SparkSession, d: str) -> DataFrame:
    return df.valid(tb.attempts(s, d))


def ranked(s: SparkSession, d: str) -> DataFrame:
    return df.ranked_best(valid(s, d))


@query("s2_attempts", "SELECT entity_id, item_id, mode, level, score, value, recorded_at, is_broken, source, medal FROM attempts")
def _(s, d):
    return tb.attempts(s, d).drop("recorded_ts", "seq")


@query("s9_integrity", "SELECT 'attempt twice' AS rule, count(*) AS n FROM (SELECT 1 FROM attempts GROUP BY entity_id, item_id HAVING count(*) > 1) UNION ALL SELECT 'broken attempt', count(*) FROM attempts WHERE is_broken")
def _(s, d):
    return up.violations(tb.attempts(s, d), tb.items(s, d))


@query("s11_credential_scan", raw=r"SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)(token|secret|password|api_key)\s*[=:]\s*\"?[A-Za-z0-9_-]{16,}') GROUP BY source")
def _(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.filter(F.col("text").rlike(r'(?i)(token|secret|password|api_key)\s*[=:]\s*"?[A-Za-z0-9_-]{16,}')).groupBy("source").agg(F.count("*").alias("n"))


@query("f1_valid_attempts", "SELECT entity_id, item_id, mode, seq, value FROM valid")
def _(s, d):
    return valid(s, d).select("entity_id", "item_id", "mode", "seq", "value")


@query("f2_rejected_count", "SELECT mode, count(*) FILTER (value <= 0 OR is_broken) AS rejected, count(*) AS n FROM attempts GROUP BY mode")
def _(s, d):
    return tb.attempts(s, d).groupBy("mode").agg(F.count_if((F.col("value") <= 0) | F.col("is_broken")).alias("rejected"), F.count("*").alias("n"))


@query("f3_folder", f"SELECT item_id, {_folder} AS folder, coalesce({_folder}, substr(mode, 1, 1) || level) AS label FROM items")
def _(s, d):
    place = fx.folder(F.col("mode"), F.col("level"))
    return tb.items(s, d).select("item_id", place.alias("folder"), F.coalesce(place, F.concat(F.substring("mode", 1, 1), F.col("level").cast("string"))).alias("label"))


@query("f6_minimum_attempts", "SELECT mode, entity_id, item_id, n FROM ranked WHERE n >= 80")
def _(s, d):
    return ranked(s, d).filter("n >= 80").select("mode", "entity_id", "item_id", "n")


@query("f7_eligible_entities", "SELECT seq, entity_id FROM attempts SEMI JOIN (SELECT entity_id FROM attempts WHERE value > 0 GROUP BY entity_id HAVING count(*) FILTER (mode = 'Single') >= 50 OR count(*) FILTER (mode = 'Double') >= 50) USING (entity_id)")
def _(s, d):
    rows = tb.attempts(s, d)
    counts = rows.filter("value > 0").groupBy("entity_id").agg(*[F.count_if(F.col("mode") == m).alias(m) for m in P.MODES])
    return rows.join(counts.filter("Single >= 50 or Double >= 50"), "entity_id", "left_semi").select("seq", "entity_id")


@query("f11_text_search", "SELECT item_id, title FROM items WHERE contains(lower(title || ' ' || author), 'bolt')")
def _(s, d):
    return vw.matching(tb.items(s, d), "Bolt", ["title", "author"]).select("item_id", "title")


@query("f13_difficulty_options", "SELECT label, CAST(row_number() OVER (ORDER BY mode DESC, level) AS INTEGER) AS ord FROM (SELECT DISTINCT substr(mode, 1, 1) || level AS label, mode, level FROM items WHERE mode <> 'CoOp')")
def _(s, d):
    return vw.difficulty_options(tb.items(s, d))


@query("j3_source_precedence", "SELECT seq, entity_id, item_id, source FROM valid v WHERE source = 'current' OR NOT EXISTS (SELECT 1 FROM valid c WHERE c.source = 'current' AND c.entity_id = v.entity_id AND c.item_id = v.item_id AND c.mode = v.mode)")
def _(s, d):
    rows = valid(s, d)
    return up.precedence(rows.filter("source = 'current'"), rows.filter("source = 'archive'"), ["entity_id", "item_id", "mode"]).select("seq", "entity_id", "item_id", "source")


@query("j5_catalog_diff", "SELECT item_id, notes_archive, notes_current FROM items WHERE notes_archive > 0 AND notes_current > 0 AND notes_archive <> notes_current")
def _(s, d):
    rows = tb.items(s, d)
    old, new = rows.select("item_id", "mode", "notes_archive"), rows.select("item_id", "mode", "notes_current")
    return old.join(new, ["item_id", "mode"]).filter("notes_archive > 0 and notes_current > 0 and notes_archive <> notes_current").drop("mode")


@query(
    "j6_rating_candidates",
    f"""SELECT t.mode, t.entity_id, i.item_id, round(t.rating + 1e-9, 6) AS rating FROM
    (SELECT mode, entity_id, avg(level) FILTER (rank_value <= 20) - 2 AS rating FROM ranked GROUP BY mode, entity_id) t
    JOIN items i ON i.mode = t.mode AND i.level BETWEEN greatest(16, floor(rating) - 2) AND floor(rating) + 2""",
)
def _(s, d):
    ratings = ranked(s, d).groupBy("mode", "entity_id").agg((F.avg(F.when(F.col("rank_value") <= P.RATING_TOP, F.col("level"))) - 2).alias("rating"))
    low, high = F.greatest(F.lit(16), F.floor("rating") - 2), F.floor("rating") + 2
    levels = ratings.filter(high >= low).withColumn("level", F.explode(F.sequence(low, high))).withColumn("level", F.col("level").cast("int"))
    return rc.all_pairs(written(levels.select("mode", "level", "entity_id", *six("rating"))), tb.items(s, d).select("mode", "level", "item_id"), ["mode", "level"]).select("mode", "entity_id", "item_id", "rating")


@query("a1_baselines", f"SELECT mode, entity_id, window_n, {r6('baseline', 'baseline_std', 'baseline_min', 'baseline_max')}, substr(sha256(entity_id), 1, 16) AS entity_hash FROM baselines")
def _(s, d):
    return df.baselines(ranked(s, d)).select("mode", "entity_id", "window_n", *six("baseline", "baseline_std", "baseline_min", "baseline_max"), fx.short_hash(F.col("entity_id")).alias("entity_hash"))


@query("a4_item_statistics", f"SELECT mode, item_id, scored, contributors, {r6('mean', 'median', 'std', 'location', 'mean_baseline')}, round(contributors / scored + 1e-9, 6) AS appearance FROM stats JOIN scored USING (mode, item_id)")
def _(s, d):
    out = df.item_stats(df.selected(ranked(s, d))).filter("contributors > 0")
    return out.select("mode", "item_id", "scored", "contributors", *six("mean", "median", "std", "location", "mean_baseline"), F.round(F.col("contributors") / F.col("scored") + 1e-9, 6).alias("appearance"))


@query("a11_slope", f"SELECT mode, rows, levels, {r6('slope')} FROM slopes")
def _(s, d):
    return df.slopes(df.best(valid(s, d))).select("mode", "rows", "levels", *six("slope"))


@query("a12_shrinkage", f"SELECT mode, items, repeated, {r6('k')} FROM prior")
def _(s, d):
    stats = df.item_stats(df.selected(ranked(s, d)))
    rows = tb.items(s, d).join(stats, ["mode", "item_id"]).select("mode", fx.folder(F.col("mode"), F.col("level")).alias("folder"), "location", "std", "contributors")
    return df.shrinkage(written(rows)).select("mode", "items", "repeated", *six("k"))


def _mixed(x: str) -> str:
    return f"(xor({x}, {x} >> 16) * 73244475) & 4294967295"


#: The SQL of resampled locations, on the steps: ends (mode, item_id, low, high).
BOOTSTRAP = f""", bp AS (SELECT mode, item_id, residual, row_number() OVER (PARTITION BY mode, item_id ORDER BY entity_id) - 1 AS place, count(*) OVER (PARTITION BY mode, item_id) AS n,
      CAST('0x' || substr(sha256('{P.SEED}:' || mode || ':' || item_id), 1, 8) AS BIGINT) AS base FROM chosen WHERE selected AND level >= 16),
    b0 AS (SELECT mode, item_id, b, n, (base + b * 2654435761 + place * 2246822519) & 4294967295 AS x FROM bp, (SELECT unnest(range(1, {P.RESAMPLES + 1})) AS b)),
    b1 AS (SELECT mode, item_id, b, n, {_mixed("x")} AS x FROM b0), b2 AS (SELECT mode, item_id, b, n, {_mixed("x")} AS x FROM b1),
    dv AS MATERIALIZED (SELECT b2.mode, b2.item_id, b, residual AS x FROM b2 JOIN bp ON b2.mode = bp.mode AND b2.item_id = bp.item_id AND xor(b2.x, b2.x >> 16) % b2.n = bp.place),
    bm AS (SELECT mode, item_id, b, median(x) AS median, avg(x) AS mean, count(*) AS n FROM dv GROUP BY ALL), bd AS (SELECT mode, item_id, b, median(abs(x - median)) AS mad FROM dv JOIN bm USING (mode, item_id, b) GROUP BY ALL),
    bl AS (SELECT mode, item_id, b, CASE WHEN any_value(n) < 3 OR any_value(mad) <= 0 THEN any_value(mean) ELSE avg(least(greatest(x, median - {P.CLIP!r}::DOUBLE * mad), median + {P.CLIP!r}::DOUBLE * mad)) END AS l FROM dv JOIN bm USING (mode, item_id, b) JOIN bd USING (mode, item_id, b) GROUP BY mode, item_id, b),
    ends AS (SELECT mode, item_id, quantile_cont(l, 0.025) AS low, quantile_cont(l, 0.975) AS high FROM bl GROUP BY mode, item_id)"""
_moved = lambda c: f"round(-0.4::DOUBLE * contributors / (contributors + k) * ({c} - reference) / slope * compression + 1e-9, 6)"
_at = lambda c: f"round(level + 0.5 + -0.4::DOUBLE * contributors / (contributors + k) * ({c} - reference) / slope * compression + 1e-9, 6)"


@query(
    "m1_difficulty_analysis",
    f"""{BOOTSTRAP} SELECT mode, item_id, folder, contributors, {_status("contributors")} AS status, {r6("delta", "estimate", "percentile", "weight")}, {_moved("high")} AS delta_low, {_moved("low")} AS delta_high, {_at("high")} AS estimate_low, {_at("low")} AS estimate_high,
    CAST(CASE WHEN delta IS NOT NULL THEN row_number() OVER (PARTITION BY mode ORDER BY delta NULLS LAST, contributors DESC, title, item_id) END AS INTEGER) AS mode_rank,
    CAST(CASE WHEN delta IS NOT NULL THEN row_number() OVER (PARTITION BY mode, folder ORDER BY delta NULLS LAST, contributors DESC, title, item_id) END AS INTEGER) AS level_rank,
    CAST(least(10, floor(percentile * 10) + 1) AS INTEGER) * CASE WHEN percentile IS NULL THEN NULL ELSE 1 END AS decile,
    CASE WHEN delta < -0.5 THEN 'Overrated' WHEN delta < -0.3 THEN 'Very Easy' WHEN delta < -0.1 THEN 'Easy' WHEN delta <= 0.1 THEN 'Medium' WHEN delta <= 0.3 THEN 'Hard' WHEN delta <= 0.5 THEN 'Very Hard' WHEN delta > 0.5 THEN 'Underrated' END AS band_name
    FROM final LEFT JOIN ends USING (mode, item_id)""",
)
def _(s, d):
    out = df.analysis(tb.attempts(s, d), tb.items(s, d))
    return out.select("mode", "item_id", "folder", "contributors", "status", *six("delta", "estimate", "percentile", "weight", "delta_low", "delta_high", "estimate_low", "estimate_high"), "mode_rank", "level_rank", "decile", "band_name")


_weights = "SELECT mode, item_id, value, (CASE WHEN source = 'archive' THEN 1.0 ELSE 2.0 END)::DOUBLE AS w FROM best"


@query(
    "a10_weighted_statistics",
    f""", ow AS ({_weights}), av AS (SELECT mode, item_id, value, sum(w) AS w FROM ow GROUP BY ALL),
    ru AS (SELECT *, sum(w) OVER (PARTITION BY mode, item_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY mode, item_id) AS total FROM av),
    md AS (SELECT mode, item_id, min(value) AS median FROM ru WHERE run >= total * 0.5 GROUP BY ALL),
    sm AS (SELECT mode, item_id, count(*) AS n, sum(w) AS sw, sum(w * w) AS sww, sum(w * value) / sum(w) AS mean, sum(w) * sum(w) / sum(w * w) AS ess FROM ow GROUP BY ALL),
    of AS (SELECT ow.*, median, mean, sw, sww, n, ess, abs(value - median) AS off FROM ow JOIN md USING (mode, item_id) JOIN sm USING (mode, item_id)),
    ao AS (SELECT mode, item_id, off, sum(w) AS w FROM of GROUP BY ALL),
    ro AS (SELECT *, sum(w) OVER (PARTITION BY mode, item_id ORDER BY off ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY mode, item_id) AS total FROM ao),
    mo AS (SELECT mode, item_id, min(off) AS mad FROM ro WHERE run >= total * 0.5 GROUP BY ALL),
    fi AS (SELECT mode, item_id, any_value(n) AS n, any_value(ess) AS ess, any_value(mean) AS mean, any_value(median) AS median, any_value(sw - sww / sw) AS room, any_value(mad) AS mad,
      sum(w * least(greatest(value, median - {P.CLIP!r}::DOUBLE * mad), median + {P.CLIP!r}::DOUBLE * mad)) / any_value(sw) AS held, sum(w * (value - mean) * (value - mean)) AS sq FROM of JOIN mo USING (mode, item_id) GROUP BY mode, item_id),
    fo AS (SELECT mode, item_id, n, ess, mean, median, CASE WHEN n < 3 OR mad <= 0 THEN mean ELSE held END AS location, CASE WHEN ess > 1 THEN sqrt(sq / room) ELSE 0 END AS std FROM fi)
    SELECT mode, item_id, n, {r6("ess", "mean", "median", "location", "std")}, round(location - CASE WHEN ess > 1 THEN 1.96::DOUBLE * std / sqrt(ess) ELSE 0 END + 1e-9, 6) AS low, round(location + CASE WHEN ess > 1 THEN 1.96::DOUBLE * std / sqrt(ess) ELSE 0 END + 1e-9, 6) AS high FROM fo""",
)
def _(s, d):
    rows = df.best(valid(s, d)).withColumn("w", F.when(F.col("source") == "archive", P.SOURCE_WEIGHTS["archive"]).otherwise(P.SOURCE_WEIGHTS["current"]))
    return wt.weighted_stats(rows, ["mode", "item_id"], "value", "w").select("mode", "item_id", "n", *six("ess", "mean", "median", "location", "std", "low", "high"))


@query("a16_quantile_row", "SELECT item_id, score, medal FROM (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY item_id) AS m FROM attempts WHERE mode = 'CoOp' WINDOW w AS (PARTITION BY item_id ORDER BY score, value, entity_id, source, seq)) WHERE r = ceil(0.75::DOUBLE * m)")
def _(s, d):
    from pyspark.sql import Window

    by = Window.partitionBy("item_id")
    rows = tb.attempts(s, d).filter("mode = 'CoOp'").select("item_id", "score", "medal", F.row_number().over(by.orderBy("score", "value", "entity_id", "source", "seq")).alias("r"), F.count("*").over(by).alias("m"))
    return rows.filter("r = ceil(0.75D * m)").select("item_id", "score", "medal")


@query(
    "a19_ability_percentile",
    """, g AS (SELECT entity_id, score, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, item_id, seq) AS r FROM attempts WHERE mode = 'CoOp'),
    m AS (SELECT entity_id, avg(score) AS ability FROM g WHERE r <= 20 GROUP BY entity_id HAVING count(*) = 20)
    SELECT entity_id, round(ability + 1e-9, 6) AS ability, round(CASE WHEN count(*) OVER () = 1 THEN 0.5 ELSE (rank() OVER (ORDER BY ability) - 1 + (count(*) OVER (PARTITION BY ability) - 1) / 2) / (count(*) OVER () - 1) END + 1e-9, 6) AS percentile FROM m""",
)
def _(s, d):
    return wt.ability_percentile(tb.attempts(s, d).filter("mode = 'CoOp'")).select("entity_id", *six("ability", "percentile"))


@query(
    "a25_medal_distribution",
    f""", gr AS (SELECT *, {_grade("score")} AS grade FROM valid), cn AS (SELECT mode, grade, medal, count(*) AS c FROM gr GROUP BY ALL),
    ms AS (SELECT * FROM (SELECT DISTINCT mode FROM cn), (SELECT unnest([{", ".join(f"'{g}'" for _, g, _ in P.GRADE_BANDS)}]) AS grade), (SELECT unnest([{", ".join(f"'{n}'" for n, _, _ in P.MEDALS)}]) AS medal)),
    fu AS (SELECT ms.*, coalesce(c, 0) AS c, coalesce((SELECT sum(c) FROM cn x WHERE x.mode = ms.mode AND x.medal = ms.medal), 0) AS mc FROM ms LEFT JOIN cn USING (mode, grade, medal)),
    us AS (SELECT *, CAST(CASE WHEN sum(c) OVER (PARTITION BY mode, grade) > 0 THEN c ELSE mc END AS BIGINT) AS used FROM fu)
    SELECT mode, grade, medal, used, round((used + 0.25) / (sum(used) OVER (PARTITION BY mode, grade) + 2) + 1e-9, 6) AS p FROM us""",
)
def _(s, d):
    rows = valid(s, d).withColumn("grade", fx.grade(F.col("score")))
    return wt.medal_distribution(rows).select("mode", "grade", "medal", F.col("used").cast("long").alias("used"), *six("p"))


@query("w1_best_attempt", "SELECT mode, entity_id, item_id, value, score, recorded_at FROM best")
def _(s, d):
    return df.best(valid(s, d)).select("mode", "entity_id", "item_id", "value", "score", "recorded_at")


@query("w2_sync_winner", "SELECT entity_id, item_id, value, score, seq FROM attempts QUALIFY row_number() OVER (PARTITION BY entity_id, item_id ORDER BY CASE WHEN value <> 0 THEN value END DESC NULLS LAST, CASE WHEN score <> 0 THEN score END DESC NULLS LAST, recorded_at DESC NULLS LAST, medal IS NOT NULL DESC, seq) = 1")
def _(s, d):
    rows = tb.attempts(s, d)
    return up.upsert(rows.filter("source = 'archive'"), rows.filter("source = 'current'")).select("entity_id", "item_id", "value", "score", "seq")


@query("w4_value_and_recency_ranks", "SELECT mode, entity_id, item_id, rank_value, rank_recent FROM ranked")
def _(s, d):
    return ranked(s, d).select("mode", "entity_id", "item_id", F.col("rank_value").cast("long").alias("rank_value"), F.col("rank_recent").cast("long").alias("rank_recent"))


@query("w7_dual_window_selection", f"SELECT mode, entity_id, item_id, rank_limit, union_n, uses_fallback, selected, {r6('residual')} FROM chosen")
def _(s, d):
    return df.selected(ranked(s, d)).select("mode", "entity_id", "item_id", "rank_limit", "union_n", "uses_fallback", "selected", *six("residual"))


@query(
    "w11_rating_without_item",
    f""", t AS (SELECT mode, entity_id, sum(value) FILTER (rank_value BETWEEN 11 AND 30) AS sv, max(value) FILTER (rank_value = 11) AS v11, max(value) FILTER (rank_value = 31) AS v31 FROM ranked GROUP BY ALL),
    u AS (SELECT r.*, CASE WHEN rank_value < 11 THEN sv - v11 + v31 WHEN rank_value <= 30 THEN sv - value + v31 ELSE sv END / 20 AS m FROM ranked r JOIN t USING (mode, entity_id))
    SELECT mode, entity_id, item_id, round(CASE WHEN n > 30 THEN {_skill("mode", "m")} END + 1e-9, 6) AS rating_without FROM u""",
)
def _(s, d):
    return wt.without_item(ranked(s, d)).select("mode", "entity_id", "item_id", *six("rating_without"))


@query("w12_top_rating", f"""SELECT mode, entity_id, round(avg(value) FILTER (rank_value <= 20) + 1e-9, 6) AS top_mean, round(sum(value) FILTER (rank_value <= 50) + 1e-9, 6) AS top_sum, max(value) FILTER (rank_value = 50) AS cutoff, count(*) AS n,
    round({_skill("mode", "avg(value) FILTER (rank_value <= 20)")} + 1e-9, 6) AS rating FROM ranked GROUP BY mode, entity_id""")  # fmt: skip
def _(s, d):
    return wt.top_rating(ranked(s, d)).select("mode", "entity_id", *six("top_mean", "top_sum"), "cutoff", "n", *six("rating"))


@query("w19_duplicate_names", raw="SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN count(*) OVER (PARTITION BY lower(c_mktsegment)) > 1 THEN c_mktsegment || ' #' || right(CAST(c_custkey AS VARCHAR), 4) ELSE c_mktsegment END AS name FROM customer")
def _(s, d):
    rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("k"), F.col("c_mktsegment").alias("name"))
    often = rows.groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("n"))  # summed in parts, so that a frequent name is no hot group
    rows = rows.withColumn("low", F.lower("name")).join(often, "low")
    return rows.select("k", F.when(F.col("n") > 1, F.concat("name", F.lit(" #"), F.expr("right(k, 4)"))).otherwise(F.col("name")).alias("name"))


@query("w20_latest_time", "SELECT entity_id, max(recorded_at) AS latest FROM attempts GROUP BY entity_id")
def _(s, d):
    return tb.attempts(s, d).groupBy("entity_id").agg(F.max("recorded_at").alias("latest"))


@query("u4_symmetric_difference", "SELECT count(*) AS n, count(*) FILTER (a IS NULL) AS only_current, count(*) FILTER (c IS NULL) AS only_archive FROM (SELECT DISTINCT entity_id || ':' || item_id AS a FROM attempts WHERE source = 'archive') FULL JOIN (SELECT DISTINCT entity_id || ':' || item_id AS c FROM attempts WHERE source = 'current') ON a = c WHERE a IS NULL OR c IS NULL")
def _(s, d):
    rows = tb.attempts(s, d).select(F.concat("entity_id", F.lit(":"), "item_id").alias("key"), "source")
    sides = rows.groupBy("key").agg(F.max(F.col("source") == "archive").alias("a"), F.max(F.col("source") == "current").alias("c"))
    odd = sides.filter("not (a and c)")
    return odd.agg(F.count("*").alias("n"), F.count_if(~F.col("a")).alias("only_current"), F.count_if(~F.col("c")).alias("only_archive"))


@query("c1_grade", f"SELECT seq, {_grade('score')} AS grade FROM attempts")
def _(s, d):
    return tb.attempts(s, d).select("seq", fx.grade(F.col("score")).alias("grade"))


@query("c3_attempt_value", f"SELECT seq, {_value('mode', 'level', _grade('score'), 'medal')} AS worth FROM valid")
def _(s, d):
    return valid(s, d).select("seq", fx.attempt_value(F.col("mode"), F.col("level"), fx.grade(F.col("score")), fx.medal_name(F.col("medal"))).alias("worth"))


@query("c4_group_rating", f"SELECT seq, floor((120.0::DOUBLE - 0.8::DOUBLE * {_map(_grade('score'), _pen | P.DOUBLE_PENALTIES)} + 0.16::DOUBLE * {_map('medal', _bon | P.DOUBLE_BONUSES)} + 1e-9::DOUBLE) * 100) / 100.0::DOUBLE AS rating FROM attempts WHERE mode = 'CoOp'")
def _(s, d):
    return tb.attempts(s, d).filter("mode = 'CoOp'").select("seq", fx.group_rating(fx.grade(F.col("score")), F.col("medal")).alias("rating"))


@query("c5_skill_rating", f"SELECT seq, round({_skill('mode', 'value')}, 6) AS rating FROM valid")
def _(s, d):
    return valid(s, d).select("seq", F.round(fx.skill_rating(F.col("mode"), F.col("value")), 6).alias("rating"))


_to = "((score / 1e6::DOUBLE * notes_archive - (notes_archive - notes_current)) / notes_current * 1e6::DOUBLE)"


@query("c8_score_normalisation", f"SELECT seq, round(CASE WHEN notes_archive = notes_current THEN score ELSE least(1e6::DOUBLE, greatest(0.0::DOUBLE, {_to})) END, 6) AS normal FROM attempts JOIN items USING (item_id) WHERE source = 'archive'")
def _(s, d):
    notes = tb.items(s, d).select("item_id", "notes_archive", "notes_current")
    rows = tb.attempts(s, d).filter("source = 'archive'").join(notes, "item_id", "left")
    return rows.select("seq", F.round(fx.normal_score(F.col("score"), F.col("notes_archive"), F.col("notes_current")), 6).alias("normal"))


_factor = lambda x: _case(x, [(b, float(v)) for b, v in P.ARCHIVE_FACTORS])


@query("c9_value_reband", f"SELECT seq, round(coalesce(value * {_factor('score - 20000')}::DOUBLE / {_factor('score')}::DOUBLE, value), 6) AS value FROM attempts WHERE source = 'archive'")
def _(s, d):
    rows = tb.attempts(s, d).filter("source = 'archive'")
    return rows.select("seq", F.round(fx.reband(F.col("value"), F.col("score"), F.col("score") - 20000), 6).alias("value"))


@query("c13_ability_weight", f"SELECT seq, round(1 / (1 + power({_skill('mode', 'value')} - level - 0.5, 2)), 6) AS w FROM valid")
def _(s, d):
    return valid(s, d).select("seq", F.round(fx.ability_weight(fx.skill_rating(F.col("mode"), F.col("value")) - F.col("level") - 0.5), 6).alias("w"))


@query("c18_log_miss", "SELECT seq, round(ln(1 + 1e6::DOUBLE - score), 6) AS miss, floor(score / 1e5::DOUBLE * 10 + 1e-9::DOUBLE) / 10.0::DOUBLE AS short FROM attempts")
def _(s, d):
    return tb.attempts(s, d).select("seq", F.round(fx.log_miss(F.col("score")), 6).alias("miss"), fx.one_decimal(F.col("score") / 1e5).alias("short"))


@query(
    "c20_marginal_gain",
    """, ct AS (SELECT mode, entity_id, max(value) FILTER (rank_value = 50) AS cutoff FROM ranked GROUP BY ALL)
    SELECT mode, entity_id, item_id, round(CASE WHEN rank_value <= 50 THEN 5.0 WHEN n < 50 THEN value + 5 ELSE greatest(0, value + 5 - coalesce(cutoff, 0)) END + 1e-9, 6) AS gain FROM ranked JOIN ct USING (mode, entity_id)""",
)
def _(s, d):
    rows = ranked(s, d)
    wanted = rows.select("mode", "entity_id", "item_id", (F.col("value") + 5).alias("worth"))
    return wt.gains(wanted, rows, wt.top_rating(rows), F.col("worth")).select("mode", "entity_id", "item_id", *six("gain"))


@query("c25_keys", f"SELECT DISTINCT entity_id, substr(sha256(entity_id), 1, 16) AS hash, substr(sha256('tier:' || entity_id), 1, 20) AS public_key, {_fold('entity_id')} AS fold FROM attempts")
def _(s, d):
    key = F.col("entity_id")
    return tb.attempts(s, d).select(key).distinct().select(key, fx.short_hash(key).alias("hash"), fx.public_key("tier", key).alias("public_key"), fx.fold(key).alias("fold"))


@query("c35_token_extraction", raw=r"SELECT p_partkey, list_sort(list_distinct(regexp_extract_all(upper(p_brand || ' S' || p_size), '[A-Z]+ ?#?[0-9]+'))) AS tokens FROM part")
def _(s, d):
    text = F.upper(F.concat("p_brand", F.lit(" S"), F.col("p_size").cast("string")))
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z]+ ?#?[0-9]+"), F.lit(0)))).alias("tokens"))


@query("i2_overlap_window", "SELECT seq, entity_id FROM (SELECT *, max(recorded_ts) OVER (PARTITION BY entity_id) AS last FROM attempts) WHERE recorded_ts >= last - INTERVAL 7 DAY")
def _(s, d):
    return up.overlapping(tb.attempts(s, d)).select("seq", "entity_id")


@query("i4_pruning", "SELECT seq FROM attempts SEMI JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS entity_id FROM supplier WHERE s_acctbal > 0) USING (entity_id) SEMI JOIN (SELECT item_id FROM items WHERE level >= 16) USING (item_id)")
def _(s, d):
    people = s.read.parquet(f"{d}/supplier.parquet").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("entity_id"))
    return up.keep_known(tb.attempts(s, d), people, tb.items(s, d).filter("level >= 16")).select("seq")


@query(
    "i7_revisions",
    """, o AS (SELECT item_id, md5(CAST(level AS VARCHAR)) AS h FROM items WHERE mode <> 'CoOp'), w AS (SELECT item_id, md5(CAST(CASE WHEN level = 20 THEN 21 ELSE level END AS VARCHAR)) AS h FROM items WHERE level > 13)
    SELECT item_id, o.h AS row_hash, 1 AS revision, CASE WHEN w.h IS NOT DISTINCT FROM o.h THEN 'open' ELSE 'closed' END AS state FROM o LEFT JOIN w USING (item_id)
    UNION ALL SELECT item_id, w.h, CASE WHEN o.h IS NULL THEN 1 ELSE 2 END, 'open' FROM w LEFT JOIN o USING (item_id) WHERE o.h IS DISTINCT FROM w.h""",
)
def _(s, d):
    rows = tb.items(s, d)
    digest = lambda c: F.md5(c.cast("string").cast("binary")).alias("row_hash")
    past, now = F.lit("2026-01-01").cast("timestamp"), F.lit("2026-02-01").cast("timestamp")
    old = rows.filter("mode <> 'CoOp'").select("item_id", digest(F.col("level")), F.lit(1).alias("revision"), past.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    new = rows.filter("level > 13").select("item_id", digest(F.when(F.col("level") == 20, 21).otherwise(F.col("level"))))
    return up.revisions(old, new, ["item_id"], now).select("item_id", "row_hash", "revision", F.when(F.col("valid_to").isNull(), "open").otherwise("closed").alias("state"))


#: The SQL of a digest: leaves by the first digits of a row's hash, as many as the number of rows asks for, and their parents, where the root stays as it is.
_parent = lambda a, b: f"{b} AS (SELECT substr(p, 1, greatest(length(p) - 1, 0)) AS p, CAST(sum(n) AS BIGINT) AS n, CASE WHEN max(length(p)) = 0 THEN max(d) ELSE sha256(string_agg(right(p, 1) || ':' || d, ',' ORDER BY p)) END AS d FROM {a} GROUP BY 1)"
_depth = "CASE " + " ".join(f"WHEN c <= {up.LEAF * 16**k} THEN {k}" for k in range(6)) + " END"
DIGEST = f""", h AS (SELECT h, count(*) AS m FROM (SELECT sha256(concat_ws('|', entity_id, item_id, CAST(seq AS VARCHAR))) AS h FROM attempts) GROUP BY h), dp AS (SELECT {_depth} AS depth FROM (SELECT sum(m) AS c FROM h)),
    d0 AS (SELECT substr(h, 1, depth) AS p, sum(m) AS n, sha256(string_agg(h || ':' || m, ',' ORDER BY h)) AS d FROM h, dp GROUP BY 1), {", ".join(_parent(f"d{k}", f"d{k + 1}") for k in range(6))}
    SELECT n, d AS digest FROM d6"""


@query(
    "i9_table_digest",
    DIGEST,
)
def _(s, d):
    return up.table_digest(tb.attempts(s, d), "entity_id", "item_id", "seq")


@query("i10_reconciliation", "SELECT CASE WHEN level = 20 THEN 'changed' WHEN mode = 'CoOp' THEN 'missing' ELSE 'exact' END AS verdict, count(*) AS n FROM items GROUP BY 1")
def _(s, d):
    rows = tb.items(s, d)
    right = rows.filter("mode <> 'CoOp'").select("item_id", F.when(F.col("level") == 20, -1).otherwise(F.col("level")).alias("row_hash"))
    return up.reconcile(rows.select("item_id", F.col("level").alias("row_hash")), right, ["item_id"])


@query("i16_event_conflicts", raw="SELECT user_id AS event_id, count(*) AS n, count(DISTINCT event_type) > 1 AS conflict FROM events GROUP BY user_id")
def _(s, d):
    return up.duplicate_events(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("event_id"), F.col("event_type").alias("body")))


@query("i17_minute_requests", raw="SELECT user_id, event_id, date_trunc('minute', ts) AS minute FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR ts >= b + INTERVAL 60 SECOND")
def _(s, d):
    return up.minute_requests(s.read.parquet(f"{d}/events.parquet"))


@query(
    "a31_latency_summary",
    raw="""SELECT event_type, n, max(value) FILTER (r = ceil(n * 0.5::DOUBLE)) AS p50, max(value) FILTER (r = ceil(n * 0.95::DOUBLE)) AS p95, CASE WHEN n >= 100 THEN max(value) FILTER (r = ceil(n * 0.99::DOUBLE)) END AS p99, max(value) AS most
    FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type, n""",
)
def _(s, d):
    return up.latency_summary(s.read.parquet(f"{d}/events.parquet"), ["event_type"], "value")
