"""URL filters: a list of rules by host and path, and beyond it rules of token combinations that FP-growth mines from labelled URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, written

#: (host, path, verdict) of the list (fixed values of the contract).
LIST = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Verdict where neither the list nor a mined rule speaks.
ELSE = "allow"
#: Labelled URLs that have a combination (a share of all, and a number), share of them with the same label, and how many times their share among all URLs that is.
SUPPORT, LEAST, CONFIDENCE, LIFT = 0.01, 5, 0.9, 1.05
#: Marks a label among the tokens; no token begins with it.
LABEL = "="

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for a null and without it."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """Up to the path, the query, the fragment or the end; A to Z lowered."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host up to the query, the fragment or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str, str]] = LIST) -> Column:
    """(rule, verdict) of the longest rule that the host, or a domain above it, and the beginning of the path fit; null if none does."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for domain, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first, so it is put on top last
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The different tokens of a URL, ten at most whatever its length: the last one, two and three labels of the host and its first one, the first two parts of the path, its ending and depth, the first parameter's name, and the scheme."""
    some = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x))
    labels, steps = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    last = lambda n: F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), "."))
    at = lambda n: F.try_element_at(steps, F.lit(n))
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^=&#]*)", 1)
    found = F.array(
        *[F.when(host != "", some("host ", last(n))) for n in (1, 2, 3)], some("sub ", F.when(F.size(labels) >= 3, F.element_at(labels, 1))), some("1 ", at(1)), some("2 ", at(2)),
        some("ending ", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})/?$", 1)), F.when(host != "", F.concat(F.lit("depth "), F.least(F.size(steps), F.lit(5)).cast("string"))),
        some("query ", query), some("scheme ", F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)),
    )
    return F.array_distinct(F.array_compact(found))


def mined(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """(tokens, verdict, confidence, n): combinations of tokens whose labelled URLs, ``n`` with the verdict, agree on it; ``labelled`` has (tokens, verdict), a row for each URL.

    FP-growth finds all combinations that a share of ``support`` of the URLs, and ``least`` of them, have. Those stay whose rule has ``confidence`` and ``lift``, and for which no part of the combination alone
    gives the same verdict with as much confidence. A URL has ten tokens at most, so there are at most 2 ** 10 / ``support`` combinations, whatever the number of URLs. Rows with nulls aren't labelled;
    without rows there are no rules.
    """
    rows = labelled.filter(F.col("tokens").isNotNull() & F.col("verdict").isNotNull()).select(F.array_append("tokens", F.concat(F.lit(LABEL), "verdict")).alias("items"))
    rows = settled(rows)  # read by each of its passes
    if not (n := rows.count()):
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, n long")
    model = FPGrowth(itemsCol="items", minSupport=max(support, least / n) if least < n else 1.0, minConfidence=confidence).fit(rows)
    end = F.element_at("consequent", 1)
    whole = F.startswith(end, F.lit(LABEL)) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit(LABEL)))
    found = model.associationRules.filter(whole & (F.col("lift") >= lift)).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(end, len(LABEL) + 1, 100).alias("verdict"), "confidence", F.round(F.col("support") * n).cast("long").alias("n"),
    )
    found = settled(found)
    # a rule is looked up by each of its tokens, as pages are: parts of it are rules all of whose tokens it has
    parts = found.select(F.explode("tokens").alias("token"), F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("part_confidence"))
    by_token = found.select(F.explode("tokens").alias("token"), "tokens", "verdict", "confidence")
    same = by_token.join(parts, ["token", "verdict"]).filter((F.size("part") < F.size("tokens")) & (F.col("part_confidence") >= F.col("confidence")))
    needless = same.groupBy("tokens", "verdict", "part").agg(F.count("*").alias("met")).filter(F.col("met") == F.size("part")).select("tokens", "verdict").distinct()
    return settled(found.join(needless, ["tokens", "verdict"], "left_anti"))


def indexed(rules: DataFrame, seen: DataFrame) -> DataFrame:
    """(token, rule): the inverted index, in which a rule is under that of its tokens that the fewest URLs of ``seen`` (tokens) have."""
    counts = seen.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("seen"))
    places = rules.select(F.explode("tokens").alias("token"), F.struct(*rules.columns).alias("rule")).join(counts, "token")
    return places.groupBy("rule").agg(F.min_by("token", F.struct("seen", "token")).alias("token")).select("token", "rule")


def judged(pages: DataFrame, index: DataFrame) -> DataFrame:
    """``pages`` (row, tokens and others) with ``mined``, the rule of most confidence, then URLs, that each one's tokens fit; null if none does.

    A page only meets rules in the index under one of its tokens, and such a rule fits if the page has its other tokens too; one without tokens meets none. The index should be a table whose size Spark knows: rules are bounded as ``mined`` says, so it is broadcast where it is as small as it mostly is.
    """
    candidates = pages.select("*", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("rule.tokens", "tokens")) == 0)
    rule = F.col("rule")
    best = candidates.groupBy("row").agg(F.max(F.struct(rule["confidence"].alias("confidence"), rule["n"].alias("n"), rule["verdict"].alias("verdict"), F.array_join(rule["tokens"], " & ").alias("tokens"))).alias("mined"))
    return pages.join(best, "row", "left")


def filtered(pages: DataFrame, labelled: list[DataFrame], rules: list[tuple[str, str, str]] = LIST, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) of every page: the list's verdict where it has one, else that of the mined rule of most confidence, else ELSE.

    ``labelled`` are tables (url, verdict), each of which is mined by itself. A null URL, or one without ``://``, has an empty host and path, fits no rule and has no tokens. Repeated rows are judged alike, columns
    other than key and url play no part, and an empty table gives an empty one; without labels, nothing is mined.
    """
    u = F.col("url")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({"host": host(u), "path": path(u)}).withColumns({"tokens": tokens(u, F.col("host"), F.col("path")), "listed": listed(F.col("host"), F.col("path"), rules)})
    own = [t.select(tokens(F.col("url"), host(F.col("url")), path(F.col("url"))).alias("tokens"), "verdict").filter(F.size("tokens") > 0) for t in labelled]
    if own:
        index = indexed(reduce(DataFrame.union, [mined(t) for t in own]), reduce(DataFrame.union, [t.select("tokens") for t in own]))
        asked = rows.withColumn("tokens", F.when(F.col("listed").isNull(), F.col("tokens")))  # the list goes first
        rows = judged(asked, written(index))
    else:
        rows = rows.withColumn("mined", F.lit(None).cast("struct<confidence: double, n: long, verdict: string, tokens: string>"))
    verdict = F.coalesce("listed.verdict", "mined.verdict", F.lit(ELSE))
    beyond = lambda c: F.when(F.col("listed").isNull(), F.col("mined")[c])
    return rows.select("page_id", "host", "path", F.col("listed")["rule"].alias("rule"), verdict.alias("verdict"), beyond("tokens").alias("mined"), beyond("confidence").alias("confidence"))


def by_list(pages: DataFrame, rules: list[tuple[str, str, str]] = LIST) -> DataFrame:
    """(url, verdict) of the pages on which the list speaks."""
    found = pages.select("url", listed(host(F.col("url")), path(F.col("url")), rules)["verdict"].alias("verdict"))
    return found.filter("verdict is not null")


def by_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, verdict) of the pages that ``labels`` names by their number: those of no quality, or toxic ones, are to be blocked."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when(bad, "block").otherwise("allow")).alias("verdict"))
    return pages.select("page_id", "url").join(marks, "page_id").select("url", "verdict")


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, with rules mined from the list's verdicts, which they carry over to hosts that it doesn't name, and from ``labels``."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return filtered(pages.select("page_id", "url"), [by_list(pages), by_labels(pages, labels)])


_up = "translate({}, '" + UPPER + "', '" + LOWER + "')"
_rules = sorted(LIST, key=lambda r: -len(r[0] + r[1]))
_fits = lambda d, p: f"((host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}'))"
_of = lambda i: "CASE " + " ".join(f"WHEN {_fits(d, p)} THEN '{(d + p, v)[i]}'" for d, p, v in _rules) + " END"
#: Combinations are all subsets of each labelled URL's frequent tokens, by the bits of a number.
OP11_SQL = f"""
WITH u AS (SELECT page_id, url, row_number() OVER () AS r, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, {_up.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT *, {_of(0)} AS rule, {_of(1)} AS listed, string_split(host, '.') AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS st,
  regexp_extract(rest, '^[^?#]*\\?([^=&#]*)', 1) AS q, regexp_extract(path, '\\.([A-Za-z0-9]{{1,8}})/?$', 1) AS e, coalesce(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '') AS s FROM h),
t AS (SELECT page_id, r, host, path, rule, listed, list_distinct(list_filter([CASE WHEN host <> '' THEN 'host ' || ls[-1] END, CASE WHEN len(ls) >= 2 THEN 'host ' || array_to_string(ls[-2:], '.') END,
  CASE WHEN len(ls) >= 3 THEN 'host ' || array_to_string(ls[-3:], '.') END, CASE WHEN len(ls) >= 3 AND ls[1] <> '' THEN 'sub ' || ls[1] END, '1 ' || st[1], '2 ' || st[2], CASE WHEN e <> '' THEN 'ending ' || e END,
  CASE WHEN host <> '' THEN 'depth ' || least(len(st), 5) END, CASE WHEN q <> '' THEN 'query ' || q END, CASE WHEN s <> '' THEN 'scheme ' || s END], lambda x: x IS NOT NULL)) AS tokens FROM l),
lab AS (SELECT 1 AS kind, r, tokens, listed AS verdict FROM t WHERE listed IS NOT NULL AND len(tokens) > 0 UNION ALL
  SELECT 2, r, tokens, b.verdict FROM t JOIN (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 'block' ELSE 'allow' END) AS verdict FROM labels GROUP BY 1) b ON page_id = b.doc_id WHERE len(tokens) > 0),
n AS (SELECT kind, count(*) AS n, CASE WHEN {LEAST} < count(*) THEN ceil(greatest({SUPPORT}::DOUBLE, {LEAST}::DOUBLE / count(*)) * count(*)) ELSE count(*) END AS least FROM lab GROUP BY kind),
f AS (SELECT kind, token FROM (SELECT kind, token, count(*) AS m FROM (SELECT kind, unnest(tokens) AS token FROM lab) GROUP BY ALL) JOIN n USING (kind) WHERE m >= least),
o AS (SELECT kind, r, verdict, list_sort(list(token)) AS own FROM (SELECT kind, r, verdict, unnest(tokens) AS token FROM lab) JOIN f USING (kind, token) GROUP BY ALL),
b AS (SELECT kind, verdict, list_filter(own, lambda x, i: (bits >> (i - 1)::INT) & 1 = 1) AS tokens FROM (SELECT *, unnest(generate_series(1, (1 << len(own)::INT) - 1)) AS bits FROM o)),
c AS (SELECT kind, tokens, count(*) AS a, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'block') AS block FROM b GROUP BY ALL),
v AS (SELECT kind, count(*) FILTER (verdict = 'allow') AS allow, count(*) FILTER (verdict = 'block') AS block FROM lab GROUP BY kind),
m AS (SELECT c.kind, tokens, 'allow' AS verdict, c.allow AS m, c.allow / c.a AS conf, (c.allow / c.a) / (v.allow / n.n) AS lift, least FROM c JOIN v USING (kind) JOIN n USING (kind) UNION ALL
  SELECT c.kind, tokens, 'block', c.block, c.block / c.a, (c.block / c.a) / (v.block / n.n), least FROM c JOIN v USING (kind) JOIN n USING (kind)),
g AS (SELECT * FROM m WHERE m >= least AND conf >= {CONFIDENCE} AND lift >= {LIFT}),
k AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g p WHERE p.kind = g.kind AND p.verdict = g.verdict AND len(p.tokens) < len(g.tokens) AND p.conf >= g.conf AND list_has_all(g.tokens, p.tokens))),
w AS (SELECT r, max(ROW(conf, m, verdict, array_to_string(k.tokens, ' & '))) AS best FROM t JOIN k ON list_has_all(t.tokens, k.tokens) WHERE listed IS NULL GROUP BY r)
SELECT page_id, host, path, rule, coalesce(listed, best[3], '{ELSE}') AS verdict, best[4] AS mined, best[1] AS confidence FROM t LEFT JOIN w USING (r)"""
