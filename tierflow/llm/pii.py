"""Personal data: candidates from wide generators, scored by boosted trees that run as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settled, texts_of

#: Kinds in the order of their listing; those of the contract first.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Generators by kind: (pattern, whether the contract's rules apply to its matches). Those of the contract are fixed by it; a start
#: that can't be the leftmost is ruled out first, so that long runs take linear time, and repeated groups are possessive, as Java's
#: regex calls itself for each repetition of others. Nothing follows them that they could give back to.
GENERATORS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", True),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    ("email", r"(?<![^\s<>(),;:])[^\s@<>(),;:]++@[^\s@<>(),;:]++", False),
    ("phone", r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,4}){2,4}(?![0-9A-Za-z])", False),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", False),
    ("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+", False),
]
#: Candidates that the trees are fitted on (at most about as many, by hash, the same number of each kind and label), trees, depth, share of right ones
#: that a threshold promises.
SAMPLE, TREES, DEPTH, PRECISION = 20_000, 12, 3, 0.95
#: Parts of the labelled candidates, without each of which trees are fitted.
FOLDS = 3
FEATURES = (
    "length", "digits", "letters", "capitals", "hex", "groups", "widest", "dots", "dashes", "spaces", "slashes", "changes", "plus", "at", "dot after at", "zero",
    "word before", "word after", "colon before", "quote before", "line start", *KINDS,
)
#: What labels a candidate, by the words right before it: those that name its kind, and those that name something else. The features don't see these words.
NAMES = {
    "email": r"(?i)\b(e-?mail|mail|mailto|correo|courriel|contact|adresse?)\W{0,4}$", "ip": r"(?i)\b(ip|ipv[46]|host|server|address|adresse|gateway|client)\W{0,4}$",
    "card": r"(?i)\b(card|karte|tarjeta|carte|visa|mastercard|amex|kreditkarte|account|konto)\W{0,4}$",
    "phone": r"(?i)\b(tel|telefon|telefono|t\u00e9l\u00e9phone|phone|fon|call|mobile|mobil|cell|fax|whatsapp|dial)\W{0,4}$",
    "secret": r"(?i)(token|key|secret|passw(or)?d|pwd|bearer|credential|api)\W{0,4}$",
}
OTHER = (
    r"(?i)(\b(version|ver|release|build|isbn|issn|order|invoice|rechnung|factura|facture|ticket|ref|page|pages|pp|section|chapter|date|datum|fecha|year|since|until|size|range|"
    r"commit|sha[0-9]*|md5|hash|checksum|digest|uuid|guid|id|at|v|no|nr|number|total|sum|price)|[$\u20ac\u00a3#])\W{0,4}$"
)
#: Matches that are taken up together while their places are summed, and characters before a match that are its context.
PART, CONTEXT = 128, 24


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, found, before, after) for the matches from left to right, in code points, end exclusive.

    ``before`` are up to CONTEXT characters of the match before and of what lies between, ``after`` is the next character; both come from the pieces that the text is
    split into, as looking up a place in a long text takes as long as the text before it. Places are summed within parts of PART matches, then over the parts, so that a
    text of n matches takes n * PART and (n / PART) ** 2 steps.
    """
    kind = "array<struct<start:int,end:int,found:string,before:string,after:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    tail = lambda x: F.when(F.length(x) > CONTEXT, x.substr(F.lit(-CONTEXT), F.lit(CONTEXT))).otherwise(x)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["piece"])
        end = start + F.length(x["found"])
        before = tail(F.concat(tail(x["last"]), tail(x["piece"])))
        after = F.when(x["follow"] == "", F.coalesce(x["next"], F.lit(""))).otherwise(x["follow"]).substr(1, 1)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["found"].alias("found"), before.alias("before"), after.alias("after")))
        return F.struct(end.alias("at"), F.concat(a["out"], one).alias("out"))

    def whole(rows: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / PART).cast("int")), lambda k: F.aggregate(F.slice(rows, k * PART + 1, F.lit(PART)), zero, step))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        # a lambda's argument is evaluated once, where a column that is named again may not be
        return F.transform(F.array(parts), lambda p: F.flatten(F.zip_with(p, F.aggregate(p, first, base)["out"], moved)))[0]

    base = lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    moved = lambda x, n: F.transform(x["out"], lambda m: F.struct((m["start"] + n).alias("start"), (m["end"] + n).alias("end"), *[m[c].alias(c) for c in ("found", "before", "after")]))
    split = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"))

    def placed(x: Column) -> Column:
        p, f = x["p"], x["f"]
        none, n = F.array(F.lit("")), F.size(f)
        rows = F.arrays_zip(p.alias("piece"), f.alias("found"), F.slice(p, F.lit(2), n).alias("follow"), F.slice(f, F.lit(2), n).alias("next"), F.concat(none, f).alias("last"))
        rows = F.filter(rows, lambda m: m["found"].isNotNull())
        return F.transform(F.array(rows), lambda r: F.when(F.size(r) <= PART, F.aggregate(r, zero, step)["out"]).otherwise(whole(r)))[0]

    return F.transform(F.array(split), placed)[0]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
    twice = lambda i: F.when(i % 2 == 1, value(i)).otherwise(F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i)))
    return F.aggregate(at, F.lit(0), lambda a, i: a + twice(i)) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    """The contract's rule for a match of a kind."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":  # leading zeros don't count; what is longer than three digits is over 255
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(found, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found) for each row: the candidates of all generators as (kind, start, end, base, label, features)."""
    text = F.coalesce("text", F.lit(""))
    count = lambda x, p: F.length(F.regexp_replace(x, p, "")).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")

    def describe(m: Column, kind: str, ruled: bool) -> Column:
        x = m["found"]
        before = m["before"]
        rule = passes(kind, x) if kind != "secret" and ruled else F.lit(False)
        named, other = before.rlike(NAMES[kind]), before.rlike(OTHER)
        known = F.when(named & ~other, F.lit(True)).when((other | ~rule if ruled else other) & ~named, F.lit(False))
        runs = F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
        features = [
            F.length(x).cast("double"), count(x, "[^0-9]"), count(x, "[^A-Za-z]"), count(x, "[^A-Z]"), count(x, "[^A-Fa-f0-9]"), F.size(runs).cast("double"),
            F.coalesce(F.array_max(F.transform(F.slice(runs, 1, 16), lambda r: F.length(r))), F.lit(0)).cast("double"), count(x, "[^.]"), count(x, "[^-]"), count(x, r"[^\x20]"), count(x, "[^/]"),
            F.size(F.regexp_extract_all(x, F.lit("[A-Za-z](?=[0-9])"), F.lit(0))).cast("double"), flag(x.startswith("+")), flag(x.contains("@")), flag(x.rlike(r"@.*\.\p{L}{2,}$")), flag(x.startswith("0")),
            flag(before.rlike(r"\w$")), flag(m["after"].rlike(r"\w")),
            flag(before.rlike(r"[:=]\W{0,3}$")), flag(before.rlike("[\"']$")), flag((before == "") | before.rlike(r"\n\s*$")),
            *[F.lit(float(kind == k)) for k in KINDS],
        ]
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), rule.alias("base"), known.alias("label"), F.array(*features).alias("features")
        )

    def generate(kind: str, pattern: str, ruled: bool) -> Column:
        needs = text.contains("@") if kind == "email" else text.rlike("[0-9]")
        raw = F.when(needs, spans(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string,before:string,after:string>>"))
        return F.transform(raw, lambda m: describe(m, kind, ruled))

    return docs.select("doc_id", F.concat(*[generate(*g) for g in GENERATORS]).alias("found"))


def _tree(node, x: Column) -> Column:
    """A fitted tree as a column expression over the features ``x``."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[split.featureIndex()] <= float(split.threshold()), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def fit(found: DataFrame, sample: int = SAMPLE) -> tuple[object, dict[int, float]]:
    """(trees as a function from features to a margin, thresholds by kind), or (None, {}) without examples of both sorts.

    Right ones are candidates of any generator right after words that name their kind, wrong ones those right after words that name something else
    (a version, an order, a date, a commit) and, without words that name them, matches of the contract's generators that fail its rules; the rest have no label, those that
    pass the rules too. The features don't see those words, so the trees have to
    tell right from wrong by format and by other context. Each kind and label has an equal part of ``sample``, taken by hash. Labelled candidates fall into FOLDS parts, and
    trees are fitted without each part in turn, so that all of them calibrate, each by trees that haven't seen it: by kind, the share of right ones at each margin is made monotone (isotonic regression),
    and the threshold is the lowest margin at which it is at least PRECISION. A candidate's margin is the mean of all trees'. A kind without right ones has no threshold and gets no spans added.
    """
    rows = found.select("doc_id", F.explode("found").alias("c")).filter("c.label is not null")
    key = F.xxhash64("doc_id", "c.kind", "c.start", "c.end")
    rows = rows.select(key.alias("key"), "c.kind", "c.features", F.col("c.label").cast("double").alias("label"))
    sizes = {(r.kind, r.label): r.n for r in rows.groupBy("kind", "label").agg(F.count("*").alias("n")).collect()}
    if len({label for _, label in sizes}) < 2:
        return None, {}
    share = F.create_map(*[F.lit(v) for (k, x), n in sizes.items() for v in (k * 2 + int(x), min(1.0, sample / len(sizes) / n))])
    fraction = F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))
    stratum = (F.col("kind") * 2 + F.col("label")).cast("int")
    fits, fold = fraction <= F.element_at(share, stratum), F.pmod("key", F.lit(FOLDS)).cast("int")
    rows = settled(rows.select("kind", "label", "features", fits.alias("fits"), fold.alias("fold")))
    margins = []
    for k in range(FOLDS):
        train = rows.filter((F.col("fold") != k) & F.col("fits")).withColumn("vector", array_to_vector("features"))
        if train.select("label").distinct().count() < 2:
            return None, {}
        model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=1, maxBins=32, cacheNodeIds=False).fit(train)
        parts = [(float(w), t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)]
        margins.append(lambda x, parts=parts: reduce(lambda a, b: a + b, [F.lit(w) * _tree(root, x) for w, root in parts]))
    apart = F.lit(None).cast("double")
    for k in range(FOLDS):
        apart = F.when(F.col("fold") == k, margins[k](F.col("features"))).otherwise(apart)
    counts = rows.select("kind", "label", F.round(apart, 2).alias("margin")).groupBy("kind", "label", "margin").agg(F.count("*").alias("n")).collect()
    steps: dict[tuple[int, float], list[float]] = {}
    for r in counts:
        step = steps.setdefault((r.kind, r.margin), [0.0, 0.0])
        step[0] += r.label * r.n
        step[1] += r.n
    best: dict[int, float] = {}
    for kind in {k for k, _ in steps}:
        curve = calibrated([(m, *x) for (k, m), x in sorted(steps.items()) if k == kind])
        if sure := [m for m, p in curve if p >= PRECISION]:
            best[kind] = min(sure)
    return lambda x: reduce(lambda a, b: a + b, [m(x) for m in margins]) / len(margins), best


def calibrated(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(margin, probability) from (margin, right, all) in ascending order: the monotone curve that fits best (pool adjacent violators)."""
    blocks: list[list] = []
    for m, right, n in points:
        blocks.append([[m], right, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            margins, r, k = blocks.pop()
            blocks[-1][0] += margins
            blocks[-1][1] += r
            blocks[-1][2] += k
    return [(m, r / n) for margins, r, n in blocks for m in margins]


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, base, added) for each row of ``docs`` (doc_id, text): arrays of (start, kind, end), kind a number in KINDS.

    ``base`` are the matches of the contract's generators that pass its rules. ``added`` are candidates of the other
    generators, and matches that failed, whose margin reaches their kind's threshold; of overlapping ones the one with the larger margin stays, then the
    first in (start, kind, end), and none overlaps a base span. Null, empty and wordless texts have none. Repeated rows each get theirs, an empty table
    gives an empty result, other columns play no part. All work on texts is in column expressions of one pass without a shuffle; candidates are few and are kept as a checkpoint. Spans are held against
    each other in the order of their starts by running maxima, so a text takes time in proportion to its candidates; only candidates that overlap in a chain, all over their thresholds, are compared with one another.
    """
    found = settled(candidates(texts_of(docs)).withColumn("row", F.monotonically_increasing_id()))
    margin, best = fit(found, sample)
    m = lambda c: F.when(~c["base"], -margin(c["features"])) if best else F.lit(None).cast("double")
    # margins are found within the array, each once, so that no filter repeats the trees
    scored = F.transform("found", lambda c: F.struct(c["base"].alias("base"), F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")).alias("span"), m(c).alias("m")))
    limit = F.create_map(*[F.lit(v) for k, m in (best or {-1: 0.0}).items() for v in (k, m)])
    rows = found.select("row", F.inline(scored)).filter(F.col("base") | F.coalesce(F.round(-F.col("m"), 2) >= F.element_at(limit, F.col("span")["kind"]), F.lit(False)))
    start, end, by = F.col("span")["start"], F.col("span")["end"], Window.partitionBy("row")
    # a range up to a start takes in all that begin there
    reach = F.max(F.when(F.col("base"), end)).over(by.orderBy(start.asc()))
    follow = F.min(F.when(F.col("base"), start)).over(by.orderBy(start.desc()))
    rows = rows.withColumn("free", ~F.col("base") & F.coalesce(reach <= start, F.lit(True)) & F.coalesce(follow >= end, F.lit(True)))
    free = Window.partitionBy("row", "free").orderBy(start.asc(), end.asc())
    over = F.max(end).over(free.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("first", F.coalesce((over <= start).cast("int"), F.lit(1))).withColumn("chain", F.sum("first").over(free.rowsBetween(Window.unboundedPreceding, 0)))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    apart = lambda a, b: (a["end"] <= b["start"]) | (b["end"] <= a["start"])
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("free"), F.struct("m", "span")))), lambda c: c["span"])
    chosen = F.aggregate(ordered, none, lambda a, c: F.when(F.exists(a, lambda b: ~apart(b, c)), a).otherwise(F.concat(a, F.array(c))))
    # base spans and those that overlap them are in one group for each text, which its length bounds; free ones are by chain
    chains = rows.groupBy("row", F.when(F.col("free"), F.col("chain")).alias("chain")).agg(F.collect_list(F.when(F.col("base"), F.col("span"))).alias("base"), chosen.alias("added"))
    every = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    out = found.select("row", "doc_id").join(chains.groupBy("row").agg(every("base").alias("base"), every("added").alias("added")), "row", "left")
    return out.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def digest(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda c: F.concat_ws(":", F.element_at(name, c["kind"] + 1), c["start"], c["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9 over the whole ``documents``."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    every = F.array_sort(F.concat("base", "added"))
    return out.select(
        "doc_id", *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(every).alias("spans"), F.size(every).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added"),
    )
