"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, unnamed, written

#: Bytes of text that a shard may hold, bits of a row's hash, and levels that are summed in one turn.
LIMIT, BITS, STEP = 4 << 20, 60, 8


def hash_code(key: Column) -> Column:
    """The first BITS bits of the MD5 of ``key`` (string) as a long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def split_buckets(coded: DataFrame, limit: int) -> DataFrame:
    """Buckets (part, depth, prefix, shard_bytes, shard_docs) of ``coded`` (part, code, n_bytes): only oversized ones split on another bit.

    A bucket is the shortest prefix of the codes of a part that holds ``limit`` bytes or one row at most, or a whole code if even that holds more.
    A turn sums the sizes at STEP more bits with partial sums, from there those of the levels between, and the next turn
    only takes up the codes of prefixes that are still too large.
    """
    found, depth, open_ = [], 0, coded
    large = (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    while True:
        deep = min(depth + STEP, BITS)
        fine = open_.groupBy("part", F.shiftrightunsigned("code", BITS - deep).alias("p")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        level = F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("depth")
        nodes = fine.select("part", "p", "b", "n", level).withColumn("prefix", F.expr(f"shiftrightunsigned(p, {deep} - depth)"))
        sizes = settled(nodes.groupBy("part", "depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")))
        twice = F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix")
        children = sizes.filter(large).select("part", (F.col("depth") + 1).alias("depth"), twice)
        reached = sizes.join(children, ["part", "depth", "prefix"], "left_semi")
        if depth == 0:
            reached = reached.union(sizes.filter("depth = 0"))
        found.append(reached.filter(~large | (F.col("depth") == BITS)))
        rest = sizes.filter(large & (F.col("depth") == deep)).select("part", F.col("prefix").alias("p"))
        if deep == BITS or rest.isEmpty():
            break
        open_ = open_.withColumn("p", F.shiftrightunsigned("code", BITS - deep)).join(rest, ["part", "p"], "left_semi").select("part", "code", "n_bytes")
        depth = deep
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def directory(buckets: DataFrame) -> DataFrame:
    """``buckets`` (part, depth, prefix, ...) with bits and entry: where the first bits of a code lead.

    Of n buckets of a part the directory has as many bits as n entries need, so that there are 2 n entries at most for buckets of fewer bits, which
    stand at all entries that begin with theirs; those of more bits stand at the entry that they begin with, and are told apart by the rest of theirs.
    """
    n = settled(buckets.groupBy("part").agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("bits")))
    wide = buckets.join(n, "part").withColumn("over", F.greatest(F.col("bits") - F.col("depth"), F.lit(0)))
    entries = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, over) - 1"))).alias("i")
    first = F.expr("shiftleft(shiftrightunsigned(prefix, greatest(depth - bits, 0)), over) + i")
    return wide.select("*", entries).withColumn("entry", first).drop("over", "i")


def assign_shards(df: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with shard (its hash prefix as binary digits, "" for the root), local_depth, n_bytes, shard_bytes and shard_docs.

    Rows go by the MD5 of their key, those with a null key by their text's; a null text has no bytes. Each row finds its shard by an equi-join on
    its entry in the directory, which Spark broadcasts if it is small. Rows with equal hashes (repeated rows and keys) whose bucket is still too large
    at the full depth split on the bits of a second hash, of a number that each gets;
    their shard's digits and depth go on after the first BITS. So a shard exceeds ``limit`` only if it is a single row that does. An empty table
    stays empty. Columns of ``df`` with the names of the added ones are replaced.
    """
    added = ["shard", "local_depth", "n_bytes", "shard_bytes", "shard_docs"]
    plain, column = unnamed(df)
    kept = [(column[c], c) for c in df.columns if c not in added]
    first = hash_code(F.coalesce(F.col(column[key]).cast("string"), F.md5(F.col(column[text]).cast("binary")), F.lit("")))
    size = F.coalesce(F.octet_length(F.col(column[text]).cast("string")), F.lit(0)).cast("long")
    rows = plain.select("*", first.alias("code"), size.alias("n_bytes"))
    buckets = settled(split_buckets(rows.select(F.lit(-1).cast("long").alias("part"), "code", "n_bytes"), limit))
    full = buckets.filter((F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)).select(F.col("prefix").alias("code"))
    digits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    whole = written(directory(buckets).withColumn("shard", digits))
    bits = whole.agg(F.max("bits")).first()[0] or 0  # the same in all rows
    rows = rows.withColumn("entry", F.shiftrightunsigned("code", BITS - bits))
    inside = F.expr(f"shiftrightunsigned(code, {BITS} - depth) = prefix")
    columns = [c for c, _ in kept] + added
    if full.isEmpty():
        found = rows.join(whole.drop("bits"), "entry").filter(inside).withColumnRenamed("depth", "local_depth").select(*columns)
    else:  # few codes, with rows that their bits can't part
        hot = rows.drop("entry").join(full, "code", "left_semi")
        hot = written(hot.withColumn("place", hash_code(F.monotonically_increasing_id().cast("string"))))  # places are kept, so that they stay the same
        again = settled(split_buckets(hot.select(F.col("code").alias("part"), F.col("place").alias("code"), "n_bytes"), limit))
        more = written(directory(again).withColumn("shard", digits))
        found = rows.join(full, "code", "left_anti").join(whole.drop("bits"), "entry").filter(inside).withColumnRenamed("depth", "local_depth").select(*columns)
        hot = hot.join(more.groupBy(F.col("part").alias("code")).agg(F.max("bits").alias("bits")), "code")
        hot = hot.withColumn("entry", F.expr(f"shiftrightunsigned(place, {BITS} - bits)")).drop("bits")
        hot = hot.join(more.drop("bits").withColumnRenamed("part", "code"), ["code", "entry"]).filter(f"shiftrightunsigned(place, {BITS} - depth) = prefix")
        hot = hot.withColumns({"shard": F.concat(F.expr(f"lpad(bin(code), {BITS}, '0')"), "shard"), "local_depth": F.col("depth") + BITS})
        found = found.union(hot.select(*columns))
    return found.toDF(*[c for _, c in kept], *added)


def write_shards(df: DataFrame, path: str, **options) -> None:
    """The shards of ``df`` as folders shard=... of Parquet files."""
    sharded = assign_shards(df, **options)
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every row of ``documents``, with the default limit."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "shard", "local_depth", "n_bytes", "shard_bytes", "shard_docs")


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, {BITS // 4}) AS BIGINT) AS code FROM documents),
x AS (SELECT unnest(range(0, {BITS + 1})) AS depth),
s AS (
  SELECT depth, code >> ({BITS} - depth) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
  FROM d, x GROUP BY ALL),
leaf AS (
  SELECT s.* FROM s LEFT JOIN s AS p ON p.depth = s.depth - 1 AND p.prefix = s.prefix >> 1
  WHERE (s.shard_bytes <= {LIMIT} OR s.shard_docs = 1 OR s.depth = {BITS}) AND (s.depth = 0 OR p.shard_bytes > {LIMIT} AND p.shard_docs > 1))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(ltrim(bin(prefix), '0'), CAST(depth AS INTEGER), '0') END AS shard,
  CAST(depth AS INTEGER) AS local_depth, n_bytes, shard_bytes, shard_docs
FROM leaf JOIN d ON code >> ({BITS} - depth) = prefix
"""
