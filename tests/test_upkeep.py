"""Digest trees, reconciliation by them, and titles that meet at their rarest word."""

import pytest
from pyspark.sql import functions as F

from tierflow.operators import linking as ln
from tierflow.operators import upkeep as up


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(700).selectExpr("id", "cast(id % 7 as string) as x").union(spark.range(40).selectExpr("cast(5 as long)", "'same'"))


def test_digest_tells_tables_apart_whatever_their_order(spark, rows):
    one = lambda t, **k: up.table_digest(t, "id", "x", **k).first()
    for leaf in (1, 8, 1000):
        a = one(rows, leaf=leaf)
        assert a.n == 740 and a == one(rows.repartition(3, "x"), leaf=leaf)
        assert a != one(rows.filter("id <> 699 or x = 'same'"), leaf=leaf) and a.digest != one(rows.union(spark.createDataFrame([(5, "same")], "id long, x string")), leaf=leaf).digest
    none = one(rows.limit(0))
    assert none.n == 0 and len(none.digest) == 64


def test_trees_name_the_leaves_that_differ(spark, rows):
    hashes = rows.select(up.row_hash("id", "x").alias("h"))
    other = rows.filter("id <> 13").withColumn("x", F.when(F.col("id") == 77, "new").otherwise(F.col("x"))).select(up.row_hash("id", "x").alias("h"))
    depth = up.tree_depth(740, 8)
    trees = [up.table_tree(t, depth) for t in (hashes, other)]
    assert [t.count() for t in trees[0]][0] == 1 and len(trees[0]) == depth + 1
    got = {r.prefix for r in up.differing(*trees).collect()}
    want = {r.h[:depth] for r in hashes.exceptAll(other).union(other.exceptAll(hashes)).collect()}
    assert got == want and 1 < len(got) < 4
    assert up.differing(trees[0], trees[0]).count() == 0
    # lists are of distinct hashes under a prefix, and stay near what a leaf is meant to have
    assert hashes.distinct().groupBy(F.substring("h", 1, depth)).count().agg(F.max("count")).first()[0] <= 3 * 8


def test_reconciliation_joins_only_leaves_that_differ(spark):
    left = spark.range(900).selectExpr("id", "cast(id * 3 as string) as row_hash")
    right = left.filter("id % 100 <> 5").withColumn("row_hash", F.when(F.col("id") % 300 == 7, F.lit(None)).otherwise(F.col("row_hash"))).union(spark.createDataFrame([(5000, "z")], "id long, row_hash string"))
    ledger = spark.createDataFrame([(7,), (105,)], "id long")
    want = {"exact": 900 - 9 - 3, "explained": 2, "changed": 2, "missing": 8, "extra": 1}
    for leaf in (1, 10, 10_000):
        got = {r.verdict: r.n for r in up.reconcile(left, right, ["id"], ledger=ledger, leaf=leaf).collect()}
        got["changed"] = got.get("changed", 0)
        assert got["exact"] == want["exact"] and got["explained"] == 2 and sum(got.values()) == 901 and got["extra"] == 1
        # a null hash on the right reads as a missing row, as a null has nothing to be compared with
        assert got.get("missing", 0) + got["changed"] == 10
    assert {r.verdict: r.n for r in up.reconcile(left, left, ["id"]).collect()} == {"exact": 900}


def test_titles_meet_at_their_rarest_word(spark):
    """A word that is in all titles and texts brings nothing together but the name that has no other."""
    texts = spark.createDataFrame([(i, "a", f"the the song w{i} of v{i % 5}") for i in range(60)] + [(100, "b", "the song"), (101, "a", "")], "text_id long, label string, normal string")
    names = spark.createDataFrame([(f"i{i}", "a", f"the song w{i}") for i in range(0, 90, 3)] + [("the", "a", "the"), ("v", "a", "of v3"), ("gap", "a", "song of"), ("", "a", ""), ("b", "b", "the song")], "item_id string, label string, name string")
    got = {(r.text_id, r.item_id) for r in ln.named(texts, names).collect()}
    plain = {(t.text_id, n.item_id) for t in texts.collect() for n in names.collect() if n["name"] and t.label == n.label and f" {n['name']} " in f" {t.normal} "}
    assert got == plain and len(got) == 20 + 60 + 12 + 1
