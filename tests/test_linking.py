"""Titles that many items and texts have, against plain loops over all pairs, and how many rows are compared."""

import random

from pyspark.sql import functions as F

from tierflow.operators import linking as ln


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tables(spark, n=160):
    rng = random.Random(5)
    names = ["", "red bolt", "red bolts", "old red bolt", "ring", "rings", "cold plate", "a", "zzzzzzzzzzzzzzzzzzzz"]
    catalog = [(str(i), rng.choice("AB"), rng.choice(names)) for i in range(n)]
    texts = [(f"t{i}", rng.choice("AB"), rng.choice(["", "see "]) + rng.choice(names)) for i in range(n)] + [("t0", "A", "red bolt"), ("t0", "B", "red bolt")]
    return catalog, texts, spark.createDataFrame(catalog, "item_id string, label string, normal string"), spark.createDataFrame(texts, "text_id string, label string, normal string")


def compared(plan):
    """The output rows of the largest join of an executed plan."""
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_close_titles_are_those_of_all_pairs(spark):
    catalog, texts, items, asked = tables(spark)
    want = set()
    for t in {t for t, _, _ in texts}:
        alike = [(1 - distance(x, y) / max(len(x), len(y), 1), i) for q, m, x in texts if q == t for i, n, y in catalog if m == n]
        near = sorted((a for a in alike if a[0] >= 0.45), key=lambda a: (-a[0], a[1]))[:3]
        want |= {(t, i, round(a, 9), k) for k, (a, i) in enumerate(near, 1)}
    assert {(r.text_id, r.item_id, round(r.alike, 9), r.place) for r in ln.close_titles(asked, items).collect()} == want


def test_linked_titles_are_those_of_all_pairs(spark):
    catalog, texts, items, asked = tables(spark)
    want = {}
    for t, m, x in texts:
        for i, n, y in catalog:
            if m == n and y and f" {y} " in f" {x} ":
                want[t, m] = min(want.get((t, m), (1, "")), (-len(y), i))
    assert {(r.text_id, r.label, r.item_id) for r in ln.title_links(asked, items).collect()} == {(*k, i) for k, (_, i) in want.items()}


def test_linked_items_are_those_of_all_pairs(spark):
    catalog, texts, items, asked = tables(spark, 60)
    catalog += [("0", "A", "ring"), ("0", "B", "cold plate")]
    ranked = [(*t, int(t[0][1:]) % 4) for t in texts]
    found = ln.linked_items(
        spark.createDataFrame(catalog, "item_id string, label string, name string"), spark.createDataFrame(ranked, "text_id string, label string, normal string, rank int"), spark.createDataFrame([("7", "t3")], "item_id string, text_id string")
    )
    want = set()
    for item in {i for i, _, _ in catalog}:
        hits = {(k, t) for i, n, y in catalog if i == item and y for t, m, x, k in ranked if m == n and f" {y} " in f" {x} "}
        best = {t for k, t in hits if k == min(hits)[0]}
        status = "override" if item == "7" else "missing" if not best else "ambiguous" if len(best) > 1 else "mapped"
        want.add((item, status, "t3" if item == "7" else min(best) if status == "mapped" else None))
    assert {tuple(r) for r in found.collect()} == want


def test_copies_of_titles_are_no_pairs(spark):
    n = 3000  # all pairs would be 9 million
    items = spark.range(n).select(F.col("id").cast("string").alias("item_id"), F.lit("A").alias("label"), F.lit("red bolt").alias("normal"))
    asked = items.withColumnRenamed("item_id", "text_id")
    names, none = items.withColumnRenamed("normal", "name"), spark.createDataFrame([], "item_id string, text_id string")
    for found in (ln.close_titles(asked, items), ln.title_links(asked, items), ln.linked_items(names, asked.withColumn("rank", F.lit(1)), none)):
        assert len(found.collect()) in (n, 3 * n)
        assert 0 < compared(found._jdf.queryExecution().executedPlan()) <= 3 * n
