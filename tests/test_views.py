import pytest

from tierflow.operators import linking as ln
from tierflow.operators import upkeep as up
from tierflow.operators import views as vw
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("1", "Single", 15), ("2", "Single", 16), ("3", "Double", 18), ("4", "CoOp", 3), ("5", "Single", 20)], "item_id string, mode string, level int")


def test_views(rows):
    ids = lambda c: {r.item_id for r in rows.filter(c).collect()}
    assert ids(vw.visible("overall")) == {"2", "3", "5"} and ids(vw.visible("group")) == {"4"}
    assert ids(vw.visible("singles", F.lit(18.4))) == {"2", "5"} and ids(vw.visible("singles", F.lit(None).cast("double"))) == ids(vw.visible("doubles")) == set()
    with pytest.raises(ValueError):
        vw.visible("solo")


def test_slice_of_an_unknown_label(rows):
    assert [r.item_id for r in vw.difficulty_slice(rows, " d18 ").collect()] == ["3"]
    for label in ("S15", "X17", "", "D19"):
        with pytest.raises(ValueError):
            vw.difficulty_slice(rows, label)


def test_order_of_a_view(spark):
    data = [("a", None, 9.0, 1.0, 1.0, "t"), ("b", 1.0, 0.0, 2.0, None, "t"), ("c", 1.0, 0.0, 2.0, 5.0, "t"), ("d", 1.0, 1.0, 9.0, 0.0, "t"), ("e", 2.0, 0.0, 9.0, 0.0, "t"), ("f", 1.0, 0.0, 1.0, 0.0, "t")]
    out = vw.view_order(spark.createDataFrame(data, "item_id string, gain double, edge double, estimate double, expected double, title string"), [])
    assert [r.item_id for r in out.orderBy("place").collect()] == ["e", "d", "f", "c", "b", "a"]


def test_overrides_of_unknown_items_and_texts(spark):
    catalog = spark.createDataFrame([("1", "L", "some name"), ("2", "L", "other")], "item_id string, label string, name string")
    texts = spark.createDataFrame([("x", "L", "see some name here", 1), ("y", "L", "some name", 1), ("z", "L", "nothing", 1)], "text_id string, label string, normal string, rank int")
    none = spark.createDataFrame([], "item_id string, text_id string")
    assert {tuple(r) for r in ln.linked_items(catalog, texts, none).collect()} == {("1", "ambiguous", None), ("2", "missing", None)}
    forced = spark.createDataFrame([("1", "z")], none.schema)
    assert {tuple(r) for r in ln.linked_items(catalog, texts, forced).collect()} == {("1", "override", "z"), ("2", "missing", None)}
    for pair in (("9", "x"), ("1", "q")):
        with pytest.raises(ValueError):
            ln.linked_items(catalog, texts, spark.createDataFrame([pair], none.schema))


def test_rerates(spark):
    catalog = spark.createDataFrame([("1", "S16", "Song"), ("2", "S17", "Song"), ("3", "D20", "New Name"), ("4", "D21", "Twin"), ("5", "D21", "Twin")], "item_id string, label string, title string")
    rows = [(1, "Song!", "S16, S17", "S17, S18"), (2, "Old", "d20", "D19"), (3, "Twin", "D21", "D22"), (4, "Song", "S16 S17", "S18"), (5, "Song", "S16", "D17"), (6, "Song", "S15", "S16"), (7, "Song", "S17", "S20")]
    moves, problems = ln.rerates(spark.createDataFrame(rows, "source_row int, title string, old string, new string"), catalog, {"Old": "New Name"})
    assert {tuple(r) for r in moves.collect()} == {("1", 1, "S16", "S17", 1, "uprated"), ("3", 2, "D20", "D19", -1, "downrated")}
    assert {tuple(r) for r in problems.collect()} == {(3, "Twin", "D21", "unmatched"), (1, "Song!", "S17", "twice"), (7, "Song", "S17", "twice")}


def test_names_without_variant_and_guest(spark):
    texts = ["my song full song", "my songfullsong ft you", "shortcut tune feat x", "ft only", "full moon song", "short cut", ""]
    out = spark.createDataFrame([(t,) for t in texts], "n string").select(ln.base_name(F.col("n")).alias("b"), ln.core_names(F.col("n"), ["remix"]).alias("c")).collect()
    assert [r.b for r in out] == ["my song", "my songfullsong ft you", "tune feat x", "ft only", "full moon song", "", ""]
    assert out[1].c == ["my songfullsong ft you", "my songfullsong"] and out[2].c == ["tune feat x", "tune"] and out[3].c == ["ft only"]


def test_states_of_two_sides(spark):
    base = spark.createDataFrame([("a", 5, "b"), ("b", 5, "b"), ("c", None, "b"), ("d", None, "b")], "entity_id string, synced int, origin string")
    live = spark.createDataFrame([("a", 5, "l"), ("b", 4, "l"), ("c", 1, "l"), ("d", None, "l"), ("e", 9, "l")], "entity_id string, synced int, origin string")
    assert {r.entity_id: r.origin for r in up.merged_states(base, live).collect()} == {"a": "l", "b": "b", "c": "l", "d": "b"}


def test_core_names_work_out_the_base_once(spark):
    out = spark.createDataFrame([("old bolt feat x full song",), (None,)], "n string").select(ln.core_names(F.col("n"), ["remix", "bolt|ring"]).alias("c"))
    assert out.first().c == ["old bolt feat x", "old"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # the title and its base name
