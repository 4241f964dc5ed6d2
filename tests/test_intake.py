"""Intake checks, audits and publishing on small and odd rows."""

import pytest
from pyspark.sql import functions as F

from tierflow.operators import audits as au
from tierflow.operators import intake as it
from tierflow.operators import upkeep as up


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_items_with_odd_tempos(spark):
    rows = spark.createDataFrame([("a", "9", "3", "x"), (" ", "1", "2", "x"), (None, "1", "2", "x"), ("b", "-1", "NaN", "x"), ("c", None, "5", "x")], "item_id string, bpm_min string, bpm_max string, secret string")
    out = it.clean_items(rows, ["item_id", "bpm_min", "bpm_max"])
    assert out.columns == ["item_id", "bpm_min", "bpm_max"] and found(out, "*") == [("a", 3.0, 9.0), ("b", None, None), ("c", None, 5.0)]


def test_attempts_without_ids_or_values_go(spark):
    rows = [("e", "i", 1.0, 2.0, " S ", " ", None, False), ("", "i", 1.0, 2.0, "S", "M", "t", False), ("e", None, 1.0, 2.0, "S", "M", "t", False), ("e", "j", float("nan"), 2.0, "S", "M", "t", False), ("e", "k", 1.0, 2.0, "S", "M", "t", True), ("e", "l", 0.0, None, None, "M", "t", None)]
    df = spark.createDataFrame(rows, "entity_id string, item_id string, value double, score double, grade string, medal string, recorded_at string, is_broken boolean")
    assert found(it.clean_attempts(df), "item_id", "value", "grade", "medal", "recorded_at", "is_broken") == [("i", 1.0, "S", None, "", False), ("l", 0.0, None, "M", "t", False)]
    assert it.clean_attempts(df.limit(0)).count() == 0


def test_first_entity_with_an_id_wins(spark):
    rows = spark.createDataFrame([(" ", "u", 2, "b"), ("u", None, 1, "a"), (None, "", 0, "c"), ("v", "u", 3, "d")], "entity_id string, user_id string, seq int, name string")
    assert found(it.clean_entities(rows, "seq"), "entity_id", "name") == [("u", "a"), ("v", "d")]


def test_last_song_of_a_title_counts(spark):
    songs = spark.createDataFrame([("t", (1.0, 2.0), 1), ("t", (3.0, 4.0), 2), ("", (5.0, 6.0), 3)], "title string, bpm struct<min: double, max: double>, seq int")
    items = spark.createDataFrame([("a", "t"), ("b", ""), ("c", "u")], "item_id string, title string")
    assert found(it.with_tempo(items, songs), "item_id", "bpm_min", "bpm_max") == [("a", 3.0, 4.0), ("b", None, None), ("c", None, None)]


def test_names_and_shapes_that_should_not_be_there(spark):
    raw = spark.createDataFrame([('{"a": 1, "b": {"c": 2, "d": 3}}',), ("no json",), (None,), ('{"x.y": 1}',)], "raw string")
    assert found(it.field_names(raw, "raw", ["a", "b", "b.c"]), "path", "n") == [("b.d", 1), ("x.y", 1)]
    rows = spark.createDataFrame([("id 0123456789abcdef0123", ["fine", None], 1), ("0123456789abcdef01234", ["123e4567-e89b-12d3-a456-426614174000"], 2), (None, None, 3)], "s string, list array<string>, n int")
    assert found(it.shaped_values(rows, it.IDENTIFIER), "column", "n") == [("list", 1), ("s", 1)]


def test_manifest_and_unresolved_rows(spark):
    schema = "name string, n long, digest string"
    left = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("d", 1, "x")], schema)
    right = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 1, "x")], schema)
    assert found(it.manifest_check(left, right), "name", "verdict") == [("a", "exact"), ("b", "changed"), ("c", "missing"), ("d", "unexpected")]
    people = spark.createDataFrame([("1", "h"), ("2", "h"), ("3", "k")], "entity_id string, entity_hash string")
    derived = spark.createDataFrame([("h", "i"), ("z", "i"), (None, "j")], "entity_hash string, item_id string")
    assert found(it.unresolved(derived, people, spark.createDataFrame([("i",)], "item_id string")), "rule", "n") == [("shared hash", 1), ("unknown entity", 2), ("unknown item", 1)]


def test_annotations(spark):
    items = spark.createDataFrame([("a", 18), ("b", 18), ("c", 18), ("d", 18), ("e", 18)], "item_id string, level int")
    notes = [("a", 18, 1, "uprated"), ("b", 17, 1, "uprated"), ("c", 18, 0, "uprated"), ("d", 18, -1, "uprated"), ("e", 18, 1, "uprated"), ("e", 18, 1, "uprated"), ("z", 18, 1, "uprated")]
    got = found(it.annotations(spark.createDataFrame(notes, "item_id string, from_level int, delta int, direction string"), items), "item_id", "problem")
    assert got == [("a", None), ("b", "other level"), ("c", "no change"), ("d", "wrong direction"), ("e", "twice"), ("e", "twice"), ("z", "unknown item")]


def test_events_are_typed_or_refused(spark):
    lines = spark.createDataFrame([('{"kind": "a", "n": 1}',), ('{"kind": "a", "m": 1}',), ("x kind=a y",), ("kind=z",), ("",), (None,)], "line string")
    assert found(au.typed_events(lines, "line", ["a"], ["kind", "n"]), "kind", "problem") == [("a", "unknown field"), ("a", None), ("a", None), ("z", "unknown kind"), (None, "no event"), (None, "no event")]


def test_drift_and_pairs_of_empty_tables(spark):
    rows = spark.createDataFrame([("a", "b", 1, "x")], "g string, k string, n int, body string")
    assert tuple(au.drift(rows.limit(0), rows, "k", 0).first()) == (0, 1, 1, 1, False)
    assert tuple(au.drift(rows.limit(0), rows.limit(0), "k", 0).first()) == (0, 0, 0, 0, True)
    assert found(au.paired_responses(rows, rows.limit(0), "g", ["k"], "body"), "*") == [("a", 0, 0, 1, 0)]


def test_a_failed_count_leaves_the_old_generation(spark, tmp_path):
    rows = spark.range(3)
    assert found(up.publish({"t": rows}, str(tmp_path), "g1", {"t": 3}), "*") == [("t", 3)]
    with pytest.raises(ValueError):
        up.publish({"t": rows}, str(tmp_path), "g2", {"t": 4})
    assert up.current_generation(spark, str(tmp_path)) == "g1"
    up.publish({"t": rows}, str(tmp_path), "g3")
    assert up.current_generation(spark, str(tmp_path)) == "g3"


def test_volatile_columns_are_out_of_the_digest(spark):
    rows = spark.range(5).withColumn("at", F.current_timestamp())
    assert up.semantic_digest(rows, "at").first() == up.semantic_digest(rows.withColumn("at", F.lit("later")).orderBy(F.desc("id")), "at").first()
