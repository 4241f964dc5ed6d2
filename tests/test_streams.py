"""Streams of attempts: what a batch writes, restarts, late rows and merges of parts."""

import random
from pathlib import Path


from tierflow.streaming import upserts as us

KIND = "entity_id string, item_id string, value double, score double, recorded_at string, medal string, seq long"


def fed(spark, folder, batches, checkpoint, out, fan=us.FAN):
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder))
    us.stream_upserts(stream, str(out), str(checkpoint), fan).awaitTermination(240)


def state(spark, out):
    return {(r.entity_id, r.item_id): r.seq for r in us.current_state(spark, str(out), KIND).collect()}


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_stream_of_attempts(spark, tmp_path):
    rows = [("e", f"i{k % 3}", float(k), 1.0, "2026", "x", k) for k in range(12)]
    fed(spark, tmp_path / "in", [rows[4 * k : 4 * k + 4] for k in range(3)], tmp_path / "check", tmp_path / "out")
    assert state(spark, tmp_path / "out") == {("e", "i0"): 9, ("e", "i1"): 10, ("e", "i2"): 11}


def test_stream_goes_on_from_a_state(spark, tmp_path):
    """A new checkpoint doesn't start from nothing, and a small batch writes in proportion to itself."""
    out = tmp_path / "out"
    rng = random.Random(1)
    many = [(f"e{i}", f"i{j}", 1.0, rng.random(), "2026", "x", i) for i in range(300) for j in range(20)]
    few = [("e3", "i0", 9.0, 1.0, "2026", "x", 1000), ("e4", "i0", 0.5, 1.0, "2026", "x", 1001)]
    fed(spark, tmp_path / "in0", [many], tmp_path / "check0", out)
    before = size(out)
    fed(spark, tmp_path / "in1", [few], tmp_path / "check1", out)
    assert size(out) - before < before / 4
    got = state(spark, out)
    assert len(got) == 6000 and got["e3", "i0"] == 1000 and got["e4", "i0"] == 4


def test_parts_are_merged_by_tiers_and_repeated_batches_change_nothing(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"e{rng.randrange(6)}", f"i{rng.randrange(4)}", rng.choice([None, 0.0, 1.0, 2.0]), rng.choice([None, 5.0]), rng.choice(["2025", "2026", None]), rng.choice([None, "x"]), k) for k in range(200)]
    batches = [rows[k::7] for k in range(7)]
    out, all_rows = tmp_path / "out", spark.createDataFrame(rows, KIND)
    want = {(r.entity_id, r.item_id): r.seq for r in us.winners(all_rows).collect()}
    fed(spark, tmp_path / "in", batches, tmp_path / "check", out, fan=3)
    tiers = {t: len(p) for t, p in us.parts(spark, str(out)).items()}
    assert state(spark, out) == want and max(tiers) == 1 and all(n < 3 for n in tiers.values())
    # all batches once more, from a new checkpoint, as after a failure
    fed(spark, tmp_path / "in", [], tmp_path / "again", out, fan=3)
    assert state(spark, out) == want and max(us.parts(spark, str(out))) == 2
    (out / "tier=0" / "part=torn").mkdir(parents=True)  # a part that isn't whole
    (out / "tier=0" / "part=torn" / "part-0.parquet").write_bytes(b"half a file")
    assert state(spark, out) == want
    us.compact(spark, str(out), all_rows.schema, fan=3)
    assert state(spark, out) == want


def test_no_state(spark, tmp_path):
    assert us.current_state(spark, str(tmp_path / "none"), KIND).collect() == []
    assert us.compact(spark, str(tmp_path / "none"), KIND) == 0
