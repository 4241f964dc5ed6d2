"""SimHash near-duplicates: every pair of fingerprints within a few bits, by exact comparison of tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, components, key_runs, settled, text_blocks, texts_of, written

#: Words in a shingle, bits that linked fingerprints may differ in, seed of XXH64.
SHINGLE, RADIUS, SEED = 3, 2, 42
#: A tile holds the fingerprints with the same population count in each of SEGMENTS equal parts: 17 ** 4 = 83,521 tiles
#: at most, whatever the corpus. A tile is stored in blocks of about CHUNK fingerprints, one row each.
SEGMENTS, CHUNK = 4, 8192
#: Comparisons held at once in a task.
CELLS = 1 << 20
#: A fingerprint is frequent if one in HOT rows has it; there are HOT such ones at most.
HOT = 1000


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of ``hashes`` (uint64)."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for each row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space with A-Z lowered. A text of fewer words than a shingle is one
    shingle, a null, empty or blank text has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, 1 << 20):
            out = []
            for text in as_bytes(batch):
                ws = text.lower().split()
                n = min(shingle, len(ws))
                grams = map(b" ".join, zip(*(ws[i:] for i in range(n)), strict=False)) if n else ()
                out.append(fingerprint(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(ws) - n + 1 if n else 0)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each node's root is the smallest of its set) after the links a-b."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all of ``fps`` (fp, distinct and not null) within ``radius`` bits of each other.

    A bit that differs moves the population count of one segment by one, so two fingerprints can only be near if
    the counts of their tiles differ by ``radius`` at most, summed over the segments; all other tile pairs are skipped.
    Blocks of a tile are compared with the blocks of tiles around it by exclusive or and bit counts, exactly; a task holds two blocks at a time,
    and what is sent is a row for each pair of blocks. Of the links in a comparison a spanning forest is returned, as its components are the same.
    """
    bits, base = 64 // segments, 64 // segments + 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit((1 << bits) - 1))) for i in range(segments)]
    tile = sum((c.cast("long") * base**i for i, c in enumerate(counts)), F.lit(0).cast("long"))
    fps = fps.select("fp", tile.alias("tile"))
    # sizes has at most base ** segments rows
    sizes = settled(fps.groupBy("tile").agg(F.ceil(F.count("*") / chunk).alias("chunks")))
    placed = fps.join(F.broadcast(sizes), "tile").select("tile", F.pmod(F.xxhash64("fp"), "chunks").alias("part"), "fp")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, "tile", "part"):
            yield pa.RecordBatch.from_arrays([*[pa.array([group[c][0].as_py()]) for c in ("tile", "part")], pa.array([group["fp"].to_numpy().tobytes()])], ["tile", "part", "fps"])

    blocks = written(placed.repartition("tile", "part").sortWithinPartitions("tile", "part").mapInArrow(pack, "tile long, part long, fps binary"))
    around = [d for d in product(range(-radius, radius + 1), repeat=segments) if sum(map(abs, d)) <= radius and d >= (0,) * segments]

    def moved(d: tuple[int, ...]):
        to = F.col("tile") + sum(x * base**i for i, x in enumerate(d))
        for i, x in enumerate(d):
            if x:
                to = F.when(F.expr(f"pmod(tile div {base**i}, {base})").between(max(0, -x), min(bits, bits - x)), to)
        return to

    near = blocks.select(F.col("tile").alias("from"), F.col("part").alias("block"), "fps", F.explode(F.array_compact(F.array(*map(moved, around)))).alias("tile"))
    near = near.join(F.broadcast(sizes), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    near = near.filter("from <> tile or block >= part").select("tile", "part", F.lit(1).alias("side"), "fps")

    def compare(mine: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([mine, other]), return_inverse=True)
        mine_at, other_at = at[: len(mine)], at[len(mine) :]
        label = np.arange(len(nodes))
        step = max(1, CELLS // max(1, len(other)))
        for i in range(0, len(mine), step):
            a, b = np.nonzero(np.bitwise_count(mine[i : i + step, None] ^ other[None, :]) <= radius)
            label = unite(label, mine_at[i + a], other_at[b])
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[x].view(np.int64)) for x in (moved, label[moved])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, small = np.zeros(0, np.uint64), []

        def done() -> Iterator[pa.RecordBatch]:
            if small and (out := compare(mine, np.concatenate(small))).num_rows:
                yield out
            small.clear()

        for batch in batches:
            for side, fps in zip(batch.column("side").to_pylist(), batch.column("fps"), strict=True):
                own = np.frombuffer(fps.as_py(), np.uint64)
                if side == 0 or sum(map(len, small)) + len(own) > chunk:  # a block's own row comes first; small blocks are compared together
                    yield from done()
                if side == 0:
                    mine = own
                else:
                    small.append(own)
        yield from done()

    dealt = blocks.select("tile", "part", F.lit(0).alias("side"), "fps").union(near).repartition("tile", "part").sortWithinPartitions("tile", "part", "side")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp long, component_id long) for each row of ``docs`` (doc_id, text).

    Copies meet in one fingerprint before anything is compared, so a group of copies of any size costs one row; then
    all pairs of different fingerprints within ``radius`` bits link, and ``component_id`` is the smallest doc_id that
    can be reached by links. Rows get their component back by an equi-join, those of frequent fingerprints, HOT at most, by a broadcast.
    Texts without words share fingerprint zero and link like any other. Rows with a null
    doc_id take part and get their component's smallest id (null if it has none); repeated rows each get theirs; an empty table gives an empty
    result. Other columns play no part.
    """
    prints = settled(fingerprints(docs, shingle))
    nodes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    roots = components(links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = settled(placed.join(ids, "root").select("fp", "n", "component_id"))
    often = F.col("n") >= max(2, total / HOT)
    hot, rest = F.broadcast(placed.filter(often).drop("n")), placed.filter(~often).drop("n")
    out = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(rest, "fp"))
    return out.select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over the whole ``documents``."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
