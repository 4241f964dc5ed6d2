"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters are lowered, all that is no word character becomes a space (fixed by the word pattern
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; UTF-8 bytes from 0x80 belong to words).
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: Of each byte its lower case, and whether it is white space; odd multiplier of the hash of words, what it makes of each byte, and bytes that are hashed at once.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
FACTOR = 0x9E3779B97F4A7C15
VALUE = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
PIECE = 1 << 18
#: Rows of a text table that are sent to Python at once.
ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder; for tables much smaller than the corpus."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_blocks(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows with about ``most`` bytes of text; a longer text is a run of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def key_runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key in turn, of a partition that is sorted by ``keys`` (integers); holds one key's rows at once."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        if held and (k[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for start, end in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
            held = []
        held.append(batch.slice(cuts[-2]))
        last = k[-1]
    if held:
        yield pa.Table.from_batches(held)


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; a null is an empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse, modulo 2 ** 64."""
    out = []
    for x in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        each = np.full(n, x, np.uint64)
        each[0] = 1
        out.append(np.multiply.accumulate(each))
    return tuple(out)


def _words(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, last three bytes) of the words of some bytes."""
    edge = np.diff(np.concatenate([[0], (~SPACE[low]).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(1 << max(12, (len(low) - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[low] * power[: len(low)], dtype=np.uint64)])
    tail = np.zeros(len(start), np.uint64)
    for k in (3, 2, 1):
        tail = tail * np.uint64(256) + np.where(end - k >= start, low[np.maximum(end - k, 0)], 0).astype(np.uint64)
    return start, mixed((sums[end] - sums[start]) * inverse[start]), tail


def hashed_words(texts: list[bytes], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, how many each text has, last three bytes as a number) of the words of ``texts`` one after another.

    Bytes are replaced by ``table`` (A-Z lowered if none is given), and words are what is left between ASCII white space. A hash is the sum of a word's
    bytes' values times powers of FACTOR, modulo 2 ** 64 and mixed, so that all words are hashed at once. Long texts are taken up in pieces, cut at white space.
    """
    raw = np.frombuffer((b"\n".join(texts) + b"\n").translate(table or LOWER), np.uint8)
    found, at = [], 0
    while at < len(raw):
        stop = at + PIECE
        while stop < len(raw) and not SPACE[raw[stop - 1]]:
            spaces = np.flatnonzero(SPACE[raw[stop : stop + PIECE]])
            stop += int(spaces[0]) + 1 if len(spaces) else PIECE
        start, h, tail = _words(raw[at:stop])
        found.append((start + at, h, tail))
        at = stop
    start, h, tail = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    return h, np.bincount(doc, minlength=len(texts)), tail


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS rows instead of Spark's 10,000, which are tens of megabytes of text in the JVM and again in Python; a session that names another number keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ROWS))


def texts_of(df: DataFrame, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Key, text and ``extra`` alone, so that other columns of the input, whatever their names, play no part."""
    small_batches(df.sparkSession)
    more = [c.alias(name) for name, c in (extra or {}).items()]
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def unnamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ..., so that no name of its own can clash with those that an operator adds, and the new name of each."""
    column = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*column.values()), column


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long): one row (node, root) for each node but the roots; root is the smallest node.

    Large-star and small-star turns (Kiveris et al., 2014) until the edges stay the same. Each turn is made of
    groupings with partial sums and equi-joins, so a node with very many links is never gathered in one task; its
    result is a checkpoint, so a lost executor doesn't start the turns over. Rows with nulls and loops are ignored.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = mark(e)
    while before[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        # a node keeps a link to its own least neighbour, besides those that its other neighbours get
        e = settled(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
