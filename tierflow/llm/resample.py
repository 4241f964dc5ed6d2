"""Importance resampling: documents weighed by how much likelier their features are in a target than in the corpus, and a sample without replacement drawn by them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import WORD_TABLE, as_bytes, text_blocks, texts_of, written

#: Buckets of features, words in the longest feature, share that is drawn (of a hundred), words that a drawn document has at least, seed (fixed values of the contract).
BUCKETS, GRAMS, SHARE, LEAST, SEED = 10_000, 2, 25, 20, "7"
#: Bytes of text taken up at once, and the longest word whose bytes are taken up side by side with those of others.
PIECE, SIDE = 1 << 20, 48
#: Relative error of the sketch that gives the first bracket.
ERROR = 0.001

#: The steps of CRC-32 for one byte, from its polynomial.
TABLE = np.array([zlib.crc32(bytes([b])) ^ 0xFF000000 for b in range(256)], np.uint32)
TABLE = TABLE ^ TABLE[0]  # what a byte alone does to a register of zeros


def continued(state: np.ndarray, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 after the bytes ``raw[start:start + size]`` follow those that ``state`` is the CRC-32 of; all rows at once, byte by byte."""
    out = state.copy()
    long = np.flatnonzero(size > SIDE)
    for i in long.tolist():
        out[i] = zlib.crc32(raw[start[i] : start[i] + size[i]].tobytes(), int(state[i]))
    rows = np.flatnonzero(size <= SIDE)
    rows = rows[np.argsort(-size[rows], kind="stable")]
    register, at, falling = ~out[rows], start[rows], -size[rows]
    for k in range(int(-falling[0]) if len(rows) else 0):
        n = int(np.searchsorted(falling, -k, "left"))  # rows with more than k bytes
        register[:n] = TABLE[(register[:n] ^ raw[at[:n] + k]) & np.uint32(0xFF)] ^ (register[:n] >> np.uint32(8))
    out[rows] = ~register
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, its bucket): features are all runs of one to GRAMS words, joined by a space."""
    raw = np.frombuffer((b"\n".join(texts) + b"\n").translate(WORD_TABLE), np.uint8)
    edge = np.diff(np.concatenate([[0], (raw != 0x20).astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")
    size, found = end - start, []
    state = continued(np.zeros(len(start), np.uint32), raw, start, size)
    found.append((doc, state))
    for k in range(1, GRAMS):
        same = doc[k:] == doc[: len(doc) - k]
        if not len(same):
            break
        register = ~state[: len(same)]
        with_space = ~(TABLE[(register ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (register >> np.uint32(8)))
        state = continued(with_space, raw, start[k:], size[k:])
        found.append((doc[k:][same], state[same]))
    words = np.bincount(doc, minlength=len(texts))
    return words, np.concatenate([d for d, _ in found]), np.concatenate([s for _, s in found]) % np.uint32(BUCKETS)


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features in each bucket over all texts: a task adds up its own, and BUCKETS rows, whatever the corpus, come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in text_blocks(batches, PIECE):
            total += np.bincount(features(as_bytes(batch))[2], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = texts_of(docs.withColumn("__none", F.lit(None).cast("long")), "__none", text).mapInArrow(run, "bucket long, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target than in the corpus, with one more feature in every bucket of both."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each text's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, PIECE):
            words, doc, bucket = features(as_bytes(batch))
            n = np.bincount(doc, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, doc, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return texts_of(docs, key, text).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def perturbed(seed: str = SEED) -> Column:
    """The weight with a Gumbel draw by the document's hash: the highest of these are a sample without replacement in proportion to the weights' exponentials."""
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(mark.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.col("weight") + F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


class Bracket(NamedTuple):
    """Scores between which the wanted row lies, and how many rows are above and inside."""

    low: int
    high: int
    above: int
    inside: int


def bracket(rows: DataFrame, wanted: int, n: int, error: float = ERROR) -> Bracket:
    """Where the ``wanted``-th highest of n scores lies, by a quantile sketch whose bracket exact counts confirm, or else widen."""
    margin = error
    while True:
        share = 1 - wanted / n
        ends = [max(0.0, share - 2 * margin), min(1.0, share + 2 * margin)]
        low, high = (int(x) for x in rows.approxQuantile("score", ends, min(margin, error)))
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < wanted <= above + inside:
            return Bracket(low, high, above, inside)
        margin = margin * 4 if margin * 4 < 1 else 1.0


def cutoff(rows: DataFrame, wanted: int, found: Bracket) -> tuple[int, int | None]:
    """(score, doc_id) of the ``wanted``-th row by score, then doc_id; only rows in the bracket are put in order."""
    inside = rows.filter(F.col("score").between(found.low, found.high)).select("score", "doc_id")
    places = numbered(inside, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "place")
    return tuple(places.filter(F.col("place") == wanted - found.above).select("score", "doc_id").first())


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: str = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document, and of those of ``least`` words the place of each that is drawn, ``share`` of a hundred.

    A null text has no words, features or weight, and isn't drawn; a null key comes after all others of the same score and is drawn for as an empty one. Rows with the same key and
    score come in any order, and as many of them are drawn as there is room for. An empty target weighs all buckets alike but for the corpus' own counts; an
    empty corpus gives an empty table. Columns other than key and text play no part. The corpus is read twice: for the counts of buckets, and for the weights,
    which are written; only the rows that are drawn and those within the bracket are put in order, over ranges.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, text))
    rows = written(weights(docs, gain, key, text).withColumn("score", perturbed(seed)))
    able = rows.filter(F.col("n_words") >= least)
    n = able.count()
    wanted = share * n // 100
    if not wanted:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    score, doc = cutoff(able, wanted, bracket(able, wanted, n))
    tied = F.col("score") == score
    first = tied if doc is None else tied & F.coalesce(F.col("doc_id") <= doc, F.lit(False))
    upper = (F.col("n_words") >= least) & ((F.col("score") > score) | first)
    places = numbered(rows.filter(upper), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    drawn = places.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    return drawn.union(rows.filter(~upper).withColumn("rank", F.lit(None).cast("long")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the benchmark's texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
