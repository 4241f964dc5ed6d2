"""Which keys of a text other texts have too, for very many keys: packed, counted by bucket and answered by chunk of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, key_runs, text_blocks

#: Bytes of text in a chunk, and for which there is a bucket; bits of a key within its bucket.
CHUNK, BUCKET, KEY = 4 << 20, 8 << 20, 40
#: Stands for the number of a text where several of a chunk have the key, so a chunk has at most as many texts.
SEVERAL = 0xFFFF


def bucket_bits(size: int) -> int:
    """Bits of the buckets' number for a corpus of ``size`` bytes."""
    return min(64 - KEY, max(4, (size // BUCKET).bit_length()))


PACKED = "chunk long, meta boolean, a binary, b binary, c binary, d binary"


def _packed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "chunk": pa.int64(), "meta": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.binary())) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names)


def sent_keys(rows: DataFrame, hashes: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]], bits: int) -> DataFrame:
    """The keys of all texts of ``rows`` (doc_id, text; each doc_id once) by bucket, packed: a row for each chunk of texts and bucket.

    ``hashes`` gives for each text its different 64-bit hashes and how often each counts. A key is the first ``bits`` bits of a hash (its bucket) and KEY more.
    A chunk sends each key once, with the sum of its counts, and the text's number if it is one; so a key that very many texts have costs a bucket one for each chunk.
    The chunk's other row (``meta``) has its doc_ids, the sizes of their sets, and the texts of each key that several have; it is
    sent through any bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SEVERAL) for b in text_blocks(batches, CHUNK) for k in range(0, b.num_rows, SEVERAL)):
            ids = batch.column("doc_id").to_numpy()
            sets, weights = zip(*hashes(as_bytes(batch)), strict=True)
            n = np.array([len(x) for x in sets], np.int32)
            key, doc = np.concatenate(sets) >> np.uint64(64 - KEY - bits), np.repeat(np.arange(len(n), dtype=np.uint16), n)
            order = np.argsort(key, kind="stable")
            key, doc, weight = key[order], doc[order], np.concatenate(weights)[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            texts = np.diff(np.append(at, len(key)))
            several = np.repeat(texts > 1, texts)
            first = np.where(texts > 1, SEVERAL, doc[at]).astype("<u2")
            one, count = key[at], np.minimum(np.add.reduceat(weight, at) if len(at) else texts, 0xFFFF).astype("<u2")
            bucket = (one >> np.uint64(KEY)).astype(np.int64)
            used, cut = np.unique(bucket, return_index=True)
            chunk = int(ids[0])
            out = [((chunk * 0x9E3779B1 >> 16) % (1 << bits), chunk, True, ids.astype("<i8").tobytes(), n.astype("<i4").tobytes(), key[several].astype("<u8").tobytes(), doc[several].astype("<u2").tobytes())]
            for b, i, j in zip(used.tolist(), cut, np.append(cut, len(one))[1:], strict=True):
                out.append((b, chunk, False, one[i:j].astype("<u4").tobytes(), (one[i:j] >> np.uint64(32)).astype("u1").tobytes(), count[i:j].tobytes(), first[i:j].tobytes()))
            yield _packed(out, ["bucket", "chunk", "meta", "a", "b", "c", "d"])

    return rows.mapInArrow(run, f"bucket long, {PACKED}")


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def shared_keys(keys: DataFrame) -> DataFrame:
    """For each chunk its keys that several texts of the corpus have, with their number; rows with ``meta`` as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk", "meta", "a", "b", "c", "d"]
        for group in key_runs(batches, "bucket"):
            meta = group["meta"].to_numpy()
            for x in group.filter(pa.array(meta)).select(names).to_batches():
                yield x
            own = group.filter(pa.array(~meta))
            if not own.num_rows:
                continue
            key = _joined(own["a"], "<u4").astype(np.uint64) | _joined(own["b"], "u1").astype(np.uint64) << np.uint64(32)
            _, inverse = np.unique(key, return_inverse=True)
            total = np.bincount(inverse, _joined(own["c"], "<u2")).astype("<u4")[inverse]
            first, shared = _joined(own["d"], "<u2"), total > 1
            key = key | np.uint64(own["bucket"][0].as_py() << KEY)
            ends = np.cumsum([len(x) for x in own["b"].to_pylist()])
            out = []
            for chunk, i, j in zip(own["chunk"].to_pylist(), np.append(0, ends[:-1]), ends, strict=True):
                if (s := shared[i:j]).any():
                    out.append((chunk, False, key[i:j][s].tobytes(), total[i:j][s].tobytes(), first[i:j][s].tobytes(), None))
            if out:
                yield _packed(out, names)

    return keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, PACKED)


def answers(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, number of the text, key, total) for the rows of one chunk: its texts, and a place for each shared key of each text."""
    meta = group["meta"].to_numpy()
    about, own = group.filter(pa.array(meta)), group.filter(pa.array(~meta))
    ids, n, many, of = (_joined(about[c], k) for c, k in zip("abcd", ("<i8", "<i4", "<u8", "<u2"), strict=True))
    key, total, doc = (_joined(own[c], k) for c, k in zip("abc", ("<u8", "<u4", "<u2"), strict=True))
    apart = doc != SEVERAL
    low, high = (np.searchsorted(many, key[~apart], side) for side in ("left", "right"))
    times = high - low
    inner = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
    return ids, n, np.concatenate([doc[apart], of[inner]]), np.concatenate([key[apart], many[inner]]), np.concatenate([total[apart], np.repeat(total[~apart], times)])
