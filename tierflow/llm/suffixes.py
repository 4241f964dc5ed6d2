"""Removal of repeated byte strings: sorted suffixes of shards, merged by interleave refinement.

The dealt method, merging the Burrows-Wheeler transforms of shards turn by turn, is replaced (the README has figures): each turn passes over all symbols, and
a hundred are needed. What is kept of it is the interleave that is refined and whose turns give common prefixes and intervals. A suffix is only taken up at anchors: of every LENGTH-byte string the place of its smallest GRAM-byte hash, which depends
on that string's bytes alone, so equal strings have their anchor at the same offset. For each anchor a shard
sends the bytes to its right (its suffix) and those to its left (what the Burrows-Wheeler transform has before
the suffix, further than one symbol), as far as strings with this anchor reach. The sequences of all shards are
merged for each gram by refining an interleave symbol by symbol, eight bytes each; only places in intervals with more
than one suffix are taken up again, so that suffixes aren't sorted anew. Common prefixes of neighbours give the intervals at any depth, to the
right and to the left; a string is repeated where two places share an interval on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, key_runs, text_blocks, texts_of
from .keys import KEY, answers, bucket_bits, sent_keys, shared_keys

#: Bytes of a repeated string, and of the gram at its anchor.
LENGTH, GRAM = 100, 16
#: Places that a string's gram can have; the last bytes to the left that a string can have.
PLACES, LEFT = LENGTH - GRAM + 1, LENGTH - GRAM
#: Bits of a position within a block, the longest piece that is looked at at once, and bytes of a block.
BITS, PIECE, BLOCK = 24, 1 << 20, 1 << 20
#: Members that are merged at once (whole groups of one gram), and contexts that a task remembers.
MERGED, REMEMBERED = 1 << 14, 1 << 19


def grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    n = len(raw)
    pad = np.concatenate([raw, np.zeros(GRAM + 8, np.uint8)])
    word = np.empty(n + 16, np.uint64)
    for r in range(8):
        part = pad[r : r + (len(pad) - r) // 8 * 8].view(np.uint64)[: len(word[r::8])]
        word[r::8][: len(part)] = part
    g = word[:n] * np.uint64(0x9E3779B97F4A7C15)
    g ^= word[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    return g


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, least offset, greatest offset, gram hash) of the anchors of ``texts``, one after another.

    Strings of LENGTH bytes that start ``offset`` bytes before the position, for all offsets from the least to the greatest, have this anchor.
    """
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    n = len(raw)
    fits = np.zeros(n + 1, np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= LENGTH
    np.add.at(fits, starts[long], 1)
    np.add.at(fits, ends[long] - LENGTH + 1, -1)
    fits = np.cumsum(fits[:-1]) > 0
    out = []
    for at in range(0, n, PIECE):
        part = raw[at : at + PIECE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        g = grams(part)
        low = np.uint64((1 << BITS) - 1)
        m = ((g & ~low) | np.arange(len(part), dtype=np.uint64))[: len(part) - GRAM + 1]
        length = 1
        while 2 * length <= PLACES:
            m = np.minimum(m[:-length], m[length:])
            length *= 2
        if length < PLACES:
            m = np.minimum(m[: length - PLACES], m[PLACES - length :])
        start = np.flatnonzero(fits[at : at + len(m)])
        q = (m[start] & low).astype(np.int64)
        if len(q):
            first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            last = np.append(first[1:], len(q)) - 1
            pos = q[first]
            out.append((pos + at, pos - start[last], pos - start[first], g[pos]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gram_counts(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the different grams at its anchors, and how many anchors each has."""
    out = []
    pos, _, _, g = anchors(texts)
    cuts = np.searchsorted(pos, np.cumsum([0, *map(len, texts)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out.append(np.unique(g[a:b], return_counts=True))
    return out


def shared_grams(rows: DataFrame, size: int) -> DataFrame:
    """(row, grams): of each text the keys of its grams that stand at two anchors or more, there or elsewhere; texts without one are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, "chunk"):
            ids, _, doc, key, _ = answers(group)
            order = np.argsort(doc, kind="stable")
            some, first = np.unique(doc[order], return_index=True)
            cuts = np.append(first, len(doc)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(key[order].view(np.int64)))], ["row", "grams"])

    replies = shared_keys(sent_keys(rows, gram_counts, bucket_bits(size)))
    return replies.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "row long, grams array<long>")


MEMBER = "g long, doc_id long, row long, at long, least int, left binary, right binary"


def members(rows: DataFrame, bits: int) -> DataFrame:
    """For each text of ``rows`` (row, doc_id, text, grams) the contexts of its anchors whose gram's key, of ``bits`` bits, is in ``grams``.

    Of equal contexts that a task meets, those after the first in (doc_id, row, position) are repeated for certain: they go on as
    spans (``right`` null, from ``at`` for ``least`` bytes) under a random group, so that a group has about one member of many copies for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int]] = {}
        for batch in text_blocks(batches, BLOCK):
            texts = as_bytes(batch)
            raw, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
            pos, least, most, g = anchors(texts)
            keep = np.isin(g >> np.uint64(64 - bits), batch.column("grams").flatten().to_numpy().view(np.uint64))
            pos, least, most, g = pos[keep], least[keep], most[keep], g[keep].view(np.int64)
            doc = np.searchsorted(ends, pos, "right")
            begin = np.concatenate([[0], ends])[doc]
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()[doc]
            row = batch.column("row").to_numpy()[doc]
            lists = [x.tolist() for x in (g, ids, row, pos - begin, least, most, pos)]
            out = []
            for group, i, r, at, lo, hi, p in zip(*lists, strict=True):
                left, right = raw[p - hi : p], raw[p : p + LENGTH - lo]
                key = xxhash.xxh3_128_digest(left + right, hi * LENGTH + lo)
                if seen.setdefault(key, (i, r, at)) < (i, r, at):
                    out.append((r, i, r, at - hi, hi - lo + LENGTH, None, None))
                else:
                    seen[key] = (i, r, at)
                    out.append((group, i, r, at, lo, left, right))
            if len(seen) > REMEMBERED:
                seen.clear()
            if out:
                kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["g", "doc_id", "row", "at", "least", "left", "right"])

    return rows.mapInArrow(run, MEMBER)


def interleave(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the rows of ``text`` (bytes, a multiple of eight columns) within each group, and the common prefix of neighbours.

    The interleave starts with the groups and is refined by a symbol of eight bytes in each turn, of which only places in
    intervals with more than one row are part. Neighbours of different groups have -1 in common.
    """
    words = text.view(">u8").astype(np.uint64)
    n = len(group)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    rank = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active = np.flatnonzero(~(new & np.append(new[1:], True)))
    for k in range(words.shape[1]):
        if not len(active):
            break
        own, word = rank[active], words[active, k]
        by = np.lexsort((word, own))
        active, own, word = active[by], own[by], word[by]
        at = np.arange(len(active))
        whole = np.concatenate([[True], own[1:] != own[:-1]])
        part = whole | np.concatenate([[True], word[1:] != word[:-1]])
        rank[active] = own + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(whole, at, 0))
        active = active[~(part & np.append(part[1:], True))]
    order = np.argsort(rank, kind="stable")
    same = text[order[1:]] == text[order[:-1]]
    common = np.where(same.all(1), text.shape[1], same.argmin(1))
    common[group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def repeated(group: np.ndarray, least: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """(members, offsets) flags: the string that starts ``offset`` bytes before a member's anchor also starts at an earlier member of its group.

    Members are sorted by group and then from the earliest on.
    """
    n = len(group)
    out = np.zeros((n, LEFT + 1), bool)
    most = np.array([len(x) for x in left])
    wide = -(-LENGTH // 8) * 8
    ahead = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in right), np.uint8).reshape(n, wide)
    wide = -(-LEFT // 8) * 8
    behind = np.ascontiguousarray(np.frombuffer(b"".join(x.rjust(wide, b"\0") for x in left), np.uint8).reshape(n, wide)[:, ::-1])
    (by_r, common_r), (by_l, common_l) = interleave(group, ahead), interleave(group, behind)
    interval = np.empty((2, n), np.int64)
    for x in range(LEFT + 1):
        on = np.flatnonzero((least <= x) & (most >= x))
        if len(on) < 2:
            continue
        interval[0, by_r] = np.concatenate([[0], np.cumsum(common_r < LENGTH - x)])
        interval[1, by_l] = np.concatenate([[0], np.cumsum(common_l < x)])
        key = interval[0, on] * n + interval[1, on]
        order = np.argsort(key, kind="stable")
        again = np.concatenate([[False], key[order[1:]] == key[order[:-1]]])
        out[on[order[again]], x] = True
    return out


def repeated_spans(contexts: DataFrame) -> DataFrame:
    """(row, start, end): bytes of texts that repeated strings cover; spans may overlap."""

    def spans(batch: pa.Table) -> pa.RecordBatch:
        row, at, least = (batch[c].to_numpy() for c in ("row", "at", "least"))
        known = batch["right"].is_null().to_numpy()
        own = np.flatnonzero(~known)
        part = batch.take(pa.array(own))
        flags = repeated(part["g"].to_numpy(), least[own], part["left"].to_pylist(), part["right"].to_pylist()) if len(own) > 1 else np.zeros((len(own), LEFT + 1), bool)
        edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (who, first), (_, last) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        start = np.concatenate([at[known], at[own][who] - last + 1])
        end = np.concatenate([at[known] + least[known], at[own][who] - first + LENGTH])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([row[known], row[own][who]])), pa.array(start), pa.array(end)], ["row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < MERGED:
                continue
            whole = pa.Table.from_batches(held)
            g = whole["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield spans(whole.slice(0, cut))
                held, size = whole.slice(cut).to_batches(), len(g) - cut
        if held:
            yield spans(pa.Table.from_batches(held))

    dealt = contexts.repartition("g").sortWithinPartitions("g", "doc_id", "row", "at")
    return dealt.mapInArrow(run, "row long, start long, end long")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept binary) for each row of ``docs`` (doc_id, text): the text without repeated bytes.

    Every byte goes that a LENGTH-byte string covers which also starts earlier: in a smaller doc_id, or in the same text
    at an earlier byte. All strings are judged on the input. Texts are UTF-8 bytes and no string crosses two. Rows with
    the same doc_id go by their place in the table, a null doc_id comes after all others. A null or short text is kept as it
    is (null as an empty one). An empty table gives an empty result. ``starts`` and ``ends`` are the removed runs.

    Only grams that stand at two anchors or more can be part of a repeated string; texts with such a gram send contexts,
    and all texts are then joined with their spans. Equal contexts meet in tasks before they are dealt by their gram. ``docs``
    has to give its rows in the same order each time, as a table that is read from files does.
    """
    rows = texts_of(docs, extra={"row": F.monotonically_increasing_id()})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = shared_grams(rows.select(F.col("row").alias("doc_id"), "text"), size)
    spans = repeated_spans(members(rows.join(wanted, "row"), KEY + bucket_bits(size)))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, BLOCK):
            out = []
            for text, found in zip(as_bytes(batch), batch.column("spans").to_pylist(), strict=True):
                starts, ends, kept, at = [], [], [], 0
                for x in found or ():
                    if ends and x["start"] <= ends[-1]:
                        ends[-1] = max(ends[-1], x["end"])
                    else:
                        starts.append(x["start"])
                        ends.append(x["end"])
                for a, b in zip(starts, ends, strict=True):
                    kept.append(text[at:a])
                    at = b
                out.append((len(text), starts, ends, b"".join([*kept, text[at:]])))
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]], ["doc_id", "n_bytes", "starts", "ends", "kept"])

    joined = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 5 over the whole ``documents``."""
    out = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
