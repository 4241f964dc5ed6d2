"""Benchmark decontamination by a positional inverted index over the training tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, as_bytes, hashed_words, settled, text_blocks, texts_of, written

#: Consecutive item words that count as a leak.
WINDOW = 10
#: A proximity match: all of an item's NEAR_TERMS rarest terms within NEAR_SPAN words of the rarest.
NEAR_TERMS, NEAR_SPAN = 4, 20
#: Bytes of text in one shard of the index, and of benchmark text that is searched (and broadcast) at once; a larger
#: benchmark is searched block by block. Words of an item's segment, of which a longer item has several.
SHARD_BYTES, QUERY_BYTES, SEGMENT = 2 << 20, 4 << 20, 4096
#: Candidate places that are held at once while lists are intersected.
CANDIDATES = 1 << 20

INDEX = "rows array<bigint>, doc_ids array<bigint>, n_words array<int>, starts array<int>, terms array<bigint>, counts array<int>, postings binary"
HITS = "row long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>, near array<string>"


def words(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lowered, then runs of 0-9, a-z and everything beyond ASCII."""
    return text.translate(WORD_TABLE).split()


class Queries:
    """Windows of benchmark items over their own vocabulary of hashed terms; small, and sent to the tasks."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        vocab: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        rows, owner, self.item_terms = [], [], []
        for k, (_, text) in enumerate(items):
            ids = [vocab.setdefault(w, len(vocab)) for w in words(text)]
            self.item_terms.append(np.unique(np.array(ids, np.int32)))
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                rows.append(ids[i : i + n] + [-1] * (window - n))
                owner.append(k)
        self.words = np.array(rows, np.int32).reshape(-1, window)
        self.owner = np.array(owner, np.int32)
        if len(rows):  # the same window of the same item once
            _, first = np.unique(np.column_stack([self.words, self.owner]), axis=0, return_index=True)
            self.words, self.owner = self.words[first], self.owner[first]
        self.length = (self.words >= 0).sum(1).astype(np.int32)
        hashes = hashed_words([b" ".join(vocab)], WORD_TABLE)[0].view(np.int64)
        self.by_hash = np.argsort(hashes)
        self.terms = hashes[self.by_hash]

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Of each word of the vocabulary the place of its hash in ``terms`` (ascending), or -1; one more -1 for what pads a short window."""
        at = np.minimum(np.searchsorted(terms, self.terms), max(0, len(terms) - 1))
        out = np.full(len(self.terms) + 1, -1, np.int64)
        if len(terms):
            out[self.by_hash] = np.where(terms[at] == self.terms, at, -1)
        return out

    def rank(self, counts: dict[int, int]) -> None:
        """Order each window's offsets, and each item's terms, from the corpus' rarest term on; ``counts`` are by hash."""
        freq = np.zeros(len(self.terms) + 1, np.int64)
        freq[self.by_hash] = [counts.get(t, 0) for t in self.terms.tolist()]
        freq[-1] = np.iinfo(np.int64).max  # what pads a short window goes last
        self.order = np.argsort(freq[self.words], axis=1, kind="stable").astype(np.int32)
        self.near = np.full((len(self.items), NEAR_TERMS), -1, np.int64)
        for k, t in enumerate(self.item_terms):
            own = t[np.argsort(freq[t], kind="stable")][:NEAR_TERMS]
            self.near[k, : len(own)] = own


def build_index(docs: DataFrame, gap: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Positional inverted index of all tokens of ``docs`` (row, doc_id, text), a row for each shard of documents.

    ``terms`` are the 64-bit hashes of a shard's terms in ascending order, ``counts`` the lengths of their lists, ``postings`` the lists of
    ascending int32 positions one after another. Document ``i`` has the positions from ``starts[i]`` on; documents are
    ``gap`` or more positions apart, so no phrase crosses two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, shard_bytes):
            hashes, n, _ = hashed_words(as_bytes(batch), WORD_TABLE)
            hashes = hashes.view(np.int64)
            starts = np.cumsum(n + gap) - n - gap
            at = np.arange(len(hashes)) + np.repeat(np.arange(len(n)) * gap, n)
            order = np.argsort(hashes, kind="stable")
            at_term = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order][:1] - 1)) if len(order) else order
            terms, counts = hashes[order][at_term], np.diff(np.append(at_term, len(order)))
            one = {
                "rows": batch.column("row").to_pylist(), "doc_ids": batch.column("doc_id").to_pylist(), "n_words": n.astype(np.int32), "starts": starts.astype(np.int32),
                "terms": terms, "counts": counts.astype(np.int32), "postings": at[order].astype(np.int32).tobytes(),
            }
            kinds = [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one.values(), kinds, strict=True)], list(one))

    return docs.mapInArrow(run, INDEX)


def term_counts(index: DataFrame, queries: Queries) -> DataFrame:
    """(term, n): how many postings each term of ``queries`` has in the whole corpus; reads the short columns of the index alone."""
    sent = index.sparkSession.sparkContext.broadcast(queries.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, n = (batch.column(c)[i].values.to_numpy() for c in ("terms", "counts"))
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
                    total += np.where(terms[at] == own, n[at], 0)
        yield pa.RecordBatch.from_arrays([pa.array(own[total > 0]), pa.array(total[total > 0])], ["term", "n"])

    return index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Lists:
    """The posting lists of a shard, as ascending keys of (list, position)."""

    def __init__(self, counts: np.ndarray, postings: np.ndarray, span: int):
        self.bounds = np.concatenate([[0], np.cumsum(counts)])
        self.at, self.span = postings, span
        self.keys = np.repeat(np.arange(len(counts)), counts) * span + postings

    def rounds(self, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number, position) of all postings of ``slots``, about CANDIDATES in a turn."""
        sizes = (self.bounds[slots + 1] - self.bounds[slots]).astype(np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(slots):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, "right")))
            own = np.repeat(np.arange(lo, hi), sizes[lo:hi])
            inner = np.arange(len(own)) - np.repeat(np.cumsum(sizes[lo:hi]) - sizes[lo:hi], sizes[lo:hi])
            yield own, self.at[self.bounds[slots[own]] + inner].astype(np.int64)
            lo = hi

    def phrases(self, q: Queries, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of each occurrence in the shard, by intersecting offset-adjusted lists from the rarest term on."""
        rare = q.order[:, 0]
        first = slot[q.words[np.arange(len(q.words)), rare]]
        # windows all of whose terms are in the shard, others can't occur
        live = np.flatnonzero((first >= 0) & ((slot[q.words] >= 0) | (q.words < 0)).all(1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for own, at in self.rounds(first[live]):
            win = live[own]
            start = at - rare[win]
            win, start = win[start >= 0], start[start >= 0]
            for step in range(1, q.words.shape[1]):
                off = q.order[win, step]
                word = q.words[win, off]
                want = slot[word] * self.span + start + off
                keep = (word < 0) | (self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want)
                win, start = win[keep], start[keep]
            found.append((win, start))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def close(self, q: Queries, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position of its rarest term) where all of the item's NEAR_TERMS rarest terms, two at least, stand within NEAR_SPAN words of that."""
        lists = slot[q.near]
        live = np.flatnonzero((q.near[:, 1] >= 0) & ((lists >= 0) | (q.near < 0)).all(1))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for own, at in self.rounds(lists[live, 0]):
            item = live[own]
            for step in range(1, NEAR_TERMS):
                low = lists[item, step] * self.span + at
                place = np.searchsorted(self.keys, low - NEAR_SPAN)  # the next posting of that list, if it is in reach
                ok = (q.near[item, step] < 0) | (self.keys[np.minimum(place, len(self.keys) - 1)] >= low - NEAR_SPAN) & (self.keys[np.minimum(place, len(self.keys) - 1)] <= low + NEAR_SPAN)
                item, at = item[ok], at[ok]
            found.append((item, at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search(index: DataFrame, queries: Queries) -> DataFrame:
    """Exact phrase and proximity matches of ``queries`` in ``index``: a row for each document.

    ``starts`` and ``ends`` are the merged runs of hit words (words from 0, end exclusive); ``items`` have a window that
    occurs exactly, ``near`` have their rarest terms close together.
    """
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                cell = {c: batch.column(c)[k] for c in batch.schema.names}
                rows, doc_ids = cell["rows"].values, cell["doc_ids"].values
                starts, n = (cell[c].values.to_numpy().astype(np.int64) for c in ("starts", "n_words"))
                terms, at = cell["terms"].values.to_numpy(), np.frombuffer(cell["postings"].as_py(), np.int32)
                found = {c: [[] for _ in range(len(n))] for c in ("starts", "ends", "items", "near")}
                if len(at) and len(q.words):
                    # keys of neighbouring lists are farther apart than any offset or distance
                    lists = Lists(cell["counts"].values.to_numpy().astype(np.int64), at, int(starts[-1] + n[-1] + q.words.shape[1] + NEAR_SPAN + 1))
                    slot = q.slots(terms)
                    doc_of = lambda p, s=starts: np.searchsorted(s, p, "right") - 1
                    win, start = lists.phrases(q, slot)
                    delta = np.zeros(lists.span + 1, np.int32)
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + q.length[win], -1)
                    edge = np.diff(np.concatenate([[0], (np.cumsum(delta) > 0).astype(np.int8)]))
                    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    for b, e, d in zip(begin, end, doc_of(begin), strict=True):
                        found["starts"][d].append(int(b - starts[d]))
                        found["ends"][d].append(int(e - starts[d]))
                    item, place = lists.close(q, slot)
                    for c, where, own in (("items", start, q.owner[win]), ("near", place, item)):
                        for d, i in np.unique(np.column_stack([doc_of(where), own]), axis=0):
                            if q.items[i] is not None:
                                found[c][d].append(q.items[i])
                kinds = [pa.list_(pa.int32())] * 2 + [pa.list_(pa.string())] * 2
                yield pa.RecordBatch.from_arrays([rows, doc_ids, pa.array(n), *[pa.array(x, t) for x, t in zip(found.values(), kinds, strict=True)]], ["row", "doc_id", "n_words", *found])

    return index.mapInArrow(run, HITS)


def segments(items: DataFrame, window: int, most: int = SEGMENT) -> DataFrame:
    """(item_id, text): the words of each item of ``items`` (item_id, text) in runs of ``most``, with window - 1 words of the next, so that no window is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, SHARD_BYTES):
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), as_bytes(batch), strict=True):
                ws = words(text)
                out += [(item, b" ".join(ws[i : i + most + window - 1])) for i in range(0, max(1, len(ws) - window + 1), most) if ws]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1].decode() for x in out], pa.string())], ["item_id", "text"])

    return items.mapInArrow(run, "item_id string, text string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, query_bytes: int = QUERY_BYTES, row: str | None = None) -> DataFrame:
    """Leaks of ``benchmark`` (item_id, text) in ``docs`` (doc_id, text): a row for each row of ``docs``.

    Returns row (the column of ``docs`` that tells its rows apart, numbers if none is named), doc_id, n_words, starts, ends (runs of hit words), items (ids as strings, sorted), near (the same for
    proximity matches, those of an item's segments), n_hit, n_items, contaminated. The index of all training tokens is built and stored once, and searched for each block of about
    ``query_bytes`` of benchmark text; the benchmark is cut into segments and only sent to tasks by such blocks, so what is sent is bounded
    whatever its size. Documents are never shuffled.

    Null and empty texts have no words and hit nothing. Benchmark rows without a word are left out; those without an id hit words, but have no id to
    list or count. Repeated benchmark rows count once; repeated document rows each get their row; an empty table gives an empty result. Other
    columns play no part. Words are told apart by 64-bit hashes.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    items = written(segments(items, window).distinct())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + int(2 * total // query_bytes) if total > query_bytes else 1
    rows = texts_of(docs, extra={"row": F.col(row) if row else F.monotonically_increasing_id()})
    index = written(build_index(rows, gap=max(window, NEAR_SPAN + 1)))
    found = []
    for k in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        q = Queries([(r.item_id, r.text.encode()) for r in block.toLocalIterator()], window)
        q.rank({r.term: r.n for r in term_counts(index, q).collect()})  # at most the block's vocabulary
        found.append(search(index, q))
    hits = found[0]
    if n_blocks > 1:
        for more in found[1:]:
            hits = hits.unionByName(more)
        each = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items", "near")}
        hits = settled(hits.groupBy("row", "doc_id", "n_words").agg(*each.values()))
    runs = F.array_sort(F.arrays_zip("starts", "ends"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["ends"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(a["end"], x["starts"]))).alias("n"),
    )
    ids = {c: F.array_sort(F.array_distinct(c)) for c in ("items", "near")}
    return hits.select(
        "row", "doc_id", "n_words", "starts", "ends", ids["items"].alias("items"), ids["near"].alias("near"), F.aggregate(runs, zero, step)["n"].alias("n_hit")
    ).withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 1 over the whole ``documents`` and ``benchmark``."""
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
w AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
p AS (
  SELECT doc_id, ws, i, n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (SELECT DISTINCT n FROM w)
  WHERE i + n - 1 <= len(ws)),
h AS (SELECT doc_id, i, p.n, item FROM p JOIN w ON p.n = w.n AND array_to_string(ws[i:i + p.n - 1], ' ') = w.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
