"""Quality rules: repetition by suffix arrays, and counts of words, symbols and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, text_blocks, texts_of

#: Words that a repeated substring has at least to count as one; share of a text's words that such ones may cover, and
#: share that the longest one may have.
LEAST, COVERED, LONGEST = 10, 0.3, 0.2
#: Base rules (fixed by the contract of operator 7): fewest words, and most words in 3-word windows found twice, of 100.
WORDS, REPEATED = 50, 50
#: Bytes of text whose suffixes are sorted at once.
BLOCK = 2 << 20
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest run of words from it that also starts elsewhere in its document.

    ``ids`` are the words of documents one after another, ``ends`` the position after each position's document. Suffixes
    are sorted by prefix doubling, of which each turn only takes up those that aren't alone yet; the longest
    common prefixes of neighbours come from the ranks that the turns leave, and the larger of a suffix's two is its answer.
    """
    n = len(ids)
    best = np.zeros(n, np.int64)
    if not n:
        return best
    # suffixes of different documents never share a first rank, so nothing is found across documents
    order = np.lexsort((ids, ends))
    key = np.ones(n, bool)
    key[1:] = (ids[order][1:] != ids[order][:-1]) | (ends[order][1:] != ends[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(key, np.arange(n), 0))
    levels, step = [rank.astype(np.int32)], 1
    active = order[~(key & np.append(key[1:], True))]
    while len(active):
        after = active + step
        inside = after < ends[active]
        nxt = np.where(inside, levels[-1][np.minimum(after, n - 1)], -1)
        own = rank[active]
        by = np.lexsort((nxt, own))
        active, own, nxt = active[by], own[by], nxt[by]
        group = np.ones(len(active), bool)
        group[1:] = own[1:] != own[:-1]
        part = group.copy()
        part[1:] |= nxt[1:] != nxt[:-1]
        at = np.arange(len(active))
        first, start = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(part, at, 0))
        rank[active] = own + start - first
        levels.append(rank.astype(np.int32))  # places in a block, which has fewer words than that
        active = active[~(part & np.append(part[1:], True))]
        step *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    a, b = array[:-1], array[1:]
    near = levels[0][a] == levels[0][b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = (x < ends[a]) & (y < ends[b])
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        common[ok] += 1 << k
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def covered(best: np.ndarray, least: int, length: int | None = None) -> np.ndarray:
    """Which positions lie in a repeated run of ``least`` words or more; of such runs only ``length`` words if given."""
    n = len(best)
    start = np.flatnonzero(best >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + (best[start] if length is None else length), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes], least: int, max_covered: float, max_longest: float) -> dict[str, np.ndarray]:
    """The counts and the verdict for each of some texts, whose suffixes are sorted together."""
    vocab: dict[bytes, int] = {}
    put, counts, parts, dups = vocab.setdefault, [], [np.zeros(0, np.int64)], []
    for text in texts:
        ws = text.split()
        counts.append(len(ws))
        parts.append(np.array([put(w, len(vocab)) for w in ws], np.int64))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dups.append(len(lines) - len(set(lines)))
    counts = np.array(counts, np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    cuts = np.cumsum([0, *map(len, texts)])
    ends = np.cumsum(counts)
    at = np.concatenate([[0], ends])
    total = lambda flags, by: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[by])
    best = repeats(np.concatenate(parts), np.repeat(ends, counts))
    triple, spans = total(covered(best, 3, 3), at), total(covered(best, least), at)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(texts)), counts), best)
    longest[longest < least] = 0
    failed = (counts < WORDS) | (100 * triple > REPEATED * counts)
    share = spans / np.maximum(counts, 1)
    return {
        "n_words": counts, "word_chars": total(((raw & 0xC0) != 0x80) & ~SPACES[raw], cuts), "n_symbols": total(SYMBOLS[raw], cuts), "n_dup_lines": np.array(dups, np.int64),
        "n_repeat_words": triple, "covered": share, "longest": longest, "base_failed": failed,
        "kept": ~failed & (share <= max_covered) & (longest <= max_longest * counts),
    }


def rate(docs: DataFrame, least: int = LEAST, max_covered: float = COVERED, max_longest: float = LONGEST) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered (share of words in maximal
    repeated substrings of ``least`` words or more, their spans united), longest (words of the longest), base_failed, and
    kept: not base_failed, ``covered`` is ``max_covered`` at most and ``longest`` is ``max_longest`` of the words at most.
    Words are runs of anything but ASCII white space. A null, empty or blank text has zero in all counts and isn't kept. Repeated rows are rated
    alike, an empty table gives an empty result, other columns play no part; a share or length just at its limit is kept.
    Documents aren't shuffled; the suffixes of about 2 MB of whole texts are sorted together, each document's apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, BLOCK):
            out = measure(as_bytes(batch), least, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out.values())], ["doc_id", *out])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered double, longest long, base_failed boolean, kept boolean"
    return texts_of(docs).mapInArrow(run, schema)


def keep_good(docs: DataFrame, least: int = LEAST, max_covered: float = COVERED, max_longest: float = LONGEST) -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, with all their columns, whatever their names; rows pass through one step and aren't shuffled."""
    small_batches(docs.sparkSession)
    held = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("held"))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the text is looked at where it is in the row, so that it is sent once
            texts = pa.RecordBatch.from_arrays([batch.column("held").field(place).cast(pa.string()), pa.array(range(batch.num_rows), pa.int32())], ["text", "row"])
            for part in text_blocks(iter([texts]), BLOCK):
                kept = measure(as_bytes(part), least, max_covered, max_longest)["kept"]
                yield batch.slice(part.column("row")[0].as_py(), part.num_rows).filter(pa.array(kept))

    out = held.mapInArrow(run, held.schema)
    return out.select(*[F.col(f"held.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over the whole ``documents``."""
    out = rate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("covered", 6).alias("covered"), "longest")
