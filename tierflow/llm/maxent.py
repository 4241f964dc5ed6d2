"""Language-model scores: a hashed maximum-entropy model with class-factored softmax, and a unigram base."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, hashed_words, mixed, text_blocks, texts_of, written

#: Word classes, by a hash of a word's last three bytes.
CLASSES = 40
#: Decisions on the way to a word that see all features (a tree over classes of equal mass has as many); those after see the word before.
DEEP = 6
#: The weight table has a weight for so many training tokens, and so many bits at most and at least.
SPREAD, BITS, LEAST_BITS = 1, 20, 16
#: Rounds of updates (each over its own share of the training documents), what keeps updates of rare features small, and the largest weight.
ROUNDS, DAMP, LARGEST = 3, 1.0, 3.0
#: Added to each token's count.
SMOOTH = 0.1
#: A token with at least this share of all training tokens is frequent: 200,000 at most are, whatever the corpus.
FREQUENT = 5e-6
#: Parts of the gradient, bytes of text and tokens that are worked on at once.
PARTS, BLOCK, STEP = 64, 1 << 20, 1 << 15
#: Distinct tokens of blocks that a task holds before it sends their counts.
HELD = 1 << 21
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix class, how many each text has) of the tokens of ``texts`` one after another: lowered words, then one end."""
    h, counts, tail = hashed_words(texts)
    place = np.arange(len(h)) + np.repeat(np.arange(len(texts)), counts)
    out, classes = np.full(len(h) + len(texts), END), np.zeros(len(h) + len(texts), np.int64)
    out[place], classes[place] = h, (mixed(tail * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % CLASSES
    return out, classes, counts + 1


def marked(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, held_out): of each ten documents by CRC-32 of their doc_id, one is held out. A null doc_id counts as ""."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    return texts_of(docs, extra={"row": F.monotonically_increasing_id(), "held_out": held})


def count_tokens(rows: DataFrame) -> DataFrame:
    """(h, suffix, c): for each distinct token of all texts its hash, suffix class and count in training texts (0 for those only held out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, suffix, c = (np.concatenate(x) for x in zip(*held, strict=True))
            one, first, where = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(suffix[first]), pa.array(np.bincount(where, c).astype(np.int64))], ["h", "suffix", "c"])

        for batch in text_blocks(batches, BLOCK):
            h, suffix, n = tokens(as_bytes(batch))
            one, first, where = np.unique(h, return_index=True, return_inverse=True)
            train = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False), n)
            held.append((one, suffix[first], np.bincount(where, train, len(one))))
            size += len(one)
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    each = rows.mapInArrow(run, "h long, suffix long, c long")
    return each.groupBy("h").agg(F.min("suffix").alias("suffix"), F.sum("c").alias("c"))


def paths(mass: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A binary tree over leaves with ``mass``, each part split where its halves weigh most alike: (start, node, right) and bias.

    ``classes`` of the leaves, which rise: a part with several of them is only split between two, so each class is a subtree, and the decisions before it are those of a tree over classes.
    The decisions of leaf i are those from start[i] to start[i + 1]: the node, and whether it goes right. A node is named by its split;
    ``bias`` is the log odds of going right by mass.
    """
    n = len(mass)
    total = np.concatenate([[0.0], np.cumsum(mass)])
    edge = np.flatnonzero(np.diff(classes, prepend=-1, append=-1)) if classes is not None and n else np.array([0, n])  # where classes begin, and the end
    lo, hi = np.zeros(n, np.int64), np.full(n, n)
    leaf, bias = np.arange(n), np.zeros(n)
    found = [(np.zeros(0, np.int64),) * 3]
    while len(leaf := leaf[hi[leaf] - lo[leaf] > 1]):
        a, b = lo[leaf], hi[leaf]
        half = (total[a] + total[b]) / 2
        split = np.clip(np.searchsorted(total, half), a + 1, b - 1)
        first, last = np.searchsorted(edge, a, "right"), np.searchsorted(edge, b) - 1  # edges inside of the part
        between = edge[np.clip(np.searchsorted(total[edge], half), first, np.maximum(first, last))]
        split = np.where(first <= last, between, split)
        bias[split] = np.log((total[b] - total[split]) / (total[split] - total[a]))
        right = leaf >= split
        found.append((leaf, split, right.astype(np.int64)))
        lo[leaf], hi[leaf] = np.where(right, split, a), np.where(right, b, split)
    leaf, node, right = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(leaf, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=n))]), node[order], right[order], bias


class Model:
    """What tasks need for scores: frequent tokens with their counts, what the rest of each class has, and the weights.

    Leaves of the tree are the frequent tokens and, of each class, the rest. Each class is a subtree: the decisions before it pick
    a token's class, and those in it the token. The tree is made anew in each process from the counts.
    """

    def __init__(self, common: np.ndarray, counts: np.ndarray, suffixes: np.ndarray, room: np.ndarray, bits: int, weights: np.ndarray | None = None):
        self.common, self.counts, self.suffixes, self.room, self.bits = common, counts, suffixes, room, bits
        self.weights = np.zeros(1 << bits, np.float32) if weights is None else weights
        self._tree = None

    def __getstate__(self):
        return self.__dict__ | {"_tree": None}

    def tree(self):
        """(leaf of each frequent token, leaf of each class' rest, start, and of each decision on the way to a leaf the node's hash, right and bias)."""
        if self._tree is None:
            of = np.concatenate([self.suffixes, np.arange(CLASSES)])
            mass = np.concatenate([self.counts + SMOOTH, self.room])
            order = np.lexsort((-mass, of))
            place = np.empty(len(of), np.int64)
            place[order] = np.arange(len(of))
            start, node, right, bias = paths(mass[order], of[order])
            mark = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            self._tree = place[: len(self.common)], place[len(self.common) :], start, mark, right.astype(np.int8), bias[node].astype(np.float32)
        return self._tree

    def find(self, h: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number among the frequent tokens or -1, leaf) of each token."""
        own, rest = self.tree()[:2]
        if not len(self.common):
            return np.full(len(h), -1), rest[suffix]
        one, first, where = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.common, one), len(self.common) - 1)
        here = self.common[at] == one
        return np.where(here, at, -1)[where], np.where(here, own[at], rest[suffix[first]])[where]

    def decisions(self, leaf: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, right, z, first rows, (decision, rows) of the others): all decisions of tokens with these leaves and features (``seen``)."""
        _, _, start, mark, right, bias = self.tree()
        n = start[leaf + 1] - start[leaf]
        token = np.repeat(np.arange(len(leaf)), n)
        inner = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(start[leaf], n) + inner
        mark = mark[at]
        shift = np.uint64(64 - self.bits)
        row = lambda f, k: ((((seen[f][token[k]] ^ mark[k]) * np.uint64(0xD6E8FEB86659FD93)) >> shift)).astype(np.int64)
        first, high = row(0, slice(None)), np.flatnonzero(inner < DEEP)
        others = np.stack([row(f, high) for f in range(1, len(seen))])
        z = bias[at] + self.weights[first]
        z[high] += self.weights[others].sum(0)
        return token, right[at], z, first, (high, others)


def contexts(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Features of each token by hash: the word before, the one before that (skip), and both (trigram); a start where there is none."""
    first = np.zeros(len(h), bool)
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
    one = np.roll(h, 1)
    one[first] = 1
    two = np.roll(one, 1)
    two[first] = 2
    found = [one * np.uint64(0x9E3779B97F4A7C15), two * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)]
    found.append((found[0] ^ (found[1] >> np.uint64(7))) * np.uint64(0x165667B19E3779F9))
    return [x ^ (x >> np.uint64(31)) for x in found]


def gradient(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(slope, curvature) of the log probability of the texts of ``rows`` for each weight; summed by parts of the table on the executors.

    A task sends each number's upper 16 bits, and the tables' parts are added one after another.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    size = 1 << model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        sums = np.zeros((2, size))
        for batch in text_blocks(batches, BLOCK):
            h, suffix, counts = tokens(as_bytes(batch))
            leaf, seen = m.find(h, suffix)[1], contexts(h, counts)
            for i in range(0, len(h), STEP):
                _, right, z, first, (high, others) = m.decisions(leaf[i : i + STEP], [x[i : i + STEP] for x in seen])
                p = 1 / (1 + np.exp(-z))
                for k, x in enumerate((right - p, p * (1 - p))):
                    x = x.astype(np.float64)  # of the same type, numpy adds fast
                    np.add.at(sums[k], first, x)
                    for own in others:
                        np.add.at(sums[k], own, x[high])
        if not sums.any():
            return
        short = ((sums.astype("<f4").view("<u4") + np.uint32(0x8000)) >> np.uint32(16)).astype("<u2")
        pieces = [x.tobytes() for x in np.split(short, PARTS, axis=1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int64()), pa.array(pieces)], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(0)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.astype("<f4").tobytes()])], ["part", "sums"])
        for batch in batches:
            for k, x in zip(batch.column("part").to_pylist(), batch.column("sums"), strict=True):
                if k != part:
                    if part is not None:
                        yield out()
                    part, total = k, np.zeros(2 * size // PARTS)
                total += (np.frombuffer(x.as_py(), "<u2").astype("<u4") << np.uint32(16)).view("<f4")
        if part is not None:
            yield out()

    parts = rows.select("text").mapInArrow(run, "part long, sums binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part long, sums binary")
    found = {r.part: np.frombuffer(r.sums, "<f4").reshape(2, -1) for r in parts.collect()}  # two numbers for each weight
    return tuple(np.concatenate([found[k] for k in range(PARTS)], axis=1)) if found else (np.zeros(size),) * 2


def train(rows: DataFrame, model: Model) -> Model:
    """``model`` after ROUNDS synchronous gradient updates, each from its own share of the training texts, all of which are used.

    An update moves each weight by slope / (curvature + DAMP), so that a frequent and a rare feature learn alike.
    """
    for k in range(ROUNDS):
        slope, curve = gradient(rows.filter(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)) == k)), model)
        weights = np.clip(model.weights + slope / (curve + DAMP) / 2, -LARGEST, LARGEST).astype(np.float32)
        model = Model(model.common, model.counts, model.suffixes, model.room, model.bits, weights)
    return model


def partial_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, n_known, base, model, h, n): per text the sums that a task can make by itself.

    ``base`` sums log10(c + SMOOTH) over the frequent tokens; ``model`` is the log10 probability of the text's leaves, less the room of their class
    for tokens that aren't frequent. ``h`` and ``n`` are those tokens, each once, and how often.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        logs, room = np.append(np.log10(m.counts + SMOOTH), 0.0), np.log10(m.room)
        for batch in text_blocks(batches, BLOCK):
            h, suffix, n = tokens(as_bytes(batch))
            doc = np.repeat(np.arange(len(n)), n)
            common, leaf = m.find(h, suffix)
            seen, chosen = contexts(h, n), np.zeros(len(n))
            for i in range(0, len(h), STEP):
                token, right, z, _, _ = m.decisions(leaf[i : i + STEP], [x[i : i + STEP] for x in seen])
                # biases are log odds of counts and weights are bounded, so nothing overflows
                chosen += np.bincount(doc[i + token], -np.log1p(np.exp(np.where(right, -z, z))), len(n))
            often = common >= 0
            rest = np.bincount(doc[~often], room[suffix[~often]], len(n))
            by = np.lexsort((h[~often], doc[~often]))
            rare, of = h[~often][by], doc[~often][by]
            at = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])])) if len(rare) else np.zeros(0, np.int64)
            cuts = np.searchsorted(of[at], np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (rare[at].view(np.int64), np.diff(np.append(at, len(rare))).astype(np.int32))]
            sums = [pa.array(x) for x in (n, np.bincount(doc[often], minlength=len(n)), np.bincount(doc, logs[common], len(n)), chosen / math.log(10) - rest)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "held_out")], *sums, *lists], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "model", "h", "n"])

    return rows.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, h array<long>, n array<int>")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) for each row of ``docs`` (doc_id, text).

    Tokens are lowered words and one end. A token's probability in the model is that of its class times that of the token in its class, both by
    decisions in a tree, each of which is a softmax of two over hashed features: the word before, and for the class also the one before that and both.
    A token that isn't frequent shares the leaf of its class' rest, of which it gets its smoothed share. The probabilities of all tokens, with
    one unseen one for each class, add up to one. The weight table grows with the training tokens up to 2 ** BITS weights, counts without a bound.
    Counts of all training tokens are summed with partial sums; frequent tokens, of which there is a
    bounded number, are looked up in the tasks, so no hot token is ever a join key, and the rest by an equi-join on their 64-bit hashes.
    Words with the same hash would count as one (with a billion distinct words, one such pair is expected once in forty corpora).
    A null, empty or blank text is its end alone. Repeated rows are scored alike. An empty table gives an empty result. Other columns play no part.
    """
    rows = marked(docs)
    vocab = written(count_tokens(rows))
    total, distinct = (int(x or 0) for x in vocab.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first())
    frequent = F.col("c") >= max(1.0, FREQUENT * total)
    known = vocab.filter(frequent).select("h", "suffix", "c").toArrow()
    common = known["h"].to_numpy().view(np.uint64)
    order = np.argsort(common)
    room = np.full(CLASSES, SMOOTH)
    for r in vocab.filter(~frequent & (F.col("c") > 0)).groupBy("suffix").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        room[r.suffix] = r.c + SMOOTH * (r.v + 1)  # a word not seen has room in each class
    bits = min(BITS, max(LEAST_BITS, (total // SPREAD).bit_length()))
    model = train(rows, Model(common[order], known["c"].to_numpy()[order], known["suffix"].to_numpy()[order], room, bits))
    parts = written(partial_scores(rows, model))
    tail = parts.select("row", F.explode(F.arrays_zip("h", "n")).alias("x")).select("row", "x.h", "x.n")
    rare = vocab.filter(~frequent & (F.col("c") > 0)).select("h", "c")
    found = tail.join(rare, "h", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("also")
    )
    more = F.coalesce("more", F.lit(0.0))
    return parts.drop("h", "n").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * math.log10(total + SMOOTH * (distinct + 1))).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10 over the whole ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
