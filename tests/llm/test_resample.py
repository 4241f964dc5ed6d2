"""Importance resampling against plain loops."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tierflow.llm import resample
from tierflow.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, target, least=20):
    """Rows (doc_id, n_features, weight, score, rank) as the contract says them."""
    words = [WORD.findall((t or "").translate(LOW)) for _, t in docs]
    of = lambda w: [*w, *(" ".join(p) for p in zip(w, w[1:]))]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for w in words for f in of(w))
    t = Counter(bucket(f) for x in target for f in of(WORD.findall((x or "").translate(LOW))))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    rows = []
    for (d, _), w in zip(docs, words, strict=True):
        g = [gain[bucket(f)] for f in of(w)]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


@pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables aren't here")
def test_query_brute_force(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    target = [t for (t,) in duckdb.sql(f"select text from '{DATA}/benchmark.parquet'").fetchall()]
    got = QUERIES["op13_resample"](spark, DATA).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(plain(docs, target))


def test_odd_rows(spark):
    many = "Ein Wort und noch EINES " * 5
    docs = [(1, None), (2, ""), (3, "..."), (4, "a" * 500 + " b"), (5, "word " * 60_000), (6, many), (6, many), (6, many), (None, many), (None, many), (7, "É é 東京 x_y"), (8, many + "\x00 tail")]
    extra = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, rank int")
    for target in ([], [None, ""], ["Wort und noch", "東京"]):
        bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
        got = resample.resampled(extra, bench).select("doc_id", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(docs, target)))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resampled(none, bench).collect() == []


def test_bracket_holds_the_row_whatever_the_scores(spark):
    rng = np.random.default_rng(1)
    for scores in (rng.integers(0, 3, 5000), rng.integers(0, 10**6, 5000), np.zeros(400, int)):
        df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(scores)], "doc_id long, score long")
        order = sorted(((-int(x), i) for i, x in enumerate(scores)))
        for wanted in (1, len(scores) // 4, len(scores)):
            found = resample.bracket(df, wanted, len(scores))
            assert found.above < wanted <= found.above + found.inside
            assert resample.cutoff(df, wanted, found) == (-order[wanted - 1][0], order[wanted - 1][1])


def test_bracket_is_widened(spark):
    """A sketch that is off by a tenth gives a bracket beside the row, which exact counts refuse."""

    class Wrong:
        def __init__(self, df):
            self.df, self.asked = df, 0

        def approxQuantile(self, column, ends, error):  # noqa: N802
            self.asked += 1
            return self.df.approxQuantile(column, ends if self.asked > 1 else [max(0.0, x - 0.1) for x in ends], 0.0)

        def agg(self, *x):
            return self.df.agg(*x)

    wrong = Wrong(spark.range(10_000).selectExpr("id as doc_id", "id as score"))
    found = resample.bracket(wrong, 2500, 10_000)
    assert wrong.asked > 1 and found.low <= 7500 <= found.high


def test_draws_follow_the_weights(spark):
    """Texts of the target's words are drawn far more often than others."""
    docs = spark.createDataFrame([(i, ("alpha beta gamma " if i % 4 == 0 else "delta epsilon zeta ") * 10) for i in range(2000)], "doc_id long, text string")
    target = spark.createDataFrame([(1, "alpha beta gamma " * 30_000)], "item_id long, text string")
    drawn = resample.resampled(docs, target).filter("rank is not null")
    assert drawn.count() == 500 and drawn.filter("doc_id % 4 = 0").count() > 400
