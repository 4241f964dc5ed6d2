"""Operators against brute force on small fixtures, and on odd rows."""

import collections
import hashlib
import math
import re
import zlib
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tierflow.llm import decontaminate, html, license, maxent, mixing, pii, quality, sharding, simhash, similar, suffixes
from tierflow.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id").fetchall()


LINE = "the same words again and again in a line that is longer than ten words"
ODD = [
    (1, None, "a", 5, "x"), (2, "", "a", 5, "x"), (None, "one two three", None, 5, "x"), (None, "one two three", None, 5, "x"), (5, "É " * 3 + "MIT License", "b", 5, "x"),
    (6, LINE + "\n" + LINE, "b", 5, "x"), (6, LINE + "\n" + LINE, "b", 5, "x"), (7, " \n\t ", "c", 5, "x"), (8, "word " * 30_000, "c", 5, "x"), (9, "a" * 300, "c", 5, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with the names of results."""
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, size int, shard string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(SQL[name])
    order = sorted(want.columns)
    got = QUERIES[name](spark, DATA).select(*order).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want.select(*order).fetchall()))


def test_phrase_and_proximity(spark):
    docs = spark.createDataFrame([(1, "x A b c d y"), (2, "a b x c d"), (3, "a b c"), (4, "b c"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "a b c d e"), (11, "B, C!"), (12, ""), (None, "a")], "item_id long, text string")
    one = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, bench, window=4).collect()}
    assert one == {1: (4, ["10", "11"]), 2: (1, []), 3: (3, ["11"]), 4: (2, ["11"]), 5: (0, [])}
    blocks = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.decontaminate(docs, bench, window=4, query_bytes=6).collect()}
    assert blocks == one
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect() if "11" in r.near} == {1, 3, 4, 2}
    unnamed = spark.createDataFrame([(None, "b c"), (None, None)], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(docs, unnamed).collect()} == {1: (2, 0, True), 2: (0, 0, False), 3: (2, 0, True), 4: (2, 0, True), 5: (0, 0, False)}


def test_proximity_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{min(int(x), 300)}" for x in rng.zipf(1.3, int(rng.integers(1, 200)))) for _ in range(60)]
    items = [" ".join(f"w{x}" for x in rng.integers(1, 60, int(rng.integers(1, 9)))) for _ in range(40)]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    count = collections.Counter(w for t in texts for w in t.split())
    order = {w: i for i, w in enumerate(dict.fromkeys(w for t in items for w in t.split()))}
    for blocks in (1 << 20, 300):
        got = {r.doc_id: set(map(int, r.near)) for r in decontaminate.decontaminate(docs, bench, query_bytes=blocks).collect()}
        for d, t in enumerate(texts):
            at = collections.defaultdict(list)
            for i, w in enumerate(t.split()):
                at[w].append(i)
            for k, item in enumerate(items):
                own = sorted(set(item.split()), key=lambda w: (count[w], order[w]))
                if len(own) < 2 or len({count[w] for w in own}) < len(own):  # ties may go either way
                    continue
                want = any(all(any(abs(i - j) <= 20 for j in at[w]) for w in own[:4]) for i in at[own[0]])
                assert (k in got[d]) == want


def test_long_item_in_segments(spark):
    item = [f"w{i}" for i in range(9000)]
    docs = spark.createDataFrame([(1, " ".join(item[4080:4120])), (2, " ".join(item[4090:4099])), (3, " ".join(item[8980:]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (40, 1), 2: (0, 0), 3: (20, 1)}


def union_find(pairs, n):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return [root(i) for i in range(n)]


@needs_data
def test_simhash_brute_force(spark, texts):
    prints = []
    for _, t in texts:
        w = t.translate(LOW).encode().split()
        n = min(3, len(w))
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if n else []
        prints.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)))
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = union_find(near, len(prints))
    want = {(d, f"{p:016x}", texts[r][0]) for (d, _), p, r in zip(texts, prints, roots, strict=True)}
    assert {tuple(r) for r in QUERIES["op3_simhash"](spark, DATA).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64).tolist()
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(12)})
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), chunk=4).collect()]
    place = {x: i for i, x in enumerate(fps)}
    want = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps[:i]) if (a ^ b).bit_count() <= 2]
    assert union_find([(place[a], place[b]) for a, b in got], len(fps)) == union_find(want, len(fps))
    assert len(got) < len(want) or len(want) < 20


def test_components_of_a_long_path(spark):
    from tierflow.llm.common import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_shards_fit(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)], "doc_id long, text string")
    rows = sharding.assign_shards(docs, limit=400).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.shard] += len(r.text)
        assert len(r.shard) == r.local_depth
    assert len(rows) == 500 and max(sizes.values()) <= 400
    assert all(r.shard_bytes == sizes[r.shard] for r in rows)
    parents = {s[:-1] for s in sizes if s}
    assert all(sum(n for s, n in sizes.items() if s.startswith(p)) > 400 for p in parents)  # only oversized ones were split
    assert not any(a != b and b.startswith(a) for a in sizes for b in sizes)


def test_shards_of_rows_that_hashes_cannot_part(spark):
    """A key with a third of all rows, a row over the limit, and columns with the names that the operator uses inside."""
    rows = [(7 if i % 3 == 0 else i, "x" * 30, 1, "p") for i in range(300)] + [(1000, "y" * 900, 1, "p"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, depth int, prefix string")
    out = sharding.assign_shards(docs, limit=400)
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:4] == docs.columns
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += len(r.text or "")
        assert len(r.shard) == r.local_depth
    assert sorted(sizes.values())[-1] == 900 and sorted(sizes.values())[-2] <= 400
    assert all(r.shard_bytes == sizes[r.shard] for r in got) and not any(a != b and b.startswith(a) for a in sizes for b in sizes)
    assert sharding.split_buckets(spark.createDataFrame([(0, 5, 900), (0, 1 << 59, 1)], "part long, code long, n_bytes long"), 400).count() == 2


def test_mix_keeps_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(i, "a b", "s", "own", i) for i in range(5)], "doc_id long, text string, source string, copies string, size long")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {(r.copies, r.size) for r in out.collect()} == {("own", i) for i in range(5)}


def cut(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@needs_data
def test_repeats_brute_force(spark, texts):
    got = {r.doc_id: bytes(r.kept) for r in suffixes.drop_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == cut(texts)


def test_repeats_at_every_border(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdé"), n))
    shared = [word(99), word(100), word(101), word(260)]
    rows = [(i, word(int(rng.integers(0, 60))) + shared[i % 4] + word(int(rng.integers(0, 60))) + shared[(i + 1) % 4]) for i in range(24)] + [(50, "ab" * 200), (51, "ab" * 70), (52, None)]
    got = {r.doc_id: bytes(r.kept) for r in suffixes.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == cut(rows)


PAGE = """<html><head><title>t</title><script>if (a < b) x("</p>")</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="ad">Buy now, really, this long advert text is here for you and everybody else to read today</div>{}<div id="comments"><p>First! I think this is a very long and pointless reader comment.</p></div><footer>&copy; us</footer></body>"""


@pytest.mark.parametrize(("wrap", "lead"), [("<article>{}</article>", "<h1>A&amp;B</h1>"), ("<div>{}</div>", "<h2>A&amp;B</h2>")])
def test_main_text(wrap, lead):
    body = lead + "<p>A paragraph of  some\nlength that goes on and on, until it is over.<br>Next line<p>Another <b>bold</b> one, which is also quite long, as texts go.</p><p>End.</p>"
    want = "A&B A paragraph of some length that goes on and on, until it is over. Next line Another bold one, which is also quite long, as texts go. End."
    assert html.main_text(PAGE.format(wrap.format(body))) == want


def test_odd_pages(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "plain &amp"), (5, "u", "<nav>x"), (None, "u", "<article>" + "<p>w" * 5000)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(rows).collect()}
    assert got == {1: ("", 0), 2: ("", 0), 3: ("", 0), 4: ("plain &", 7), 5: ("", 0), None: ("w " * 4999 + "w", 9999)}


LONG = "The body goes on for a good while here, with many words that tell one what there is to tell, and some more."


@pytest.mark.parametrize(
    ("noise", "kept"),
    [
        ("<p class='notice'>note<p>body", "body"), ("<ul><li class='share'>x</ul>", ""), ("<ul><li class='share'>a<ul><li>b</ul>c<li>next</ul>", "next"),
        ("<table><tr><td class='ad'>x<td>cell</table>", "cell"), ("<table><tr class='ad'><td>x<tr><td>row</table>", "row"), ("<dl><dt class='ad'>x<dd>y</dl>", "y"), ("<div><span class='ad'>x</div>", ""),
    ],
)
def test_noise_without_end_tag(noise, kept):
    assert html.main_text(f"<body><div>{noise}<p>{LONG}</div></body>") == f"{kept} {LONG}".strip()


def test_article_element_is_weighed():
    teaser = "<article><h3>Teaser</h3><p>Only a teaser.</p></article>"
    assert html.main_text(f"<div>{f'<p>{LONG}' * 4}</div>{teaser}").startswith(" ".join([LONG] * 4))
    comment = f"<article class='comment-body'><p>{LONG}</article>"
    assert html.main_text(f"<div><p>Body. {LONG}</div>{comment * 3}") == f"Body. {LONG}"
    # an element with most of the text keeps its short ends and nothing beside it
    assert html.main_text(f"<p>Home<article><p>Start<p>{LONG}<p>1<p>2<p>3<p>4</article><p>More") == f"Start {LONG} 1 2 3 4"


@pytest.mark.parametrize("name", ["layout with-sidebar", "page has-banner", "post-related", "content no-ads", "sidebar-layout", "banner"])
def test_container_of_the_text_is_kept(name):
    page = f"<body><div class='site-footer'>All rights reserved by us, the people of this site, for ever and ever.</div><div class='{name}'>{f'<p>{LONG}' * 3}<div class='ad-box'>{LONG}</div></div></body>"
    assert html.main_text(page) == " ".join([LONG] * 3)


def test_long_comments_under_a_short_text():
    comments = f"<div id='comments'>{f'<p>{LONG}' * 9}</div>"
    assert html.main_text(f"<body><div><p>{LONG}<p>{LONG}</div>{comments}</body>") == f"{LONG} {LONG}"


class Article(HTMLParser):
    """The text of article elements by Python's parser, without asides and names that say so."""

    def __init__(self):
        super().__init__()
        self.out, self.inside, self.skip = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in html.VOID:
            self.out.append(" " if tag == "br" else "")
            return
        self.inside += tag == "article"
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).split()
        if self.skip:
            self.skip.append(tag) if tag == self.skip[0] else None
        elif tag in ("script", "style", "nav", "aside", "form", "footer") or set(names) & {"ad", "share", "comment", "comments", "related", "notice", "cookie", "newsletter", "sidebar"}:
            self.skip.append(tag)
        if tag in html.BREAKS:
            self.out.append(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if self.skip and tag == self.skip[0]:
            self.skip.pop()
        if tag in html.BREAKS:
            self.out.append(" ")

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.out.append(data)


@needs_data
def test_given_pages_by_another_parser(spark):
    """All given pages have one article; with its tag made a div, its text is the same on nearly all of them, and nothing else comes in."""
    pages = duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    want = {}
    for i, page in pages:
        parser = Article()
        parser.feed(page)
        want[i] = " ".join("".join(parser.out).split())
    got = {r.page_id: r.text for r in QUERIES["op6_html"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want
    same = 0
    for i, page in pages:
        text = html.main_text(re.sub("<(/?)article", r"<\1div", page))
        assert text in want[i] and len(text) > 0.8 * len(want[i])
        same += text == want[i]
    assert same > 0.95 * len(pages)


def longest_runs(w):
    n = len(w)
    return [max((next((k for k in range(n) if max(i, j) + k >= n or w[i + k] != w[j + k]), 0) for j in range(n) if j != i), default=0) for i in range(n)]


def test_suffix_arrays_brute_force():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 40))) for _ in range(60)]
    ends = np.cumsum([len(x) for x in docs])
    got = quality.repeats(np.concatenate(docs), np.repeat(ends, [len(x) for x in docs]))
    assert got.tolist() == [x for w in docs for x in longest_runs(w.tolist())]


@needs_data
def test_quality_counts(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op7_quality"](spark, DATA).collect()}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(twice))
        assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w)) and not (r.base_failed and r.kept)
        if len(w) <= 400:
            runs = longest_runs(w)
            spans = {k for i, n in enumerate(runs) if n >= quality.LEAST for k in range(i, i + n)}
            longest = max((n for n in runs if n >= quality.LEAST), default=0)
            assert (r.covered, r.longest) == (pytest.approx(len(spans) / max(1, len(w)), abs=1e-6), longest)
            assert r.kept == (not r.base_failed and len(spans) / len(w) <= quality.COVERED and longest <= quality.LONGEST * len(w))


def test_megabytes_of_text(spark):
    """One text of megabytes in each operator."""
    long = " ".join(f"w{i * 7919 % 50_021}" for i in range(100_000)) + " +1 (389) 555-5010 x " + "7" * 100_000
    docs = spark.createDataFrame([(1, long, "a"), (2, None, "a"), (1, long, "a")], "doc_id long, text string, source string")
    n = len(long.split())
    assert {r.n_words for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, long[:9000])], "item_id long, text string")).collect() if r.n_hit} == {len(re.findall(r"[0-9a-z]+", long))}
    assert {r.n_words for r in quality.rate(docs).collect()} == {n, 0}
    assert [r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id == 1] == [1, 1]
    assert sorted(len(r.kept) for r in suffixes.drop_repeats(docs).collect())[-1] < len(long)
    assert {len(r.base) for r in pii.find(docs).collect()} == {0, 1}
    assert {r.n_tokens for r in maxent.score(docs).collect()} == {n + 1, 1}
    assert {r["size"] for r in mixing.mix(docs).collect()} == {n, 0} and sharding.assign_shards(docs).count() == 3
    assert {r.n_words for r in license.scan(docs).collect()} == {len(re.findall(r"[0-9a-z]+", long)), 0}
    pages = spark.createDataFrame([(1, "u", f"<p>{long}</p>" * 2)], "page_id long, url string, html string")
    assert html.extract(pages).first().n_chars == 2 * len(long) + 1


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 10 <= len(d) <= 15 if kind == "phone" else True


def test_personal_data_base(spark):
    tricky = ["a@b.c_d@e.f", "x@y.z.w.v and é@b.cd", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0004", "4111 1111-1111 1111 4111111111111112", "+1 (389) 555-5010, +123 +49 30 1234567-", "", None, "+" * 50 + "1" * 60]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    got = {r.doc_id: [(c.start, pii.KINDS[c.kind], c.end) for c in r.base] for r in pii.find(docs).collect()}
    for i, t in enumerate(tricky):
        want = [(m.start(), k, m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if passes(k, m[0])]
        assert got[i] == sorted(want, key=lambda x: (x[0], pii.KINDS.index(x[1])))


def test_personal_data_in_very_long_runs(spark):
    long = ["7 " * 20_000, "1" * 50_000, "a@b" + ".c" * 30_000, "4111 1111-1111 1111", "1 " * 9_000 + "x 4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: [(c.start, pii.KINDS[c.kind], c.end) for c in r.base] for r in pii.find(docs).collect()}
    assert got == {0: [], 1: [], 2: [(0, "email", 60_003)], 3: [(0, "card", 19)], 4: [(18_002, "card", 18_018)]}


def test_rare_kind_has_a_threshold(spark):
    """20 keys among 40,000 numbers, of which a sample by hash alone of this size has next to none."""
    token = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    rows = [(i, " ".join(f"{i}x{100 + j}" for j in range(40))) for i in range(1000)] + [(1000 + i, f"api key = {token(i)} in use") for i in range(20)]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    _, best = pii.fit(found, sample=400)
    assert pii.KINDS.index("secret") in best
    added = {r.doc_id for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), sample=400).collect() if any(pii.KINDS[c.kind] == "secret" for c in r.added)}
    assert added == set(range(1000, 1020))


def planted_personal_data(n, seed, hints):
    """(text, start, end, kind or None) of candidates that no rule of the contract covers, right and wrong ones, with words that name them or without."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abdeiklmnorstuz"), int(rng.integers(3, 9))))
    right = [
        ("phone", "call ", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", "tel. ", lambda: f"0{digits(3)} {digits(3)} {digits(4)}"), ("email", "mail: ", lambda: f"{word()}\u00fc@{word()}\u00f6.com"),
        ("secret", "api key = ", lambda: hashlib.sha256(word().encode()).hexdigest()), ("ip", "server ", lambda: ":".join(f"{int(x):x}" for x in rng.integers(4096, 65536, 8))),
    ]
    wrong = [
        (None, "date ", lambda: f"{int(rng.integers(10, 29))}/{int(rng.integers(10, 13))}/20{digits(2)}"), (None, "version ", lambda: f"{digits(2)}-{digits(2)}-{digits(2)}-{digits(2)}-{digits(2)}"),
        (None, "page ", lambda: f"{word()}@{word()}"), (None, "id ", lambda: "-".join(word() + digits(1) for _ in range(4))),
    ]
    out = []
    for i in range(n):
        kind, name, make = (right + wrong)[i % 9]
        lead = " ".join(word() for _ in range(6)) + " "
        lead += name if hints else ""
        found = make()
        out.append((f"{lead}{found} {word()} {word()}", len(lead), len(lead) + len(found), kind))
    return out


def test_added_spans_on_planted_data(spark):
    """Texts that name what they have teach the trees; they are judged on texts that don't."""
    train, test = planted_personal_data(1800, 1, True), planted_personal_data(900, 2, False)
    docs = spark.createDataFrame([(i, x[0]) for i, x in enumerate(train + test)], "doc_id long, text string")
    got = {(r.doc_id, c.start, c.end, pii.KINDS[c.kind]) for r in pii.find(docs).collect() for c in r.added if r.doc_id >= len(train)}
    want = {(len(train) + i, a, b, kind) for i, (_, a, b, kind) in enumerate(test) if kind}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
    # without trees nothing is added, so that it is they that decide
    assert not [c for r in pii.find(docs.filter(f"doc_id >= {len(train)}")).collect() for c in r.added]


def test_places_of_very_many_matches(spark):
    text = " x ".join(str(10 + i % 90) for i in range(40_000))
    rows = spark.createDataFrame([(text,)], "text string").select(pii.spans(F.col("text"), "[0-9]+").alias("m")).first().m
    assert [(m.start, m.end) for m in rows] == [m.span() for m in re.finditer("[0-9]+", text)]
    short = spark.createDataFrame([("a tel: 12 345,6é7",)], "text string").select(pii.spans(F.col("text"), "[0-9]+").alias("m")).first().m
    assert [(m.found, m.before, m.after) for m in short] == [("12", "a tel: ", " "), ("345", "12 ", ","), ("6", "345,", "é"), ("7", "6é", "")]


def test_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights a 1, b 2, c 3, d 1, null 2: a, c and d are full, b and null share the rest evenly
    assert got["a"] == 30 and got["c"] == 60 and got["d"] == 0
    assert got["b"] == pytest.approx(720) and got[None] == pytest.approx(720)
    assert sum(got.values()) == pytest.approx(1530)


@needs_data
def test_language_model(spark, texts):
    got = {r.doc_id: r for r in maxent.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    tokens = {d: [*t.translate(LOW).encode().split(), b"\n"] for d, t in texts}
    counts = collections.Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(d).encode()) % 10 == 0, len(ws), sum(w in counts for w in ws), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in ws), abs=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than the base on texts it hasn't learned from


def test_tree_of_words():
    """Every leaf has its own way, the tree's probabilities by mass are the leaves' shares, and the model's add up to one whatever its weights."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 300):
        mass = rng.pareto(1.0, n) + 0.1
        start, node, right, bias = maxent.paths(mass)
        ways = [tuple(zip(node[a:b].tolist(), right[a:b].tolist(), strict=True)) for a, b in zip(start[:-1], start[1:], strict=True)]
        assert len(set(ways)) == n
        share = [math.prod(1 / (1 + math.exp(-bias[k] if r else bias[k])) for k, r in way) for way in ways]
        assert share == pytest.approx((mass / mass.sum()).tolist())
        classes = np.sort(rng.integers(0, 12, n))
        start, node, right, bias = maxent.paths(mass, classes)
        ways = [tuple(zip(node[a:b].tolist(), right[a:b].tolist(), strict=True)) for a, b in zip(start[:-1], start[1:], strict=True)]
        assert [math.prod(1 / (1 + math.exp(-bias[k] if r else bias[k])) for k, r in way) for way in ways] == pytest.approx((mass / mass.sum()).tolist())
        for c in np.unique(classes):  # one way leads to a class, and no other class has a decision of those in it
            own, others = ([w for w, k in zip(ways, classes, strict=True) if (k == c) == inside] for inside in (True, False))
            seen = {k for w in others for k, _ in w}
            heads = {tuple(x for x in w if x[0] in seen) for w in own}
            assert len(heads) == 1 and all(w[: len(next(iter(heads)))] in heads for w in own)
    common = np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    model = maxent.Model(common, rng.integers(1, 90, 50), rng.integers(0, maxent.CLASSES, 50), rng.random(maxent.CLASSES) * 9 + 0.1, 10, rng.normal(0, 1, 1 << 10).astype(np.float32))
    leaves = np.arange(50 + maxent.CLASSES)
    seen = [np.full(len(leaves), x, np.uint64) for x in (11, 12, 13)]
    token, right, z, _, _ = model.decisions(leaves, seen)
    assert np.exp(np.bincount(token, -np.logaddexp(0, np.where(right, -z, z)))).sum() == pytest.approx(1)


MIT = """MIT License  Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""


def filled(tree, rng, optional):
    """A text of a template, with each optional region by chance and replaceable ones filled."""
    out = []
    for x in tree:
        if isinstance(x, list):
            out += filled(x, rng, optional) if rng.random() < optional else []
        elif isinstance(x, tuple):
            pick = x[1].split("|") if x[1] and "|" in x[1] else ["2024"] if x[1] else ["some", "person", "7"]
            out += [str(w) for w in rng.choice(pick, int(rng.integers(1, x[0] + 1)))]
        else:
            out.append(x)
    return out


def test_license_texts(spark):
    rng = np.random.default_rng(6)
    texts = [MIT, MIT.replace("free of charge", "for a fee"), MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "Acme Inc."), MIT.replace("sublicense, and/or", "and")]
    names = list(license.TEMPLATES)
    made = [" ".join(filled(license.parse(license.TEMPLATES[n]), rng, p)) for n in names for p in (0.0, 0.5, 1.0)]
    docs = spark.createDataFrame(list(enumerate(texts + made)), "doc_id long, text string")
    got = {r.doc_id: {m.label for m in r.matches if m.template} for r in license.scan(docs).collect()}
    assert "MIT" in got[0] and "MIT" in got[2] and "MIT" not in got[1] | got[3]
    for i, n in enumerate(names * 3):
        assert names[i // 3] in got[len(texts) + i]
    # a text that goes on otherwise after its first paragraph isn't accepted
    for n in ("BSL-1.0", "Unlicense"):
        words = filled(license.parse(license.TEMPLATES[n]), rng, 0.0)
        words[len(words) // 2 :] = "the authors keep all copyright and you must pay".split()
        assert license.Automaton(license.TEMPLATES[n]).match([w.encode() for w in words], 0) == -1
    # a word of the mandatory wording changed
    for n in names:
        tree = license.parse(license.TEMPLATES[n])
        words = filled(tree, rng, 0.0)
        at = max(i for i, w in enumerate(words) if w in tree and w not in ("some", "person", "7", "2024"))
        words[at] = "elsewhat"
        assert license.Automaton(license.TEMPLATES[n]).match([w.encode() for w in words], 0) == -1


@pytest.mark.parametrize("name", ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"])
def test_whole_license(name):
    rng = np.random.default_rng(8)
    tree, automaton = license.parse(license.TEMPLATES[name]), license.Automaton(license.TEMPLATES[name])
    bare, full = ([w.encode() for w in filled(tree, rng, p)] for p in (0.0, 1.0))
    assert len(bare) > 900
    around = [b"before", b"it"], [b"and", b"after"]
    for words in (bare, full):
        assert automaton.match(around[0] + words + around[1], 2) == 2 + len(words)
    for at in (*rng.integers(1, len(bare), 20), len(bare) * 19 // 20, len(bare) - 2):
        for other in (bare[:at] + [b"elsewhat"] + bare[at + 1 :], bare[:at] + [b"elsewhat"] + bare[at:], bare[:at]):  # changed, put in, cut off
            assert automaton.match(other, 0) == -1


def test_anchors_in_pieces(monkeypatch):
    """Every 100-byte string has the same anchor, in however small pieces a block is looked at; and documents keep theirs apart."""
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 101, int(n), dtype=np.uint8)) for n in (0, 99, 100, 350, 1200, 101, 640)]
    cuts = np.cumsum([0, *map(len, texts)])

    def found():
        pos, least, most, _ = suffixes.anchors(texts)
        counts = [len(g) for g, _ in suffixes.gram_counts(texts)]
        return {p - x: p for p, a, b in zip(pos.tolist(), least.tolist(), most.tolist(), strict=True) for x in range(a, b + 1)}, counts

    want = found()
    assert set(want[0]) == {i for a, n in zip(cuts, map(len, texts), strict=False) for i in range(a, a + n - 99)}
    monkeypatch.setattr(suffixes, "PIECE", 170)
    assert found() == want


def test_hashed_words_in_pieces(monkeypatch):
    texts = [b"", b"one two  three", b"A" * 300 + b" b", b" \n", "é ü one".encode(), b"one"]
    from tierflow.llm import common

    want = [x.tolist() for x in common.hashed_words(texts)]
    assert want[1] == [0, 3, 2, 0, 3, 1] and want[0][0] == want[0][-1] == want[0][-2] and len(set(want[0])) == 7
    for piece in (1, 7, 64, 1 << 12):
        monkeypatch.setattr(common, "PIECE", piece)
        assert [x.tolist() for x in common.hashed_words(texts)] == want


def test_near_copies_of_texts_without_words(spark):
    docs = spark.createDataFrame([(3, ""), (5, None), (9, " \n")], "doc_id long, text string")
    assert {tuple(r) for r in similar.near_copies(docs).collect()} == {(5, 3), (9, 3)}


def test_odd_rows(spark, odd):
    assert decontaminate.decontaminate(odd, odd.selectExpr("doc_id item_id", "text", "size")).count() == suffixes.drop_repeats(odd).count() == simhash.near_duplicates(odd).count() == len(ODD)
    sizes = {r.doc_id: r.size for r in mixing.mix(odd).collect()}
    assert sizes[1] == sizes[2] == sizes[7] == 0 and sizes[8] == 30_000
    shards = sharding.assign_shards(odd, limit=1000)
    assert shards.count() == len(ODD) and shards.columns.count("shard") == 1
    assert {r.doc_id for r in quality.keep_good(odd).collect()} == set()
    found = {r.doc_id: r for r in license.scan(odd).collect()}
    assert [m.label for m in found[5].matches] == ["mit"] and found[1].n_words == 0
    scores = maxent.score(odd).collect()
    assert len(scores) == len(ODD) and all(r.n_tokens >= 1 for r in scores)
    assert pii.find(odd).count() == len(ODD)


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (decontaminate.decontaminate(none, bench), simhash.near_duplicates(none), suffixes.drop_repeats(none), quality.rate(none), license.scan(none), maxent.score(none), pii.find(none), mixing.mix(none), sharding.assign_shards(none)):
        assert out.count() == 0


@needs_data
def test_pipeline_stages(spark, texts):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    verdicts = {r.doc_id: r.kept for r in quality.rate(docs).collect()}
    kept = corpus_pipeline.quality(spark, docs, DATA)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, k in verdicts.items() if k}
    assert corpus_pipeline.dedup(spark, docs, DATA).count() == len(set(near_roots([t for _, t in texts])))
    hit = {r.doc_id for r in QUERIES["op1_decontamination"](spark, DATA).filter("contaminated").collect()}
    clean = corpus_pipeline.decontamination(spark, docs, DATA)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in texts} - hit
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    times = collections.Counter(r.doc_id for r in corpus_pipeline.mixing(spark, docs, DATA).collect())
    assert all(times[d] == n for d, n in copies.items())
    assert corpus_pipeline.run(spark, DATA).filter(F.col("shard").isNull()).count() == 0


def near_roots(texts):
    """The first text of each component of pairs with a Jaccard similarity of 0.8 or more."""

    def grams(t):
        w = (t or "").translate(LOW).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a == b or len(a & b) / len(a | b) >= 0.8]
    return union_find(near, len(texts))


def test_pipeline_dedup_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for n in (3, 12, 40, 90, 90, 300):
        base = rng.integers(0, 4000, n).tolist()
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for at in rng.integers(0, n, edits):
                w[at] = int(rng.integers(4000, 9000))
            rows.append(" ".join(f"W{x}" for x in w))
    rows += ["", None, " \n"]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in corpus_pipeline.dedup(spark, docs, DATA).collect()) == sorted(set(near_roots(rows)))


def test_blocks_equal_all_pairs(spark, monkeypatch):
    """A cluster that is compared in many blocks."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    monkeypatch.setattr(similar, "COLUMNS", 16)
    rng = np.random.default_rng(11)
    base = rng.integers(0, 500, 60).tolist()
    rows = []
    for _ in range(70):
        w = list(base)
        for at in rng.integers(0, 60, int(rng.integers(0, 5))):
            w[at] = int(rng.integers(500, 900))
        rows.append(" ".join(map(str, w)))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_copies(docs).collect()}
    assert [got.get(i, i) for i in range(70)] == near_roots(rows) and len(set(near_roots(rows))) < 60


def test_hash_of_kept_bytes(spark):
    rows = spark.createDataFrame([(1, "ä" * 80), (2, "ä" * 80)], "doc_id long, text string")
    got = {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in suffixes.drop_repeats(rows).collect()}
    # 160 bytes: every later 100-byte string that starts at an even offset has come before
    assert got[2] == hashlib.sha256(b"").hexdigest()


def plain_pipeline(rows, items):
    """The rows that the pipeline gives, by plain loops: (doc_id, text, source, times)."""
    kept = []
    for r in rows:
        w = (r["text"] or "").encode().split()
        if len(w) < 50:
            continue
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
        runs = longest_runs(w)
        covered = {k for i, n in enumerate(runs) if n >= quality.LEAST for k in range(i, i + n)}
        longest = max((n for n in runs if n >= quality.LEAST), default=0)
        if 100 * len(twice) <= 50 * len(w) and len(covered) / len(w) <= quality.COVERED and longest <= quality.LONGEST * len(w):
            kept.append(r)
    roots = near_roots([r["text"] for r in kept])
    kept = [r for i, r in enumerate(kept) if roots[i] == i]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {tuple(w[i : i + min(10, len(w))]) for w in map(words, items) if w for i in range(len(w) - min(10, len(w)) + 1)}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w)))
    kept = [r for r in kept if not hit(words(r["text"]))]
    size = lambda r: len((r["text"] or "").encode().split())
    sizes = collections.Counter()
    for r in kept:
        sizes[r["source"]] += size(r)
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    room, full = sum(sizes.values()), {}
    while True:  # what is over goes to the others by weight, until none is above
        open_ = [s for s in order if s not in full]
        level = (room - sum(full.values())) / max(1, sum(weight[s] for s in open_))
        over = {s: 3 * sizes[s] for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    out = collections.Counter()
    for r in kept:
        s = r["source"]
        rate = full.get(s, level * weight[s]) / sizes[s]
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        part = int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:13], 16) / float(1 << 52)
        out[(r["doc_id"], r["text"], s, r["size"], r["row"])] += math.floor(rate) + (part < rate - math.floor(rate))
    return +out


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_brute_force(spark, tmp_path, empty):
    """Nulls, repeated rows, ties, an empty table, and columns with the names that stages use."""
    rng = np.random.default_rng(9)
    text = lambda n=80: " ".join(f"w{x}" for x in rng.integers(0, 2000, n))
    items = [text(12), text(4), None, ""]
    rows, base = [], [text() for _ in range(14)]
    for i, t in enumerate(base):
        w = t.split()
        w[int(rng.integers(0, 80))] = "other"
        rows += [(i, t, f"s{i % 4}"), (100 + i, " ".join(w), f"s{i % 3}")] + ([(i, t, f"s{i % 4}")] if i % 5 == 0 else [])
    rows += [(200 + i, text(200), None if i % 2 else "s9") for i in range(6)] + [(None, text(), "s1"), (None, text(), "s1"), (300, None, "s1"), (301, "", None), (302, "short text", "s2")]
    rows += [(400, f"{text(60)} {items[0]}", "s2"), (401, f"{text(60)} {items[1]} {text(9)}", "s2"), (402, " ".join([text(11)] * 7), "s1"), (403, "x " * 300, "s1")]
    rows = [] if empty else [dict(zip(("doc_id", "text", "source", "size", "copies", "row", "shard"), (*r, i, "own", -i, None), strict=True)) for i, r in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies string, row long, shard string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_pipeline(rows, items)
    assert collections.Counter((r.doc_id, r.text, r.source, r["size"], r.row) for r in got) == want
    assert all(r.shard == "" and r.copies == "own" for r in got) and (empty or len(want) > 15)
