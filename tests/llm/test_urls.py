"""URL filters against plain loops, and on odd rows."""

import itertools

import pytest

from tierflow.llm import urls

ODD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://Example.ORG:80/es/x"), (6, "http://sub.EXAMPLE.org/es/1?x=/en/1"), (7, "http://example.org"), (8, "x://y.org?q#f"),
    (9, "http://a.com/fr/1"), (9, "http://a.com/fr/1"), (None, "http://a.com/de/"), (10, "http://notexample.org/en/12"), (11, "http://a.example.org/en/12#top"), (12, "a://b://c.org/"), (13, "http://x.net/" + "seg/" * 50_000 + "end.html?k=v"),
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = max((r for r in urls.LIST if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_list_and_odd_rows(spark):
    pages = spark.createDataFrame([(*r, "h", 5) for r in ODD], "page_id long, url string, host string, row int")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filtered(pages, []).collect()]
    want = [(i, *plain(u)[:3], plain(u)[3] or urls.ELSE) for i, u in ODD]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    nothing = spark.createDataFrame([], "url string, verdict string")
    assert urls.filtered(none, [nothing]).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [(r.verdict, r.mined) for r in urls.filtered(one, [nothing]).collect()] == [("allow", None)]


def brute(rows, support, least, confidence, lift):
    """All rules by plain counting of all combinations."""
    n = len(rows)
    frequent = max(support * n, least)
    combos = {}
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), k):
                combos.setdefault(c, []).append(verdict)
    share = {v: sum(x == v for _, x in rows) / n for v in ("allow", "block")}
    found = {(c, v): (vs.count(v) / len(vs), vs.count(v)) for c, vs in combos.items() for v in ("allow", "block") if vs.count(v) >= frequent and vs.count(v) / len(vs) >= confidence and vs.count(v) / len(vs) / share[v] >= lift}
    return {(c, v): x for (c, v), x in found.items() if not any(w == v and len(d) < len(c) and set(d) <= set(c) and y[0] >= x[0] for (d, w), y in found.items())}


@pytest.fixture(scope="module")
def labelled():
    out = []
    for i in range(300):
        tokens = [f"a{i % 3}", f"b{i % 4}", f"c{i % 5}", f"d{i % 97}"]
        bad = i % 3 == 0 and i % 4 in (1, 2) or i % 5 == 4 and i % 7
        out.append((tokens, "block" if bad else "allow"))
    return out


def test_mined_rules_equal_all_combinations(spark, labelled):
    df = spark.createDataFrame([*labelled, (None, "allow"), (["a0"], None)], "tokens array<string>, verdict string")
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.n) for r in urls.mined(df, 0.03, 5, 0.8, 1.05).collect()}
    want = brute(labelled, 0.03, 5, 0.8, 1.05)
    assert got == want and {v for _, v in got} == {"allow", "block"} and max(len(c) for c, _ in got) > 1


def test_index_finds_every_rule_that_fits(spark, labelled):
    df = spark.createDataFrame(labelled, "tokens array<string>, verdict string")
    rules = urls.mined(df, 0.03, 5, 0.8, 1.05)
    pages = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(labelled)] + [(1000, None), (1001, [])], "row long, tokens array<string>")
    got = {r.row: r.mined and (r.mined.confidence, r.mined.n, r.mined.verdict) for r in urls.judged(pages, urls.indexed(rules, df)).collect()}
    all_rules = brute(labelled, 0.03, 5, 0.8, 1.05)
    for i, (t, _) in enumerate(labelled):
        assert got[i] == max(((*x, v) for (c, v), x in all_rules.items() if set(c) <= set(t)), default=None)
    assert got[1000] is None and got[1001] is None


def test_rules_carry_over_to_hosts_that_were_not_labelled(spark):
    """Labels of four fifths of the hosts; the others' verdicts come from mined rules alone."""
    urls_of = lambda hosts: [f"http://s{h}.example.{('net', 'com')[h % 2]}/{('shop', 'news', 'wiki')[k % 3]}/{k}{('', '?ref=x')[k % 2]}" for h in hosts for k in range(12)]
    truth = lambda u: "block" if "/shop/" in u and "ref" in u else "allow"
    known = spark.createDataFrame([(u, truth(u)) for u in urls_of(range(40))], "url string, verdict string")
    asked = urls_of(range(40, 50))
    got = urls.filtered(spark.createDataFrame(list(enumerate(asked)), "page_id long, url string"), [known], rules=[]).collect()
    assert all(r.verdict == truth(asked[r.page_id]) for r in got) and {r.verdict for r in got} == {"allow", "block"}
