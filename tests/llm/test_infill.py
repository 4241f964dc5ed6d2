"""Fill-in-middle forms against plain slicing, and back again."""

import hashlib

import pytest

from tierflow.llm import infill

TEXTS = [None, "", "a", "é😀\n\r\nb" * 40, "has <P> in it", "ends in <", "<S", "x" * 3000, "word " * 100_000, "\x00\u2028\u0301a"]


def test_forms_and_way_back(spark):
    rows = [(i if i != 4 else None, t) for i in range(12) for t in TEXTS]
    docs = spark.createDataFrame([(*r, 1, "plain") for r in rows], "doc_id long, text string, n int, form string")
    got = infill.infilled(docs).collect()
    forms = set()
    want = []
    for i, t in rows:
        t = t or ""
        h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
        n = len(t)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            row = (i, n, "plain", None, None, t, t)
        elif h[3] % 100 < 20:
            row = (i, n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", t)
        else:
            row = (i, n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", t)
        forms.add(row[2])
        want.append(row)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, want)) and forms == {"plain", "psm", "spm"}


def test_pieces_equal_one_match():
    one, many = infill.compiled(".", 7)
    for n in (0, 1, 6, 7, 8, 14, 100):
        assert infill.ends("é" * n, one, many).tolist() == list(range(1, n + 1))


def test_units_of_words(spark):
    one, many = infill.compiled(r"\S+\s*|\s+")
    text = "  one two\nthree "
    assert infill.ends(text, one, many).tolist() == [2, 6, 10, 16]
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    for r in infill.infilled(docs, unit=r"\S+\s*|\s+").collect():
        assert r.n == 4 and r.restored == text
        assert r.form == "plain" or {r.prefix_chars, r.prefix_chars + r.middle_chars} <= {0, 2, 6, 10, 16}


def test_unit_that_does_not_fit():
    one, many = infill.compiled("[a-z]")
    with pytest.raises(ValueError, match="doesn't match at 2"):
        infill.ends("ab1", one, many)


def test_empty_table(spark):
    assert infill.infilled(spark.createDataFrame([], "doc_id long, text string")).collect() == []
