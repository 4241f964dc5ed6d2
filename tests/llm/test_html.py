"""Main text of pages that HTML's own rules repair: unclosed foreign elements, fallback words, pages without article tags."""

import pytest

from tierflow.llm import html

LONG = "The body goes on for a good while here, with many words that tell one what there is to tell, and some more."


@pytest.mark.parametrize(
    ("start", "want"),
    [
        (f"<svg><path d='x'><p>{LONG}", LONG), (f"<svg><title>t</title><text>drawn<div>{LONG}</div>", LONG), (f"<object data='x'><p>{LONG}", LONG), (f"<p>{LONG}<object data=x>shown instead</object>", f"{LONG} shown instead".replace(" shown", "shown")),
        (f"<p>{LONG} <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds.", f"{LONG} a=1 holds."), (f"<p>{LONG}<svg><text>drawn</text></svg> End.", f"{LONG} End."), (f"<p>{LONG}<svg/> End.", f"{LONG} End."),
        (f"<template><p>not shown</template><p>{LONG}", LONG), (f"<div><select><option>a<option>b</div><p>{LONG}", LONG), (f"<svg><foreignObject><p>in it</p></foreignObject></svg><p>{LONG}", LONG),
        (f"<svg><g><svg><p>{LONG}</svg> more", f"{LONG} more"),
    ],
)
def test_foreign_and_fallback_elements(start, want):
    for wrap in ("<article>{}</article>", "<div>{}</div>", "{}"):
        assert html.main_text("<body>" + wrap.format(start)) == want


def test_short_paragraphs_at_both_ends_stay():
    body = "<h1>Title</h1><p>By me.</p><p>Short.</p><p>Also.</p><p>More.</p>" + f"<p>{LONG}</p>" * 4 + "<p>End.</p><p>The end.</p><p>fin</p><p>last</p>"
    want = " ".join(["Title By me. Short. Also. More.", *[LONG] * 4, "End. The end. fin last"])
    menu = "<div><a href=x>Home</a> <a href=y>News</a></div>"
    assert html.main_text(f"<body>{menu}<div>{body}</div>{menu}") == want
    assert html.main_text(f"<body>{body}") == want
    assert html.main_text(f"<body>{menu}<div>{body}</div><div class='legal'>All rights reserved. {LONG}</div>") == want


def test_seven_short_paragraphs():
    words = ["One two three.", "Four five six seven.", "Eight nine.", "Ten eleven twelve.", "Thirteen.", "Fourteen fifteen.", "Sixteen."]
    assert html.main_text("<body><div>" + "".join(f"<p>{w}</p>" for w in words) + "</div>") == " ".join(words)
