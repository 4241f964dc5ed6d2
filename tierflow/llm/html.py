"""Main text of web pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, text_blocks

#: Lines in a block, and characters outside links from which on a block counts as text.
BLOCK, SURGE = 3, 86

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|textarea|iframe|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s>/]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that break lines, those without an end tag, those that aren't content, and words that say so in class, id or role.
BREAKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose children belong together.
CONTAINERS = frozenset("article body center dd div fieldset li main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav footer aside form menu button dialog svg template select".split())
#: Foreign elements that the start of one of these ends, also without their own end tag, unless it is in a part of them that holds HTML.
FOREIGN, HOLDS_HTML = ("svg", "math"), ("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "cookie cookies consent notice notices popup modal newsletter subscribe subscription signup comment comments disqus respond social share sharing related "
    "recommended widget pagination pager masthead complementary contentinfo legal copyright disclaimer imprint impressum".split()
)
#: Parts that a name of several may have besides: whole names count, so "with-sidebar" or "post-related" are no noise, "site-footer" and "ad-box" are.
NEUTRAL = frozenset(
    "area articles bar block body bottom box button buttons col column container content footer form global group header holder icons inner inline item items left links list "
    "main message module outer overlay page panel posts primary right row secondary section site slot small stories text thread title top unit widget wrap wrapper".split()
)
#: Elements whose start ends an open one without its end tag: by their tag, those that they end. A p ends at any start of a block.
_ROWS = ("thead", "tbody", "tfoot")
OPTIONAL_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"),
    **dict.fromkeys(_ROWS, ("td", "th", "tr", *_ROWS)),
}
#: Elements that end tags and implied ends of those inside don't reach beyond.
_CELLS = ("table", "td", "th", "caption", "button")
SCOPES = {
    **dict.fromkeys(("td", "th", "tr", "table", "caption", *_ROWS), ("table",)), "li": ("ul", "ol", "menu", "dir", "dl", "section", "article", "blockquote", *_CELLS),
    **dict.fromkeys(("dt", "dd"), ("dl", "ul", "ol", "section", "article", "blockquote", *_CELLS)),
}
#: Elements within lines whose end tag also ends blocks that are open in them.
WHOLE = frozenset("button math object select svg template".split())
P_STAYS = frozenset("body caption head html legend option tbody td tfoot th thead tr".split())


def is_aside(tag: str, inside: bool) -> bool:
    """Whether an element is no content by its tag."""
    return tag in ASIDE or tag == "header" and not inside


def is_noise(tag: str, attrs: str) -> bool:
    """Whether a whole name in class, id or role says that an element is no content (of an article, a name that begins so)."""
    if "=" not in attrs or tag in ("html", "body", "main"):
        return False
    for name in " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attrs)).lower().split():
        parts = [w for w in re.split(r"[^a-z]+", name) if w]
        if any(w in NOISE for w in parts) and (all(w in NOISE or w in NEUTRAL for w in parts) or tag == "article" and parts[0] in NOISE):
            return True
    return False


class OpenElements:
    """The elements open at a place of a page; finding and closing one takes constant time for each element that was opened."""

    def __init__(self):
        self.stack: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tags: Iterable[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop()
            self.places[tag].pop()
            if tag in BREAKS:
                self.blocks.pop()

    def start(self, tag: str) -> None:
        """Ends what the start of ``tag`` implies the end of."""
        if tag in ENDS_FOREIGN and (at := self.last(FOREIGN)) > self.last(HOLDS_HTML):
            self.cut(min(p for t in FOREIGN for p in self.places.get(t, ()) if p > self.last(HOLDS_HTML)))
        if tag in BREAKS and tag not in P_STAYS and (at := self.last(("p",))) > self.last(_CELLS):
            self.cut(at)
        if closed := OPTIONAL_END.get(tag):
            bound = self.last(SCOPES.get(tag, _CELLS)) if tag not in ("td", "th") else self.last(("table", "tr"))
            found = [p[-1] for t in closed if (p := self.places.get(t)) and p[-1] > bound]
            if found:
                self.cut(min(found))

    def push(self, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BREAKS:
            self.blocks.append(len(self.stack))
        self.stack.append(tag)

    def end(self, tag: str) -> None:
        """Ends the innermost open ``tag`` and all in it; an end tag without a start is ignored."""
        if not (p := self.places.get(tag)):
            return
        if tag in BREAKS or tag in WHOLE:
            bound = self.last(t for t in SCOPES.get(tag, _CELLS) if t != tag) if tag not in ("html", "body", "template") else -1
        else:
            bound = self.blocks[-1] if self.blocks else -1
        if p[-1] > bound:
            self.cut(p[-1])


def lines(html: str) -> list[tuple[str, int, int, int]]:
    """The page's lines: (text, its characters outside links, number of the outermost article or main element that it is in, or 0, number of the innermost container that it is in).

    Elements that aren't content by their tag are left out, and those that aren't by their names unless nothing else has a surge and they hold over half of
    the page's characters outside links.
    """
    out: list[tuple[str, int, int, int, tuple[int, ...]]] = []
    containers, boxes = 0, []  # number of the containers so far; place and number of the open ones
    held: list[str] = []
    opened = OpenElements()
    plain = link = at = regions = named = 0
    region, skip = (-1, 0), -1  # place of the outermost article or main element and its number; place of an element that is left out
    noise: list[tuple[int, int]] = []  # place and number of the open elements that aren't content by their names

    def put(text: str) -> None:
        nonlocal plain
        if text and skip < 0:
            text = unescape(text) if "&" in text else text
            held.append(text)
            if not link:
                plain += sum(map(len, text.split()))

    def end() -> None:
        nonlocal plain
        if held and (text := " ".join("".join(held).split())):
            out.append((text, plain, region[1], boxes[-1][1] if boxes else 0, tuple(n for _, n in noise)))
        held.clear()
        plain = 0

    for m in MARKUP.finditer(html):
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        if m["raw"] or not m["tag"]:
            continue
        tag, attrs, closing = m["tag"].lower(), m["attrs"], bool(m["end"])
        alone = tag in VOID or attrs.endswith("/") and (len(attrs) == 1 or attrs[-2] in " \t\r\n\f\"'")
        if skip < 0 and tag in BREAKS:
            end()
        if closing:
            opened.end(tag)
        else:
            opened.start(tag)
        depth = len(opened.stack)
        while boxes and depth <= boxes[-1][0]:
            end()
            boxes.pop()
        if depth <= region[0]:
            end()
            region = (-1, 0)
        while noise and depth <= noise[-1][0]:
            end()
            noise.pop()
        if depth <= skip:
            end()
            skip = -1
            if closing:
                continue
        if skip < 0:
            if tag == "br":
                put(" ")
            elif tag == "a":
                link = 0 if closing else 1
            elif closing or alone:
                pass
            elif is_aside(tag, region[1] > 0):
                end()
                skip = depth
            elif is_noise(tag, attrs):
                end()
                named += 1
                noise.append((depth, named))
            if not closing and not alone and skip < 0 and not noise and tag in ("article", "main") and not region[1]:
                regions += 1
                region = (depth, regions)
        if not closing and not alone:
            if tag in CONTAINERS:
                containers += 1
                boxes.append((depth, containers))
            opened.push(tag)
    put(html[at:])
    end()
    clean = [x[:4] for x in out if not x[4]]
    if len(clean) == len(out) or any(sum(x[1] for x in clean[i : i + BLOCK]) >= SURGE for i in range(len(clean))):
        return clean
    sums: dict[int, int] = {}
    for _, n, _, _, within in out:
        for x in within:
            sums[x] = sums.get(x, 0) + n
    total = sum(x[1] for x in out)
    return [x[:4] for x in out if all(2 * sums[k] > total for k in x[4])]


def main_text(html: str, block: int = BLOCK, surge: int = SURGE) -> str:
    """The text between the first surge and the last dive of the page's line blocks, joined by single spaces.

    If article and main elements hold at least half of the characters outside links of that text, it is the lines of those
    of them that it touches: what else lies between surge and dive goes, and their short first and last lines come in.
    Else surge and dive are moved out over lines of the container that holds most of the text, so that its title and short paragraphs at its ends stay.
    """
    found = lines(html)
    sizes = [x[1] for x in found]
    sums = [sum(sizes[i : i + block]) for i in range(len(sizes))]
    if not any(sums):
        return ""
    level = min(surge, max(sums))
    start = next(i for i, n in enumerate(sums) if n >= level)
    while not sizes[start]:
        start += 1
    stop = max(i for i, n in enumerate(sums) if n >= level)
    stop = min(len(sizes), stop + block)
    while not sizes[stop - 1]:
        stop -= 1
    first, last, kept = start, stop, found[start:stop]
    if 2 * sum(x[1] for x in kept if x[2]) >= sum(x[1] for x in kept):
        regions = {x[2] for x in kept if x[2]}
        kept = [x for x in found if x[2] in regions]
    else:
        held: dict[int, int] = {}
        for x in kept:
            held[x[3]] = held.get(x[3], 0) + x[1]
        box = max(held, key=lambda k: held[k])
        own = [i for i, x in enumerate(found) if x[3] == box and x[1]]
        start, stop = min(start, own[0]), max(stop, own[-1] + 1)
        kept = [x for i, x in enumerate(found) if start <= i < stop and (first <= i < last or x[3] == box)]
    return " ".join(x[0] for x in kept)


def extract(pages: DataFrame, block: int = BLOCK, surge: int = SURGE) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html).

    Scripts, styles, comments and elements that aren't content by their tag or by a whole name in class, id or role (unless such an element holds over half of
    the page's text and no block of the rest reaches ``SURGE``) are stripped; what is left falls into lines at the elements that break them, with character references decoded and white space made single.
    Characters outside links are summed over ``block`` lines from each line on. The text is kept from the first line
    whose sum reaches ``surge`` (the largest sum, if none does) to the end of the last such block, without lines of links
    at either end, and with the other lines of the container that holds most of it. Where article or main elements hold most of it, the lines of those are kept. Elements end as HTML says, also
    where it lets their end tags be left out. A null, empty or markup-only page has an empty text. Repeated rows each get theirs, an empty table gives an empty result,
    other columns play no part. Pages aren't shuffled, and whole pages are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, 8 << 20, "html"):
            out = [main_text(x or "", block, surge) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6 over the whole ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
