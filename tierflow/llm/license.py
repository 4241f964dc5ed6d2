"""License scan: templates with optional and replaceable regions, as automata over tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, text_blocks, texts_of
from .decontaminate import words
from .templates import TEXTS

#: Phrases and their labels (fixed by the contract of operator 2).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Templates by label. ``[[ ]]`` may be left out; ``{{name:n:pattern}}`` stands for one to n words that each match the
#: pattern (any word if none is given); all other words must stand as they are.
TEMPLATES = {
    "gpl-notice": "[[this work is]] licensed under the [[terms of the]] gnu general public license [[version {{version:2:[0-9]+}} [[or [[at your option]] any later version]]]]",
    "mit-notice": "[[this software is]] released under the [[terms of the]] mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction",
    "apache-2.0-notice": "licensed under the apache license version 2 0 [[the license]]",
    "cc-by-notice": "[[this work is]] licensed under [[a]] [[creative commons]] cc by {{version:2:[0-9]+}} [[international]] [[license]]",
    "cc-by-nc-notice": "[[this work is]] licensed under [[a]] [[creative commons]] cc by nc {{version:2:[0-9]+}} [[international]] [[license]]",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "copyright-all-rights": "copyright [[c]] {{year:1:[0-9]{4}}} {{holder:6}} all rights reserved",
    **TEXTS,
}


def parse(markup: str) -> list:
    """The template as a list of words, as texts are split into them, nested lists (optional regions) and (most, pattern) pairs (replaceable ones)."""
    stack: list[list] = [[]]
    for part in re.findall(r"\[\[|\]\]|\{\{.*?\}\}+|[^\[\]{}]+", markup):
        if part == "[[":
            stack.append([])
        elif part == "]]":
            done = stack.pop()
            stack[-1].append(done)
        elif part.startswith("{{"):
            _, most, *pattern = part[2:-2].split(":", 2)
            stack[-1].append((int(most), pattern[0] if pattern else None))
        else:
            stack[-1] += [w.decode() for w in words(part.encode())]
    if len(stack) != 1:
        raise ValueError(f"an optional region isn't closed in {markup!r}")
    return stack[0]


class Automaton:
    """The template as a deterministic automaton over token classes; each class is made once for each kind of token."""

    def __init__(self, markup: str):
        self.steps: list[list[tuple[bytes | re.Pattern | None, int]]] = [[]]  # of each state: (token, next state)
        self.free: list[list[int]] = [[]]  # moves without a token
        tree = parse(markup)
        self.final = self._build(tree, 0)
        self.mandatory = sorted({x.encode() for x in tree if isinstance(x, str)}, key=len, reverse=True)  # long words are rare, so most texts fail at once
        self.starts = {t for s in self._closure({0}) for t, _ in self.steps[s]}
        if not all(isinstance(t, bytes) for t in self.starts):
            raise ValueError("a template can't begin with a replaceable region")
        self._next = lru_cache(maxsize=4096)(self._move)
        self.start = self._closure({0})

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _build(self, tree: list, at: int) -> int:
        for x in tree:
            if isinstance(x, list):
                end = self._build(x, at)
                self.free[at].append(end)
                at = end
            elif isinstance(x, tuple):
                most, pattern = x
                end, token = self._state(), re.compile(pattern.encode()) if pattern else None
                for _ in range(most):
                    to = self._state()
                    self.steps[at].append((token, to))
                    self.free[to].append(end)
                    at = to
                at = end
            else:
                to = self._state()
                self.steps[at].append((x.encode(), to))
                at = to
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def _move(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        fits = lambda t: t is None or (t == word if isinstance(t, bytes) else t.fullmatch(word) is not None)
        return self._closure({to for s in states for t, to in self.steps[s] if fits(t)})

    def match(self, tokens: list[bytes], start: int) -> int:
        """The end of the longest accepted run from ``start`` on, or -1."""
        states, end = self.start, -1
        for i in range(start, len(tokens)):
            states = self._next(states, tokens[i])
            if not states:
                break
            if self.final in states:
                end = i + 1
        return end


def phrase_places(tokens: list[bytes], joined: bytes, phrase: list[bytes]) -> list[int]:
    """Every word number at which the phrase's words stand consecutively."""
    needle = b" " + b" ".join(phrase) + b" "
    out, at, word, seen = [], joined.find(needle), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = joined.find(needle, at + 1)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, matches array of (label, start, end, template)) for each row of ``docs`` (doc_id, text).

    Phrases match wherever their words stand consecutively, overlaps included. A template matches from a word on
    if its mandatory words stand exactly as written, with any optional region left out and any replaceable one filled;
    of a start the longest run counts, and of nested runs of one template the outermost. Positions are words from 0, end exclusive.
    Documents aren't shuffled, whole texts are read, and an automaton only runs where its first words stand, in documents
    with all its mandatory words; a run ends at the first word that doesn't fit, so a text takes its words times a template's length at most. Null, empty and wordless
    texts have no words and no matches. Repeated rows each get theirs, an empty table gives an empty result, other columns play no part.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {label: Automaton(t) for label, t in templates.items()}
        split = {label: p.encode().split() for p, label in phrases.items()}
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("template", pa.bool_())]))
        for batch in text_blocks(batches, 4 << 20):
            counts, out = [], []
            for text in as_bytes(batch):
                tokens = words(text)
                joined = b" " + b" ".join(tokens) + b" "
                found = [(label, i, i + len(p), False) for label, p in split.items() for i in phrase_places(tokens, joined, p)]
                for label, a in automata.items():
                    if all(b" " + w + b" " in joined for w in a.mandatory):
                        covered = 0
                        for i, w in enumerate(tokens):
                            if w in a.starts and (end := a.match(tokens, i)) > covered:
                                found.append((label, i, end, True))
                                covered = end
                counts.append(len(tokens))
                out.append([dict(zip(("label", "start", "end", "template"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(out, kind)], ["doc_id", "n_words", "matches"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_words long, matches array<struct<label string, start long, end long, template boolean>>")


def weight(label: str) -> float:
    """How sure a match is: m / (m + 1) for m mandatory words."""
    phrase = next((p for p, x in PHRASES.items() if x == label), None)
    m = len(phrase.split()) if phrase else sum(isinstance(x, str) for x in parse(TEMPLATES[label]))
    return m / (m + 1)


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over the whole ``documents``; score is the weight of the document's surest match, 0 without one."""
    base = F.filter("matches", lambda m: ~m["template"])
    pick = lambda x, f: F.transform(x, lambda m: m[f])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(pick(x, "label"))), ",")
    sure = F.create_map(*[F.lit(v) for label in [*PHRASES.values(), *TEMPLATES] for v in (label, weight(label))])
    score = F.coalesce(F.array_max(F.transform(pick(F.col("matches"), "label"), lambda x: F.element_at(sure, x))), F.lit(0.0))
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(pick(base, "start")).alias("first_word"), F.array_max(pick(base, "start")).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), score.alias("score"),
    )


def as_regex(tree: list) -> str:
    """The parsed template as a regular expression over words that each follow a space."""
    part = lambda x: f"(?:{as_regex(x)})?" if isinstance(x, list) else f"(?: (?:{x[1] or '[^ ]+'})){{1,{x[0]}}}" if isinstance(x, tuple) else f" {x}"
    return "".join(map(part, tree))


def _sql() -> str:
    sets = {label: f"regexp_matches(j, '{as_regex(parse(t))} ')" for label, t in TEMPLATES.items()}
    base = {label: f"list_filter(range(1, len(ws) + 1), lambda i: {' AND '.join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split()))})" for p, label in PHRASES.items()}
    places = f"list_concat(list_concat({base['gpl']}, {base['apache']}), list_concat({base['cc-by']}, {base['mit']}))"
    has = {label: f"len({x}) > 0" for label, x in base.items()}
    names = lambda d: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{x}' END" for x, c in d.items()) + "], lambda x: x IS NOT NULL)), ',')"
    score = "greatest(0.0::DOUBLE, " + ", ".join(f"CASE WHEN {c} THEN {weight(x)!r}::DOUBLE ELSE 0.0::DOUBLE END" for x, c in (has | sets).items()) + ")"
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
j AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS j FROM d),
p AS (SELECT *, {places} AS places FROM j)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
  {names(has)} AS base_labels, {names(has | sets)} AS labels, {score} AS score
FROM p
"""


OP2_SQL = _sql()
