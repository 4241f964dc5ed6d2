"""Fill-in-middle forms of texts: cut in units by one match whose repeated group keeps every repetition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts_of

#: Marks of the parts, shares of texts that are transformed and of those that begin with the suffix, seed, and the unit of a cut (fixed values of the contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST, SEED, UNIT = 90, 20, "1", "."
#: Units that one match takes up; the captures of a unit take about 110 bytes.
PIECE = 250_000

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def ends(text: str, unit: regex.Pattern, units: regex.Pattern) -> np.ndarray:
    """Where each unit of ``text`` ends. ``units`` takes PIECE of them at most; a longer text is matched in pieces that begin where the last one ended."""
    if found := units.fullmatch(text):
        return np.array(found.ends(1), np.int64)
    out, at = [], 0
    while at < len(text):
        found = units.match(text, at)
        if found.end() == at:
            raise ValueError(f"{unit.pattern} doesn't match at {at}")
        out.append(np.array(found.ends(1), np.int64))
        at = found.end()
    return np.concatenate(out)


def compiled(unit: str = UNIT, piece: int = PIECE) -> tuple[regex.Pattern, regex.Pattern]:
    """The unit alone, and as a group that is repeated and never given back."""
    return regex.compile(f"(?s){unit}"), regex.compile(f"(?s)(?>({unit}){{0,{piece}}})")


def parts(text: str, key: str, unit: regex.Pattern, units: regex.Pattern, seed: str = SEED) -> tuple:
    """(units, form, prefix, middle, suffix) of a text; the parts are None for a plain one.

    The draws are the first four 32-bit numbers of the SHA-256 of ``seed:key``: two places, the form, and which part comes first.
    """
    h = [int(x, 16) for x in regex.findall(".{8}", hashlib.sha256(f"{seed}:{key}".encode()).hexdigest())[:4]]
    at = ends(text, unit, units)
    n = len(at)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= TRANSFORMED:
        return n, "plain", None, None, None
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(at[k - 1]) if k else 0 for k in (first, second))
    return n, "spm" if h[3] % 100 < SUFFIX_FIRST else "psm", text[:a], text[a:b], text[b:]


def joined(text: str, form: str, prefix: str | None, middle: str | None, suffix: str | None) -> str:
    """The text in its form."""
    if form == "plain":
        return text
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text of an output: no part has a mark within, so each mark's first place is its own."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    one, _, rest = output[len(PREFIX) :].partition(second)
    other, _, middle = rest.partition(MIDDLE)
    return one + middle + other if form == "psm" else other + middle + one


def infilled(docs: DataFrame, unit: str = UNIT, seed: str = SEED, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored): each text in its form for training to fill in the middle, and the text rebuilt from that.

    ``unit`` is a pattern whose repetitions make up any text, as a code point is by default; cuts lie between units and ``n`` counts them, while lengths are in code
    points. Without ``texts``, output and restored are their SHA-256 in hex, so that texts aren't carried along.
    A null text is an empty one, which stays plain, as does one that has a mark; a null key is drawn for as an empty one. Repeated rows give repeated rows, columns other than
    key and text play no part, and an empty table gives an empty one. A text is one match of the repeated unit; texts of over PIECE units are matched in pieces.
    """
    one, many = compiled(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                own = batch.slice(start, 100)
                ids, rows = own.column("doc_id"), []
                for doc, t in zip(ids.to_pylist(), own.column("text").to_pylist(), strict=True):
                    t = t or ""
                    n, form, *cut = parts(t, "" if doc is None else str(doc), one, many, seed)
                    output = joined(t, form, *cut)
                    both = [output, restored(output, form)]
                    if not texts:
                        both = [hashlib.sha256(x.encode()).hexdigest() for x in both]
                    rows.append((n, form, *(None if x is None else len(x) for x in cut[:2]), *both))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    return texts_of(docs, key, text).mapInArrow(run, f"doc_id long, {SCHEMA}")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in their form, as digests."""
    found = infilled(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").alias("output_sha256"), F.col("restored").alias("restored_sha256"))


_h = lambda k: f"CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * k + 1}, 8) AS BIGINT)"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, {", ".join(f"{_h(k)} AS h{k + 1}" for k in range(4))} FROM documents),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
