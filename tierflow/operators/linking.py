"""Titles: normal forms, tokens and links between a catalog and free text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Accented Latin letters and what stands for them.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def normal_title(title: Column) -> Column:
    """Lower case without accents, parentheses of one letter or of foreign script; & is and, + is plus; words with single spaces."""
    text = F.regexp_replace(title, r"\(\s*\w\s*\)|\([^)]*[^\x00-\x7FÀ-ÿ][^)]*\)", " ")
    text = F.translate(F.lower(text), ACCENTED, PLAIN)
    text = F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def compact_title(title: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(title), ACCENTED, PLAIN), "[^a-z0-9]", "")


def paired_tokens(old: Column, new: Column, pattern: str) -> Column:
    """Array of (old, new): the nth token of one text with that of the other; empty if their numbers differ."""
    a, b = (F.regexp_extract_all(x, F.lit(pattern), F.lit(0)) for x in (old, new))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("old"), y.alias("new")))
    return F.when(F.size(a) == F.size(b), pairs).otherwise(F.filter(pairs, lambda x: F.lit(False)))


def unique_matches(rows: DataFrame, catalog: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): rows whose keys one item of the catalog has, with its item_id, and the others."""
    single = catalog.groupBy(*keys).agg(F.count("*").alias("m"), F.min("item_id").alias("item_id")).filter("m = 1").drop("m")
    return rows.join(single, keys), rows.join(single, keys, "left_anti")


def title_links(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(text_id, label, item_id) where the text, blocked by label, has the item's normal title as whole words; the longest title of a text and label wins.

    ``texts``: (text_id, label, normal), ``catalog``: (item_id, label, normal). Texts that read alike are looked at once, and of items with the same title the first is kept, so rows don't grow with the square of copies.
    A text_id that several texts of a label have gets one item.
    """
    names = catalog.groupBy("label", F.col("normal").alias("name")).agg(F.min("item_id").alias("item_id"))
    longest = named(texts.select("label", "normal").distinct(), names).groupBy("label", "normal").agg(F.min(F.struct((-F.length("name")).alias("short"), "item_id")).alias("top"))
    return texts.join(longest, ["label", "normal"]).groupBy("text_id", "label").agg(F.min("top").alias("top")).select("text_id", "label", "top.item_id")


def named(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs of ``texts`` (label, normal, ...) and ``names`` (label, name, ...) whose name stands in the text as whole words.

    They meet at that word of the name which the fewest texts of the label have, so a word that all texts have only brings names to them that have no other. Names with a word that no text has meet none.
    """
    words = texts.select("label", F.explode(F.array_distinct(F.split("normal", " "))).alias("word")).groupBy("label", "word").agg(F.count("*").alias("seen"))
    of_name = names.filter("name <> ''").select("label", "name").distinct().withColumn("words", F.array_distinct(F.split("name", " ")))
    known = of_name.select("label", "name", F.size("words").alias("many"), F.explode("words").alias("word")).join(words, ["label", "word"])
    rarest = known.groupBy("label", "name").agg(F.min_by("word", F.struct("seen", "word")).alias("word"), F.count("*").alias("met"), F.first("many").alias("many")).filter("met = many").drop("met", "many")
    keyed = names.join(rarest, ["label", "name"])
    rows = texts.withColumn("word", F.explode(F.array_distinct(F.split("normal", " ")))).join(keyed, ["label", "word"])
    return rows.filter(F.contains(F.concat(F.lit(" "), "normal", F.lit(" ")), F.concat(F.lit(" "), "name", F.lit(" ")))).drop("word")


def linked_items(catalog: DataFrame, texts: DataFrame, overrides: DataFrame) -> DataFrame:
    """(item_id, status, text_id): the text that each item is linked with.

    ``catalog``: (item_id, label, name), a row for each name of an item; ``texts``: (text_id, label, normal, rank), the lower rank the better; ``overrides``:
    (item_id, text_id). An override goes before all else; then the best candidate is ``mapped``, two different texts of the same best rank make an item
    ``ambiguous`` and no candidate makes it ``missing``, both without a text. An override of an unknown item or text is an error.
    """
    unknown = overrides.join(catalog, "item_id", "left_anti").select("item_id").union(overrides.join(texts, "text_id", "left_anti").select("text_id"))
    if bad := [r[0] for r in unknown.limit(5).collect()]:
        raise ValueError(f"overrides name unknown items or texts, as {', '.join(bad)}")
    # of texts that read alike the first and the last of the best rank say all, and items with the same name share what it finds
    alike = texts.filter("text_id is not null and rank is not null").groupBy("label", "normal", "rank").agg(F.min("text_id").alias("text_id"), F.max("text_id").alias("last"))
    alike = alike.groupBy("label", "normal").agg(F.min(F.struct("rank", "text_id", "last")).alias("best")).select("label", "normal", "best.*")
    best = lambda found, by: found.groupBy(*by, "rank").agg(F.min("text_id").alias("text_id"), F.max("last").alias("last")).groupBy(*by).agg(F.min(F.struct("rank", "text_id", "last")).alias("top"))
    of_name = best(named(alike, catalog.select("label", "name").distinct()), ["label", "name"]).select("label", "name", "top.*")
    first = best(catalog.select("item_id", "label", "name").join(of_name, ["label", "name"]), ["item_id"])
    rows = catalog.select("item_id").distinct().join(first, "item_id", "left").join(overrides.select("item_id", F.col("text_id").alias("forced")), "item_id", "left")
    status = F.when(F.col("forced").isNotNull(), "override").when(F.col("top").isNull(), "missing").when(F.col("top.text_id") != F.col("top.last"), "ambiguous").otherwise("mapped")
    rows = rows.withColumn("status", status)
    return rows.select("item_id", "status", F.when(F.col("status") == "override", F.col("forced")).when(F.col("status") == "mapped", F.col("top.text_id")).alias("text_id"))


def rerates(rows: DataFrame, catalog: DataFrame, aliases: dict[str, str] | None = None, least: int = 16) -> tuple[DataFrame, DataFrame]:
    """(moves, problems) of an import: rows (source_row, title, old, new) with the labels of before and after, several in a cell.

    The nth old label goes with the nth new one if there are as many; pairs that change their mode or keep their level aren't moves, and labels under
    ``least`` aren't looked at. ``catalog``: (item_id, label, title). moves: (item_id, source_row, from_label, to_label, delta, direction). problems:
    (source_row, title, from_label, problem), ``unmatched`` where not exactly one item has the title and label, ``twice`` where an item is moved more than once.
    """
    pairs = rows.select("source_row", "title", F.explode(paired_tokens(F.upper("old"), F.upper("new"), "[SD][0-9]+")).alias("x")).select("source_row", "title", "x.*")
    level = lambda c: F.expr(f"cast(substr({c}, 2) as int)")
    pairs = pairs.filter((F.expr("left(old, 1) = left(new, 1)")) & (level("old") != level("new")) & (level("old") >= least))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    title = F.coalesce(F.element_at(known, F.col("title")), F.col("title")) if aliases else F.col("title")
    pairs = pairs.select("source_row", "title", F.col("old").alias("label"), "new", normal_title(title).alias("normal"))
    matched, unmatched = unique_matches(pairs, catalog.select("item_id", "label", normal_title(F.col("title")).alias("normal")), ["normal", "label"])
    again = matched.groupBy("item_id").agg(F.count("*").alias("n"))
    delta = level("new") - level("label")
    moves = matched.join(again, "item_id").select(
        "item_id", "source_row", "title", F.col("label").alias("from_label"), F.col("new").alias("to_label"), delta.alias("delta"), F.when(delta > 0, "uprated").otherwise("downrated").alias("direction"), "n"
    )
    problems = unmatched.select("source_row", "title", F.col("label").alias("from_label"), F.lit("unmatched").alias("problem"))
    problems = problems.union(moves.filter("n > 1").select("source_row", "title", "from_label", F.lit("twice")))
    return moves.filter("n = 1").drop("n", "title"), problems


def close_titles(rows: DataFrame, catalog: DataFrame, least: float = 0.45, most: int = 3) -> DataFrame:
    """(text_id, item_id, alike, place): the closest titles of the same label, by edit distance as a share of the longer one; up to ``most`` items that are at least ``least`` alike.

    ``rows``: (text_id, label, normal), ``catalog``: (item_id, label, normal). Different titles of a label are compared once each. Of items with the same title only the first ``most`` can have a place, and rows that read alike share what is found.
    """
    name = catalog.select("label", F.col("normal").alias("name")).distinct()
    longer = F.greatest(F.length("normal"), F.length("name"), F.lit(1))
    pairs = rows.select("label", "normal").distinct().join(name, "label").filter(F.abs(F.length("normal") - F.length("name")) <= (1 - least + 1e-9) * longer)  # no distance is under that of lengths
    near = pairs.withColumn("alike", F.lit(1.0) - F.levenshtein("normal", "name") / longer).filter(F.col("alike") >= least)
    near = near.withColumn("place", F.rank().over(Window.partitionBy("label", "normal").orderBy(F.col("alike").desc()))).filter(F.col("place") <= most).drop("place")
    items = catalog.select("item_id", "label", F.col("normal").alias("name"), F.row_number().over(Window.partitionBy("label", "normal").orderBy("item_id")).alias("nth")).filter(F.col("nth") <= most)
    first = lambda found, *by: found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("alike").desc(), "item_id"))).filter(F.col("place") <= most)
    nearest = first(near.join(items, ["label", "name"]), "label", "normal").select("label", "normal", "item_id", "alike")
    return first(rows.join(nearest, ["label", "normal"]), "text_id").select("text_id", "item_id", "alike", "place")


def variant(normal: Column) -> Column:
    """short-cut, full-song or normal, of a title in normal form."""
    return F.when(normal.rlike("short ?cut"), "short-cut").when(normal.rlike("full ?song"), "full-song").otherwise("normal")


#: Words, as in a normal form, that only tell a variant, and those that a guest's name follows.
VARIANT_PAIRS, GUEST = (("short", "cut"), ("full", "song")), ("feat", "ft")


def _once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is worked out once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def _rest(words: Column) -> Column:
    """All words but the first."""
    return F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))


def _before(words: Column, stops: Column) -> Column:
    """The words before the first, after the first word, of ``stops``."""
    found = _once(_rest(words), lambda rest: F.transform(stops, lambda g: F.nullif(F.array_position(rest, g), F.lit(0))))
    return _once(F.array_min(found), lambda place: F.when(place.isNull(), words).otherwise(F.slice(words, F.lit(1), place.cast("int"))))


def base_name(normal: Column) -> Column:
    """The normal form without words for its variant, which may be written as one."""
    joined = [a + b for a, b in VARIANT_PAIRS]
    is_pair = lambda a, b: reduce(lambda t, p: t | ((a == p[0]) & (b == p[1])), VARIANT_PAIRS, F.lit(False))

    def kept(words: Column) -> Column:
        following = F.concat(_rest(words), F.array(F.lit("")))
        leading = F.concat(F.array(F.lit("")), words)
        cells = F.arrays_zip(words.alias("w"), following.alias("f"), leading.alias("l"))
        kept = F.filter(cells, lambda c: c["w"].isNotNull() & ~c["w"].isin(*joined) & ~is_pair(c["w"], c["f"]) & ~is_pair(c["l"], c["w"]))
        return F.array_join(F.transform(kept, lambda c: c["w"]), " ")

    return _once(F.filter(F.split(normal, " "), lambda w: w != ""), kept)


def core_names(normal: Column, suffixes: list[str]) -> Column:
    """The base name, and it without a guest and the given last words (a pattern each), where that leaves something else."""

    def cores(name: Column) -> Column:
        core = _once(F.split(name, " "), lambda words: F.array_join(_before(words, F.array(*map(F.lit, GUEST))), " "))
        for suffix in suffixes:
            core = F.trim(F.regexp_replace(core, rf"\s+(?:{suffix})$", ""))
        return _once(core, lambda core: F.array_distinct(F.when(core != "", F.array(name, core)).otherwise(F.array(name))))

    return _once(base_name(normal), cores)


def pattern_rank(text: Column, steps: list[tuple[str, int]], otherwise: int = 0) -> Column:
    """The rank of the first pattern that ``text`` has."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for pattern, rank in steps:
        out = out.when(text.rlike(pattern), rank)
    return out.otherwise(otherwise)
