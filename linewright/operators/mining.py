"""Kinds of lines found from the lines themselves: templates with places that vary.

Lines are cut at spaces, after quoted texts and numbers are masked. All lines with the same
number of words form a tree, word by word from the left: at a node, lines part by
their next word, unless it takes more than ``max_words`` values there. Then the place varies:
only words that one in ``max_words`` lines of the node has keep a branch of their own, and all
others are the same branch. So a user name or a host is found to vary because it
does, not because it looks like one.

The tree is built a place at a time over the distinct kinds that are left, which get fewer
with each place; the lines themselves are read once. What comes out depends on the set of
lines alone, not on their order or on how they are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lookup import attach, store
from .templates import template

VARIES = "<*>"
# More different words than this at a node make its place one that varies.
MAX_WORDS = 8
# Words of a line that are looked at one by one; what follows them is one place more.
MAX_PLACES = 48


def mined_templates(
    parsed: DataFrame,
    max_words: int = MAX_WORDS,
    max_places: int = MAX_PLACES,
    top: int | None = None,
) -> DataFrame:
    """``template, n, path, line_number, value``: kinds of lines and their first example.

    Only ``path``, ``line_number`` and ``value`` are read; a null value is no line.
    """
    rest = f"array_join(slice(w, {max_places + 1}, greatest(size(w) - {max_places}, 1)), ' ')"
    words = (
        f"CASE WHEN size(w) <= {max_places} THEN w "
        f"ELSE concat(slice(w, 1, {max_places}), array({rest})) END"
    )
    kinds = (
        parsed.filter("value IS NOT NULL")
        .select(
            F.split(F.expr(template("value")), " ").alias("w"),
            F.struct("path", "line_number").alias("first"),
        )
        .select(F.expr(words).alias("words"), "first")
        .groupBy("words")
        .agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
        .withColumn("size", F.size("words"))
    )
    kinds = store(kinds, "kinds")
    places = kinds.agg(F.max("size")).first()[0] or 0
    for place in range(places):
        kinds = _merged(kinds, place, max_words)
    found = kinds.select(
        F.array_join("words", " ").alias("template"),
        "n",
        F.col("first.path").alias("path"),
        F.col("first.line_number").alias("line_number"),
    )
    if top is not None:
        found = found.orderBy(F.desc("n"), "template").limit(top)
    # The text of the examples, one line per kind.
    return attach(
        parsed.select("path", "line_number", "value"),
        found,
        ["path", "line_number"],
    ).select("template", "n", "path", "line_number", "value")


def _merged(kinds: DataFrame, place: int, max_words: int) -> DataFrame:
    """The kinds after the words at one place are looked at."""
    key = ["size", "prefix"]
    # Partial aggregates first: a node of any number of kinds sends on its distinct words.
    words = (
        kinds.filter(F.col("size") > place)
        .select(
            "size", F.slice("words", 1, place).alias("prefix"), F.col("words")[place].alias("word"), "n"
        )
        .groupBy(*key, "word")
        .agg(F.sum("n").alias("lines"))
    )
    words = store(words, "node-words")
    varying = (
        words.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("words"), F.sum("lines").alias("all"))
        .filter(F.col("words") > max_words)
        .drop("words")
    )
    # No more than ``max_words`` words can have such a share.
    frequent = (
        attach(words, varying, key)
        .groupBy(*key)
        .agg(
            F.expr(
                f"collect_list(CASE WHEN lines * {max_words} >= all THEN word END)"
            ).alias("stay")
        )
    )
    told = attach(kinds.withColumn("prefix", F.slice("words", 1, place)), frequent, key, how="left")
    here = F.expr(
        f"CASE WHEN size > {place} AND NOT array_contains(stay, words[{place}]) "
        f"THEN concat(prefix, array('{VARIES}'), slice(words, {place + 2}, size)) ELSE words END"
    )
    merged = (
        told.select("size", here.alias("words"), "n", "first")
        .groupBy("size", "words")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    )
    return store(merged, "kinds")
