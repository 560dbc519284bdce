"""A search whose matches are kept: pages, jumps and combinations without searching again.

The matches of a file are kept as one bit per line, in rows of ``SET_LINES`` lines that have a
match: 8 KB as they are, and what Parquet makes of them in the table. Beside them
lies one row per set with its number of matches and of those before it, so that
a page or the n-th match is found from the counts, and then from the few sets that hold it.

Sets are combined bit by bit: ``a & b``, ``a | b`` and ``a - b`` are saved searches too. All
must have been saved from the same lines, with the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lookup import attach, store
from .ranges import merged_ranges, within

SET_LINES = 1 << 16
_WORDS = SET_LINES // 64

_EMPTY = f"array_repeat(0L, {_WORDS})"


def save_search(matches: DataFrame) -> SavedSearch:
    """Keep which lines (``path, line_number``) are matches. One pass over them."""
    place = f"CAST((line_number - 1) % {SET_LINES} AS INT)"
    words = (
        matches.selectExpr(
            "path",
            f"(line_number - 1) DIV {SET_LINES} AS block",
            f"{place} DIV 64 AS word",
            f"shiftleft(1L, {place} % 64) AS bit",
        )
        .groupBy("path", "block", "word")
        .agg(F.expr("bit_or(bit)").alias("bits"))
    )
    # At most as many rows as a set has words.
    sets = (
        words.groupBy("path", "block")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
        .selectExpr(
            "path",
            "block",
            f"transform(sequence(0, {_WORDS - 1}), i -> coalesce(held[i], 0L)) AS words",
        )
    )
    return _saved(sets)


def _saved(sets: DataFrame) -> SavedSearch:
    count = "aggregate(words, 0L, (n, w) -> n + bit_count(w))"
    sets = store(sets.selectExpr("path", "block", f"{count} AS n", "words").filter("n > 0"), "sets")
    earlier = Window.partitionBy("path").orderBy("block")
    before = F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    counts = sets.select("path", "block", "n", F.coalesce(before, F.lit(0)).alias("before"))
    return SavedSearch(sets, store(counts, "set-counts"))


class SavedSearch:
    """``sets``: path, block, n, words; ``counts``: path, block, n, before; both stored."""

    def __init__(self, sets: DataFrame, counts: DataFrame):
        self.sets, self.counts = sets, counts

    def matches(self) -> DataFrame:
        """``path, matches`` of the files that have any."""
        return self.counts.groupBy("path").agg(F.sum("n").alias("matches"))

    def ranks(self, first: int, last: int) -> DataFrame:
        """``path, line_number, match_rank`` of the matches with those ranks in every file."""
        held = self.counts.filter((F.col("before") < last) & (F.col("before") + F.col("n") >= first))
        sets = attach(self.sets.drop("n"), held.drop("n"), ["path", "block"])
        lines = (
            "flatten(transform(words, (w, i) -> transform(filter(sequence(0, 63), "
            f"b -> shiftright(w, b) & 1L = 1L), b -> block * {SET_LINES} + i * 64 + b + 1)))"
        )
        found = sets.select("path", "before", F.posexplode(F.expr(lines)).alias("i", "line_number"))
        ranked = found.selectExpr(
            "path", "CAST(line_number AS BIGINT) AS line_number", "before + i + 1 AS match_rank"
        )
        return ranked.filter(F.col("match_rank").between(first, last))

    def page(self, lines: DataFrame, offset: int, limit: int) -> DataFrame:
        """``lines`` with ranks ``offset + 1`` to ``offset + limit`` of every file.

        Only the row groups between a page's first and last line are read again.
        """
        ranked = store(self.ranks(offset + 1, offset + limit), "page")
        span = ranked.groupBy("path").agg(
            F.min("line_number").alias("low"), F.max("line_number").alias("high")
        )
        return attach(within(lines, span), ranked, ["path", "line_number"])

    def nth(self, lines: DataFrame, rank: int) -> DataFrame:
        """The match at 0-based ``rank`` of every file that has that many."""
        return self.page(lines, rank, 1)

    def lines(self, lines: DataFrame) -> DataFrame:
        """All matches among ``lines``; stretches without any are not read again."""
        near = within(lines, merged_ranges(self.counts.select("path", "block"), SET_LINES))
        place = f"CAST((line_number - 1) % {SET_LINES} AS INT)"
        blocked = near.withColumn("_block", F.expr(f"(line_number - 1) DIV {SET_LINES}"))
        sets = self.sets.selectExpr("path", "block AS _block", "words AS _words")
        # A set goes to each of its lines: never broadcast, dealt by file and block.
        joined = blocked.join(sets.hint("shuffle_merge"), ["path", "_block"])
        hit = F.expr(f"shiftright(_words[{place} DIV 64], {place} % 64) & 1L = 1L")
        return joined.filter(hit).drop("_block", "_words")

    def _with(self, other: SavedSearch, bits: str) -> SavedSearch:
        theirs = other.sets.selectExpr("path", "block", "words AS others")
        both = self.sets.join(theirs, ["path", "block"], "full")
        words = (
            f"zip_with(coalesce(words, {_EMPTY}), coalesce(others, {_EMPTY}), (x, y) -> {bits})"
        )
        return _saved(both.selectExpr("path", "block", f"{words} AS words"))

    def __and__(self, other: SavedSearch) -> SavedSearch:
        return self._with(other, "x & y")

    def __or__(self, other: SavedSearch) -> SavedSearch:
        return self._with(other, "x | y")

    def __sub__(self, other: SavedSearch) -> SavedSearch:
        return self._with(other, "x & ~y")
