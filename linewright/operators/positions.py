"""Places in the list of matches: ranks, pages, next and previous, go to line.

Matches are rows with ``path`` and ``line_number``; ranks count per file from 1.
A file may hold a third of all lines, so nothing here sorts a whole file in one
task. Line numbers are cut into blocks; one row per block with its match count
is enough to know which ranks a block holds, and only lines of one block are
ever ranked together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lookup import attach

BLOCK_LINES = 1 << 19


def _with_block(rows: DataFrame) -> DataFrame:
    block = F.floor((F.col("line_number") - 1) / BLOCK_LINES).cast("bigint")
    return rows.withColumn("_block", block)


def _block_ranks(matches: DataFrame) -> DataFrame:
    """``path, _block, _before, _n``: matches in earlier blocks and in this one."""
    counts = (
        _with_block(matches.select("path", "line_number"))
        .groupBy("path", "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    earlier = (
        Window.partitionBy("path")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    )


def _ranked(rows: DataFrame) -> DataFrame:
    within = Window.partitionBy("path", "_block").orderBy("line_number")
    rank = F.col("_before") + F.row_number().over(within)
    return rows.withColumn("match_rank", rank.cast("bigint"))


def rank_matches(matches: DataFrame) -> DataFrame:
    """All matches plus ``match_rank``. One shuffle of the matches, by block."""
    blocks = _block_ranks(matches).drop("_n")
    joined = _with_block(matches).join(blocks, ["path", "_block"])
    return _ranked(joined).drop("_block", "_before")


def match_page(matches: DataFrame, offset: int, limit: int) -> DataFrame:
    """The matches with ranks ``offset + 1`` to ``offset + limit`` of every file.

    Only blocks that hold one of those ranks are looked at again, so a page deep
    in the list costs no more than the first.
    """
    first, last = offset + 1, offset + limit
    blocks = _block_ranks(matches).filter(
        (F.col("_before") < last) & (F.col("_before") + F.col("_n") >= first)
    )
    wanted = attach(
        _with_block(matches), blocks.drop("_n"), ["path", "_block"]
    )
    page = _ranked(wanted).filter(F.col("match_rank").between(first, last))
    return page.drop("_block", "_before")


def nth_match(matches: DataFrame, rank: int) -> DataFrame:
    """The match at 0-based ``rank`` of every file that has that many."""
    return match_page(matches, rank, 1)


def next_match(matches: DataFrame, current: int) -> DataFrame:
    """First match of each file after line ``current``, from the top if none."""
    line = F.col("line_number")
    return _pick(matches, F.min_by, F.when(line > current, line), line)


def prev_match(matches: DataFrame, current: int) -> DataFrame:
    """Last match of each file before line ``current``, from the end if none."""
    line = F.col("line_number")
    return _pick(matches, F.max_by, F.when(line < current, line), line)


def goto_line(
    lines: DataFrame, number: int, counts: DataFrame | None = None
) -> DataFrame:
    """Line ``number`` of every file, clamped to 1..line count.

    That is the last line up to the number, or the first; the bound on the line number
    reaches the scan. ``counts`` (``path, line_count``) from a manifest name the line,
    and then nothing is aggregated.
    """
    number = max(number, 1)
    upto = lines.filter(F.col("line_number") <= number)
    if counts is None:
        return _pick(upto, F.max_by, F.col("line_number"))
    clamped = F.least(F.lit(number), F.col("line_count")).cast("bigint")
    target = counts.filter("line_count > 0").select("path", clamped.alias("line_number"))
    return upto.join(target, ["path", "line_number"])


def _pick(rows: DataFrame, choose, *orders) -> DataFrame:
    """Of each file the row chosen by the first order that any of its rows has.

    One pass: a task keeps one row per file and order.
    """
    row = F.struct(*[c for c in rows.columns if c != "path"])
    best = rows.groupBy("path").agg(
        *[choose(row, order).alias(f"_{i}") for i, order in enumerate(orders)]
    )
    chosen = F.coalesce(*[F.col(f"_{i}") for i in range(len(orders))])
    return best.select("path", chosen.alias("_row")).select("path", "_row.*")
