"""What lines take over from the lines before them in their file.

A stack trace has the time of the line above it, and a stamp without a year is of the year the
lines before it have come to. Neither needs a file in one task: lines are cut into blocks,
each block is summed up in one row, what the blocks before it come to is found from
these rows alone, and only lines of one block are ever put in order together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.times import event_time, stamp_month
from .lookup import attach, store

# Lines of a file that are put in order in one task.
BLOCK_LINES = 1 << 19

_BLOCK = ["path", "_block"]


def _in_block() -> WindowSpec:
    return Window.partitionBy(*_BLOCK).orderBy("line_number")


def _blocks() -> WindowSpec:
    return Window.partitionBy("path").orderBy("_block")


def _blocked(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_block", F.expr(f"(line_number - 1) DIV {BLOCK_LINES}"))


def _so_far(column: Column, window: WindowSpec, current: bool) -> Column:
    """The last value that isn't null, up to the row or up to the one before it."""
    end = Window.currentRow if current else -1
    return F.last(column, ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, end)
    )


def carry_event_time(timed: DataFrame) -> DataFrame:
    """``timed`` with the ``event_time`` of the last line before that has one, where a line has none.

    ``own_time`` tells which lines have one themselves. Lines before a file's first
    stamp stay without.
    """
    blocked = _blocked(timed)
    stamped = F.when(F.col("event_time").isNotNull(), F.col("line_number"))
    ends = blocked.groupBy(*_BLOCK).agg(F.max_by("event_time", stamped).alias("_last"))
    carried = ends.select(*_BLOCK, _so_far(F.col("_last"), _blocks(), False).alias("_carried"))
    joined = attach(blocked, carried, _BLOCK)
    filled = F.coalesce(_so_far(F.col("event_time"), _in_block(), True), F.col("_carried"))
    return (
        joined.withColumn("own_time", F.col("event_time").isNotNull())
        .withColumn("event_time", filled)
        .drop("_block", "_carried")
    )


def _turn(before: str, month: str) -> str:
    """Years a step from one month to another makes: 1 from December on to January, -1 back.

    A step of more than half a year is taken the other way round, so lines that are
    logged a little late around New Year do not count as a year.
    """
    return (
        f"CASE WHEN {month} - {before} <= -6 THEN 1 "
        f"WHEN {month} - {before} > 6 THEN -1 ELSE 0 END"
    )


def with_rolling_year(
    parsed: DataFrame, year: int, date: str | None = None, zone: str = "UTC"
) -> DataFrame:
    """``parsed`` plus ``event_time``, for files whose stamps have no year and turn it.

    ``year`` is that of a file's first stamp; it goes up by one with every step from December
    to January, and down where a late line goes back. The steps in each block are counted
    from the stamps alone; a block begins with the sum of all before it.
    """
    month = F.expr(stamp_month("ts_text"))
    narrow = _blocked(parsed.select("path", "line_number", month.alias("_month")))
    before = _so_far(F.col("_month"), _in_block(), False).alias("_before")
    steps = narrow.filter("_month IS NOT NULL").select("*", before)
    sums = steps.groupBy(*_BLOCK).agg(
        F.min_by("_month", "line_number").alias("_first"),
        F.max_by("_month", "line_number").alias("_last"),
        F.expr(f"sum({_turn('_before', '_month')})").alias("_turns"),
    )
    # One row per block that has a stamp.
    sums = store(sums, "year-turns")
    entered = sums.withColumn("_prior", F.lag("_last").over(_blocks())).withColumn(
        "_enter", F.expr(f"coalesce({_turn('_prior', '_first')}, 0)")
    )
    upto = _blocks().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.expr("_enter + _turns")).over(upto) - F.col("_turns")
    years = entered.select(*_BLOCK, (F.lit(year) + total).cast("int").alias("_year"))
    lines = attach(_blocked(parsed.withColumn("_month", month)), years, _BLOCK, how="left")
    lines = lines.withColumn("_before", _so_far(F.col("_month"), _in_block(), False))
    turned = F.sum(F.expr(_turn("_before", "_month"))).over(
        _in_block().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    timed = lines.withColumn("_year", (F.col("_year") + turned).cast("int"))
    own = F.expr(event_time("ts_text", "_year", date, zone))
    return timed.withColumn("event_time", own).drop(
        "_month", "_before", "_block", "_year"
    )
