"""Lines picked by ranges of line numbers, without reading the others where that can be.

Lines stored in order of path and number have bounds of both in every row group, so a test of
a few ranges as literals lets the scan leave out what they don't touch. Many ranges are
joined by blocks of lines instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .lookup import attach, store

# Up to so many ranges become literals of a filter.
PUSHED = 200
BLOCK_LINES = 1 << 19


def merged_ranges(blocks: DataFrame, size: int) -> DataFrame:
    """``path, low, high``: line numbers of neighbouring blocks (path, block) put together."""
    order = Window.partitionBy("path").orderBy("block")
    island = F.col("block") - F.row_number().over(order)
    return (
        blocks.withColumn("island", island)
        .groupBy("path", "island")
        .agg(F.min("block").alias("a"), F.max("block").alias("b"))
        .selectExpr(
            "path",
            f"CAST(a * {size} + 1 AS BIGINT) AS low",
            f"CAST((b + 1) * {size} AS BIGINT) AS high",
        )
    )


def within(lines: DataFrame, ranges: DataFrame, or_else: str = "false") -> DataFrame:
    """``lines`` whose number lies in a range (``path, low, high``) of their file.

    Ranges of one file must not overlap. ``or_else`` is SQL for lines that are wanted in
    any case.
    """
    ranges = store(ranges, "ranges")
    few = ranges.limit(PUSHED + 1).collect()
    if len(few) <= PUSHED:
        wanted = F.expr(or_else)
        by_path: dict = {}
        for row in few:
            by_path.setdefault(row.path, []).append(F.col("line_number").between(row.low, row.high))
        for path, tests in sorted(by_path.items(), key=str):
            inside = tests[0]
            for test in tests[1:]:
                inside = inside | test
            wanted = wanted | ((F.col("path") == F.lit(path)) & inside)
        return lines.filter(wanted)
    # Every block of lines once per range in it; a block holds few ranges of one file.
    block = f"(line_number - 1) DIV {BLOCK_LINES}"
    spread = ranges.selectExpr(
        "path",
        f"explode(sequence((low - 1) DIV {BLOCK_LINES}, (high - 1) DIV {BLOCK_LINES})) AS _block",
        "low",
        "high",
    )
    spread = spread.groupBy("path", "_block").agg(
        F.collect_list(F.struct("low", "high")).alias("_ranges")
    )
    joined = attach(
        lines.withColumn("_block", F.expr(block)), spread, ["path", "_block"], how="left"
    )
    inside = F.expr(
        "coalesce(exists(_ranges, r -> line_number BETWEEN r.low AND r.high), false)"
    )
    return joined.filter(inside | F.expr(or_else)).drop("_block", "_ranges")
