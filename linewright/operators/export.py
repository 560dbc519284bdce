"""Matching lines as text files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def export_lines(matches: DataFrame, folder: str) -> None:
    """Write one line per match in file and line order.

    The sort is a range shuffle over (path, line_number), so a large file spreads
    over many tasks; the part files, read by name, keep the order.
    """
    ordered = matches.orderBy("path", "line_number")
    ordered.select("value").write.option("lineSep", "\n").text(folder)
