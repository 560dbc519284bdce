"""Lines grouped by their shape, and columns from patterns of the user's own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from ..functions import sql

# What varies between lines of one kind, and what stands for it; in this order.
MASKS = (
    ('"[^"]*"', '"*"'),
    ("'[^']*'", "'*'"),
    ("0x[0-9A-Fa-f]+", "#"),
    ("[0-9]+", "#"),
)


def template(value: str) -> str:
    """SQL for a line with quoted texts and numbers masked."""
    for pattern, mark in MASKS:
        value = f"regexp_replace({value}, {sql.text(pattern)}, {sql.text(mark)})"
    return value


def similar_lines(parsed: DataFrame, top: int | None = None) -> DataFrame:
    """``template, n, path, line_number, value``: kinds of lines and their first example.

    The example is the first by path and line number. Kinds are counted in each task
    before the shuffle; ``top`` keeps that many of the most frequent, by template where
    they tie.
    """
    kinds = (
        parsed.select("path", "line_number", "value", F.expr(template("value")).alias("template"))
        .groupBy("template")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("path", "line_number", "value")).alias("example"),
        )
        .select("template", "n", "example.*")
    )
    return kinds if top is None else kinds.orderBy(F.desc("n"), "template").limit(top)


def parse_pattern(lines: DataFrame, pattern: str) -> DataFrame:
    """``lines`` plus a string column for each named group of ``pattern``.

    The pattern is searched for anywhere in the line. Where it isn't found, or a group
    took no part, the columns are null and empty respectively. A name that is a column
    already is refused.
    """
    found = re.compile(pattern)
    if not found.groupindex:
        raise ValueError("the pattern has no named group (?P<name>...)")
    clash = set(found.groupindex) & set(lines.columns)
    if clash:
        raise ValueError(f"already columns: {sorted(clash)}")
    java = pattern.replace("(?P<", "(?<")
    hit = sql.matches("value", java)
    return lines.selectExpr(
        "*",
        *(
            f"CASE WHEN {hit} THEN regexp_extract(value, {sql.text(java)}, {index}) END "
            f"AS `{name}`"
            for name, index in found.groupindex.items()
        ),
    )
