"""Search over parsed lines: predicates, counts, highlight spans, the line view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import contains_ignoring_case
from ..functions.text import match_spans as spans_of

COUNTED_LEVELS = ("error", "warn", "info", "debug")


def search_predicate(query: str = "", level: str | None = None) -> Column:
    """Level equality AND case-insensitive substring; both pass all by default.

    The level comes first: it is cheap, and on a stored table it reaches the scan.
    """
    matches = F.lit(True)
    if level is not None:
        matches = F.col("level") == level
    if query != "":
        hit = F.expr(contains_ignoring_case("value", query))
        matches = hit if level is None else matches & hit
    return matches


def search_logs(
    parsed: DataFrame, query: str = "", level: str | None = None
) -> DataFrame:
    """Lines that match. Their order is left to the sink."""
    if query == "" and level is None:
        return parsed
    return parsed.filter(search_predicate(query, level))


def match_count(parsed: DataFrame, query: str = "", level: str | None = None) -> DataFrame:
    """``path, matches``, zero where a file has none."""
    found = F.count_if(search_predicate(query, level))
    return parsed.groupBy("path").agg(found.alias("matches"))


def search_counts(
    parsed: DataFrame, query: str = "", level: str | None = None
) -> DataFrame:
    """``path, all, error, warn, info, debug`` shown beside the level buttons.

    With an empty query the counts are those of the whole file, a level filter
    notwithstanding; otherwise those of the lines passing both predicates. The
    predicate is evaluated once per line: it is summed per level first.
    """
    counted = search_predicate(query, level) if query != "" else F.lit(True)
    by_level = parsed.groupBy("path", "level").agg(F.count_if(counted).alias("n"))
    return by_level.groupBy("path").agg(
        F.sum("n").alias("all"),
        *[
            F.sum(F.when(F.col("level") == name, F.col("n")).otherwise(0)).alias(name)
            for name in COUNTED_LEVELS
        ],
    )


def live_search_counts(
    parsed: DataFrame, query: str = "", level: str | None = None
) -> DataFrame:
    """The counts of :func:`search_counts` in one aggregation, as streams need them.

    State is six numbers per file. The predicate is evaluated once per line: the explode
    of one element keeps it from being copied into each count.
    """
    counted = search_predicate(query, level) if query != "" else F.lit(True)
    lines = parsed.select("path", "level", F.explode(F.array(counted)).alias("hit"))
    return lines.groupBy("path").agg(
        F.count_if("hit").alias("all"),
        *[
            F.count_if(F.col("hit") & (F.col("level") == name)).alias(name)
            for name in COUNTED_LEVELS
        ],
    )


def match_spans(parsed: DataFrame, needle: str) -> DataFrame:
    """``path, line_number, spans``: 1-based starts of every highlighted match."""
    return parsed.select(
        "path", "line_number", F.expr(spans_of("value", needle)).alias("spans")
    )


def log_view(parsed: DataFrame) -> DataFrame:
    """The three displayed columns (and the file they belong to)."""
    return parsed.select(
        "path",
        "line_number",
        F.coalesce("ts_text", F.lit("")).alias("ts_text"),
        "value",
    )
