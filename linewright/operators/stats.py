"""Per-file figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.levels import LEVELS


def level_counts(parsed: DataFrame) -> DataFrame:
    """``path`` and one counter per level, zero for absent levels."""
    return parsed.groupBy("path").agg(
        *[F.count_if(F.col("level") == name).alias(name) for name in LEVELS]
    )


def file_summary(files: DataFrame) -> DataFrame:
    """``path, format, line_count, file_size, size_gb`` from rows with a ``file_size``.

    Gigabytes are 10^9 bytes, to one decimal.
    """
    size = F.round(F.col("file_size") / F.lit(1e9), 1)
    return files.select(
        "path", "format", "line_count", "file_size", size.alias("size_gb")
    )


def line_counts(parsed: DataFrame) -> DataFrame:
    """``path, format, line_count``."""
    return parsed.groupBy("path", "format").agg(
        F.count(F.lit(1)).alias("line_count")
    )
