"""Lines by time: instants, ranges, and counts per window and level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.times import event_time

# Timestamps of this kind have bounds in every row group; Spark's default kind has none.
_KIND = "spark.sql.parquet.outputTimestampType"


def with_event_time(
    parsed: DataFrame,
    year: int | None = None,
    date: str | None = None,
    zone: str = "UTC",
) -> DataFrame:
    """``parsed`` plus ``event_time``, null where ``ts_text`` gives no instant.

    ``year`` and ``date`` complete stamps that lack them, ``zone`` those without one.
    """
    return parsed.withColumn("event_time", F.expr(event_time("ts_text", year, date, zone)))


def time_range(timed: DataFrame, start=None, end=None) -> DataFrame:
    """Lines with ``start <= event_time < end``; an open side is None.

    Lines without an instant are in no range. On a stored ``event_time`` the test
    reaches the scan.
    """
    time = F.col("event_time")
    inside = time.isNotNull()
    if start is not None:
        inside = inside & (time >= F.lit(start).cast("timestamp"))
    if end is not None:
        inside = inside & (time < F.lit(end).cast("timestamp"))
    return timed.filter(inside)


def store_timed(timed: DataFrame, folder: str) -> None:
    """Write lines with their ``event_time`` so that a range of it skips what lies outside.

    Lines are laid out in ranges of path and line number, and so mostly of time: each
    row group has the least and the greatest instant in it.
    """
    spark = timed.sparkSession
    before = spark.conf.get(_KIND)
    spark.conf.set(_KIND, "TIMESTAMP_MICROS")
    try:
        timed.repartitionByRange("path", "line_number").sortWithinPartitions(
            "path", "line_number"
        ).write.parquet(folder)
    finally:
        spark.conf.set(_KIND, before)


def read_timed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def frequency(
    timed: DataFrame, window: str = "1 minute", late: str | None = None
) -> DataFrame:
    """``path, window_start, level, n``: lines per window, for batches and streams.

    With ``late`` a stream forgets windows that old, and may append those closed.
    Counts are summed in each task before anything is shuffled.
    """
    timed = timed.filter("event_time IS NOT NULL")
    if late is not None:
        timed = timed.withWatermark("event_time", late)
    counted = timed.groupBy("path", F.window("event_time", window).alias("w"), "level")
    return counted.agg(F.count(F.lit(1)).alias("n")).select(
        "path", F.col("w.start").alias("window_start"), "level", "n"
    )
