"""Log files as a table of numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.formats import format_name, sniff_code
from ..functions.text import clean_line
from ..operators.lookup import BROADCAST_BYTES, store_measured
from ..session import fresh_dir, shared_listing

_STAGED = "file string, block bigint, sniffed tinyint, value string"


def file_uri(column: str) -> Column:
    """A file's absolute URI without percent-encoding: its identity everywhere here."""
    decoded = f"url_decode(replace({column}, '+', '%2B'))"
    return F.expr(f"CASE WHEN contains({column}, '%') THEN {decoded} ELSE {column} END")


def refuse_hidden(paths: str | list[str]) -> None:
    """Spark reads no file or folder with such a name, and says nothing."""
    for path in [paths] if isinstance(paths, str) else paths:
        name = path.rstrip("/").rpartition("/")[2]
        if name.startswith(("_", ".")) and name not in (".", ".."):
            raise ValueError(f"a name that starts with _ or . is not read: {path}")


def _scan(spark: SparkSession, paths: str | list[str], options: dict) -> DataFrame:
    refuse_hidden(paths)
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    reader = reader.options(**options)
    with shared_listing(spark):
        text = reader.text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.expr(clean_line("value")).alias("value"),
    )


def scan_lines(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """``path, value``: lines cut at LF only, cleaned, without numbers.

    Every Hadoop URI, directory (with all below it) and glob works; large files are split
    for parallel reading and compressed files are unpacked by their extension. Names
    that start with ``_`` or ``.`` are left out, and refused where given as a path.
    """
    lines = _scan(spark, paths, options)
    return lines.select(file_uri("file").alias("path"), "value")


class NumberedLines:
    """Numbered lines of many files, with what is known about each file.

    ``lines``   path, line_number, value, format
    ``files``   path, format, line_count (files without any line are absent)
    ``folder``  the staged copy the lines are read from
    """

    def __init__(self, lines: DataFrame, files: DataFrame, folder: str):
        self.lines = lines
        self.files = files
        self.folder = folder


def number_lines(
    spark: SparkSession,
    paths: str | list[str],
    broadcast_limit: int = BROADCAST_BYTES,
    **options,
) -> NumberedLines:
    """Read log files and number their lines from 1.

    The text is read once and staged as Parquet in scan order: one staged file
    per task, so a row's position in its staged file orders the lines of a split.
    From the staged ``file`` and ``block`` columns alone comes one row per split
    (first position, line count); a running sum of those counts per file gives
    the number of the first line of each split. That table has one row per split
    however long the lines are, is stored, and is joined back: broadcast up to
    ``broadcast_limit`` bytes, else shuffled on (file, block), where one key never
    holds more than a split. Numbers rest on stored rows, so a lost executor or
    a changed cluster size cannot move them.
    """
    folder = fresh_dir(spark, "staged")
    first_block = F.col("block") == 0
    staged = _scan(spark, paths, options).select(
        "file",
        "block",
        F.when(first_block, F.expr(sniff_code("value"))).alias("sniffed"),
        "value",
    )
    # One staged file per task, whatever the session's default says.
    staged.write.option("maxRecordsPerFile", 0).parquet(folder)

    rows = spark.read.schema(_STAGED).parquet(folder)
    rows = rows.withColumn("position", F.col("_metadata.row_index"))
    splits = (
        split_counts(rows)
        .withColumn("path", file_uri("file"))
        .withColumn("format", F.expr(format_name("path", "sniffed")))
    )
    return numbered(rows, splits, folder, broadcast_limit)


def split_counts(rows: DataFrame) -> DataFrame:
    """``file, block, n, shift, sniffed`` of staged rows: one row per split.

    ``shift`` added to a row's position in its staged file is its line number in the
    file, ``sniffed`` is what the file's first split says.
    """
    splits = rows.groupBy("file", "block").agg(
        F.min("position").alias("first_position"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("sniffed", "position").alias("sniffed"),
    )
    file = Window.partitionBy("file").orderBy("block")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(
        "file",
        "block",
        "n",
        (
            F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_position") + 1
        ).alias("shift"),
        F.first("sniffed").over(file).alias("sniffed"),
    )


def numbered(
    rows: DataFrame, splits: DataFrame, folder: str, broadcast_limit: int
) -> NumberedLines:
    """Staged rows with the numbers that ``splits`` (path, format, shift, n) give them."""
    splits = splits.select("file", "path", "block", "n", "shift", "format")
    splits, size = store_measured(splits, "splits")
    shifts = splits.select("file", "block", "path", "shift", "format")
    if size <= broadcast_limit:
        shifts = F.broadcast(shifts)
    lines = (
        rows.select("file", "block", "value", "position")
        .join(shifts, ["file", "block"])
        .select(
            "path",
            (F.col("position") + F.col("shift")).alias("line_number"),
            "value",
            "format",
        )
    )
    files = splits.groupBy("path", "format").agg(F.sum("n").alias("line_count"))
    return NumberedLines(lines, files, folder)


def read_log_lines(
    spark: SparkSession, paths: str | list[str], **options
) -> DataFrame:
    """``path, line_number, value, format`` of every line of the given files."""
    return number_lines(spark, paths, **options).lines
