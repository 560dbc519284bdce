"""Parsed streams: growing files, and folders that new log segments arrive in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.formats import detect_format
from ..functions.text import clean_line, let
from ..operators.parse import parse_logs, pin_level
from ..sources.text_lines import file_uri
from ..session import qualified
from .folder import FolderSource
from .tail import TASK_BYTES, TailSource, split_path


def tail_lines(
    spark: SparkSession,
    paths: list[str],
    starting: str = "start",
    task_bytes: int | None = None,
    missing: str = "error",
) -> DataFrame:
    """Stream of ``path, byte_offset, value, head`` from files that grow.

    A path without a scheme is resolved as Spark does, by the default file system.
    """
    paths = [qualified(spark, path) for path in paths]
    for path in paths:
        split_path(path)  # an unknown scheme fails here, not in a task
    spark.dataSource.register(TailSource)
    reader = (
        spark.readStream.format(TailSource.name())
        .option("paths", json.dumps(list(paths)))
        .option("startingPosition", starting)
        .option("missing", missing)
        .option("tasks", str(spark.sparkContext.defaultParallelism))
    )
    if task_bytes is not None:
        reader = reader.option("taskBytes", str(task_bytes))
    return reader.load()


def follow(
    spark: SparkSession,
    paths: list[str],
    format: str | None = None,
    **options,
) -> DataFrame:
    """Stream of parsed lines: ``path, byte_offset, value, format, level, ...``.

    Without ``format`` each file's own is told from its name and first line, so
    appended lines never change it and a replaced file may.
    """
    return _parse_tail(tail_lines(spark, paths, **options), format)


def follow_folder(
    spark: SparkSession,
    folder: str,
    state: str,
    format: str | None = None,
    pattern: str = "*",
    batch_bytes: int | None = None,
    task_bytes: int = TASK_BYTES,
    missing: str = "error",
) -> DataFrame:
    """Stream of parsed lines, as of :func:`follow`, of all files below a folder.

    New files join, and a batch reads at most ``batch_bytes`` (by default ``task_bytes``
    for every core). ``state`` is a folder of this query alone, as its checkpoint is, and
    is kept as long. With ``missing="skip"`` planned lines of a file that was removed
    before they were read are left out, instead of ending the query.

    With ``trigger(availableNow=True)`` a run takes one batch; ``append_until_idle`` goes on
    until nothing is left.
    """
    folder, state = (qualified(spark, path).rstrip("/") for path in (folder, state))
    for path in (folder, state):
        split_path(path)
    if f"{state}/".startswith(f"{folder}/"):
        raise ValueError(f"the state folder must not lie in the folder it follows: {state}")
    if missing not in ("error", "skip"):
        raise ValueError(f"missing is error or skip, not {missing}")
    cores = spark.sparkContext.defaultParallelism
    batch_bytes = task_bytes * cores if batch_bytes is None else batch_bytes
    if batch_bytes < 1 or task_bytes < 1:
        raise ValueError("a batch and a task take at least one byte")
    spark.dataSource.register(FolderSource)
    reader = (
        spark.readStream.format(FolderSource.name())
        .option("folder", folder)
        .option("state", state)
        .option("pattern", pattern)
        .option("batchBytes", str(batch_bytes))
        .option("taskBytes", str(task_bytes))
        .option("tasks", str(cores))
        .option("missing", missing)
    )
    return _parse_tail(reader.load(), format)


def _parse_tail(lines: DataFrame, format: str | None) -> DataFrame:
    if format is None:
        # Bound to a variable, it is compiled apart from the parsing: both in one method are more
        # bytecode than the JVM compiles, and every line would be interpreted.
        told = let("told", detect_format("path", "head"), "told")
        lines = lines.withColumn("format", F.expr(told))
    return _parse_stream(lines, "byte_offset", format)


def follow_segments(
    spark: SparkSession, folder: str, format: str, **options
) -> DataFrame:
    """Stream of parsed lines of the segment files that appear in a folder."""
    reader = spark.readStream.option("lineSep", "\n")
    reader = reader.option("recursiveFileLookup", "true").options(**options)
    lines = reader.text(folder).select(
        file_uri("_metadata.file_path").alias("path"),
        F.expr(clean_line("value")).alias("value"),
    )
    return _parse_stream(lines, None, format)


def _parse_stream(lines: DataFrame, order: str | None, format: str | None) -> DataFrame:
    # A stream has no line numbers; within a file, lines are ordered by offset.
    unnumbered = lines.withColumn("line_number", F.lit(None).cast("bigint"))
    parsed = parse_logs(unnumbered, format)
    keys = ["path"] if order is None else ["path", order]
    parsed = parsed.select(*keys, "value", "format", "level", "level_code", "ts_text")
    return pin_level(parsed)


def live_level_counts(parsed: DataFrame) -> DataFrame:
    """Running count per file and level. State is one number per pair."""
    return parsed.groupBy("path", "level").agg(F.count(F.lit(1)).alias("n"))
