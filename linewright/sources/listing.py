"""The files that are there now, with what tells whether they changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_listing
from .text_lines import file_uri, refuse_hidden


def list_files(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """``path, file_size, mtime_secs``, one row per file; no content is read.

    Folders are taken with all that lies below them, whatever the subfolders' names.
    Spark's file sources leave out files of zero bytes, and names that start with ``_``
    or ``.``; so does this, except that such a name given as a path is refused.
    """
    refuse_hidden(paths)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.options(**options)
    with shared_listing(spark):
        files = reader.load(paths)
    return (
        files.select(
            file_uri("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("file_size"),
            F.unix_seconds(F.col("_metadata.file_modification_time")).alias(
                "mtime_secs"
            ),
        )
        .dropDuplicates(["path"])
    )


def glob_escape(path: str) -> str:
    """A file's path with the characters Hadoop would expand taken literally."""
    for mark in "\\{}[]*?":
        path = path.replace(mark, "\\" + mark)
    return path
