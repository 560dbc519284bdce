"""Files that have grown since they were read: where their lines end, and what came after.

The place after a file's last line end is kept with a seal of the bytes before it: a
digest of the file's start and of the bytes right before that place. A larger file whose
seal still holds has only been appended to, and is read on from there. What lies
between the file's start and the bytes before the place is not looked at again, as
reading it would cost what resuming saves.

Byte ranges are read by the executors, by the schemes of ``streaming.tail``. Files of
another scheme, packed ones and those that can't be opened this way have no place, and
are read whole by Spark's own reader.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.formats import format_name, sniff_code
from ..functions.text import clean_line
from ..operators.lookup import BROADCAST_BYTES
from ..session import fresh_dir
from ..streaming import tail
from .text_lines import NumberedLines, numbered, split_counts

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes a seal is made of: the file's first ones, and the last before the place.
HEAD_BYTES = 4096
TAIL_BYTES = 1 << 16
# Tasks per core that look at files.
WAVES = 4
# Most bytes of a file that one task reads.
RANGE_BYTES = 64 << 20
# Endings of files that Spark's reader unpacks.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz")

_STAGED = "file string, block bigint, sniffed tinyint, value string"
_BOM = b"\xef\xbb\xbf"


def by_ranges(path: str) -> bool:
    """Whether a file can be read from a place on."""
    scheme, colon, _ = path.partition(":")
    known = not colon or "/" in scheme or scheme.lower() in tail.SCHEMES
    return known and not path.lower().endswith(PACKED)


def last_line_end(source, size: int) -> int:
    """The byte after the last LF among the first ``size``; 0 if there is none."""
    end = size
    while end > 0:
        start = max(0, end - TAIL_BYTES)
        cut = source.read_at(end - start, start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        end = start
    return 0


def seal_of(source, place: int) -> str:
    """Digest of a file's start and of the bytes before a place."""
    digest = hashlib.sha256(source.read_at(min(HEAD_BYTES, place), 0))
    start = max(0, place - TAIL_BYTES)
    digest.update(source.read_at(place - start, start))
    return digest.hexdigest()


def _opened(path: str):
    """``source, size``, or None where the file can't be opened by this reader."""
    if not by_ranges(path):
        return None
    try:
        return tail.open_file(path)
    except (OSError, pa.ArrowException):
        return None


def _per_file(files: DataFrame, look: Callable, fields: list[pa.Field]) -> DataFrame:
    """``files`` plus what ``look`` finds out about each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [look(row) for row in batch.to_pylist()]
            columns = zip(*found, strict=True) if found else [()] * len(fields)
            added = [
                pa.array(list(column), type=field.type)
                for column, field in zip(columns, fields, strict=True)
            ]
            names = [*batch.schema.names, *(field.name for field in fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    kinds = {"int64": "bigint", "string": "string"}
    schema = files.selectExpr(
        "*", *(f"CAST(NULL AS {kinds[str(f.type)]}) AS {f.name}" for f in fields)
    ).schema
    # A row is a file to open: few bytes of rows would come to a single task.
    tasks = files.sparkSession.sparkContext.defaultParallelism * WAVES
    return files.repartition(tasks, "path").mapInArrow(run, schema)


def line_ends(files: DataFrame) -> DataFrame:
    """``path, file_size, exact`` plus ``end_offset, seal``: after the last LF of those bytes.

    Both are null where the file can't be read by ranges, and where it must be ``exact``
    and is no longer of that size.
    """

    def look(row: dict) -> tuple:
        opened = _opened(row["path"])
        if opened is None:
            return None, None
        source, size = opened
        with source:
            if size < row["file_size"] or (row["exact"] and size != row["file_size"]):
                return None, None
            end = last_line_end(source, row["file_size"])
            return end, seal_of(source, end)

    return _per_file(
        files, look, [pa.field("end_offset", pa.int64()), pa.field("seal", pa.string())]
    )


def resume_places(files: DataFrame) -> DataFrame:
    """``files`` plus ``resume_at``: the byte to read each on from, null to read it whole.

    ``known`` tells that an earlier size ``old_size`` is known, ``end_offset`` and ``seal``
    what was kept then. A file that grew while it was last read has no place, and is read
    from its start by ranges, which are exact whatever is appended meanwhile.
    """

    def look(row: dict) -> tuple:
        if not row["known"] or not by_ranges(row["path"]):
            return (None,)
        if row["end_offset"] is None:
            return (0,)
        if row["file_size"] <= row["old_size"]:
            return (None,)
        opened = _opened(row["path"])
        if opened is None:
            return (None,)
        source, size = opened
        with source:
            whole = size >= row["file_size"]
            held = whole and seal_of(source, row["end_offset"]) == row["seal"]
            return (row["end_offset"] if held else None,)

    return _per_file(files, look, [pa.field("resume_at", pa.int64())])


def lines_of_range(path: str, lower: int, upper: int, stop: int, first: bool):
    """Arrow arrays of the raw lines that start in a range; the last may lack its LF."""
    import pyarrow.compute as pc

    source, _ = tail.open_file(path)
    with source:
        position = lower if first else tail._after_newline(source, lower - 1, stop)
        for start, block in tail._whole_lines(source, position, upper, stop):
            position = start + len(block)
            if position > upper:
                # Lines that start past the range are another's.
                block = block[: block.find(b"\n", upper - 1 - start) + 1]
            if start == 0:
                block = block.removeprefix(_BOM)
            lines = pc.split_pattern(pa.array([block], pa.large_binary()), b"\n").flatten()
            yield lines.slice(0, len(lines) - 1)
        if position < min(upper, stop):
            rest = source.read_at(stop - position, position)
            rest = rest.removeprefix(_BOM) if position == 0 else rest
            yield pa.array([rest], pa.large_binary())


def read_appended(
    spark: SparkSession, files: DataFrame, broadcast_limit: int = BROADCAST_BYTES
) -> NumberedLines:
    """Number and return the lines from ``resume_at`` to ``file_size`` of each file.

    ``files``: ``path, file_size, resume_at, lines_before, format``. Numbers go on from
    ``lines_before``; a null format is told from the file's first line.
    """
    size = F.sum(F.col("file_size") - F.col("resume_at"))
    total = files.agg(size).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // RANGE_BYTES))
    share = max(1 << 20, min(RANGE_BYTES, -(-total // tasks)))
    ranges = (
        files.filter("resume_at < file_size")
        .selectExpr(
            "path",
            "resume_at",
            "file_size AS stop",
            f"explode(sequence(resume_at, file_size - 1, CAST({share} AS BIGINT))) AS lower",
        )
        .selectExpr("*", f"least(lower + {share}, stop) AS upper")
        .repartition(int(min(tasks, 100_000)), "path", "lower")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path, lower = row["path"], row["lower"]
                for lines in lines_of_range(
                    path, lower, row["upper"], row["stop"], lower == row["resume_at"]
                ):
                    for at in range(0, len(lines), tail.BATCH_LINES):
                        some = lines.slice(at, tail.BATCH_LINES)
                        n = len(some)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.repeat(path, n),
                                pa.repeat(pa.scalar(lower, pa.int64()), n),
                                some.cast(pa.binary()),
                            ],
                            names=["file", "block", "raw"],
                        )

    raw = ranges.mapInArrow(read, "file string, block bigint, raw binary")
    text = F.expr("CAST(raw AS STRING)")
    staged = raw.select("file", "block", text.alias("raw")).select(
        "file",
        "block",
        F.when(F.col("block") == 0, F.expr(sniff_code(clean_line("raw")))).alias("sniffed"),
        F.expr(clean_line("raw")).alias("value"),
    )
    folder = fresh_dir(spark, "appended")
    # One staged file per task, whatever the session's default says.
    staged.write.option("maxRecordsPerFile", 0).parquet(folder)
    rows = spark.read.schema(_STAGED).parquet(folder)
    rows = rows.withColumn("position", F.col("_metadata.row_index"))
    known = files.selectExpr("path", "lines_before", "format AS known_format")
    told = F.coalesce("known_format", F.expr(format_name("path", "sniffed")))
    splits = (
        split_counts(rows)
        .withColumnRenamed("file", "path")
        .join(known, "path")
        .select(
            F.col("path").alias("file"),
            "path",
            "block",
            "n",
            (F.col("shift") + F.col("lines_before")).alias("shift"),
            told.alias("format"),
        )
    )
    return numbered(rows, splits, folder, broadcast_limit)
