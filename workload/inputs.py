"""Log lines and log files that Spark makes from the given tables."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linewright.functions import sql
from linewright.operators.lookup import store
from linewright.operators.parse import parse_logs
from linewright.session import fresh_dir

from . import shapes

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Lines of one made file: its writer holds no more than these.
SEGMENT_EVENTS = 2500
SEGMENT_DOCS = 250

# Seconds spent on writing files for a query to read; the bench takes them off.
spent_writing = 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Stamps in the tables have no zone; reading and writing them in UTC keeps
    # every wall-clock time as it is.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_type(names: dict, other: str) -> str:
    branches = [(f"event_type = {sql.text(k)}", sql.text(v)) for k, v in names.items()]
    return sql.case(branches, sql.text(other))


# An event's stamp is formatted once, and its fields are cut out of that text.
STAMP = "date_format(ts, 'HH:mm:ss.SSS|MM-dd|MMM|yyyy-MM-dd')"

FIELDS = {
    "d": "substring_index(stamp, '|', -1)",
    "t": "substring(stamp, 1, 8)",
    "f": "substring(stamp, 10, 3)",
    "m": "substring(stamp, 20, 3)",
    "dd": "substring(stamp, 17, 2)",
    "md": "substring(stamp, 14, 5)",
    "u": "CAST(user_id AS STRING)",
    "one": "CAST(user_id % 10 AS STRING)",
    "h": "CAST(user_id % 7 AS STRING)",
    "id": "CAST(event_id AS STRING)",
    "type": "event_type",
    "lvl": _by_type(shapes.LEVEL_WORDS, shapes.OTHER_WORD),
    "mark": _by_type(shapes.LETTERS, shapes.OTHER_LETTER),
    "props": "props",
}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("stamp", F.expr(STAMP))


def _line(shape: str) -> Column:
    parts = [
        FIELDS[text] if kind == "field" else sql.text(text)
        for kind, text in shapes.pieces(shape)
    ]
    return F.expr(f"concat({', '.join(parts)})")


def file_lines(
    spark: SparkSession, sf_dir: str, path: str, events: DataFrame | None = None
) -> DataFrame:
    """Lines of one of the four log files."""
    if events is None:
        events = _events(spark, sf_dir)
    return events.select(
        F.lit(path).alias("path"),
        (F.col("event_id") + 1).alias("line_number"),
        _line(shapes.FILES[path]).alias("value"),
    )


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the four log files together."""
    events = _events(spark, sf_dir)
    frames = [file_lines(spark, sf_dir, path, events) for path in shapes.FILES]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionAll(frame)
    return result


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One irregular line per event."""
    odd = f"array({sql.texts(shapes.ODD_SHAPES)})"
    value = f"element_at({odd}, CAST(event_id % {len(shapes.ODD_SHAPES)} AS INT) + 1)"
    for name, field in FIELDS.items():
        value = f"replace({value}, '<{name}>', {field})"
    return _events(spark, sf_dir).select(
        F.lit("odd.log").alias("path"),
        (F.col("event_id") + 1).alias("line_number"),
        F.expr(value).alias("value"),
    )


def with_odd(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    return file_lines(spark, sf_dir, path).unionAll(odd_lines(spark, sf_dir))


# Lines with words of documents in some places; ``<w>`` is the n-th word.
WORDY = (
    "fetch <1> for <source> in <lang> done",
    "fetch <2> for <source> gave up",
    "worker <lang> says <3> and <1> at 12:30",
    "cache <lang> is full",
)


def wordy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per document, with words of its text in places that vary."""
    value = f"element_at(array({sql.texts(WORDY)}), CAST(doc_id % {len(WORDY)} AS INT) + 1)"
    for n in (1, 2, 3):
        value = f"replace({value}, '<{n}>', split_part(text, ' ', {n}))"
    for name in ("source", "lang"):
        value = f"replace({value}, '<{name}>', coalesce({name}, ''))"
    return table(spark, sf_dir, "documents").selectExpr(
        "'words.log' AS path", "doc_id + 1 AS line_number", f"{value} AS value"
    )


# Where the stamps of ``yearless_lines`` start, and seconds from line to line.
FIRST_YEAR, STEP_SECS = 2019, 37_003
FIRST_TIME = f"{FIRST_YEAR}-11-05 08:00:00"


def yearless_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two files whose stamps go on for years without naming one.

    Every fifth line has no stamp, and every seventh is a day late.
    """
    late = "CASE WHEN event_id % 7 = 3 THEN 86400 ELSE 0 END"
    time = f"timestamp_seconds(unix_seconds(TIMESTAMP '{FIRST_TIME}') + event_id * {STEP_SECS} - {late})"
    events = table(spark, sf_dir, "events").withColumn("t", F.expr(time))
    shapes_of = {
        "sys.txt": "date_format(t, 'MMM dd HH:mm:ss'), ' host app: '",
        "device.log": "date_format(t, 'MM-dd HH:mm:ss.SSS'), '  1  2 I Tag: '",
    }
    frames = [
        events.select(
            F.lit(path).alias("path"),
            (F.col("event_id") + 1).alias("line_number"),
            F.expr(
                f"concat(CASE WHEN event_id % 5 = 4 THEN '  at ' ELSE concat({stamp}) END, "
                "event_type)"
            ).alias("value"),
        )
        for path, stamp in shapes_of.items()
    ]
    return frames[0].unionAll(frames[1])


_stored: dict[tuple, DataFrame] = {}


def parsed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four files parsed and stored, once per session: what a search runs on."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = store(parse_logs(all_lines(spark, sf_dir)), "parsed")
    return _stored[key]


def segment_lines(spark: SparkSession, sf_dir: str, *paths: str) -> DataFrame:
    """``file, position, value``: the named files cut into segments."""
    events = _events(spark, sf_dir)
    frames = [file_lines(spark, sf_dir, path, events) for path in paths]
    lines = frames[0]
    for frame in frames[1:]:
        lines = lines.unionAll(frame)
    position = F.col("line_number") - 1
    part = F.floor(position / SEGMENT_EVENTS).cast("string")
    stem = F.regexp_replace("path", r"\..*", "")
    return lines.select(
        F.concat(stem, F.lit("-"), part).alias("file"),
        position.alias("position"),
        "value",
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, position, value``: whole document texts, a group of them per file."""
    return table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / SEGMENT_DOCS).cast("string").alias("file"),
        F.col("doc_id").alias("position"),
        F.col("text").alias("value"),
    )


def _system(folder: str):
    """File system of a folder, and its path there."""
    from pyarrow import fs

    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


def _write_file(folder: str, name: str, data: bytes) -> None:
    system, inner = _system(folder)
    system.create_dir(f"{inner}/{name}".rpartition("/")[0], recursive=True)
    with system.open_output_stream(f"{inner}/{name}.txt") as out:
        out.write(data)


def _file_bytes(texts, edits: tuple = ()) -> bytes:
    data = "".join(text + "\n" for text in texts).encode("utf-8")
    for old, new in edits:
        data = data.replace(old, new)
    return data


def make_files(lines: DataFrame, *kept: str) -> list[DataFrame]:
    """Whole files of the lines that each condition keeps, in a folder of their own.

    Each frame (``file, size, whole``) names those of one condition. :func:`write_files`
    takes it in place of the lines, which are then made, moved and sorted once, however
    often a query writes them.
    """
    spark = lines.sparkSession
    folders = [fresh_dir(spark, "whole") for _ in kept]

    def write(pdf):
        import pandas as pd

        name = pdf["file"].iloc[0]
        pdf = pdf.sort_values("position")
        rows = []
        for i, folder in enumerate(folders):
            texts = pdf["value"][pdf[f"kept_{i}"]]
            if len(texts):
                data = _file_bytes(texts)
                _write_file(folder, name, data)
                rows.append((name, i, len(data), f"{folder}/{name}.txt"))
        return pd.DataFrame(rows, columns=["file", "i", "size", "whole"])

    global spent_writing
    start = time.perf_counter()
    marked = lines.selectExpr(
        "*", *(f"coalesce({test}, false) AS kept_{i}" for i, test in enumerate(kept))
    )
    schema = "file string, i int, size bigint, whole string"
    made = store(marked.groupBy("file").applyInPandas(write, schema), "made")
    spent_writing += time.perf_counter() - start
    return [made.filter(F.col("i") == i).drop("i") for i in range(len(kept))]


def _write_shares(made: DataFrame, folder: str, share: float) -> DataFrame:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for row in batch.to_pylist():
                system, whole = _system(row["whole"])
                with system.open_input_stream(whole) as source:
                    data = source.read(int(row["size"] * share))
                _write_file(folder, row["file"], data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["size"])

    # A row is a file to write: few bytes of rows would come to a single task.
    tasks = 4 * made.sparkSession.sparkContext.defaultParallelism
    return made.repartition(tasks, "file").mapInArrow(write, "size bigint")


def write_files(
    lines: DataFrame, folder: str, share: float = 1.0, edits: tuple = ()
) -> None:
    """Write ``<folder>/<file>.txt`` for every ``file``, lines by position.

    ``lines`` may be a frame of :func:`make_files`. ``edits`` are pairs of bytes to look for
    and to put in their place.

    ``share`` below 1 writes that part of the bytes only, as a file looks that is
    still growing. Each file is small and written whole, so a task may run twice.
    """

    def write(pdf):
        import pandas as pd

        name = pdf["file"].iloc[0]
        data = _file_bytes(pdf.sort_values("position")["value"], edits)
        data = data[: int(len(data) * share)]
        _write_file(folder, name, data)
        return pd.DataFrame({"file": [name], "size": [len(data)]})

    global spent_writing
    start = time.perf_counter()
    if "whole" in lines.columns:
        if edits:
            raise ValueError("files that are made already are not edited")
        written = _write_shares(lines, folder, share)
    else:
        written = lines.groupBy("file").applyInPandas(write, "file string, size bigint")
    written.agg(F.sum("size")).collect()
    spent_writing += time.perf_counter() - start


def file_id(path: Column) -> Column:
    """Name of a made file without folder and extension.

    The name is cut off first: an expression that may begin at any character of the path
    is tried at each, and takes the square of a folder name's length.
    """
    name = F.substring_index(path, "/", -1)
    stem = F.left(name, F.char_length(name) - 4)
    return F.when(F.endswith(name, F.lit(".txt")), stem).when(name.isNotNull(), "")


def run_dir(spark: SparkSession, purpose: str) -> str:
    return fresh_dir(spark, purpose)


def file_paths(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the made files, for the stream that follows them."""
    from linewright import list_files

    return [r.path for r in list_files(spark, folder).select("path").collect()]
