"""A stored table of parsed lines that follows its source files.

Layout below the table folder::

    lines/ingest_id=N/      parsed lines that commit N wrote
    manifest/ingest_id=N/   what commit N took in: one row per file
    claims/N                taken by the run that may write N
    index/ingest_id=N/      the pieces of those lines, where the table is indexed
    snapshots/N/            what all earlier commits come to (see ``plans.compact``)

The manifest rows of a commit are written last and are what makes its lines
visible: a run that died at any point leaves lines nobody reads, and a number
nobody uses again. Each commit claims a number by creating a file that must not be
there, so two runs at once never write to one place.

A manifest row says which lines of its file the commit holds, ``first_line`` to
``line_count``. A file that was only appended to is read on from the byte after its last
line end, and its new commit holds the lines from there on: an unfinished last line is
in it once more, as it is now. Any other change is read from the start. Lines that a later
commit has too are superseded, and left out on reading.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.formats import format_name
from ..operators.grams import GRAMS_SCHEMA, in_order, line_pieces, search_indexed
from ..operators.lookup import BROADCAST_BYTES, store, store_measured
from ..operators.parse import BLOCK_LINES, parse_logs
from ..operators.search import search_logs
from ..session import claim, dir_exists, drop_dir, fresh_dir, list_dirs
from ..sources.byte_ranges import line_ends, read_appended, resume_places
from ..sources.listing import glob_escape, list_files
from ..sources.text_lines import number_lines

LINES_SCHEMA = (
    "path string, line_number bigint, value string, format string, level string, "
    "level_code tinyint, ts_text string, ingest_id bigint"
)
MANIFEST_SCHEMA = (
    "path string, file_size bigint, mtime_secs bigint, format string, "
    "line_count bigint, first_line bigint, end_offset bigint, end_lines bigint, "
    "seal string, ingest_id bigint"
)
# Manifest rows as a snapshot keeps them: where the lines are now, and up to which one.
LIVE_SCHEMA = f"{MANIFEST_SCHEMA}, folder bigint, last_line bigint"
IDENTITY = ["path", "file_size", "mtime_secs"]
DONE = "_DONE"

# One ingest takes at most this many files and bytes (but always one file), so
# the paths the driver handles stay few and a long load advances in commits.
MAX_FILES = 10_000
MAX_BYTES = 20 * 10**12
# After so many commits their manifests are put together in a snapshot.
SNAPSHOT_COMMITS = 64


def stale_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed files the manifest does not know in exactly this size and mtime."""
    return listing.join(manifest.select(*IDENTITY), IDENTITY, "left_anti")


def manifest_history(spark: SparkSession, table: str) -> DataFrame:
    """The manifest rows of commits; snapshots take them in after a while."""
    folder = f"{table}/manifest"
    if not dir_exists(spark, folder):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(folder)


def folder_numbers(spark: SparkSession, folder: str, marked: str | None = None) -> list[int]:
    """The numbers N of the subfolders ``ingest_id=N``."""
    names = list_dirs(spark, folder, marked)
    return [int(name[10:]) for name in names if name.startswith("ingest_id=")]


def newest_snapshot(spark: SparkSession, table: str) -> int | None:
    found = [int(n) for n in list_dirs(spark, f"{table}/snapshots", marked=DONE) if n.isdigit()]
    return max(found, default=None)


def live_rows(spark: SparkSession, table: str) -> DataFrame:
    """Every manifest row that may still matter, and ``live_last``, the last line it has alone.

    A row's lines end where those of a later commit of the same file begin; a row with
    ``live_last < first_line`` is wholly superseded.
    """
    rows = manifest_history(spark, table).withColumns(
        {
            "folder": F.col("ingest_id"),
            "first_line": F.coalesce("first_line", F.lit(1).cast("bigint")),
            "last_line": F.col("line_count"),
        }
    )
    number = newest_snapshot(spark, table)
    if number is not None:
        base = f"{table}/snapshots/{number}"
        covered = spark.read.schema("ingest_id bigint").parquet(f"{base}/covered")
        rows = rows.join(F.broadcast(covered), "ingest_id", "left_anti")
        rows = rows.unionByName(spark.read.schema(LIVE_SCHEMA).parquet(f"{base}/live"))
    later = Window.partitionBy("path").orderBy(F.desc("ingest_id"))
    taken = F.min("first_line").over(later.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns(
        {
            "live_last": F.least("last_line", F.coalesce(taken - 1, F.col("last_line"))),
            "age": F.row_number().over(later),
        }
    )


def read_manifest(spark: SparkSession, table: str) -> DataFrame:
    """The newest manifest row of each path."""
    names = [field.split()[0] for field in MANIFEST_SCHEMA.split(", ")]
    return live_rows(spark, table).filter("age = 1").select(*names)


def ingest(
    spark: SparkSession,
    paths: str | list[str],
    table: str,
    max_files: int = MAX_FILES,
    max_bytes: int = MAX_BYTES,
    index: bool = False,
    **options,
) -> int:
    """Take in new and changed files; returns how many commits that took.

    Unchanged files are not read. A file that was appended to is read on from its last
    line end, and the bytes before it are only compared with what was kept of them. Any
    other changed file is parsed again as a whole, and its earlier lines go out of sight with
    the same commit. With ``index``, or where the table has one, the new lines are indexed.
    """
    # Listed and compared once, in order of path: a commit starts after the last one's
    # path, and looks neither at the manifest nor at files that are done.
    known = read_manifest(spark, table)
    stale = stale_files(list_files(spark, paths, **options), known)
    stale = store(_with_places(stale, known).orderBy("path"), "stale")
    index = index or dir_exists(spark, f"{table}/index")
    next_id = _next_id(spark, table)
    commits, done = 0, None
    while True:
        rest = stale if done is None else stale.filter(F.col("path") > done)
        found = rest.orderBy("path").limit(max_files).collect()
        batch, size = [], 0
        for row in found:
            new = row.file_size - (row.resume_at or 0)
            if batch and size + new > max_bytes:
                break
            batch.append(row)
            size += new
        if batch:
            while not claim(spark, f"{table}/claims/{next_id}"):
                next_id += 1
            _commit(spark, batch, stale.schema, table, next_id, index, options)
            commits, done = commits + 1, batch[-1].path
        if len(batch) == len(found) < max_files:
            break
    if commits and len(folder_numbers(spark, f"{table}/manifest")) >= SNAPSHOT_COMMITS:
        from .compact import snapshot

        snapshot(spark, table)
    return commits


def _next_id(spark: SparkSession, table: str) -> int:
    last = manifest_history(spark, table).agg(F.max("ingest_id")).first()[0]
    return 1 + max(-1 if last is None else last, newest_snapshot(spark, table) or -1)


def _with_places(stale: DataFrame, known: DataFrame) -> DataFrame:
    """``stale`` plus where to read each file on, its lines before that, and its format."""
    old = known.selectExpr(
        "path", "true AS known", "file_size AS old_size", "end_offset", "end_lines", "seal",
        "format",
    )
    found = resume_places(
        stale.join(old, "path", "left").withColumn("known", F.col("known").isNotNull())
    )
    goes_on = F.col("resume_at") > 0
    return found.select(
        *IDENTITY,
        "resume_at",
        F.when(goes_on, F.col("end_lines")).otherwise(F.lit(0)).alias("lines_before"),
        F.when(goes_on, F.col("format")).alias("format"),
    )


def _commit(
    spark: SparkSession,
    batch: list,
    schema,
    table: str,
    ingest_id: int,
    index: bool,
    options: dict,
) -> None:
    listed = spark.createDataFrame(batch, schema)
    whole = [glob_escape(row.path) for row in batch if row.resume_at is None]
    parts = []
    if whole:
        parts.append(number_lines(spark, whole, **options))
    if len(whole) < len(batch):
        parts.append(read_appended(spark, listed.filter("resume_at IS NOT NULL")))
    lines = reduce(DataFrame.unionByName, [part.lines for part in parts])
    files = reduce(DataFrame.unionByName, [part.files for part in parts])
    parsed = parse_logs(lines)
    parsed.write.mode("overwrite").parquet(f"{table}/lines/ingest_id={ingest_id}")
    if index:
        write_index(spark, table, ingest_id)
    # Only now is it known whether a file stayed as it was while it was read.
    ends = line_ends(listed.selectExpr("path", "file_size", "resume_at IS NULL AS exact"))
    read = files.selectExpr("path", "format AS told", "line_count AS n")
    no_line = F.expr(format_name("path", "CAST(NULL AS TINYINT)"))
    count = F.col("lines_before") + F.coalesce("n", F.lit(0))
    unfinished = (F.col("end_offset") < F.col("file_size")).cast("bigint")
    manifest = (
        listed.join(read, "path", "left")
        .join(ends.select("path", "end_offset", "seal"), "path", "left")
        .select(
            *IDENTITY,
            F.coalesce("format", "told", no_line).alias("format"),
            count.cast("bigint").alias("line_count"),
            (F.col("lines_before") + 1).cast("bigint").alias("first_line"),
            "end_offset",
            (count - unfinished).cast("bigint").alias("end_lines"),
            "seal",
        )
    )
    manifest.write.parquet(f"{table}/manifest/ingest_id={ingest_id}")
    for part in parts:
        drop_dir(spark, part.folder)


def write_index(spark: SparkSession, table: str, folder: int) -> None:
    """Index the lines of one folder, from the folder itself."""
    held = spark.read.schema(LINES_SCHEMA).parquet(f"{table}/lines/ingest_id={folder}")
    # Stored before they are put in order, so that the lines are gone through once.
    found = fresh_dir(spark, "pieces")
    line_pieces(held.select("path", "line_number", "value")).write.parquet(found)
    pieces = in_order(spark.read.schema(GRAMS_SCHEMA).parquet(found))
    pieces.write.mode("overwrite").parquet(f"{table}/index/ingest_id={folder}")
    drop_dir(spark, found)


def index_table(spark: SparkSession, table: str) -> int:
    """Index every folder of current lines that has no index yet; returns how many."""
    live = live_rows(spark, table).filter("live_last >= first_line")
    folders = {row.folder for row in live.select("folder").distinct().collect()}
    missing = sorted(folders - set(folder_numbers(spark, f"{table}/index", "_SUCCESS")))
    for folder in missing:
        write_index(spark, table, folder)
    return len(missing)


def search_table(
    spark: SparkSession, table: str, query: str, level: str | None = None
) -> DataFrame:
    """``search_logs`` over the current lines, by the index as far as there is one."""
    rows = store(live_rows(spark, table), "live-rows")
    lines = current_lines(spark, table, rows)
    indexed = set(folder_numbers(spark, f"{table}/index", "_SUCCESS"))
    live = rows.filter("live_last >= first_line").select("folder").distinct().collect()
    without = sorted({row.folder for row in live} - indexed)
    if indexed:
        pieces = spark.read.schema(GRAMS_SCHEMA).parquet(f"{table}/index")
        others = f"ingest_id IN ({', '.join(map(str, without))})" if without else "false"
        lines = search_indexed(lines, pieces, query, level, others)
    else:
        lines = search_logs(lines, query, level)
    return lines.drop("ingest_id")


def read_parsed(spark: SparkSession, table: str) -> DataFrame:
    """The current parsed lines of every file.

    Where the folders hold nothing but current lines, as after a compaction, this is a
    plain scan and every filter reaches Parquet.
    """
    return current_lines(spark, table, live_rows(spark, table)).drop("ingest_id")


def current_lines(spark: SparkSession, table: str, rows: DataFrame) -> DataFrame:
    """``LINES_SCHEMA`` of the lines that are current by some manifest rows."""
    lines = spark.read.schema(LINES_SCHEMA).parquet(f"{table}/lines")
    # Listed after the reader did, so nothing it may have seen is missing here.
    there = set(folder_numbers(spark, f"{table}/lines"))
    rows, _ = store_measured(rows.select(*_RANGE, "live_last"), "live")
    live = rows.filter("live_last >= first_line").select(F.col("folder").alias("ingest_id"))
    live = live.distinct()
    # One row per folder: as few as there are commits since the last compaction.
    if {row.ingest_id for row in live.collect()} != there:
        lines = lines.join(F.broadcast(live), "ingest_id", "left_semi")
    # Of each file in each folder, the last current line, where there are others too.
    cut = (
        rows.groupBy("path", F.col("folder").alias("ingest_id"))
        .agg(
            F.max(F.when(F.expr("live_last >= first_line"), F.col("live_last"))).alias("upto"),
            F.max("last_line").alias("top"),
        )
        .withColumn("upto", F.coalesce("upto", F.lit(0)))
        .filter("upto < top")
    )
    cut, size = store_measured(cut.join(live, "ingest_id", "left_semi"), "superseded")
    if size == 0:
        return lines
    current = F.col("upto").isNull() | (F.col("line_number") <= F.col("upto"))
    if size <= BROADCAST_BYTES:
        cut = F.broadcast(cut.drop("top"))
        return lines.join(cut, ["path", "ingest_id"], "left").filter(current).drop("upto")
    # By blocks of lines, so that no file is one key.
    block = f"(line_number - 1) DIV {BLOCK_LINES}"
    blocks = f"explode(sequence(upto DIV {BLOCK_LINES}, (top - 1) DIV {BLOCK_LINES}))"
    cut = cut.selectExpr("path", "ingest_id", "upto", f"{blocks} AS _block")
    joined = lines.withColumn("_block", F.expr(block)).join(
        cut, ["path", "ingest_id", "_block"], "left"
    )
    return joined.filter(current).drop("upto", "_block")


_RANGE = ["path", "folder", "ingest_id", "first_line", "last_line"]
