"""Snapshots of an ingested table's commits, and rewriting of superseded lines.

A snapshot is a folder of small tables::

    snapshots/N/live      the manifest rows that still matter, and where their lines are
    snapshots/N/covered   the commits that are taken in
    snapshots/N/replaced  folders of lines nobody reads any more

It counts once its marker file is there, which is created last. Readers take the newest one and
the manifests of commits that it doesn't cover. Only then are folders dropped, and what a
crash leaves undropped is dropped by the next compaction. So a compaction that dies at any
step leaves a table with the same lines.

Compactions of one table must not overlap: one that finds another's snapshot in its
place gives up. Ingests may go on meanwhile, as their commits are covered by neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.lookup import store
from ..session import claim, dir_exists, drop_part, list_dirs
from .ingest import (
    DONE,
    LIVE_SCHEMA,
    _next_id,
    current_lines,
    folder_numbers,
    live_rows,
    newest_snapshot,
    write_index,
)

# Folders of fewer lines than this are put together.
SMALL_LINES = 1_000_000


def snapshot(spark: SparkSession, table: str) -> int:
    """Put the manifests of all commits together; no line is rewritten."""
    return _replace(spark, table, [], drop=True)


def compact(
    spark: SparkSession,
    table: str,
    min_share: float = 0.0,
    small_lines: int = SMALL_LINES,
    drop: bool = True,
) -> int:
    """Rewrite the folders of lines of which more than ``min_share`` are superseded.

    Folders of fewer than ``small_lines`` current lines are put together with them. With
    ``drop`` the old folders go at once, and queries that were planned before must have
    ended; without, they go with the next compaction. Returns the snapshot's number.
    """
    rows = live_rows(spark, table)
    held = F.greatest(F.expr("live_last - first_line + 1"), F.lit(0))
    folders = rows.groupBy("folder").agg(
        F.sum(held).alias("live"), F.sum(F.expr("last_line - first_line + 1")).alias("all")
    )
    # One row per folder: as few as there are commits since the last compaction.
    chosen = [
        row.folder
        for row in folders.filter("live > 0").collect()
        if row["all"] - row.live > min_share * row["all"] or row.live < small_lines
    ]
    clean = folders.filter("live > 0 AND live = all").filter(F.col("live") < small_lines)
    if len(chosen) == 1 and clean.filter(F.col("folder") == chosen[0]).count():
        chosen = []  # a single small folder without anything superseded
    return _replace(spark, table, chosen, drop)


def _replace(spark: SparkSession, table: str, chosen: list[int], drop: bool) -> int:
    before = newest_snapshot(spark, table)
    number = _next_id(spark, table)
    while not claim(spark, f"{table}/claims/{number}"):
        number += 1
    # What is covered is listed first: a commit that comes in between stays uncovered.
    committed = folder_numbers(spark, f"{table}/manifest", "_SUCCESS")
    taken = spark.createDataFrame([(n,) for n in committed], "ingest_id bigint")
    old = _snapshot_part(spark, table, before, "covered", "ingest_id bigint")
    covered = store(old.union(taken).distinct(), "covered")
    rows = live_rows(spark, table).join(F.broadcast(covered), "ingest_id", "left_semi")
    rows = store(rows, "live-rows")
    picked = spark.createDataFrame([(n,) for n in chosen], "folder bigint")
    if chosen:
        _rewrite(spark, table, rows.join(F.broadcast(picked), "folder", "left_semi"), number)
    _write_snapshot(spark, table, before, number, rows, picked, covered)
    if newest_snapshot(spark, table) != before:
        raise RuntimeError(f"another compaction of {table} has come first")
    claim(spark, f"{table}/snapshots/{number}/{DONE}")
    if drop:
        drop_replaced(spark, table)
    return number


def _snapshot_part(
    spark: SparkSession, table: str, number: int | None, part: str, schema: str
) -> DataFrame:
    if number is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{table}/snapshots/{number}/{part}")


def _rewrite(spark: SparkSession, table: str, rows: DataFrame, number: int) -> None:
    """The current lines of some folders as one new folder."""
    current_lines(spark, table, rows).drop("ingest_id").write.mode("overwrite").parquet(
        f"{table}/lines/ingest_id={number}"
    )
    if dir_exists(spark, f"{table}/index"):
        write_index(spark, table, number)


def _write_snapshot(
    spark: SparkSession,
    table: str,
    before: int | None,
    number: int,
    rows: DataFrame,
    picked: DataFrame,
    covered: DataFrame,
) -> None:
    base = f"{table}/snapshots/{number}"
    live = rows.filter("live_last >= first_line")
    kept = live.select("folder").distinct().join(picked, "folder", "left_anti")
    names = [field.split()[0] for field in LIVE_SCHEMA.split(", ")]
    # Superseded rows stay where their folder stays: their lines are still in it.
    stay = rows.join(F.broadcast(kept), "folder", "left_semi").select(*names)
    moved = (
        live.join(F.broadcast(picked), "folder", "left_semi")
        .withColumns({"folder": F.lit(number).cast("bigint"), "last_line": F.col("live_last")})
        .select(*names)
    )
    stay.unionByName(moved).write.parquet(f"{base}/live")
    covered.coalesce(1).write.parquet(f"{base}/covered")
    gone = rows.select("folder").distinct().join(F.broadcast(kept), "folder", "left_anti")
    old = _snapshot_part(spark, table, before, "replaced", "folder bigint")
    gone.union(old).distinct().coalesce(1).write.parquet(f"{base}/replaced")


def drop_replaced(spark: SparkSession, table: str) -> None:
    """Drop what the newest snapshot has replaced: lines, manifests, older snapshots."""
    number = newest_snapshot(spark, table)
    gone = _snapshot_part(spark, table, number, "replaced", "folder bigint").collect()
    covered = _snapshot_part(spark, table, number, "covered", "ingest_id bigint").collect()
    for folder in sorted(row.folder for row in gone):
        drop_part(spark, f"{table}/lines/ingest_id={folder}")
        drop_part(spark, f"{table}/index/ingest_id={folder}")
    there = set(folder_numbers(spark, f"{table}/manifest"))
    for commit in sorted(there & {row.ingest_id for row in covered}):
        drop_part(spark, f"{table}/manifest/ingest_id={commit}")
    done = [int(n) for n in list_dirs(spark, f"{table}/snapshots", marked=DONE)]
    for old in sorted(done)[:-2]:
        drop_part(spark, f"{table}/snapshots/{old}")
