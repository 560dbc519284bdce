"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may do
    without: it gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if named:
        return named.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="linewright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_scopes: list[list[str]] = []


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A folder name below the shared folder that nothing else uses."""
    folder = f"{shared_dir(spark)}/linewright/{purpose}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns the intermediate tables that are made within: they go at its end.

    Numbered lines, stored sides and staged tables rest on such folders, so what is built
    within must have been written or collected by then. Scopes nest.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            drop_dir(spark, folder)


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path without scheme, completed by the default file system unless that is local."""
    if ":" in path.split("/")[0]:
        return path
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return path if default.startswith("file:") else default.rstrip("/") + path


# Fixed value: Spark's setting for the tasks that list the paths a reader is given.
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Tasks per core that list paths.
_LISTING_WAVES = 4


@contextmanager
def shared_listing(spark: SparkSession) -> Iterator[None]:
    """Has a task list many of the paths a reader is given.

    By itself Spark gives each of up to 10,000 paths a task, and starting those
    costs the driver more than the files take to read.
    """
    before = spark.conf.get(_LISTING, None)
    tasks = _LISTING_WAVES * spark.sparkContext.defaultParallelism
    spark.conf.set(_LISTING, str(tasks if before is None else min(tasks, int(before))))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_LISTING)
        else:
            spark.conf.set(_LISTING, before)


def dir_exists(spark: SparkSession, folder: str) -> bool:
    path, system = _file_system(spark, folder)
    return system.exists(path)


def drop_dir(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by :func:`fresh_dir`, on whatever file system it is."""
    if "/linewright/" not in folder:
        raise ValueError(f"not an intermediate folder: {folder}")
    path, system = _file_system(spark, folder)
    system.delete(path, True)


def list_dirs(spark: SparkSession, folder: str, marked: str | None = None) -> list[str]:
    """Names of the subfolders, of all or of those that hold a file named ``marked``."""
    path, system = _file_system(spark, folder)
    if not system.exists(path):
        return []
    inner = spark._jvm.org.apache.hadoop.fs.Path
    found = [f.getPath() for f in system.listStatus(path) if f.isDirectory()]
    if marked is not None:
        found = [p for p in found if system.exists(inner(p, marked))]
    return [p.getName() for p in found]


# The parts of an ingested table that a compaction may drop.
_PART = re.compile("/((lines|index|manifest)/ingest_id=[0-9]+|snapshots/[0-9]+)$")


def drop_part(spark: SparkSession, folder: str) -> None:
    """Delete one replaced part of an ingested table."""
    if not _PART.search(folder):
        raise ValueError(f"not a part of a table: {folder}")
    path, system = _file_system(spark, folder)
    system.delete(path, True)


def drop_batch(spark: SparkSession, folder: str) -> None:
    """Delete one batch of a sink's running totals."""
    name = folder.rpartition("/")[2]
    if not name.startswith("batch-"):
        raise ValueError(f"not a batch of totals: {folder}")
    path, system = _file_system(spark, folder)
    system.delete(path, True)


def claim(spark: SparkSession, file: str) -> bool:
    """Create a file that must not exist; False if another run was first."""
    path, system = _file_system(spark, file)
    system.mkdirs(path.getParent())
    return system.createNewFile(path)
