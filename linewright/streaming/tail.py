"""A streaming source for files that grow in place.

Spark's own file source takes each file once and never sees bytes appended to it.
This one keeps, per file, its size and the byte after the last complete line, and
yields the lines completed since. Rows: ``path, byte_offset, value, head``; ``head``
is the start of the file's first line, from which the format is told.

A file that is smaller than when last looked at was replaced and is read from its
start. So was one, of whatever size, whose first bytes are others: offsets hold digests of
them, up to the first kilobyte. A path that is missing keeps its place while the query runs. At a restart its
place would be lost and the file read again when it is back, so that is an error,
unless the option ``missing`` is ``skip``.

Lines are read by the executors, a range of bytes per task. Paths are local (then
every executor must see them) or URIs; see :func:`open_file` for the schemes.
"""

from __future__ import annotations

import hashlib
import json
import sys
from concurrent.futures import ThreadPoolExecutor

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, byte_offset bigint, value string, head string"
CHUNK = 1 << 20
LOOKBACK = 1 << 16
STAT_THREADS = 32
TASK_BYTES = 64 * CHUNK
BATCH_LINES = 50_000
# Digests are kept of so many first bytes of a file, as far as it has them.
HEADS = (4, 32, 256, 1024)

# Start of a trimmed first line that is kept. No format is told by more than its first 22
# characters (a test holds the patterns to this), so the rest can't change the format.
HEAD_CHARS = 64

# What the JVM-side trim treats as white space, as a Python strip set.
_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def file_system(path: str):
    """File system of a local path or URI, and the path within it."""
    from pyarrow import fs

    kind, authority, inner = split_path(path)
    if kind == "local":
        return fs.LocalFileSystem(), inner
    if kind == "s3":
        return fs.S3FileSystem(), f"{authority}{inner}"
    if kind == "gs":
        return fs.GcsFileSystem(), f"{authority}{inner}"
    if kind == "azure":
        container, account = azure_names(authority)
        return fs.AzureFileSystem(account), f"{container}{inner}"
    host, _, port = authority.partition(":")
    return fs.HadoopFileSystem(host or "default", int(port or 0)), inner


def azure_names(authority: str) -> tuple[str, str]:
    """Container and account of ``container@account.dfs.core.windows.net``."""
    container, at, host = authority.partition("@")
    if not (container and at and host):
        raise ValueError(f"not container@account: {authority}")
    return container, host.partition(".")[0]


def open_file(path: str):
    """Random-access input of a local path or URI, and its current size."""
    system, inner = file_system(path)
    source = system.open_input_file(inner)
    return source, source.size()


# URI schemes and the kind of file system that reads them.
SCHEMES = {
    "file": "local",
    "s3": "s3",
    "s3a": "s3",
    "s3n": "s3",
    "gs": "gs",
    "abfs": "azure",
    "abfss": "azure",
    "hdfs": "hdfs",
    "viewfs": "hdfs",
}


def split_path(path: str) -> tuple[str, str, str]:
    """Kind of file system, authority and path of a decoded URI, taken as it stands.

    Nothing is percent-decoded: listings hand out decoded URIs, whose blanks and
    percent signs are part of the name. A path without scheme is local; ``follow``
    completes it by the cluster's default file system first.
    """
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return "local", "", path
    kind = SCHEMES.get(scheme.lower())
    if kind is None:
        known = ", ".join(sorted(SCHEMES))
        raise ValueError(f"can't follow files by {scheme}: (only {known}): {path}")
    if kind == "local":
        return kind, "", "/" + rest.lstrip("/")
    authority, slash, inner = rest.removeprefix("//").partition("/")
    return kind, authority, slash + inner


def heads_of(source, size: int) -> tuple[str, ...]:
    """Digests of a file's first bytes, one for each of ``HEADS`` that it is long enough for."""
    first = source.read_at(min(HEADS[-1], size), 0)
    return tuple(
        hashlib.blake2b(first[:n], digest_size=6).hexdigest() for n in HEADS if n <= size
    )


def same_file(old: tuple, new: tuple) -> bool:
    """Whether a file's state may follow from an earlier one by appending to it."""
    pairs = zip(old[2:], new[2:], strict=False)
    return new[0] >= old[0] and all(a == b for a, b in pairs)


def end_of_lines(path: str, seen: tuple | None = None) -> tuple | None:
    """``(size, byte after the last LF)`` of a file, None if there is no file.

    ``seen`` is an earlier result: nothing is read if the size is still the same,
    and only what came after that last LF if the file grew.
    """
    try:
        source, size = open_file(path)
    except FileNotFoundError:
        return None
    with source:
        return _line_end(source, size, seen)


def _line_end(source, size: int, seen: tuple | None) -> tuple:
    if seen is not None and seen[0] == size:
        return seen
    floor = seen[1] if seen is not None and seen[0] < size else 0
    end = size
    while end > floor:
        start = max(floor, end - LOOKBACK)
        cut = source.read_at(end - start, start).rfind(b"\n")
        if cut >= 0:
            return size, start + cut + 1
        end = start
    return size, floor


def state_of(path: str, seen: tuple | None = None) -> tuple | None:
    """``(size, byte after the last LF, *heads)`` of a file, None if there is no file.

    Of a file that is the one ``seen`` before, only the first bytes are read, and what came
    after its last LF.
    """
    try:
        source, size = open_file(path)
    except FileNotFoundError:
        return None
    with source:
        heads = heads_of(source, size)
        known = seen is not None and same_file(seen, (size, 0, *heads))
        return *_line_end(source, size, tuple(seen[:2]) if known else None), *heads


def spans(start: dict, end: dict) -> list[tuple]:
    """``(path, lower, stop)`` of the bytes between two offsets, by path.

    Offsets hold ``[size, end of lines, *heads]`` of each path. A file that is not the same
    or whose size is less than it was, whatever its last line end, was replaced and is read
    from its start.
    """
    found = []
    for path in sorted(end):
        old = start.get(path, (0, 0))
        lower = old[1] if same_file(old, end[path]) else 0
        if lower < end[path][1]:
            found.append((path, lower, end[path][1]))
    return found


def cut_ranges(start: dict, end: dict, task_bytes: int = TASK_BYTES) -> list[tuple]:
    """``(path, lower, upper, stop, at a line's start)`` byte ranges between two offsets."""
    return cut_spans(spans(start, end), task_bytes)


def cut_spans(found: list[tuple], task_bytes: int) -> list[tuple]:
    ranges = []
    for path, first, stop in found:
        lower = first
        while lower < stop:
            upper = min(lower + task_bytes, stop)
            # Where the range does not start a line, its first line belongs to
            # the range before.
            ranges.append((path, lower, upper, stop, lower == first))
            lower = upper
    return ranges


def pack_ranges(start: dict, end: dict, task_bytes: int, tasks: int) -> list[list]:
    """Ranges for each task: large files are cut, small ones share a task."""
    return pack_spans(spans(start, end), task_bytes, tasks)


def pack_spans(found: list[tuple], task_bytes: int, tasks: int) -> list[list]:
    total = sum(stop - lower for _, lower, stop in found)
    share = min(task_bytes, max(CHUNK, -(-total // tasks)))
    packed, size = [], share
    for one in cut_spans(found, share):
        length = one[2] - one[1]
        if size + length > share:
            packed.append([])
            size = 0
        packed[-1].append(one)
        size += length
    return packed


def lines_in_range(source, lower: int, upper: int, stop: int, at_line: bool):
    """``(byte offset, bytes)`` of each complete line that starts in the range."""
    position = lower
    if lower > 0 and not at_line:
        position = _after_newline(source, lower - 1, stop)
    rest: list[bytes] = []
    read_to = position
    while position < upper:
        block = source.read_at(min(CHUNK, stop - read_to), read_to)
        if not block:
            return
        read_to += len(block)
        pieces = block.split(b"\n")
        if len(pieces) == 1:  # a long line: joined once, when it ends
            rest.append(block)
            continue
        pieces[0] = b"".join([*rest, pieces[0]])
        rest = [pieces.pop()]
        for piece in pieces:
            if position >= upper:
                return
            yield position, piece
            position += len(piece) + 1


def _after_newline(source, position: int, stop: int) -> int:
    while position < stop:
        block = source.read_at(min(CHUNK, stop - position), position)
        if not block:
            break
        cut = block.find(b"\n")
        if cut >= 0:
            return position + cut + 1
        position += len(block)
    return stop


def shown(line: bytes) -> str:
    """One trailing CR removed; empty if the bytes are not UTF-8."""
    if line.endswith(b"\r"):
        line = line[:-1]
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return ""


def head_of(source, stop: int) -> str:
    for _, line in lines_in_range(source, 0, 1, stop, True):
        return shown(line).lstrip(_SPACE)[:HEAD_CHARS]
    return ""


def read_range(path, lower, upper, stop, at_line):
    """Record batches of the lines that start in one byte range of a file.

    Blocks are cut into lines, stripped and checked as a whole; only a block that holds
    invalid bytes is looked at line by line.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    source, _ = open_file(path)
    with source:
        head = head_of(source, stop)
        position = lower
        if lower > 0 and not at_line:
            position = _after_newline(source, lower - 1, stop)
        for start, block in _whole_lines(source, position, upper, stop):
            lines = pc.split_pattern(pa.array([block], pa.large_binary()), b"\n")
            lines = lines.flatten()
            lines = lines.slice(0, len(lines) - 1)
            widths = pc.binary_length(lines).to_numpy() + 1
            offsets = start + np.cumsum(widths) - widths
            n = int(np.searchsorted(offsets, upper))
            try:
                values = lines.slice(0, n).cast(pa.large_string())
                values = pc.replace_substring_regex(values, r"\r\z", "").cast(pa.string())
            except pa.ArrowInvalid:
                texts = [shown(line) for line in lines.slice(0, n).to_pylist()]
                values = pa.array(texts, pa.string())
            for at in range(0, n, BATCH_LINES):
                some = values.slice(at, BATCH_LINES)
                columns = [
                    pa.repeat(path, len(some)),
                    pa.array(offsets[at : at + len(some)], pa.int64()),
                    some,
                    pa.repeat(head, len(some)),
                ]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["path", "byte_offset", "value", "head"]
                )


def _whole_lines(source, position: int, upper: int, stop: int):
    """``(byte offset, bytes)`` of runs of whole lines, until one starts past the range."""
    rest: list[bytes] = []
    read_to = position
    while position < upper:
        block = source.read_at(min(CHUNK, stop - read_to), read_to)
        if not block:
            return
        read_to += len(block)
        cut = block.rfind(b"\n") + 1
        if not cut:  # a long line: joined once, when it ends
            rest.append(block)
            continue
        whole = b"".join([*rest, block[:cut]])
        rest = [block[cut:]]
        yield position, whole
        position += len(whole)


class ByteRanges(InputPartition):
    def __init__(self, ranges):
        self.ranges = ranges


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.from_end = options.get("startingposition", "start") == "end"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.tasks = int(options.get("tasks", 1))
        self.skip_missing = options.get("missing", "error") == "skip"
        self.seen = {}
        # Only a query without checkpoint asks for its initial offset.
        self.fresh = False

    def initialOffset(self):
        self.fresh = True
        return self.latestOffset() if self.from_end else {}

    def latestOffset(self):
        def look(path):
            return path, state_of(path, self.seen.get(path))

        with ThreadPoolExecutor(STAT_THREADS) as pool:
            found = dict(pool.map(look, self.paths))
        if not self.fresh and not self.skip_missing:
            lost = [p for p in self.paths if not found[p] and p not in self.seen]
            if lost:
                raise FileNotFoundError(
                    "missing at a restart, and its place would be lost: "
                    f"{lost[0]} ({len(lost)} in all); put it back, leave it out of the "
                    "paths, or set the option missing to skip"
                )
        self.fresh = True
        # A file that is missing right now keeps its last offset.
        self.seen.update({p: state for p, state in found.items() if state})
        return {p: list(state) for p, state in self.seen.items()}

    def partitions(self, start, end):
        packed = pack_ranges(start, end, self.task_bytes, self.tasks)
        return [ByteRanges(ranges) for ranges in packed]

    def read(self, partition):
        for one in partition.ranges:
            yield from read_range(*one)


class TailSource(DataSource):
    """``spark.readStream.format("growing_files")``.

    Options: ``paths`` (JSON list), ``startingPosition`` (start or end),
    ``taskBytes`` (most bytes one task reads), ``tasks`` (tasks wanted per batch),
    ``missing`` (at a restart: error or skip).
    """

    @classmethod
    def name(cls):
        return "growing_files"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return TailReader(self.options)
