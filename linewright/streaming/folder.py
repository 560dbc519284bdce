"""A streaming source for a folder of files that grow, with a bound on each batch.

Spark 4.1 tells a source in Python neither how much to take nor where its query stands. So
this one plans its batches itself: each is written, before Spark hears of it, as a numbered
file in a folder of the query's own (``state``), with its byte ranges and the new place of
every file that it takes something from. An offset is that number alone, whatever the
number of files, and a restart goes on from the plans. Rows are those of ``growing_files``.

A batch ends at line ends and takes at most ``batchBytes``, or a single line that is longer.
A plan that was written when the driver died, and that Spark hadn't yet heard of, goes with
the next batch. Files take turns: who was left out, or has waited longest, comes first.

Files join by listing; names that start with ``_`` or ``.`` are left out, as Spark does, and
so are those that the pattern doesn't match. Only files whose size or time changed are
opened. A file that is smaller than before or has other first bytes was replaced and is
read from its start. A file that is gone keeps its place; one that was renamed is a new file.
"""

from __future__ import annotations

import json
import posixpath
import sys
import uuid
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatchcase
from itertools import repeat

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from .tail import (
    LOOKBACK,
    SCHEMA,
    STAT_THREADS,
    TASK_BYTES,
    ByteRanges,
    _after_newline,
    file_system,
    heads_of,
    open_file,
    pack_spans,
    read_range,
    same_file,
)

# Executors need no installed copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# All places are written every so many plans, so that a restart reads few plans.
PLANS_PER_SNAPSHOT = 64
# Plans kept below the last committed one: more than the batches Spark can go back to.
PLANS_KEPT = 128


class Plans:
    """Numbered JSON files of one query: planned batches, and places after some of them."""

    def __init__(self, folder: str):
        self.folder = folder
        self.system, self.inner = file_system(folder.rstrip("/"))
        self.system.create_dir(self.inner, recursive=True)

    def numbers(self, kind: str) -> list[int]:
        from pyarrow import fs

        infos = self.system.get_file_info(fs.FileSelector(self.inner))
        names = [info.base_name for info in infos]
        found = [n for n in names if n.startswith(f"{kind}-") and n.endswith(".json")]
        return sorted(int(n[len(kind) + 1 : -5]) for n in found)

    def read(self, kind: str, number: int) -> dict:
        try:
            with self.system.open_input_stream(self._name(kind, number)) as source:
                return json.loads(source.read())
        except FileNotFoundError as error:
            raise FileNotFoundError(
                f"{kind} {number} is not in {self.folder}: the checkpoint and the state "
                "folder are not of the same query"
            ) from error

    def write(self, kind: str, number: int, content: dict) -> None:
        """All or nothing; a plan that is there already is another query's."""
        from pyarrow import fs

        name = self._name(kind, number)
        if self.system.get_file_info(name).type != fs.FileType.NotFound:
            raise FileExistsError(f"{name}: two queries share the state folder")
        # Not by its start: the listing leaves the file out until it has its name.
        draft = f"{self.inner}/_{uuid.uuid4().hex}"
        with self.system.open_output_stream(draft) as out:
            out.write(json.dumps(content).encode())
        self.system.move(draft, name)

    def forget(self, kind: str, below: int) -> None:
        for number in self.numbers(kind):
            if number < below:
                self.system.delete_file(self._name(kind, number))

    def _name(self, kind: str, number: int) -> str:
        return f"{self.inner}/{kind}-{number:012d}.json"


def list_folder(folder: str, pattern: str) -> dict[str, list]:
    """``[size, modification time]`` of each file below a folder that isn't hidden."""
    from pyarrow import fs

    folder = folder.rstrip("/")
    system, inner = file_system(folder)
    inner = posixpath.normpath(inner)
    selector = fs.FileSelector(inner, allow_not_found=True, recursive=True)
    found = {}
    for info in system.get_file_info(selector):
        below = info.path[len(inner) + 1 :]
        hidden = any(part[0] in "_." for part in below.split("/"))
        if info.type == fs.FileType.File and not hidden:
            if fnmatchcase(info.base_name, pattern):
                found[f"{folder}/{below}"] = [info.size, info.mtime_ns]
    return found


def last_line_end(source, lower: int, upper: int) -> int:
    """Byte after the last LF in ``[lower, upper)``, ``lower`` if there is none."""
    end = upper
    while end > lower:
        start = max(lower, end - LOOKBACK)
        cut = source.read_at(end - start, start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        end = start
    return lower


def next_lines(path: str, old: dict | None, room: int, first: bool) -> dict | None:
    """Whole lines that come next in a file, at most ``room`` bytes; None if it is gone.

    ``old`` is its place so far. ``first`` takes a line that is longer than the room.
    """
    try:
        source, size = open_file(path)
    except FileNotFoundError:
        return None
    with source:
        heads = heads_of(source, size)
        known = old is not None and same_file((old["size"], 0, *old["heads"]), (size, 0, *heads))
        lower = old["done"] if known else 0
        upper = min(size, lower + room)
        stop = last_line_end(source, lower, upper)
        more = upper < size
        if first and stop == lower and more:
            after = _after_newline(source, upper, size)
            if source.read_at(1, after - 1) == b"\n":
                stop, more = after, after < size
            else:
                more = False  # that line isn't finished
    return {"lower": lower, "done": stop, "more": more, "size": size, "heads": list(heads)}


class FolderReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = options["folder"]
        self.state = options["state"]
        self.pattern = options.get("pattern", "*")
        self.batch_bytes = int(options["batchbytes"])
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.tasks = int(options.get("tasks", 1))
        self.skip_missing = options.get("missing", "error") == "skip"
        self.plans = None

    def __getstate__(self):
        # Tasks read ranges; the places of all files stay on the driver.
        return {"skip_missing": self.skip_missing}

    def _load(self) -> None:
        if self.plans is not None:
            return
        plans = Plans(self.state)
        numbers = plans.numbers("plan")
        self.snapshot = max(plans.numbers("places"), default=0)
        self.places = plans.read("places", self.snapshot) if self.snapshot else {}
        self.planned = max(numbers, default=0)
        for number in range(self.snapshot + 1, self.planned + 1):
            self.places |= plans.read("plan", number)["places"]
        self.whole = numbers == list(range(1, self.planned + 1))
        # Places that changed without a line to read, for the next plan to note.
        self.noted = {}
        # Since which plan a file that was never read has been waiting.
        self.waiting = {}
        self.plans = plans

    def initialOffset(self):
        """Asked of a query without checkpoint only: it gets all planned batches again."""
        self._load()
        if not self.whole:
            raise ValueError(
                f"no checkpoint, but {self.state} is of a query that has got far; "
                "give the new query a state folder of its own"
            )
        return {"batch": 0}

    def latestOffset(self):
        self._load()
        ranges, places = self._plan(self.planned + 1)
        self.places |= places
        self.noted |= places
        if ranges:
            self.planned += 1
            plan = {"ranges": ranges, "places": self.noted}
            self.plans.write("plan", self.planned, plan)
            self.noted = {}
            if self.planned - self.snapshot >= PLANS_PER_SNAPSHOT:
                self.plans.write("places", self.planned, self.places)
                self.snapshot = self.planned
        return {"batch": self.planned}

    def _plan(self, number: int) -> tuple[list, dict]:
        """Byte ranges of the next batch, and the places after it of the files looked at."""
        listed = list_folder(self.folder, self.pattern)
        due = {}
        for path, stamp in listed.items():
            place = self.places.get(path)
            if place is None:
                due[path] = self.waiting.setdefault(path, number)
            elif place["stamp"] != stamp or place["more"]:
                due[path] = place["turn"]
        order = sorted(due, key=lambda path: (due[path], path))
        ranges, places, room = [], {}, self.batch_bytes
        with ThreadPoolExecutor(STAT_THREADS) as pool:
            for at in range(0, len(order), STAT_THREADS):
                some = order[at : at + STAT_THREADS]
                old = [self.places.get(path) for path in some]
                looks = pool.map(next_lines, some, old, repeat(room), repeat(not ranges))
                for path, found in zip(some, looks, strict=True):
                    if found is not None and ranges and found["done"] - found["lower"] > room:
                        found = next_lines(path, self.places.get(path), room, False)
                    if found is None:
                        continue
                    lower, taken = found["lower"], found["done"] - found["lower"]
                    if not taken and found["more"]:
                        return ranges, places  # its next line doesn't fit: its turn is next
                    turn = number + 1 if taken else due[path]
                    del found["lower"]
                    places[path] = {**found, "stamp": listed[path], "turn": turn}
                    self.waiting.pop(path, None)
                    if taken:
                        ranges.append([path, lower, lower + taken])
                        room -= taken
                    if room <= 0:
                        return ranges, places
        return ranges, places

    def partitions(self, start, end):
        self._load()
        first, last = start["batch"], end["batch"]
        if first > last:
            raise ValueError(f"the checkpoint is ahead of the plans in {self.state}")
        ranges = []
        for number in range(first + 1, last + 1):
            ranges += self.plans.read("plan", number)["ranges"]
        packed = pack_spans(ranges, self.task_bytes, self.tasks)
        return [ByteRanges(some) for some in packed]

    def read(self, partition):
        for one in partition.ranges:
            try:
                yield from read_range(*one)
            except FileNotFoundError:
                if not self.skip_missing:
                    raise

    def commit(self, end):
        self._load()
        done = min(end["batch"], self.snapshot) - PLANS_KEPT
        if done > 0 and end["batch"] % PLANS_PER_SNAPSHOT == 0:
            self.plans.forget("plan", done)
            self.plans.forget("places", self.snapshot)


class FolderSource(DataSource):
    """``spark.readStream.format("growing_folder")``.

    Options: ``folder``, ``state`` (the query's own folder for its plans), ``pattern`` (of
    file names), ``batchBytes`` (most bytes of one batch), ``taskBytes``, ``tasks`` (as of
    ``growing_files``), ``missing`` (a planned file that is gone: error or skip).
    """

    @classmethod
    def name(cls):
        return "growing_folder"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return FolderReader(self.options)
