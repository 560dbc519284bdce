"""Helpers the operators share: staging, partitions, whole-batch word offsets."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.lookup import BROADCAST_BYTES, store
from ..session import fresh_dir

# Bytes of text handled at once inside a task; a longer text is one step by itself.
STEP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Share of the driver's largest heap from which on a stored table has garbage collected.
HEAP_SHARE = 0.5
# What a row of a broadcast side takes on the driver besides its values, as measured.
_ENTRY_BYTES = 84


def staged(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a derived table once to the shared folder and read it back."""
    stored = store(frame, f"llm-{purpose}")
    relieve_driver(frame.sparkSession)
    return stored


def relieve_driver(spark: SparkSession) -> None:
    """Have the driver let go of what finished jobs left, once its heap has grown.

    Spark drops a job's broadcasts and shuffle files when the driver's garbage is
    collected, and a heap that grew under many short jobs only shrinks then. A stage is a
    hundred jobs whose live data is small, so the heap would else go to its limit.
    """
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        # What Python still names can't go over there.
        gc.collect()
        spark._jvm.java.lang.System.gc()


def relieve_executors(spark: SparkSession) -> None:
    """Have the executors' JVMs return the heap that finished work left.

    A heap that grew under one stage's shuffles stays grown while the next one's Python
    workers need the memory beside it. One task a core, which idle executors are dealt in
    turns, has garbage collected, and the heap shrinks to what is live and some room.
    """
    cores = spark.sparkContext.defaultParallelism
    collected = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    rows = spark.range(0, cores, 1, cores).select(collected.alias("collected"))
    rows.write.format("noop").mode("overwrite").save()


def partitions(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: what the session sets for its shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# What a worker keeps from task to task, while they are of one kind.
_kept: dict = {}


def kept(key: tuple, make: Callable):
    """The worker's object of this key, made by its first task of this kind."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    _kept.clear()


def frugal(work: Callable, keeps: bool = False) -> Callable:
    """A task's work that gives its memory back when it is done.

    Python workers outlive their tasks; what the allocators keep for later would count
    against the executor all the while. Only work that ``keeps`` leaves what :func:`kept`
    made for the next task, and the next one of another kind drops that first.
    """

    def run(batches: Iterator) -> Iterator:
        if not keeps:
            drop_kept()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return what the allocators hold for later to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``offsets, bytes`` of a string array; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int64)[
        texts.offset : texts.offset + len(texts) + 1
    ]
    if data is None or cuts[-1] == cuts[0]:
        return np.zeros(len(texts) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    raw = np.frombuffer(data, dtype=np.uint8)[cuts[0] : cuts[-1]]
    return cuts - cuts[0], raw


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[a, b)`` of at most ``limit`` bytes of text, or a single text."""
    offsets, _ = text_buffers(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Word offsets of a whole batch of texts.

    Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. They are laid out
    anew joined by one space: ``data`` holds all texts so normalised, word ``i`` is
    ``data[start[i]:end[i]]`` and text ``d`` has the words ``first[d]`` to
    ``first[d + 1]``. Words of one text are one byte apart, so a run of them is one slice.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        offsets, raw = text_buffers(texts)
        inside = ~_SPACE[raw]
        before = np.zeros(len(raw), dtype=bool)
        before[1:] = inside[:-1]
        # A text's first byte starts a word even if the text before ends in one.
        heads = offsets[:-1][offsets[:-1] < len(raw)]
        before[heads] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(raw), dtype=bool)
        after[:-1] = inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        after[tails] = False
        ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(starts, offsets, side="left")
        # One byte of space after each word: the copy keeps inside bytes plus that one.
        lengths = ends - starts
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        data = np.full(int(lengths.sum()) + len(lengths), 0x20, dtype=np.uint8)
        keep = np.ones(len(data), dtype=bool)
        keep[self.end] = False
        data[keep] = raw[inside]
        if lower:
            upper = (data >= 0x41) & (data <= 0x5A)
            data[upper] += 0x20
        self.data = data

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal in every batch and process."""
        powers = _powers(len(self.data) + 1)
        value = (self.data.astype(np.uint64) + np.uint64(1)) * powers[:-1]
        sums = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(value, out=sums[1:])
        # Dividing by the start's power makes a word's value independent of its place.
        inverse = _powers(len(self.data) + 1, True)
        code = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mix(code ^ (self.end - self.start).astype(np.uint64))


_BASE = 0x9E3779B97F4A7C15
_tables: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    known = _tables.get(inverse)
    if known is None or len(known) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        known = np.full(max(n, 1 << 20), np.uint64(base), dtype=np.uint64)
        known[0] = 1
        _tables[inverse] = known = np.cumprod(known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def join_side(
    rows: DataFrame, side: DataFrame, on: list[str], how: str, bytes_each: str, name: str
) -> DataFrame:
    """Join with a derived side of unknown size, stored and measured first.

    ``bytes_each`` is SQL for the bytes of one row's values of the side. Up to
    ``BROADCAST_BYTES`` the side is broadcast and ``rows`` stay where they are; beyond,
    both are shuffled on the key, where adaptive execution can split a hot one.
    """
    spark = rows.sparkSession
    folder, seen = fresh_dir(spark, f"llm-{name}"), Observation()
    size = F.sum(F.expr(f"CAST({bytes_each} + {_ENTRY_BYTES} AS BIGINT)")).alias("size")
    side.observe(seen, size).write.parquet(folder)
    relieve_driver(spark)
    stored = spark.read.schema(side.schema).parquet(folder)
    if (seen.get["size"] or 0) <= BROADCAST_BYTES:
        stored = F.broadcast(stored)
    else:
        stored = stored.hint("shuffle_merge")
    return rows.join(stored, on, how)


class Aside:
    """The columns a stage doesn't look at, under names that its own can't clash with."""

    def __init__(self, docs: DataFrame, known: tuple[str, ...]):
        self.names = docs.columns
        self.inner = [
            name if name in known else f"other_{i}" for i, name in enumerate(self.names)
        ]
        self.docs = docs.toDF(*self.inner)

    def back(self, rows: DataFrame) -> DataFrame:
        """The rows with the table's own columns only, by their names."""
        return rows.select(*self.inner).toDF(*self.names)


class KeySet:
    """Which 64-bit keys may be in a side, in sixteen bits a key: a Bloom filter.

    It decides before a shuffle which rows can have a partner at all, so that the texts
    of the others stay where they are. The answer "may be" is wrong for about one key in
    seventy, so a join still follows. The bits are bounded by ``BROADCAST_BYTES``; a
    larger side has no filter (``bits`` is None) and every row "may be" in it.
    """

    def __init__(self, side: DataFrame, key: str):
        keys = side.selectExpr(f"CAST({key} AS BIGINT) AS k").filter("k IS NOT NULL")
        width = max(16 * keys.count(), 1024).bit_length()
        self.bits = None
        self.mask = np.uint64((1 << width) - 1)
        if (1 << width) // 8 > BROADCAST_BYTES:
            return
        places = f"explode(array(k & {int(self.mask)}L, shiftrightunsigned(k, 32) & {int(self.mask)}L))"
        words = (
            keys.selectExpr("xxhash64(k) AS k")
            .selectExpr(f"{places} AS i")
            .groupBy(F.expr("shiftright(i, 6)").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(i & 63 AS INT)))").alias("bits"))
            .toArrow()
        )
        self.bits = np.zeros((1 << width) // 64 + 1, dtype=np.uint64)
        self.bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For Spark's ``xxhash64(key)`` of some keys, whether they may be in the side."""
        if self.bits is None:
            return np.ones(len(hashes), dtype=bool)
        x = hashes.view(np.uint64)
        found = np.ones(len(x), dtype=bool)
        for i in (x & self.mask, (x >> np.uint64(32)) & self.mask):
            word = self.bits[(i >> np.uint64(6)).astype(np.int64)]
            found &= (word >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

    def among(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be in the side."""
        if self.bits is None:
            return rows

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = self.holds(batch.column("_key_hash").to_numpy())
                if held.any():
                    yield batch.drop_columns(["_key_hash"]).filter(pa.array(held))

        hashed = rows.withColumn("_key_hash", F.expr(f"xxhash64(CAST({key} AS BIGINT))"))
        return hashed.mapInArrow(frugal(keep), rows.schema)
