"""Harmonic packing of token ids into sequences of fixed capacity.

A piece of ``r`` tokens belongs to class ``k = capacity div r``: ``k`` such pieces
always fit one sequence, so a class fills its sequences with ``k`` pieces each and
no piece needs to know another. Documents may be cut: whole capacities first, and a
rest that would leave its class's sequences more than ``SLACK`` empty gives up a
piece of exactly the next class's size, until what is left fits its class well.

Every task numbers the pieces of each class by itself; the counts of the tasks
before it are added later, and rank div k is the sequence. Less than ``k`` pieces
per class stay over: a number set by the capacity alone, packed by first-fit
decreasing together.

Defined cases: a null or empty text is the end id alone; repeated rows are packed
each; a null ``doc_id`` stays null; an empty table gives no rows; other columns are
not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.lookup import attach
from .common import STEP_BYTES, frugal, staged, steps
from .tokens import CACHE_WORDS, END_ID, TOKENIZER, encoder

CAPACITY = 4096
# Share of a sequence that a class may leave empty before a rest is cut again.
SLACK = 0.03

PIECES = (
    "doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, "
    "per_sequence int, part int, local_rank bigint"
)


@cache
def cut_rest(rest: int, capacity: int = CAPACITY) -> tuple[int, ...]:
    """Lengths of the pieces of a rest shorter than the capacity."""
    pieces = []
    while rest:
        k = capacity // rest
        if capacity - k * rest <= SLACK * capacity or rest == 1:
            pieces.append(rest)
            break
        pieces.append(capacity // (k + 1))
        rest -= pieces[-1]
    return tuple(pieces)


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    full, rest = divmod(length, capacity)
    return [capacity] * full + list(cut_rest(rest, capacity))


def cut_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    tokenizer_dir: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = False,
    encoder_words: int = CACHE_WORDS,
    encoder_bytes: int = STEP_BYTES,
) -> DataFrame:
    """One row per piece, with its class and its number within class and task.

    ``with_ids`` adds the ids themselves. The rows are stored: a piece keeps its
    number even if executors are lost afterwards. ``encoder_words`` and ``encoder_bytes``
    bound what a worker remembers and takes at once: less memory for more time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, tokenizer_dir, encoder_words)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for a, b in steps(batch.column("text"), encoder_bytes):
                offsets, ids = words.encode_ended(
                    batch.column("text").slice(a, b - a), end_id
                )
                plain = np.ascontiguousarray(ids, dtype="<u4")
                doc, start, length, crc, rank = [], [], [], [], []
                for i in range(b - a):
                    at, first = int(offsets[i]), int(offsets[i])
                    for n in cut(int(offsets[i + 1]) - first, capacity):
                        k = capacity // n
                        doc.append(i)
                        start.append(at - first)
                        length.append(n)
                        crc.append(zlib.crc32(plain[at : at + n]))
                        rank.append(seen[k])
                        seen[k] += 1
                        at += n
                doc = np.array(doc, dtype=np.int64)
                length = np.array(length, dtype=np.int32)
                columns = {
                    "doc_id": batch.column("doc_id").slice(a, b - a).take(pa.array(doc)),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(np.diff(offsets)[doc]),
                    "per_sequence": pa.array((capacity // length).astype(np.int32)),
                    "part": pa.array(np.full(len(doc), part, dtype=np.int32)),
                    "local_rank": pa.array(rank, pa.int64()),
                }
                if with_ids:
                    cuts = np.zeros(len(length) + 1, dtype=np.int32)
                    np.cumsum(length, out=cuts[1:])
                    columns["ids"] = pa.ListArray.from_arrays(
                        pa.array(cuts), pa.array(ids)
                    )
                yield pa.RecordBatch.from_pydict(columns)

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return staged(texts.mapInArrow(frugal(pieces, keeps=True), schema), "pieces")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset`` within the sequence."""
    counts = pieces.groupBy("part", "per_sequence").agg(F.count(F.lit(1)).alias("n"))
    counts = staged(counts, "piece-counts")
    # One row per class: at most twice the square root of the capacity.
    totals = counts.groupBy("per_sequence").agg(F.sum("n").alias("n")).collect()
    full, base = [], 0
    for row in sorted(totals):
        full.append((row.per_sequence, row.n // row.per_sequence, base))
        base += row.n // row.per_sequence
    classes = pieces.sparkSession.createDataFrame(
        full, "per_sequence int, sequences bigint, first_sequence bigint"
    )
    before = (
        Window.partitionBy("per_sequence")
        .orderBy("part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counts.select(
        "part",
        "per_sequence",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"),
    )
    ranked = (
        attach(pieces, shifts, ["part", "per_sequence"])
        .join(F.broadcast(classes), "per_sequence")
        .withColumn("rank", F.col("local_rank") + F.col("shift"))
        .withColumn(
            "sequence_id",
            F.col("first_sequence") + F.expr("rank DIV per_sequence"),
        )
        .withColumn("_over", F.expr("rank >= sequences * per_sequence"))
    )
    names = [*pieces.columns, "sequence_id", "offset"]
    order = Window.partitionBy("sequence_id").orderBy("rank")
    offset = F.coalesce(
        F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    ).cast("bigint")
    placed = ranked.filter("NOT _over").withColumn("offset", offset).select(*names)

    def first_fit(rest: pd.DataFrame) -> pd.DataFrame:
        rest = rest.sort_values(["length", "part", "local_rank"])[::-1]
        room = np.zeros(0, dtype=np.int64)
        sequence, offset = [], []
        for n in rest["length"]:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                room = np.append(room, capacity)
                fits = [len(room) - 1]
            sequence.append(base + int(fits[0]))
            offset.append(capacity - int(room[fits[0]]))
            room[fits[0]] -= n
        return rest.assign(sequence_id=sequence, offset=offset)[
            ["part", "per_sequence", "local_rank", "sequence_id", "offset"]
        ]

    keys = ["part", "per_sequence", "local_rank"]
    over = ranked.filter("_over").drop("sequence_id")
    # Fewer pieces than classes hold together, whatever the input: one task.
    fitted = (
        over.select(*keys, "length")
        .groupBy()
        .applyInPandas(
            first_fit,
            "part int, per_sequence int, local_rank bigint, sequence_id bigint, "
            "offset bigint",
        )
    )
    return placed.unionByName(over.join(F.broadcast(fitted), keys).select(*names))


def sequences(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, ids, n_tokens, n_padded``: the packed ids, for pieces with ids.

    ``n_padded`` is the length a trainer pads to: the capacity, or the sequence's own
    length where that is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = placed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"),
        F.sum("length").alias("n_tokens"),
    )
    power = F.expr("bit_count(n_tokens) = 1")
    return whole.withColumn(
        "n_padded", F.when(power, F.col("n_tokens")).otherwise(F.lit(capacity))
    )


def pack(docs: DataFrame, **options) -> DataFrame:
    """Where every id of every document lies: one row per piece."""
    capacity = options.get("capacity", CAPACITY)
    return place(cut_documents(docs, **options), capacity).select(
        "doc_id",
        "start",
        F.col("length").cast("bigint").alias("length"),
        "ids_crc32",
        "doc_tokens",
        "sequence_id",
        "offset",
    )
