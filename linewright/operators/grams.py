"""An index of three-byte pieces by block of lines, for substring search.

For every block of ``INDEX_LINES`` lines the index holds which pieces of three bytes its
lower-cased lines have, each hashed to ``GRAM_BITS`` bits: an ordinary table, sorted by
piece. A needle can only be in blocks that hold all of its pieces. Those are found
from the rows of these pieces alone, and their lines are then tested as any search tests
them. Needles of fewer than three bytes have no piece, and search all lines.

A block that is indexed twice, or whose lines have changed since, is a candidate too many at
worst; so the rows of several commits simply lie side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sql
from .ranges import merged_ranges, within
from .search import search_logs

INDEX_LINES = 4096
GRAM_BITS = 18
GRAMS_SCHEMA = "gram int, path string, block bigint"


def _codes(data: np.ndarray) -> np.ndarray:
    """Hash of the three bytes at each place but the last two."""
    wide = data.astype(np.uint32)
    code = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


def gram_index(parsed: DataFrame) -> DataFrame:
    """``gram, path, block`` of some lines, in order of piece.

    Only the pieces of each block are shuffled, dealt by piece, file and block, so that a
    piece every block has is no single key. Where to cut is sampled first, and that goes
    through the lines once more, unless :func:`line_pieces` were stored in between.
    """
    return in_order(line_pieces(parsed))


def in_order(found: DataFrame) -> DataFrame:
    return found.repartitionByRange("gram", "path", "block").sortWithinPartitions(
        "gram", "path", "block"
    )


def line_pieces(parsed: DataFrame) -> DataFrame:
    """``gram, path, block`` of some lines, in no order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column("low").cast(pa.large_string())
            _, offsets, data = low.buffers()
            cuts = np.frombuffer(offsets, np.int64)[low.offset : low.offset + len(low) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            block = batch.column("block").to_numpy()
            path = batch.column("path").dictionary_encode().indices.to_numpy()
            new = np.ones(len(block), dtype=bool)
            new[1:] = (block[1:] != block[:-1]) | (path[1:] != path[:-1])
            heads = np.flatnonzero(new)
            for a, b in zip(heads, np.append(heads[1:], len(block)), strict=True):
                text = raw[cuts[a] : cuts[b]]
                if len(text) < 3:
                    continue
                codes = _codes(text)
                # A piece must not reach from one line into the next.
                inside = np.ones(len(codes) + 2, dtype=bool)
                ends = cuts[a + 1 : b + 1] - cuts[a]
                for back in (1, 2):
                    inside[(ends - back)[ends >= back]] = False
                seen = np.zeros(1 << GRAM_BITS, dtype=bool)
                seen[codes[inside[: len(codes)]]] = True
                found = np.flatnonzero(seen).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found),
                        pa.repeat(batch.column("path")[int(a)], len(found)),
                        pa.repeat(pa.scalar(int(block[a]), pa.int64()), len(found)),
                    ],
                    names=["gram", "path", "block"],
                )

    lines = parsed.selectExpr(
        "path",
        f"CAST((line_number - 1) DIV {INDEX_LINES} AS BIGINT) AS block",
        "lower(coalesce(value, '')) AS low",
    )
    return lines.mapInArrow(pieces, GRAMS_SCHEMA)


def needle_grams(spark: SparkSession, needle: str) -> list[int]:
    """The pieces of a needle, lower-cased by the engine as lines are."""
    low = spark.sql(f"SELECT lower({sql.text(needle)}) AS low").first().low.encode()
    if len(low) < 3:
        return []
    return sorted({int(x) for x in _codes(np.frombuffer(low, dtype=np.uint8))})


def candidate_blocks(index: DataFrame, needle: str) -> DataFrame | None:
    """``path, block`` that may hold a needle; None where all may, for it is too short."""
    grams = needle_grams(index.sparkSession, needle)
    if not grams:
        return None
    held = index.filter(F.col("gram").isin(grams)).select("path", "block", "gram").distinct()
    counts = held.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") == len(grams)).select("path", "block")


def search_indexed(
    parsed: DataFrame,
    index: DataFrame,
    query: str,
    level: str | None = None,
    or_else: str = "false",
) -> DataFrame:
    """As ``search_logs``, reading only blocks that may hold the text.

    ``or_else`` is SQL for lines that the index does not cover.
    """
    blocks = candidate_blocks(index, query)
    if blocks is not None:
        parsed = within(parsed, merged_ranges(blocks, INDEX_LINES), or_else)
    return search_logs(parsed, query, level)
