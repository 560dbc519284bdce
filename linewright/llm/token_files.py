"""Token ids as Parquet files that can be read in part.

One row per document, in ascending ``doc_id`` order over all files:

``doc_id, part, local_start, n_tokens``  metadata, delta encoded
``ids``                                  list column, dictionary encoded

Row groups and pages are small and pages carry an index, so a range of documents
or the metadata alone is read without the other tokens. ``local_start`` counts ids
within the file; :func:`read_starts` adds what the files before it hold.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` comes
first; rows with the same ``doc_id`` are ordered by a hash of their text, equal rows
are all kept; an empty table gives files without rows; other columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import frugal, partitions, steps
from .tokens import END_ID, TOKENIZER, encoder

SCHEMA = "doc_id bigint, part int, local_start bigint, n_tokens int, ids array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str = TOKENIZER,
    tokenizer_dir: str | None = None,
    end_id: int = END_ID,
) -> None:
    """Encode ``doc_id, text`` and write one file per range of ids.

    The texts are dealt by ranges of ``(doc_id, hash of text)`` and encoded where
    they arrive, so the ids themselves are never shuffled.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer, tokenizer_dir)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for a, b in steps(texts):
                offsets, ids = words.encode_ended(texts.slice(a, b - a), end_id)
                rows = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, rows),
                        pa.array(np.full(rows, part, dtype=np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(np.diff(offsets).astype(np.int32)),
                        pa.ListArray.from_arrays(
                            pa.array(offsets.astype(np.int32)), pa.array(ids)
                        ),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    n = partitions(docs.sparkSession)
    ordered = (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(n, "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
    )
    encoded = ordered.mapInArrow(frugal(encode, keeps=True), SCHEMA)
    encoded.write.options(**LAYOUT).parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def read_starts(files: DataFrame) -> DataFrame:
    """``part, base``: ids in the files before each file. Reads two columns only.

    One row per file, so its window and its broadcast are as small as the listing.
    """
    per_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    return per_part.select("part", base)


def id_checksums(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids = np.ascontiguousarray(lists.flatten().to_numpy(), dtype="<u4")
            cuts = lists.offsets.to_numpy()
            cuts = (cuts - cuts[0]).tolist()
            crcs = [
                zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "part", "local_start")),
                    pa.array(np.diff(cuts).astype(np.int64)),
                    pa.array(crcs, type=pa.int64()),
                ],
                names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )

    rows = files.select("doc_id", "part", "local_start", "ids").mapInArrow(
        frugal(sums),
        "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids_crc32 bigint",
    )
    return rows.join(F.broadcast(read_starts(files)), "part").select(
        "doc_id",
        (F.col("base") + F.col("local_start")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
