"""Join of many rows with a per-file or per-split side of unknown size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import fresh_dir

# A side is broadcast only up to this many bytes, measured on its rows.
BROADCAST_BYTES = 64 * 1024 * 1024
# Rough size of one row besides its text.
_ROW_BYTES = 64


def store(side: DataFrame, purpose: str) -> DataFrame:
    """Write a derived side once to the shared folder and read it back.

    It is then computed once, and losing an executor later does not set off its
    whole derivation again.
    """
    return store_measured(side, purpose)[0]


def store_measured(side: DataFrame, purpose: str) -> tuple[DataFrame, int]:
    """As :func:`store`, plus the side's size in bytes, summed up while writing.

    A repeated task can only make the sum too large, never too small.
    """
    spark = side.sparkSession
    folder = fresh_dir(spark, purpose)
    width = F.lit(_ROW_BYTES).cast("bigint")
    for field in side.schema.fields:
        if field.dataType.typeName() == "string":
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    seen = Observation()
    side.observe(seen, F.sum(width).alias("size")).write.parquet(folder)
    stored = spark.read.schema(side.schema).parquet(folder)
    return stored, seen.get["size"] or 0


def attach(
    rows: DataFrame,
    side: DataFrame,
    on: list[str],
    limit: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` with ``side``, which has one row per value of ``on``.

    Below the limit the side is broadcast and ``rows`` do not move. Above it both
    are shuffled, so no value of ``on`` should hold more rows than a task can take.
    """
    side, size = store_measured(side, "side")
    if size <= (BROADCAST_BYTES if limit is None else limit):
        return rows.join(F.broadcast(side), on, how)
    return rows.join(side, on, how)
