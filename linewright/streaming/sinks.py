"""Ways to run a stream to the end of what is there now."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import drop_batch, list_dirs


def append_available(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append everything now available to a Parquet folder, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def append_until_idle(stream: DataFrame, folder: str, checkpoint: str) -> int:
    """Append batch after batch until a look finds nothing new; the number of batches."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .start()
    )
    try:
        query.processAllAvailable()
        return sum(1 for p in query.recentProgress if p.numInputRows)
    finally:
        query.stop()


def refresh_available(totals: DataFrame, folder: str, checkpoint: str) -> None:
    """Keep the running totals of a stream in a folder, then stop.

    Each batch is a table of its own, complete once its writer has marked it so, and
    the one before it stays until the next. :func:`read_totals` reads the newest complete
    one, at any moment.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{batch_id}")
        for old in _batches(spark, folder):
            if old < batch_id - 1:
                drop_batch(spark, f"{folder}/batch-{old}")

    query = (
        totals.writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete batches."""
    names = list_dirs(spark, folder, marked="_SUCCESS")
    return sorted(int(n[6:]) for n in names if re.fullmatch("batch-[0-9]+", n))


def read_totals(spark: SparkSession, folder: str) -> DataFrame:
    """The newest complete totals that :func:`refresh_available` keeps."""
    found = _batches(spark, folder)
    if not found:
        raise FileNotFoundError(f"no complete totals in {folder}")
    return spark.read.parquet(f"{folder}/batch-{found[-1]}")
