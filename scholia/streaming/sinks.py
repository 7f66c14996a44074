"""Idempotent table sink for update-mode streams: one folder per micro-batch, newest row per key on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholia.operators.history import latest_per_key
from scholia.session import working_folder  # noqa: F401


def write_changes(stream: DataFrame, folder: str, mode: str = "update", available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch's changed rows to `folder/rows/batch=N`. A replayed batch overwrites its own folder only."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The table as of the last micro-batch."""
    return latest_per_key(spark.read.parquet(f"{folder}/rows"), keys, ["batch"]).drop("batch")


def compact(spark: SparkSession, folder: str, keys: list[str], into: str) -> None:
    """Write the newest row per key as a new snapshot; the batches stay until readers have switched."""
    read_latest(spark, folder, keys).write.mode("errorifexists").parquet(into)
