"""Sinks: appended facts, reports, batch files and snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.scalars import percentage


def session_rows(sessions: DataFrame) -> DataFrame:
    """Session facts with their score, ready to append."""
    return sessions.withColumn("score_pct", percentage(F.col("correct_answers"), F.col("total_questions"), 2))


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").parquet(path, partitionBy=partition_by)


def append_database(df: DataFrame, url: str, table: str, batch: int = 500, **options: str) -> None:
    df.write.jdbc(url, table, mode="append", properties={**options, "batchsize": str(batch)})


def write_report(df: DataFrame, path: str) -> None:
    """A JSON report, one object per line, written by all tasks."""
    df.write.mode("overwrite").json(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """A JSON array in each file, written by all tasks; a task without rows writes an empty array."""
    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            lines = []
            for record in batch.column(0).to_pylist():
                lines.append(before + record)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if before == "," else "[]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Write a new snapshot folder and return its path. Readers switch once it is complete, so a failed write loses nothing."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_batches(df: DataFrame, path: str, batch: str = "batch_no") -> None:
    """One folder per batch. Rows of a batch meet in one task first, so a batch is one file."""
    df.repartition(batch).write.mode("overwrite").partitionBy(batch).json(path)


def batch_manifest(df: DataFrame, batch: str, source: str) -> DataFrame:
    """Rows and sources per batch; a batch has a fixed size, so its source list is short."""
    return df.groupBy(batch).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(source)).alias("sources"))
