"""Session settings, stage tables in the shared folder, and spreading of scans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session at hand."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("scholia")
    settings = {**SETTINGS, "spark.driver.memory": "12g",
                "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def working_folder(spark: SparkSession, kind: str = "stage") -> str:
    """A fresh folder under `spark.checkpoint.dir`. Only a local session without the setting gets one of its own; a cluster
    without it is refused, since a driver-local path would not be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="run-", dir="/tmp") + f"/{kind}"


def stage_table(df: DataFrame, **options: str) -> DataFrame:
    """Write `df` once to the shared folder, with `options` of the writer, and go on from the files.

    This cuts the lineage, survives lost executors and gives later joins real sizes and column pruning. What was shuffled for the files is
    removed when they are there.
    """
    spark, folder = df.sparkSession, working_folder(df.sparkSession)
    kept = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(folder)
    finally:
        spark.conf.unset(CLEAN_UP) if kept is None else spark.conf.set(CLEAN_UP, kept)
    return spark.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over as many partitions as the session's `spark.scholia.scanPartitions` says; unset, scans keep their splits.

    It is for files of one row group, or few small rows, with much work per row, which no split size can divide.
    """
    parts = df.sparkSession.conf.get("spark.scholia.scanPartitions", None)
    return df.repartition(int(parts)) if parts else df
