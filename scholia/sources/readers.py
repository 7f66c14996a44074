"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.sources.arrays import array_records
from scholia.sources.schemas import ITEM

MARKER_TYPES = ["questions", "answers"]


def read_dump(spark: SparkSession, path: str, schema: T.StructType, source: str | None = None, array: bool = True) -> DataFrame:
    """A question dump, malformed records in `_corrupt_record`, optionally one source only.

    Both JSON arrays (a byte order mark is fine) and dumps with one object per line are read in splits. A malformed record of an array
    spoils itself only.
    """
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    if array:
        df = array_records(spark, path).select(F.from_json("record", wide, {"mode": "PERMISSIVE"}).alias("_r")).select("_r.*")
    else:
        df = spark.read.schema(wide).json(path, mode="PERMISSIVE")
    return df if source is None else df.where(F.col("source") == source)


def read_table(spark: SparkSession, path: str, columns: list[str], source: str | None = None) -> DataFrame:
    """Columns of a parquet table; the filter and the column list reach the scan."""
    df = spark.read.parquet(path)
    return (df if source is None else df.where(F.col("source") == source)).select(*columns)


def read_database(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options)


def read_batches(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All result files of a pattern; `file` keeps where each row came from."""
    return spark.read.schema(schema).json(pattern, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def page_items(pages: DataFrame, types: list[str] = MARKER_TYPES) -> DataFrame:
    """One row per item of the wanted page types; null and empty pages give none."""
    rest = [c for c in pages.columns if c != "items"]
    return pages.where(F.col("page_type").isin(types)).select(*rest, F.inline("items"))


def flat_items(items: DataFrame, answered: bool = False) -> DataFrame:
    """Flat cache rows without page markers, optionally only those with a valid letter."""
    rows = items.where(F.col("stem").isNotNull())
    return rows.where(F.upper(F.trim("correct")).isin("A", "B", "C")) if answered else rows


def read_page_cache(spark: SparkSession, pattern: str) -> DataFrame:
    """Nested page caches of many files; items may call their number `n` or `qnum`."""
    raw = read_batches(spark, pattern, T.StructType([
        T.StructField("page_idx", T.IntegerType()), T.StructField("page_type", T.StringType()), T.StructField("topic", T.StringType()),
        T.StructField("items", T.ArrayType(ITEM))]))
    same = F.transform("items", lambda i: i.withField("n", F.coalesce(i["n"], i["qnum"])).dropFields("qnum"))
    return raw.withColumn("items", same)


def note_sections(notes: DataFrame, topic: str) -> DataFrame:
    """Sections of one topic's notes in order: the content, or the body where a section has none."""
    rest = [c for c in notes.columns if c != "sections"]
    return (notes.where(F.col("topic") == topic).select(*rest, F.posexplode("sections").alias("section_no", "_s"))
            .withColumn("text", F.coalesce("_s.content", "_s.body")).drop("_s"))


def note_tips(notes: DataFrame, topic: str) -> DataFrame:
    """Tips of one topic's notes in order: the exam tips, or the key points where there are none."""
    tips = F.when(F.coalesce(F.size("exam_tips"), F.lit(0)) > 0, F.col("exam_tips")).otherwise(F.col("key_points"))
    rest = [c for c in notes.columns if c not in ("exam_tips", "key_points")]
    return notes.where(F.col("topic") == topic).select(*rest, F.posexplode(tips).alias("tip_no", "tip"))
