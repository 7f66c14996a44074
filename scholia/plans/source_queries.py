"""Files written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.operators.history import numbered_batches
from scholia.plans.registry import query
from scholia.plans.tables import ITEMS, Tables
from scholia.session import working_folder
from scholia.sources import readers, writers

DUMP = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


@query("S1 S7", "SELECT doc_id, md5(text) AS text FROM documents WHERE source = 'src4'")
def dump_round_trip(t: Tables):
    """The bank as a JSON report, one source of it read back."""
    folder = working_folder(t.spark, "dump")
    writers.write_report(t.raw("documents").select("doc_id", "text", "source"), folder)
    return readers.read_dump(t.spark, folder, DUMP, source="src4", array=False).select("doc_id", F.md5("text").alias("text"))


@query("S1 S7", "SELECT doc_id, source, md5(concat(text, '\\\"}],[{\"', source)) AS text FROM documents")
def array_dump_round_trip(t: Tables):
    """The bank written as JSON arrays and read back in splits; every text holds quotes, braces and brackets."""
    folder = working_folder(t.spark, "arrays")
    marked = F.concat("text", F.lit('\\"}],[{"'), "source")
    writers.write_arrays(t.raw("documents").select("doc_id", marked.alias("text"), "source"), folder)
    return readers.read_dump(t.spark, folder, DUMP).select("doc_id", "source", F.md5("text").alias("text"))


@query("S3 S9", "SELECT batch_no, count(*) AS n, 1 AS files FROM (SELECT (row_number() OVER (ORDER BY source, doc_id) - 1) // 100 AS batch_no FROM documents) GROUP BY batch_no")
def batch_files(t: Tables):
    """Review batches written one file each and read back with the file that each row came from."""
    folder = working_folder(t.spark, "batches")
    writers.write_batches(numbered_batches(t.raw("documents").select("doc_id", "source"), ["source", "doc_id"], 100), folder)
    rows = t.spark.read.schema("doc_id long, source string, batch_no long").json(folder).select("*", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("batch_no").agg(F.count("*").alias("n"), F.count_distinct("file").cast("int").alias("files"))


@query("S8 S10", "SELECT user_id, 2 * count(*) AS n FROM events GROUP BY user_id")
def appended_attempts(t: Tables):
    """Attempts appended twice to a fact table."""
    folder = working_folder(t.spark, "facts")
    for _ in range(2):
        writers.append_rows(t.attempts(), folder)
    return t.spark.read.parquet(folder).groupBy("user_id").agg(F.count("*").alias("n"))


@query("S5", f"""WITH {ITEMS} SELECT doc_id AS qnum, upper(trim(answer)) AS answer, md5(stem) AS stem FROM (
  SELECT *, CASE doc_id % 4 WHEN 0 THEN ' ' || lower(stored) || ' ' WHEN 1 THEN stored WHEN 2 THEN 'D' END AS answer FROM items) WHERE stem <> '' AND upper(trim(answer)) IN ('A', 'B', 'C')""")
def flat_cache_items(t: Tables):
    """Items written as a flat cache, where a missing stem is null, read back: those with a stem and a valid letter."""
    folder = working_folder(t.spark, "flat")
    answer = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" "), F.lower("stored"), F.lit(" ")))
              .when(F.col("doc_id") % 4 == 1, F.col("stored")).when(F.col("doc_id") % 4 == 2, F.lit("D")))
    writers.write_report(t.items().select(F.col("doc_id").alias("qnum"), F.nullif("stem", F.lit("")).alias("stem"), answer.alias("correct")), folder)
    cache = t.spark.read.schema("qnum long, stem string, correct string").json(folder)
    return readers.flat_items(cache, answered=True).select("qnum", F.upper(F.trim("correct")).alias("answer"), F.md5("stem").alias("stem"))
