"""Near-duplicate detection on SimHash fingerprints by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most two bits exactly when some value is within one bit of both. So every distinct
fingerprint emits itself and its 64 one-bit variants, and those that meet on a variant are linked. All fingerprints that meet on
one variant are within two bits of each other, so each is tied to the smallest of them only: at most 65 fingerprints can meet
there, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import as_bytes, components, keyed_texts, slices, stage

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
BLOCK = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of the lower-cased words of a UTF-8 text; without words 0, below `width` words of the one sequence."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, BLOCK):
        part = words[start:start + BLOCK + width - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        values = [fingerprint(t) for t in as_bytes(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(values, pa.int64())], ["doc_id", "fp"])


def simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `fp`, the fingerprint of the whole text as a signed long. Null and empty texts have fingerprint 0."""
    return keyed_texts(docs, id_col, text_col).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all distinct `fp` at `RADIUS` or fewer differing bits."""
    masks = [0, *(1 << i for i in range(63)), -(1 << 63)]
    # A number of partitions of its own keeps adaptive execution from joining the small partitions before the 65-fold explode.
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (prints.select("fp").repartition(parts, "fp").distinct()
           .select("fp", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
           .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
           .groupBy("variant").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1))
    return (met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a != b").distinct()
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """The documents with all their columns and their fingerprint as the column `name`."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or b"") for t in as_bytes(texts)], pa.int64())

    return docs.withColumn(name, of(text_col))


def _labelled(prints: DataFrame) -> DataFrame:
    """`fp`, `first_id` (smallest id with it) and `label`, which the fingerprints of a component share, of each distinct `fp`."""
    first = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(stage(ball_links(first)))
    return stage(first.join(labels, first.fp == labels.node, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `doc_id`, `fp`, `component_id` (smallest id reachable over links, itself included).

    Null and empty texts share fingerprint 0 and are linked like others; repeated rows stay repeated; rows without id take part
    and give no name to a component (null if none of it has an id). An empty table gives an empty result. Other columns are ignored.
    """
    prints = stage(simhashes(docs, id_col, text_col))
    grouped = _labelled(prints)
    named = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    classes = stage(grouped.join(stage(named), "label").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: one with the smallest id, then the smallest fingerprint, then any of
    its repeated rows. A component without any id keeps one row too; one id under two components keeps one row in each.
    """
    grouped = _labelled(stage(simhashes(docs)))
    least = F.min(F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "fp")).alias("least")
    kept = stage(grouped.groupBy("label").agg(least).select(F.col("least.first_id").alias("kept_id"), F.col("least.fp").alias("kept_fp")))
    own = with_fingerprint(docs.select(*(F.col(c).alias(f"d_{c}") for c in docs.columns))
                           .join(kept, F.col("d_doc_id").eqNullSafe(F.col("kept_id"))), "own_fp", "d_text")
    return (own.where("own_fp = kept_fp").dropDuplicates(["d_doc_id", "kept_fp"])
            .select(*(F.col(f"d_{c}").alias(c) for c in docs.columns)))
