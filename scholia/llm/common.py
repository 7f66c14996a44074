"""What the operators of this subpackage share: staging, batches of whole texts, and components of a graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.session import stage_table

SLICE_BYTES = 2 << 20


def stage(df: DataFrame, *keys: str) -> DataFrame:
    """Write `df` to the shared folder and go on from the files, dealt by `keys` if there are any."""
    return stage_table(df.repartition(*keys) if keys else df)


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only `doc_id` and `text` (null: empty), whatever other columns there are."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `budget` bytes of `column`, or one long value."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            limit = (ends[start - 1] if start else 0) + budget
            end = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def as_bytes(values: pa.Array) -> list[bytes]:
    return values.cast(pa.binary()).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of the undirected graph `edges` (a, b), for all nodes with an edge.

    Each round takes the smallest label among the neighbours and then the label of that label, so that paths halve.
    Labels live in staged tables; only the number of changed labels comes to the driver.
    """
    spark = edges.sparkSession
    links = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct())
    labels = stage(links.groupBy("a").agg(F.min("b").alias("least"))
                   .select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        near = (links.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy("a").agg(F.min("label").alias("near")))
        hooked = stage(labels.join(near, labels.node == near.a)
                       .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        of = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stage(hooked.join(of, "label").select("node", "old", F.col("next").alias("label")))
        labels = jumped.select("node", "label")
        if not jumped.where("old != label").limit(1).count():
            return labels


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], count: str = "n", heavy: int = 1000) -> DataFrame:
    """Inner equi-join of `rows` with the one row that `facts` has for each key; `facts[count]` is the number of rows of that key.

    A key with more than 1/`heavy` of all counted rows is cut into slices of that size: its rows go to one of them by a hash of the
    columns `spread`, its fact to all. Fewer than `heavy` keys can be so frequent, so their broadcast is bounded. Keys must not be null.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    # A total is an integer literal of the plan, so a retried task cuts alike.
    frequent = (facts.where(F.col(count) * heavy > total)
                .select(*(F.col(k).alias(f"_{k}") for k in keys), F.ceil(F.col(count) * heavy / F.lit(max(total, 1))).cast("int").alias("_slices")))
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    named = [f"_{k}" for k in keys]
    salted = (rows.join(F.broadcast(frequent), same, "left")
              .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_slices")).cast("int"), F.lit(0))).drop("_slices", *named))
    copied = (facts.join(F.broadcast(frequent), same, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_slices") - 1, F.lit(0))))).drop("_slices", *named))
    return salted.join(copied, [*keys, "_salt"]).drop("_salt")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with its place 1, 2, 3... in the order of `order`, which must end in something distinct so that ties can be cut anywhere.

    Rows are sorted over ranges; what precedes a range is counted in a table of one row per range.
    """
    at = f"_{name}"
    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    span = F.shiftright(at, 33)
    before = (placed.groupBy(span.alias("_span")).agg(F.count("*").alias("_size"))
              .select("_span", (F.sum("_size").over(Window.orderBy("_span")) - F.col("_size")).alias("_before")))
    return (placed.withColumn("_span", span).join(F.broadcast(before), "_span")
            .withColumn(name, F.col("_before") + F.col(at) % (1 << 33) + 1).drop(at, "_span", "_before"))
