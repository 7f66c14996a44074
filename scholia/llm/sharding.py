"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

The items that are packed are groups of equal texts. Groups with a noticeable part of any total are items of their own; the rest are
hashed into a fixed number of bundles, some coarse and some fine as sand, so the number of items has a bound that does not depend
on the data. Items go, largest first, to the shard where the dot product of their vector with its residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import keyed_texts, stage

SHARDS = 40
ROW_OVERHEAD = 16
COARSE, FINE = 2048, 8192
FINE_SHARE = 16  # one in so many groups is sand
LARGE = 4096  # a group with more than this part of a total is an item of its own
SLOT_ROWS = 100_000  # rows that are numbered together, on average
MEASURES = ("size", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """Shard of each item; `vectors` has a row for each item and a column for each measure.

    Largest part of any total first, ties in the order given. The residual may go below zero once shards are full; the dot product then
    finds the least overfull.
    """
    totals = vectors.sum(axis=0)
    parts = vectors / np.where(totals > 0, totals / shards, 1)
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-parts.max(axis=1), kind="stable"):
        best = int(np.argmax(residual @ parts[i]))
        out[i] = best
        residual[best] -= parts[i]
    return out


def pieces_of_group(parts: np.ndarray, shards: int = SHARDS) -> int:
    """Pieces that a group is cut into: 1 unless it alone is larger than a shard, then such as fill at most a quarter."""
    most = float(parts.max()) * shards
    return 1 if most <= 1 else int(np.ceil(4 * most))


def shards_of(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `doc_id`, `size` (bytes of the text plus 16), `text_crc32`, `tokens` (words), `shard`, `slot`.

    Equal texts share a shard, except a group larger than a whole shard, which is cut by a number of the row into pieces that are packed each for itself.
    Slots number the rows of a shard from 0 without gaps. Null texts have no bytes and are a group with the empty ones.
    Rows without id and repeated rows count like others; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text")
    rows = stage(keyed_texts(docs, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("digest"),
        F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("tokens")))
    groups = stage(rows.groupBy("digest", "text_crc32").agg(
        F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total = groups.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES)).first()
    limits = [max(1, total[m]) / LARGE for m in MEASURES]
    large = F.lit(False)
    for m, limit in zip(MEASURES, limits):
        large |= F.col(m) > limit
    # At most LARGE groups pass in each measure.
    big = sorted(groups.where(large).select("digest", "text_crc32", *MEASURES).collect())
    bundle = _bundle()
    small = sorted(groups.where(~large).groupBy(bundle.alias("bundle")).agg(*(F.sum(m).alias(m) for m in MEASURES)).collect())
    names, vectors = [], []
    whole = np.array([max(1, total[m]) for m in MEASURES], dtype=float)
    for g in big:
        vector = np.array([g[m] for m in MEASURES], dtype=float)
        pieces = pieces_of_group(vector / whole, shards)
        names += [("g", g.digest, g.text_crc32, k, pieces) for k in range(pieces)]
        vectors += [vector / pieces] * pieces
    for b in small:
        names.append(("b", b.bundle, 0, 0, 1))
        vectors.append(np.array([b[m] for m in MEASURES], dtype=float))
    placed = pack(np.array(vectors), shards).tolist() if vectors else []
    items = [(*name, shard) for name, shard in zip(names, placed)]
    # Both tables are as small as the number of items.
    own = spark.createDataFrame([i[1:] for i in items if i[0] == "g"],
                                "digest long, text_crc32 long, piece int, pieces int, own_shard int")
    cut = own.select("digest", "text_crc32", "pieces").distinct()
    bundles = spark.createDataFrame([(i[1], i[5]) for i in items if i[0] == "b"], "bundle int, bundle_shard int")
    dealt = (rows.join(F.broadcast(cut), ["digest", "text_crc32"], "left")
             .withColumn("piece", F.pmod(F.xxhash64("row", F.lit(1)), F.col("pieces")).cast("int")).withColumn("bundle", bundle)
             .join(F.broadcast(own.drop("pieces")), ["digest", "text_crc32", "piece"], "left")
             .join(F.broadcast(bundles), "bundle", "left")
             .select("doc_id", "row", "size", "text_crc32", "tokens", F.coalesce("own_shard", "bundle_shard").alias("shard")))
    return with_slots(dealt, int(total["rows"]), shards)


def _bundle() -> Column:
    """Bundle of a small group: one in `FINE_SHARE` goes to the fine ones, which stand behind the coarse ones."""
    spread = F.pmod(F.xxhash64("digest", "text_crc32"), F.lit(FINE_SHARE * COARSE * FINE))
    fine = spread % FINE_SHARE == 0
    spread = (spread / FINE_SHARE).cast("long")
    return F.when(fine, COARSE + spread % FINE).otherwise(spread % COARSE).cast("int")


def with_slots(dealt: DataFrame, rows: int, shards: int = SHARDS) -> DataFrame:
    """`slot` of each row in its shard. Rows of a shard are numbered in parts, whose number grows with the rows; the starts of
    the parts come from their counts."""
    from pyspark.sql import Window

    parts = max(16, -(-rows // (SLOT_ROWS * shards)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "part").orderBy("row")
    numbered = dealt.withColumn("at", F.row_number().over(within) - 1)
    return (numbered.join(starts, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "tokens", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot")))
