"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, components of the links.

Equal vectors of a label are folded to one with a count first. A vector lives in the cell of its nearest centroid. Two vectors with
a cosine of at least `t` are at most sqrt(2 - 2t) apart, so if their cells differ, both are that close to the plane between the two
centroids: each vector also visits the higher-numbered cells to whose plane it is that close. Every pair above the bound then meets
exactly once, so the answer is exact and does not depend on the centroids, which only decide how much work it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import components, stage

COSINE = 0.98
CELL_ROWS = 2000  # vectors of a cell on average, until there are CELLS_MOST cells
CELLS_MOST = 2048
SAMPLE = 16_384  # vectors that the centroids are fitted on, in the order of their hash
ROUNDS = 8
BLOCK = 1024


def usable(vector: str = "embedding", label: str = "label"):
    """Has a label and a vector that is not zero and has no null or non-finite component."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Spherical k-means: unit centroids that maximise the cosine to their vectors; a cell that loses all its vectors keeps its centroid."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    centroids = unit[rng.choice(len(unit), size=min(cells, len(unit)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(unit, max(1, len(unit) // 4096))])
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, unit)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def cells_of(unit: np.ndarray, centroids: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) for each vector's home cell and the higher-numbered cells it visits."""
    near = unit @ centroids.T
    home = near.argmax(axis=1)
    gap = near[np.arange(len(unit)), home][:, None] - near
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids @ centroids.T)))
    reach = math.sqrt(2 - 2 * cosine) + 1e-6
    visit = (gap <= reach * apart[home] + 1e-9) & (np.arange(len(centroids)) > home[:, None])
    rows, cells = np.nonzero(visit)
    every = np.arange(len(unit))
    return np.concatenate([every, rows]), np.concatenate([home, cells]), np.concatenate([np.ones(len(unit), bool), np.zeros(len(rows), bool)])


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per input row: `vec_id`, `n_links`, `component_id`, `kept`.

    Vectors are compared when labels are equal and not null and both have as many components. A vector that is null, empty, zero, or has
    null or non-finite components is linked to nothing. Repeated rows are linked to each other. Rows without id take part, are not
    kept, and name no component unless it has no other; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.when(usable(), F.xxhash64("label", "embedding")).alias("key"),
                          F.col("embedding").cast("array<double>").alias("v"), "label")
    keys = stage(rows.select("vec_id", "key"))
    folded = stage(rows.where("key is not null").groupBy("key", "label").agg(
        F.first("v").alias("v"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("width", F.size("v")))
    widths = folded.groupBy("width").count().collect()  # one row for each number of components
    pieces = []
    for w in sorted(widths):
        own = folded.where(F.col("width") == w.width)
        sample = np.array([r.v for r in own.orderBy("key").select("v").limit(SAMPLE).collect()])
        centroids = fit_centroids(sample, max(1, min(CELLS_MOST, len(sample) // 8, -(-w["count"] // CELL_ROWS))))
        pieces.append(_compared(own, spark.sparkContext.broadcast(centroids), cosine))
    none = spark.createDataFrame([], "key long, links long, root long")
    found = none
    for p in pieces:
        found = found.union(p)
    found = stage(found)
    labels = components(stage(found.where("root is not null").select(F.col("key").alias("a"), F.col("root").alias("b"))))
    links = stage(found.groupBy("key").agg(F.sum("links").alias("links")))
    classes = stage(folded.select("key", "first_id", "n").join(labels, F.col("key") == F.col("node"), "left").join(links, "key", "left")
                    .select("key", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                            F.coalesce("label", "key").alias("label")))
    named = stage(classes.groupBy("label").agg(F.min("first_id").alias("component_id")))
    classes = stage(classes.join(named, "label").select("key", "n_links", "component_id"))
    return (keys.join(classes, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def _compared(folded: DataFrame, centroids, cosine: float) -> DataFrame:
    """(key, links, root): links of each vector in each pair of blocks, and the first vector there that its links reach."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = centroids.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                scaled = flat / np.abs(flat).max(axis=1, keepdims=True)
                unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
                row, cell, home = cells_of(unit, middle, cosine)
                take = part.select(["key", "label", "n"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*take.columns, pa.array(cell.astype(np.int32)), pa.array(home),
                     pa.array([u.tobytes() for u in unit[row]], pa.binary())], ["key", "label", "n", "cell", "home", "unit"])

    label_type = dict(folded.dtypes)["label"]
    dealt = stage(folded.select("key", "label", "n", "v")
                  .mapInArrow(assign, f"key long, label {label_type}, n long, cell int, home boolean, unit binary"))
    cell = ["label", "cell"]
    counts = (dealt.groupBy(*cell).agg(F.count_if("home").alias("residents"), F.count_if(~F.col("home")).alias("visitors"))
              .select(*cell, F.ceil(F.col("residents") / BLOCK).cast("int").alias("blocks"),
                      F.ceil(F.col("visitors") / BLOCK).cast("int").alias("visits")).where("blocks > 0"))
    sized = dealt.join(stage(counts), cell).withColumn(
        "block", F.pmod(F.hash("key"), F.when(F.col("home"), F.col("blocks")).otherwise(F.col("visits"))))
    upto = F.sequence(F.lit(0), F.col("blocks") - 1)
    low, high = F.least(F.col("block"), F.col("other")), F.greatest(F.col("block"), F.col("other"))
    # Residents meet every block of residents and every block of visitors; visitors meet every block of residents.
    pairs = (sized.where("home").withColumn("other", F.explode(upto))
             .select(*cell, F.lit(True).alias("inner"), low.alias("i"), high.alias("j"), "block", "home", "key", "n", "unit"))
    hosts = (sized.where("home and visits > 0").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("visits") - 1)))
             .select(*cell, F.lit(False).alias("inner"), F.col("other").alias("i"), F.col("block").alias("j"), "block", "home", "key", "n", "unit"))
    guests = (sized.where("not home").withColumn("other", F.explode(upto))
              .select(*cell, F.lit(False).alias("inner"), F.col("block").alias("i"), F.col("other").alias("j"), "block", "home", "key", "n", "unit"))

    def compare(table: pa.Table) -> pa.Table:
        key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), dtype=np.float64).reshape(len(key), -1)
        inner = table.column("inner")[0].as_py()
        side = (table.column("block").to_numpy() == table.column("i")[0].as_py()) if inner else table.column("home").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        same = inner and not len(right)
        if same:  # one block with itself
            right = left
        linked = unit[left] @ unit[right].T >= cosine
        if same:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(key), dtype=np.int64)
        links[left] = linked @ n[right]
        if not same:
            links[right] = linked.T @ n[left]
        root = np.arange(len(key))
        while True:  # smallest row reachable within the block pair
            new = root.copy()
            if linked.any():
                to_left = np.where(linked, root[right][None, :], len(key)).min(axis=1)
                new[left] = np.minimum(new[left], to_left)
                to_right = np.where(linked, new[left][:, None], len(key)).min(axis=0)
                new[right] = np.minimum(new[right], to_right)
            new = new[new]
            if (new == root).all():
                break
            root = new
        own = links > 0
        return pa.table({"key": key[own], "links": links[own],
                         "root": pa.array(key[root[own]], mask=root[own] == np.flatnonzero(own))})

    return (pairs.union(hosts).union(guests).groupBy(*cell, "inner", "i", "j")
            .applyInArrow(compare, "key long, links long, root long"))
