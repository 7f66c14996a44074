"""Records of large JSON arrays, read in splits.

A file is read as text whose lines end at closing braces, so that Spark splits it anywhere. Whether a brace lies in a string, and how
deep, depends on all that precedes it; but what a split does to that state is known without it: it turns the state of strings over or
not, and adds to the depth one number if it begins outside of a string and another if inside. These effects, one row a split, are summed
up along the file; then each split cuts its records, and only records that cross splits are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ESCAPED = re.compile(r"\\.", re.DOTALL)
BATCH_CHARS = 4 << 20


def effect(piece: str, inside: int, closes: bool = True) -> tuple[int, int]:
    """Whether a piece that begins inside of a string ends there, and its change of depth; a brace follows it if it `closes`."""
    runs = (ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    outside = "".join(runs[inside::2])
    after = (inside + len(runs) - 1) % 2
    return after, outside.count("{") + outside.count("[") - outside.count("]") - (closes and not after)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, turns, outside, inside): what each split does to the state. Pieces of a split come together and in order."""
    sums: dict[tuple[int, int], list[int]] = {}
    for batch in batches:
        for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
            own = sums.setdefault((file, start), [0, 0, 0])
            turned, begun_outside = effect(value, own[0])
            _, begun_inside = effect(value, 1 - own[0])
            own[:] = turned, own[1] + begun_outside, own[2] + begun_inside
    rows = [(*key, *own) for key, own in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)],
                                     ["file", "start", "turns", "outside", "inside"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool]]:
    """Each piece, and whether it is the last of its split."""
    held = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held is not None:
                yield held, held[:2] != row[:2]
            held = row
    if held is not None:
        yield held, True


def _cutter(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(file, start, opens, text): the whole records of each split, or else what it has of records that cross its bounds; `opens` is 1
    where a record begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held = 0
        parts: list[str] | None = None
        inside = depth = opens = 0
        for (file, start, value, inside_before, depth_before, last), ends in _with_end(batches):
            if inside_before is None:
                raise ValueError("the splits of a dump changed while it was read")
            if parts is None:
                parts, inside, depth = [], inside_before, depth_before
                opens = int(not inside and depth <= 1)
            closes = not (ends and last)  # what follows the last brace of an array is no record
            inside, step = effect(value, inside, closes)
            depth += step
            parts.append(value + "}" if closes else value)
            done = closes and not inside and depth == 1
            if done or ends:
                if (done and opens == 1) == whole:
                    found.append((file, start, opens, "".join(parts)))
                    held += len(found[-1][3])
                parts, opens = [], 1
            if ends:
                parts = None
            if held >= BATCH_CHARS:
                yield _rows(found)
                found, held = [], 0
        yield _rows(found)

    return run


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = {"file": pa.int64(), "start": pa.int64(), "opens": pa.int32(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds.values())], list(kinds))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """One row (`record`) for each object of the JSON arrays in the files of `path`.

    Arrays of objects are expected: other elements stay before the next object, which makes that record malformed. An array without its
    end keeps its unfinished rest as a malformed record; where brackets do not match, the rest of the file is one. Empty arrays and files
    have no record.

    Text is scanned three times (effects, whole records, cut records) and not shuffled. What is broadcast has one row a split.
    """
    pieces = spark.read.text(path, lineSep="}").select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    effects = pieces.mapInArrow(_effects, "file long, start long, turns long, outside long, inside long")
    along = Window.partitionBy("file").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    spans = (effects.withColumn("inside_before", F.coalesce(F.sum("turns").over(before), nothing) % 2)
             .withColumn("step", F.when(F.col("inside_before") == 1, F.col("inside")).otherwise(F.col("outside")))
             .select("file", "start", "inside_before", F.coalesce(F.sum("step").over(before), nothing).alias("depth_before"),
                     F.lead("start").over(along).isNull().alias("last")))
    placed = (pieces.join(F.broadcast(spans), ["file", "start"], "left")
              .select("file", "start", "value", "inside_before", "depth_before", "last"))
    kind = "file long, start long, opens int, text string"
    # Few rows, at most two a split: what it has of the record before its first whole one and after its last.
    cut = (placed.mapInArrow(_cutter(False), kind)
           .withColumn("record", F.sum("opens").over(Window.partitionBy("file").orderBy("start", "opens")))
           .groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "opens", "text"))),
                                                                   lambda p: p["text"]), "").alias("text")))
    bare = F.regexp_replace("text", r"^\x{FEFF}?\s*[\[,]?\s*", "")
    return (placed.mapInArrow(_cutter(True), kind).select("text").unionByName(cut.select("text"))
            .select(bare.alias("record")).where(~F.col("record").rlike(r"^\s*\]?\s*$")))
