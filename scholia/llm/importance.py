"""Importance resampling towards a target distribution, with counting by segments.

Newlines separate words, so they cut a text into lines. The features (bucketed word n-grams) of each distinct line of the corpus are
counted once and multiplied by how often the line occurs; n-grams that run over the end of a line are counted apart. A document's weight
is the mean log ratio of target to corpus over its features, and documents are drawn by weight plus Gumbel noise of their id.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import as_bytes, keyed_texts, numbered, salted_join, slices, stage

NGRAMS = 1
BUCKETS = 10_000
MIN_WORDS = 20
SHARE_PERCENT = 10
SEED = 2024
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # on UTF-8, so no piece of a code point is cut off


def words_of(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z only (`bytes.lower` leaves other letters)."""
    return WORD.findall(text.lower())


def line_features(words: list[bytes], ngrams: int, buckets: int, memo: dict[bytes, int]) -> list[int]:
    """Buckets of all runs of 1 to `ngrams` words of one line; `memo` keeps those of single words."""
    found = []
    for w in words:
        b = memo.get(w)
        if b is None:
            b = memo[w] = zlib.crc32(w) % buckets
        found.append(b)
    for size in range(2, ngrams + 1):
        found += [zlib.crc32(b" ".join(words[i:i + size])) % buckets for i in range(len(words) - size + 1)]
    return found


def cross_features(lines: list[list[bytes]], ngrams: int, buckets: int) -> list[int]:
    """Buckets of the runs of 2 to `ngrams` words that lie in more than one line."""
    lines = [line for line in lines if line]
    if ngrams < 2 or len(lines) < 2:
        return []
    words = [w for line in lines for w in line]
    found, end = [], 0
    ends = []
    for line in lines[:-1]:
        end += len(line)
        ends.append(end)
    for size in range(2, ngrams + 1):
        done = 0  # runs over several line ends count once
        for end in ends:
            for start in range(max(done, end - size + 1, 0), min(end, len(words) - size + 1)):
                found.append(zlib.crc32(b" ".join(words[start:start + size])) % buckets)
            done = max(done, end)
    return found


def _line_key(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _packed(buckets: int) -> np.dtype:
    return np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")


def documents_by_line(docs: DataFrame, ngrams: int, buckets: int) -> DataFrame:
    """Staged `row`, `doc_id`, `lines` (key of each line, in order) and `crossing` (packed buckets of n-grams over line ends)."""
    kind = _packed(buckets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.split(b"\n") for t in as_bytes(part.column("text"))]
            lines = pa.array([[_line_key(x) for x in t] for t in texts], pa.list_(pa.binary()))
            crossing = [np.array(cross_features([words_of(x) for x in t], ngrams, buckets) if ngrams > 1 else [], kind).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), lines, pa.array(crossing, pa.binary())],
                                             ["row", "doc_id", "lines", "crossing"])

    keyed = keyed_texts(docs).withColumn("row", F.monotonically_increasing_id())
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return stage(keyed.mapInArrow(cut, f"row long, doc_id {id_type}, lines array<binary>, crossing binary"))


def distinct_lines(docs: DataFrame, ngrams: int, buckets: int) -> DataFrame:
    """Staged, one row per distinct line: `line` (key), `n` (occurrences in all documents), `words`, `found` (packed buckets)."""
    kind = _packed(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines, memo = as_bytes(part.column("text")), {}
            split = [words_of(x) for x in lines]
            found = [np.array(line_features(w, ngrams, buckets, memo), kind).tobytes() for w in split]
            yield pa.RecordBatch.from_arrays([pa.array(map(_line_key, lines), pa.binary()), part.column("n"),
                                              pa.array(map(len, split), pa.int64()), pa.array(found, pa.binary())],
                                             ["line", "n", "words", "found"])

    lines = keyed_texts(docs).select(F.explode(F.split("text", "\n")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    return stage(lines.mapInArrow(count, "line binary, n long, words long, found binary"))


def bucket_counts(lines: DataFrame, documents: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: the counts of distinct lines times their occurrences, and the crossing n-grams."""
    kind = _packed(buckets)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for part in slices(batches, "found"):
            held = as_bytes(part.column("found"))
            times = np.repeat(part.column("n").to_numpy(), [len(x) // kind.itemsize for x in held])
            np.add.at(sums, np.frombuffer(b"".join(held), kind), times)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], ["bucket", "n"])

    counted = lines.select("n", "found").union(documents.select(F.lit(1).cast("long"), "crossing").where(F.octet_length("crossing") > 0))
    sums = np.zeros(buckets, np.int64)
    for bucket, n in counted.mapInArrow(total, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # one row per bucket
        sums[bucket] = n
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    buckets, every, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (every + buckets) / ((float(s) + 1) * (wanted + buckets))))
                     for s, t in zip(corpus, target)], np.int64)


def _gain_sums(df: DataFrame, value: np.ndarray, packed: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, `features` (number) and `gain` (sum) of each row's packed buckets."""
    kind = _packed(len(value))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, packed):
            held = [np.frombuffer(x, kind) for x in as_bytes(part.column(packed))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(map(len, held), pa.int64()),
                                              pa.array([int(value[x].sum()) for x in held], pa.int64())], [*keep, "features", "gain"])

    kept = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, packed).mapInArrow(add, f"{kept}, features long, gain long")


def floor_mean(total: Column, n: Column) -> Column:
    """The mean rounded down, in integers; 0 of none."""
    return F.when(n > 0, ((total - F.pmod(total, n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def gumbel(id_col: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) of a uniform number that the id decides; a null id counts as empty text."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform)))


def weights(docs: DataFrame, target: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """`row`, `doc_id`, `n_words`, `n_features` and `weight` of every document of `docs` against the texts of `target`."""
    documents, lines = documents_by_line(docs, ngrams, buckets), distinct_lines(docs, ngrams, buckets)
    wanted = target.select(F.lit(0).cast("long").alias("doc_id"), "text")
    wanted_counts = bucket_counts(distinct_lines(wanted, ngrams, buckets), documents_by_line(wanted, ngrams, buckets), buckets)
    value = gains(bucket_counts(lines, documents, buckets), wanted_counts)
    of_line = stage(_gain_sums(lines, value, "found", ["line", "n", "words"]))
    parts = documents.select("row", F.posexplode("lines").alias("place", "line"))
    joined = salted_join(parts, of_line, ["line"], ["row", "place"]).select("row", "words", "features", "gain")
    crossing = (_gain_sums(documents.where(F.octet_length("crossing") > 0), value, "crossing", ["row"])
                .select("row", F.lit(0).cast("long").alias("words"), "features", "gain"))
    sums = (joined.union(crossing) if ngrams > 1 else joined).groupBy("row").agg(
        F.sum("words").alias("n_words"), F.sum("features").alias("n_features"), F.sum("gain").alias("gain"))
    return documents.select("row", "doc_id").join(sums, "row").select(
        "row", "doc_id", "n_words", "n_features", floor_mean(F.col("gain"), F.col("n_features")).alias("weight"))


def resample(docs: DataFrame, target: DataFrame, share_percent: int = SHARE_PERCENT, min_words: int = MIN_WORDS, ngrams: int = NGRAMS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's `doc_id`, `n_features`, `weight`, `score` and, if it is drawn, `rank` (1 is the highest score; ties to the
    smaller id).

    Drawn are the `share_percent` of the documents with at least `min_words` words, rounded down. Null texts have no features and
    weight 0. Rows without id rank last among equal scores; repeated rows take a rank each. An empty table gives an empty result, an
    empty target a weight that only the corpus decides. Other columns are ignored.
    """
    scored = stage(weights(docs, target, ngrams, buckets).withColumn("score", F.col("weight") + gumbel("doc_id", seed)))
    able = scored.where(F.col("n_words") >= min_words)
    # Scores are whole numbers of a narrow range (logarithms times 1,000), so there are few distinct ones.
    places = Counter({r["score"]: r["n"] for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()})
    drawn = sum(places.values()) * share_percent // 100
    above, least = 0, None
    for least in sorted(places, reverse=True):
        above += places[least]
        if above >= drawn:
            break
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    first = numbered(able.where(F.col("score") >= F.lit(least)).select("row", "score", "doc_id"), order, "rank").select("row", "rank")
    return (scored.join(first.where(F.col("rank") <= drawn), "row", "left")
            .select("doc_id", "n_features", "weight", "score", "rank", "n_words"))
