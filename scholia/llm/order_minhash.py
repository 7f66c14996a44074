"""Order MinHash document fingerprints.

A text's k-mers are numbered by occurrence. Hashing deals the numbered k-mers into `SKETCHES` sketches and ranks them; the `TUPLE`
smallest of a sketch are put back into text order and hashed as a tuple. Texts agree in a sketch when they share those k-mers *and*
their order, so likeness follows the edit distance, not just the set of k-mers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import keyed_texts

K = 8  # bytes of a k-mer
SKETCHES = 64
TUPLE = 2
EMPTY = 0

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def signature(text: bytes) -> np.ndarray:
    """16 bits for each sketch; 0 for a sketch without k-mers. A text shorter than `K` bytes is one k-mer, an empty one none.

    Occurrences are numbered over the whole text, and each has a rank of its own, independent of the other occurrences'. Only those
    ranked below a bound are dealt into sketches; the bound is raised until it holds enough for every sketch.
    """
    out = np.zeros(SKETCHES, dtype=np.uint16)
    if not text:
        return out
    text = text if len(text) >= K else text + b"\0" * (K - len(text))
    kmers = np.ndarray((len(text) - K + 1,), dtype="<u8", buffer=text, strides=(1,)).copy()
    place = np.argsort(kmers, kind="stable")
    kmers = kmers[place]
    number = np.arange(len(kmers), dtype=np.uint64)
    start = number.copy()
    start[1:][kmers[1:] == kmers[:-1]] = 0
    np.maximum.accumulate(start, out=start)
    number -= start
    del start
    every = _mix(kmers + number * np.uint64(0x9E3779B97F4A7C15))
    del kmers, number
    wanted = 6 * SKETCHES * TUPLE
    while True:
        everything = wanted >= len(every)
        low = slice(None) if everything else np.flatnonzero(every < np.uint64(2**64 * wanted // len(every)))
        own, at = every[low], place[low]
        sketch = (own & np.uint64(SKETCHES - 1)).astype(np.int64)
        if everything or np.bincount(sketch, minlength=SKETCHES).min() >= TUPLE:
            break
        wanted *= 8
    order = np.lexsort((at, own, sketch))
    sketch, own, at = sketch[order], own[order], at[order]
    begin = np.flatnonzero(np.concatenate(([True], sketch[1:] != sketch[:-1])))
    place = np.arange(len(sketch)) - np.repeat(begin, np.diff(np.append(begin, len(sketch))))
    keep = place < TUPLE
    sketch, own, at = sketch[keep], own[keep], at[keep]
    order = np.lexsort((at, sketch))  # back into text order
    sketch, own = sketch[order], own[order]
    begin = np.flatnonzero(np.concatenate(([True], sketch[1:] != sketch[:-1])))
    value = own[begin].copy()
    for j in range(1, TUPLE):
        there = begin + j < np.append(begin[1:], len(sketch))
        value[there] = _mix(value[there] * _B + own[begin[there] + j])
    out[sketch[begin]] = np.maximum(_mix(value) & np.uint64(0xFFFF), 1).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Part of the sketches that either has in which both agree; 1 for two empty texts."""
    either = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & either).sum() / either.sum()) if either.any() else 1.0


def fingerprint(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `fingerprint` (4 hex digits a sketch) of every whole text. Null texts count as empty, whose fingerprint is all
    zeros; equal texts have equal fingerprints; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [fingerprint(signature(t)) for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(values, pa.string())], ["doc_id", "fingerprint"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text"):
        yield value.as_buffer().to_pybytes()


def in_succession(docs: DataFrame) -> DataFrame:
    """All documents dealt into ranges of descending id and sorted in them (columns `span`, `tail`, `doc_id`, `text`).

    Each range ends with a copy of the next range's first document (`tail` 1), the last one with the first of all, so that a task finds
    every document's successor in its own range. Texts are shuffled once. Equal ids follow the hash of their texts; null ids come last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = [i / n for i in range(1, n)] or [0.5]
    cuts = docs.agg(F.percentile_approx("doc_id", quantiles, 10 * n).alias("q")).first().q or []
    cuts = np.array(sorted(set(cuts)), dtype=np.int64)

    @F.arrow_udf("int")
    def span_of(ids: pa.Array) -> pa.Array:
        # Descending: the highest ids are in span 0, null in the last.
        out = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, out).astype(np.int32))

    rows = keyed_texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("hash", F.xxhash64("text"))
    spans = rows.select("doc_id", "hash").withColumn("span", span_of("doc_id"))
    # The first of a span, as what sorts highest; one row for each span.
    firsts = sorted((r.span, r.top.doc_id, r.top.hash) for r in
                    spans.groupBy("span").agg(F.max(F.struct("doc_id", "hash")).alias("top")).collect())
    follows = [(doc_id, hash_, firsts[i - 1][0]) for i, (_, doc_id, hash_) in enumerate(firsts)]
    extra = F.broadcast(spark.createDataFrame(follows, "first_id long, first_hash long, tail_of int"))
    tagged = (rows.withColumn("span", span_of("doc_id"))
              .join(extra, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")), "left"))
    both = F.array(F.struct("span", F.lit(0).alias("tail")), F.struct(F.col("tail_of").alias("span"), F.lit(1).alias("tail")))
    places = F.when(F.col("tail_of").isNotNull(), both).otherwise(F.slice(both, 1, 1))
    return (tagged.select("doc_id", "hash", "text", F.explode(places).alias("place"))
            .select("place.span", "place.tail", "doc_id", "hash", "text").repartition(n, "span")
            .sortWithinPartitions("span", "tail", F.col("doc_id").desc_nulls_last(), F.col("hash").desc()).drop("hash"))


def edited(text: str, following: str) -> str:
    """The second half of the text replaced by as many first characters of the following one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_sensitivity(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how near they and its successor's are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        last, out = None, []

        def emit(doc, following):
            _, doc_id, text, sig = doc
            new = edited(text, following[2])
            raw = new.encode()
            other = sig if new == text else signature(raw)
            out.append((doc_id, len(text), hashlib.sha256(raw).hexdigest(), fingerprint(sig), fingerprint(other),
                        likeness(sig, other), likeness(sig, following[3])))

        for b in batches:
            ids, spans, tails = (b.column(c).to_pylist() for c in ("doc_id", "span", "tail"))
            for doc_id, span, tail, raw in zip(ids, spans, tails, _texts(b)):
                if tail and (last is None or last[0] != span):
                    continue  # another copy of the tail; only the first one follows
                same = last is not None and last[0] == span
                sig = last[3] if same and last[4] == raw else signature(raw)
                doc = (span, doc_id, raw.decode(), sig, raw)
                if same:
                    emit(last[:4], doc[:4])
                last = None if tail else doc
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out.clear()

    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    return in_succession(docs).mapInArrow(run, schema)
