"""Toxicity: a subword-bag embedding model with a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams, and a passage the mean of its words, so an unseen misspelling
shares most n-grams with the word it hides. A text is judged by its most toxic passage: a short insult in a long text is not
averaged away. Passages are runs of `WINDOW` words; training moves embeddings and softmax together on the passage of each text
that is judged worst at that time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import as_bytes, held_out, keyed_texts, slices

GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
WIDTH = 8
WINDOW = 4
EPOCHS = 60
RATE = 0.05
# Bounds of the training sample: labelled texts of each class, and bytes of text together.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1200, 2400, 16 << 20
THRESHOLD = 0.3

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_SALTS = {n: np.uint64(0x9E3779B97F4A7C15 + 2 * n * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1) for n in GRAMS}


def word_grams(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the words of a cleaned text (lower case, punctuation as spaces), and for each n-gram its word and its bucket.

    A space before and after a word is part of its n-grams, so they know where it begins and ends.
    """
    raw = np.frombuffer(b" " + text.translate(_TABLE) + b" " * 8, dtype=np.uint8)
    space = raw == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return starts, np.zeros(0, np.int32), np.zeros(0, np.int32)
    # Word of a position; the space before a word counts as part of it.
    word = np.cumsum(space[:-1] & ~space[1:], dtype=np.int32) - 1
    n_raw = len(raw) - 8
    wide = np.ndarray((n_raw,), dtype="<u8", buffer=raw.data, strides=(1,)).copy()
    inner = np.zeros(n_raw, dtype=bool)  # a space strictly inside the n-gram so far
    words, buckets, seen = [], [], 2
    for n in GRAMS:
        for k in range(seen - 1, n - 1):
            inner |= space[k:n_raw + k]
        seen = n
        at = np.flatnonzero(~inner)
        gram = (wide[at] & np.uint64((1 << 8 * n) - 1)) * _SALTS[n]
        gram ^= gram >> np.uint64(29)
        gram *= np.uint64(0xBF58476D1CE4E5B9)
        words.append(word[at])
        buckets.append((gram >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
    return starts, np.concatenate(words), np.concatenate(buckets)


@dataclass
class Model:
    """`weight` of each bucket towards the toxic class (its embedding through the softmax), and the bias."""

    weight: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        starts, words, buckets = word_grams(text)
        if not len(starts):
            return float(1 / (1 + np.exp(-self.bias)))
        sums = np.bincount(words, self.weight[buckets], len(starts))
        value = sums / np.maximum(np.bincount(words, minlength=len(starts)), 1)
        size = min(WINDOW, len(value))
        total = np.concatenate(([0.0], np.cumsum(value)))
        best = (total[size:] - total[:-size]).max() / size
        return float(1 / (1 + np.exp(-np.clip(best + self.bias, -50, 50))))


def train(texts: list[bytes], toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit embeddings and softmax with Adam on whole texts. Without texts or with one class only, the model is the bias alone."""
    toxic = np.asarray(toxic, dtype=np.float64)
    rate = (toxic.sum() + 1) / (len(toxic) + 2)
    prior = float(np.log(rate / (1 - rate)))
    if not len(texts) or toxic.min() == toxic.max():
        return Model(np.zeros(BUCKETS, np.float32), prior)
    # Distinct words once; texts as word numbers.
    seen: dict[bytes, int] = {}
    spelled = [t.translate(_TABLE).split() for t in texts]
    numbers = [np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.int32, len(ws)) for ws in spelled]
    del spelled
    _, gram_word, gram = word_grams(b" ".join(seen))
    n_words = len(seen)
    order = np.argsort(gram_word, kind="stable")
    gram, counts = gram[order], np.bincount(gram_word, minlength=n_words)
    firsts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    kept = [i for i, ids in enumerate(numbers) if len(ids)]
    lengths = np.array([len(numbers[i]) for i in kept])
    flat, y = np.concatenate([numbers[i] for i in kept]), toxic[kept]
    sizes = np.minimum(WINDOW, lengths)
    n_windows = lengths - sizes + 1
    window_text = np.repeat(np.arange(len(kept)), n_windows)
    text_first = np.concatenate(([0], np.cumsum(n_windows)[:-1]))
    offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    window_at = np.arange(len(window_text)) - text_first[window_text] + offset[window_text]
    window_size = sizes[window_text]
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    soft = rng.normal(0, 0.3, (WIDTH, 2)).astype(np.float32)
    bias = np.array([0.0, prior], dtype=np.float32)
    params = [table, soft, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    equal = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    balance = 0.5 * equal + 0.5  # halfway between equal classes and equal texts
    for step in range(1, epochs + 1):
        direction = soft[:, 1] - soft[:, 0]
        bucket_value = table @ direction
        word_value = np.add.reduceat(bucket_value[gram], firsts) / counts
        run = np.concatenate(([0.0], np.cumsum(word_value[flat], dtype=np.float64)))
        value = (run[window_at + window_size] - run[window_at]) / window_size
        worst = np.maximum.reduceat(value, text_first)
        pick = np.flatnonzero(value == worst[window_text])
        pick = pick[np.unique(window_text[pick], return_index=True)[1]]
        # All words of the picked passages, each with its text.
        size = window_size[pick]
        text_of = np.repeat(np.arange(len(pick)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        words = flat[window_at[pick][text_of] + inside]
        used, slot = np.unique(words, return_inverse=True)
        used_counts = counts[used]
        used_of = np.repeat(np.arange(len(used)), used_counts)
        used_gram = gram[np.repeat(firsts[used], used_counts) + np.arange(used_counts.sum())
                         - np.repeat(np.cumsum(used_counts) - used_counts, used_counts)]
        vectors = np.add.reduceat(table[used_gram], np.cumsum(used_counts) - used_counts, axis=0) / used_counts[:, None]
        passage = np.add.reduceat(vectors[slot], np.cumsum(size) - size, axis=0) / size[:, None]
        logits = passage @ soft + bias
        chance = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -50, 50)))
        error = ((chance - y) * balance / len(y)).astype(np.float32)
        two = np.stack([-error, error], axis=1)
        to_passage = two @ soft.T
        to_word = np.zeros((len(used), WIDTH), np.float32)
        np.add.at(to_word, slot, to_passage[text_of] / size[text_of][:, None])
        to_table = np.zeros_like(table)
        np.add.at(to_table, used_gram, (to_word / used_counts[:, None])[used_of])
        for p, g, (m, v) in zip(params, (to_table, passage.T @ two + 1e-4 * soft, two.sum(axis=0)), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, seen) -> tuple[list[bytes], np.ndarray]:
    """At most `SAMPLE_TOXIC` and `SAMPLE_CLEAN` labelled whole texts, and `SAMPLE_BYTES` of them, in the order of their id's hash.

    `seen` filters ids that may be learnt from. A document with several labels is toxic if one says so; null labels don't count. One text
    is learnt from each id; a text that is larger than the bytes left for its class is passed over.
    """
    spark = docs.sparkSession
    marked = (labels.where("doc_id is not null and toxic is not null").where(seen)
              .groupBy("doc_id").agg((F.max("toxic") >= 1).alias("toxic")))
    # Of several texts of one id, that of the smallest hash.
    sized = (keyed_texts(docs).select("doc_id", F.struct(F.xxhash64("text").alias("version"), F.octet_length("text").alias("n")).alias("own"))
             .join(marked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("own").alias("own")).select("doc_id", "toxic", "own.*"))
    ranked = sized.withColumn("rank", F.xxhash64("doc_id"))
    chosen = []
    for toxic, most in ((True, SAMPLE_TOXIC), (False, SAMPLE_CLEAN)):
        room = SAMPLE_BYTES * most // (SAMPLE_TOXIC + SAMPLE_CLEAN)
        for r in ranked.where(F.col("toxic") == F.lit(toxic)).orderBy("rank", "doc_id", "n").limit(most).collect():
            if r.n <= room:
                room -= r.n
                chosen.append((r.doc_id, toxic, r.version))
    if not chosen:
        return [], np.zeros(0)
    ids = spark.createDataFrame(sorted(set(chosen)), "doc_id long, toxic boolean, version long")
    rows = (keyed_texts(docs).withColumn("version", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "version"])
            .dropDuplicates(["doc_id", "version"]).collect())
    rows = sorted({(r.doc_id, r.text, r.toxic) for r in rows})
    return [r[1].encode() for r in rows], np.array([r[2] for r in rows], dtype=float)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `score` from 0 to 1 of every whole text; a text without words gets the score of the bias."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for part in slices(batches):
            values = [own.score(t) for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(values, pa.float64())], ["doc_id", "score"])

    return keyed_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def scorer(spark: SparkSession, model: Model):
    """The score as a function of a text column, for tables whose other columns must stay as they are."""
    shared = spark.sparkContext.broadcast((model.weight, model.bias))

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        own = Model(*shared.value)
        return pa.array([own.score(t or b"") for t in as_bytes(texts)], pa.float64())

    return of


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` (1 from `THRESHOLD`) of every document.

    Learns only from labels of ids whose crc32 mod 4 is not 2. Null and empty texts have no words and get the score of the bias; so do
    all texts if there are no labels of both classes. Rows that repeat stay repeated. Other columns are ignored.
    """
    model = train(*training_sample(docs, labels, ~held_out("doc_id", 4, 2)))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
