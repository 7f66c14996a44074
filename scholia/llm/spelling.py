"""Spelling variants found by Bloom-guided neighbourhoods.

The vocabulary is entered into blocked Bloom filters, one for each word length. Every word generates its edits (each letter deleted or
replaced) as hashes and probes the filter of the edit's length; an insertion is the deletion seen from the longer word. Only edits
that a filter lets through become strings and are shuffled to the exact vocabulary, which removes false positives. A word's form is its
most frequent near word, if that is ten times as frequent; forms are followed to their root by doubling.

Filters are broadcast in rounds of at most `ROUND_BYTES`: a length whose filter is larger is cut into pieces by hash, which only the
edits of that piece probe. So the broadcast doesn't grow with the vocabulary; the number of rounds does.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import as_bytes, keyed_texts, slices, stage

MIN_LETTERS = 7
MIN_COUNT = 2
DROP_EVERY = 31
RATIO = 10
ALPHABET = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))  # lower-cased a-z and the Latin letters that runs may hold
RUN = re.compile("[A-Za-zÀ-ÿ]+")

BITS_A_WORD = 16
PROBES = 5
BLOCK_BITS = 512  # one block is 8 words of 64 bits
ROUND_BYTES = 16 << 20
EDITS_AT_ONCE = 1 << 18
WORDS_A_TASK = 50_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), base))), dtype=np.uint64)[:n]


_SCRAMBLED = _mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1))  # a 64-bit number for each code point


def noisy_word(doc_id: object, run: str, every: int = DROP_EVERY) -> str:
    """The lower-cased run, without one code point if the crc32 of id and run is divisible by `every`."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1:]


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, every: int = DROP_EVERY) -> DataFrame:
    """Staged `word`, `n` and `letters` of the words of at least `min_letters` code points that occur at least `min_count` times."""
    long_run = re.compile(RUN.pattern[:-1] + f"{{{min_letters},}}")  # greedy, so such a match is a maximal run

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found: Counter[str] = Counter()
            for doc_id, text in zip(part.column("doc_id").to_pylist(), as_bytes(part.column("text"))):
                for run, n in Counter(long_run.findall(text.lower().decode())).items():  # `bytes.lower` changes A-Z only
                    found[noisy_word(doc_id, run, every)] += n
            held = {w: n for w, n in found.items() if len(w) >= min_letters}
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    counted = (keyed_texts(docs).mapInArrow(count, "word string, n long")
               .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    return stage(counted.withColumn("letters", F.char_length("word")))


def codes_of(words: list[str], letters: int) -> np.ndarray:
    """Code points of words of one length as a matrix."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), letters)


def hashes_of(codes: np.ndarray) -> np.ndarray:
    """Unmixed polynomial hash of each row; `_mix` it before use."""
    return (_SCRAMBLED[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


class Filters:
    """Blocked Bloom filters of some lengths (or hash pieces of one length), packed into one array of 64-bit words."""

    def __init__(self, blocks: dict[int, int], pieces: int = 1, piece: int = 0):
        self.blocks, self.pieces, self.piece = blocks, pieces, piece
        ends = np.cumsum([0, *blocks.values()])
        self.start = dict(zip(blocks, ends[:-1].tolist()))
        self.size = int(ends[-1])
        self.bits = np.zeros(self.size * (BLOCK_BITS // 64), np.uint64)

    def mine(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(40)) % np.uint64(self.pieces) == np.uint64(self.piece)

    def places(self, h: np.ndarray, letters: int) -> np.ndarray:
        """The block of each mixed hash."""
        return self.start[letters] + (_mix(h ^ _BASE) % np.uint64(self.blocks[letters])).astype(np.int64)

    @staticmethod
    def marks(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each probe, which word of the block and which bit of it."""
        for i in range(PROBES):
            spot = (h >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1)
            yield (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63))

    def holds(self, h: np.ndarray, letters: int) -> np.ndarray:
        at, ok = self.places(h, letters) * (BLOCK_BITS // 64), self.mine(h)
        for word, bit in self.marks(h):
            ok &= (self.bits[at + word] & bit) != 0
        return ok


def rounds(sizes: dict[int, int], budget: int = ROUND_BYTES) -> Iterator[Filters]:
    """Empty filters for all lengths (length -> words), each of at most `budget` bytes or one block."""
    room = max(1, budget * 8 // BLOCK_BITS)
    pending: dict[int, int] = {}
    for letters, n in sorted(sizes.items()):
        need = -(-n * BITS_A_WORD // BLOCK_BITS)
        if need > room:
            pieces = -(-need // room)
            for piece in range(pieces):
                yield Filters({letters: room}, pieces, piece)
            continue
        if sum(pending.values()) + need > room:
            yield Filters(pending)
            pending = {}
        pending[letters] = need
    if pending:
        yield Filters(pending)


def filled(filters: Filters, words: DataFrame) -> Filters:
    """The filters with all words of their lengths: tasks mark bits, Spark joins the blocks, the bounded array comes to the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list[str]] = {}
            for w, letters in zip(batch.column("word").to_pylist(), batch.column("letters").to_pylist()):
                held.setdefault(letters, []).append(w)
            for letters, some in held.items():
                h = _mix(hashes_of(codes_of(some, letters)))
                h = h[filters.mine(h)]
                at = filters.places(h, letters) * (BLOCK_BITS // 64)
                for word, bit in filters.marks(h):
                    yield pa.RecordBatch.from_arrays([pa.array(at + word), pa.array(bit.view(np.int64))], ["at", "bit"])

    marked = (words.where(F.col("letters").isin(list(filters.blocks))).mapInArrow(mark, "at long, bit long")
              .groupBy("at").agg(F.bit_or("bit").alias("bits"))).toArrow()
    filters.bits[marked.column("at").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
    return filters


def edits_let_through(words: list[str], letters: int, filters: Filters) -> Iterator[tuple[str, str]]:
    """(word, edit) for the deletions and replacements of words of one length that the filters may hold.

    Of replacements only those by a greater code point, since the other word of the pair finds the rest; of equal neighbours only
    the first is deleted.
    """
    alphabet = np.array([ord(c) for c in ALPHABET], np.uint32)
    power = _powers(letters)
    step = max(1, EDITS_AT_ONCE // (len(alphabet) + 1) // max(letters, 1))
    for begin in range(0, len(words), step):
        some = words[begin:begin + step]
        codes = codes_of(some, letters)
        terms = _SCRAMBLED[codes] * power
        whole = terms.sum(axis=1, dtype=np.uint64)
        if letters - 1 in filters.blocks:
            before = np.cumsum(terms, axis=1, dtype=np.uint64)
            gone = before - terms + (whole[:, None] - before) * _BACK
            differs = np.ones(codes.shape, bool)
            differs[:, 1:] = codes[:, 1:] != codes[:, :-1]
            hit = differs & filters.holds(_mix(gone), letters - 1)
            for i, at in zip(*(x.tolist() for x in np.nonzero(hit))):
                yield some[i], some[i][:at] + some[i][at + 1:]
        if letters in filters.blocks:
            width = max(1, EDITS_AT_ONCE // len(alphabet) // len(some))
            for left in range(0, letters, width):
                part = codes[:, left:left + width]
                changed = (whole[:, None] - terms[:, left:left + width])[:, :, None] + _SCRAMBLED[alphabet] * power[left:left + width, None]
                row, at, new = np.nonzero(alphabet > part[:, :, None])
                hit = filters.holds(_mix(changed[row, at, new]), letters)
                for i, place, k in zip(row[hit].tolist(), (at[hit] + left).tolist(), new[hit].tolist()):
                    yield some[i], some[i][:place] + ALPHABET[k] + some[i][place + 1:]


def candidates(words: DataFrame, filters: Filters) -> DataFrame:
    """(word, n, near) for all edits of `words` that the broadcast filters let through."""
    shared = words.sparkSession.sparkContext.broadcast(filters)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            counts = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))
            held: dict[int, list[str]] = {}
            for w in counts:
                held.setdefault(len(w), []).append(w)
            for letters, some in held.items():
                pairs = list(edits_let_through(some, letters, filters))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([counts[a] for a, _ in pairs], pa.int64()),
                                                  pa.array([b for _, b in pairs], pa.string())], ["word", "n", "near"])

    reach = sorted({x for letters in filters.blocks for x in (letters, letters + 1)})
    return words.where(F.col("letters").isin(reach)).select("word", "n").mapInArrow(probe, "word string, n long, near string")


def near_words(words: DataFrame, budget: int = ROUND_BYTES) -> DataFrame:
    """Staged (word, near, near_n): each pair of vocabulary words at one edit, in both directions."""
    sizes = {r["letters"]: r["count"] for r in words.groupBy("letters").count().collect()}
    # A word makes hundreds of probes, so a small table is dealt over many tasks.
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(sizes.values()) // WORDS_A_TASK + 1)
    dealt = words.repartition(tasks, "word")
    found = None
    for filters in rounds(sizes, budget):
        let_through = stage(candidates(dealt, filled(filters, words)))
        found = let_through if found is None else found.union(let_through)
    if found is None:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    exact = found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    both = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return stage(exact.select(F.inline(both)))


def variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, every: int = DROP_EVERY,
             budget: int = ROUND_BYTES) -> DataFrame:
    """`word`, `n`, `n_near` (number of near words), `form` and `form_n` (null without one) and `root` of each vocabulary word.

    Null and empty texts hold no words, a null id counts as empty text, repeated rows count again, other columns are ignored and an
    empty table gives an empty result. Ties among near words go to the smaller in code-point order.
    """
    words = vocabulary(docs, min_letters, min_count, every)
    best = (near_words(words, budget).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")))
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *(F.when(-F.col("best.less") >= ratio * F.col("n"), c).alias(name) for c, name in ((F.col("best.form"), "form"), (-F.col("best.less"), "form_n"))))
    known = stage(known)
    up = stage(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    # Every form is `ratio` times as frequent as its word, so paths are short and end; each round doubles the steps.
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stage(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            break
    return known.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
