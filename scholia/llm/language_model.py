"""A hierarchical Pitman-Yor language model, trained by Gibbs sampling of Chinese-restaurant seatings.

Three levels share parents. The restaurant of a context (the preceding word, whole, however rare) has the restaurant of all words as its
parent; that one has a model of spelling, itself a Pitman-Yor hierarchy over up to three preceding bytes, as its base. A word's customers
in a context restaurant sit at tables; its tables there are its customers in the parent, and its tables there are drawn from spelling.

What the seatings of different words share are only the numbers of tables and customers of each restaurant. So the customers of a word
are kept together, in a lot of words that one task holds; whole sweeps over a word's restaurants run inside a task, and between
passes the table totals of each context are summed over all lots and given out again to the lots that have customers there. A sweep
reseats the customers of each dish in blocks: those of a block are seated given the tables at its start, so that work grows with the
logarithm of a count. A dish with one customer has one table, and is counted only. Predictive probabilities are averaged over the sweeps
after burn-in.

Texts are cut to tokens once. A slice of texts asks the lots about its pairs of words; the lots count them, and answer pair by pair.
Nothing whose number grows with the texts is collected or broadcast. Lots and the words in a lot both grow with the square root of the texts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import as_bytes, held_out, keyed_texts, slices
from scholia.session import stage_table

START = b" "  # the context of a first word; no word holds a blank
END = b""  # the token after the last word; no word is empty
STRENGTH = (20.0, 100.0)  # of context restaurants and of the restaurant of all words
DISCOUNT = (0.67, 0.71)  # the same, until the counts of one and of two customers tell
PASSES = 2  # rounds of sampling before the last one, each of which renews the totals
SWEEPS, BURN_IN = 4, 1
COUNT_BYTES = 8 << 20
LOT_BYTES = 1 << 18  # n**2 times as many bytes of text are dealt over n lots
ROUNDS = 4  # in which lots answer and slices are summed, so that a part of them is on the move at once
BASE_ADD = 0.1

# Spelling: contexts of 1, 2 and 3 bytes, hashed to so many; symbols are bytes and the end of the word.
SPELLING_CONTEXTS = (256, 1 << 12, 1 << 13)
SPELLING_DISCOUNT, SPELLING_STRENGTH = 0.8, 2.0
SPELLING_WORDS = 20_000
SYMBOLS = 257


# Tokens of whole texts


def tokens_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of the texts and `START`; then for every token its number, that of the word before it (or `START`), and its text.
    Each text ends with `END`."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__  # a new word gets the next number
    number_of = seen.__getitem__
    number_of(END)
    runs = []
    for t in texts:
        words = t.lower().split()
        runs.append(np.fromiter(map(number_of, words), np.int32, len(words)))
    lengths = np.array([len(r) + 1 for r in runs], dtype=np.int64)
    number = np.zeros(int(lengths.sum()), dtype=np.int32)
    stops = np.cumsum(lengths)
    keep = np.ones(len(number), dtype=bool)
    keep[stops - 1] = False
    if runs:
        number[keep] = np.concatenate(runs)
    context = np.zeros(len(number), dtype=np.int32)
    context[1:] = number[:-1]
    context[stops - lengths] = len(seen)
    return [*seen, START], number, context, np.repeat(np.arange(len(texts), dtype=np.int32), lengths)


def _name(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def _names(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, by which words are told apart."""
    return np.fromiter(map(_name, words), np.uint64, len(words))


def _changes(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """Bounds of runs of these sizes."""
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


# Rows of packed numbers: `lot` or `part` says whose they are

_ASKS = ("lot int, slice long, names binary, sizes binary, keys binary, contexts binary, learnt binary, occurs binary, texts binary, "
         "ids binary, nulls binary")
_LOTS = _ASKS + ", at binary, ones long, twos long"


def _stage(df: DataFrame) -> DataFrame:
    return stage_table(df, compression="zstd")


def _rows(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def _short(values: np.ndarray, most: int) -> bytes:
    """Numbers up to `most` in two bytes or four each."""
    return values.astype(np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _long(blob: bytes, count: int) -> np.ndarray:
    """So many numbers that `_short` has packed."""
    return np.frombuffer(blob, np.uint16 if len(blob) == 2 * count else np.uint32)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each value of `key`, by which the stream is sorted."""
    held, rows = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if rows and row[key] != held:
                yield held, rows
                rows = []
            held = row[key]
            rows.append(row)
    if rows:
        yield held, rows


def _dealt(df: DataFrame, lots: int, key: str, *order: str) -> DataFrame:
    """Rows of equal `key` together, in order. Few bytes stand for much work, and a lot's rows are large, so each has its own partition."""
    return df.repartitionById(lots, F.pmod(key, F.lit(lots)).cast("int")).sortWithinPartitions(key, *order)


def _asking(lots: int):
    """For each slice of texts and each lot of words: the words, how many contexts each has (`sizes`), and for each such pair the place of the
    context among `keys`, how often it occurs and how often in texts learnt from; then the texts of all occurrences, pair by pair. A row with
    lot -1 has the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number_of_slice = TaskContext.get().partitionId() << 32
        for part in slices(batches, budget=COUNT_BYTES):
            vocabulary, number, context, text = tokens_of(as_bytes(part.column("text")))
            names = _names(vocabulary)
            lot = (names % np.uint64(lots)).astype(np.int32)
            by = np.lexsort((names, lot))
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            known, rank = np.unique(names, return_inverse=True)
            pair = place[number] * len(by) + rank[context]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            first = _changes(pair)
            learnt = np.add.reduceat(~part.column("held").to_numpy(zero_copy_only=False)[text[order]], first, dtype=np.uint32)
            occurs = np.diff(np.append(first, len(pair))).astype(np.uint32)
            word, before = pair[first] // len(by), pair[first] % len(by)
            new = _changes(word)
            words = by[word[new]]
            in_words = np.searchsorted(lot[words], np.arange(lots + 1))
            in_pairs = np.append(new, len(word))[in_words]
            in_tokens = np.append(first, len(pair))[in_pairs]
            sizes = np.diff(np.append(new, len(word))).astype(np.uint32)
            texts, ids = text[order], part.column("doc_id")
            del pair, order, place, number, context, text
            yield _rows([{"lot": -1, "slice": number_of_slice, "ids": ids.fill_null(0).to_numpy().tobytes(),
                          "nulls": ids.is_null().to_numpy(zero_copy_only=False).tobytes()}], _ASKS)
            for i in np.flatnonzero(np.diff(in_words)):
                (a, b), (c, d), (e, f) = in_words[i:i + 2], in_pairs[i:i + 2], in_tokens[i:i + 2]
                keys, at = np.unique(before[c:d], return_inverse=True)
                yield _rows([{"lot": int(i), "slice": number_of_slice, "names": b" ".join([vocabulary[w] for w in words[a:b]]),
                              "sizes": sizes[a:b].tobytes(), "keys": known[keys].tobytes(), "contexts": _short(at, len(keys)),
                              "learnt": learnt[c:d].tobytes(), "occurs": occurs[c:d].tobytes(), "texts": _short(texts[e:f], part.num_rows)}], _ASKS)
            number_of_slice += 1
    return run


def _joined(rows: list[dict], column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _counting(lots: int):
    """A row with slice -1 for each lot: its words, sorted by hash, how many contexts each has, and the contexts, sorted by hash, with how often
    a pair was learnt (0 where it is only asked about). Contexts are places among `keys`, which are in the order of `_by_part`. Then each ask,
    with how far the places of its pairs among those are from one another (`at`)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot, rows in _groups(batches, "lot"):
            if lot < 0:
                for r in rows:
                    yield _rows([r], _LOTS)
                continue
            spelled = [w for r in rows for w in r["names"].split(b" ")]
            _, first, word = np.unique(_names(spelled), return_index=True, return_inverse=True)
            word = np.repeat(word.astype(np.uint32), _joined(rows, "sizes", np.uint32))
            learnt = _joined(rows, "learnt", np.uint32)
            bounds = _ranges([len(r["learnt"]) // 4 for r in rows])
            contexts = np.concatenate([np.frombuffer(r["keys"], np.uint64)[_long(r["contexts"], b - a)] for r, a, b in zip(rows, bounds, bounds[1:])])
            order = np.lexsort((contexts, word))
            word, contexts = word[order], contexts[order]
            new = np.append(True, (word[1:] != word[:-1]) | (contexts[1:] != contexts[:-1]))
            starts = np.flatnonzero(new)
            n = np.add.reduceat(learnt[order], starts, dtype=np.uint64)
            at = np.empty(len(order), np.uint32)
            at[order] = np.cumsum(new) - 1
            keys, place, _ = _by_part(contexts[starts], lots)
            yield _rows([{"lot": lot, "slice": -1, "names": b" ".join([spelled[i] for i in first]),
                          "sizes": np.bincount(word[starts], minlength=len(first)).astype(np.uint32).tobytes(), "keys": keys.tobytes(),
                          "contexts": _short(place, len(keys)), "learnt": n.tobytes(), "ones": int((n == 1).sum()), "twos": int((n == 2).sum())}], _LOTS)
            for r, a, b in zip(rows, bounds, bounds[1:]):
                apart = np.diff(at[a:b], prepend=np.uint32(0))
                yield _rows([{**{c: r[c] for c in ("lot", "slice", "sizes", "occurs", "texts")}, "at": _short(apart, int(apart.max()))}], _LOTS)
    return run


class _Lot:
    """The words and pairs of a lot's row: `of` is the word of each pair, `at` the place of its context, `n` how often it was learnt."""

    def __init__(self, row: dict):
        self.words = row["names"].split(b" ")
        self.n = np.frombuffer(row["learnt"], np.uint64).astype(np.int64)
        self.at = _long(row["contexts"], len(self.n))
        self.of = np.repeat(np.arange(len(self.words)), np.frombuffer(row["sizes"], np.uint32))
        self.total = np.bincount(self.of, self.n, len(self.words)).astype(np.int64)


def _by_part(contexts: np.ndarray, lots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts, by the part that keeps their totals; the place of each of `contexts` among them; and the bounds of the parts."""
    keys, at = np.unique(contexts, return_inverse=True)
    order = np.argsort(keys % np.uint64(lots), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], place[at], _parts(keys[order], lots)


def _parts(keys: np.ndarray, lots: int) -> np.ndarray:
    return np.searchsorted(keys % np.uint64(lots), np.arange(lots + 1, dtype=np.uint64))


# Spelling


def _spelling_places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For every byte of every word, and its end: the word, the symbol, and the hashed contexts of 1, 2 and 3 bytes before."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1)
    symbol = np.full(int(ends[-1]) if len(words) else 0, SYMBOLS - 1, dtype=np.int64)
    inside = np.ones(len(symbol), dtype=bool)
    inside[ends - 1] = False
    symbol[inside] = np.frombuffer(b"".join(words), dtype=np.uint8)
    word = np.repeat(np.arange(len(words)), lengths + 1)
    place = np.arange(len(symbol)) - np.repeat(ends - lengths - 1, lengths + 1)
    contexts, mixed = [], np.zeros(len(symbol), dtype=np.uint64)
    for back, size in enumerate(SPELLING_CONTEXTS, start=1):
        before = np.zeros(len(symbol), dtype=np.uint64)  # 0 before the word begins
        before[back:] = symbol[:-back] + 1
        before[place < back] = 0
        mixed = (mixed + before) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        contexts.append((mixed % np.uint64(size)).astype(np.int64))
    return word, symbol, contexts


def _spelling_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, context, symbol, n) of the distinct words that were learnt."""
    for batch in batches:
        for row in batch.to_pylist():
            lot = _Lot(row)
            learnt = [w for w, total in zip(lot.words, lot.total.tolist()) if total]
            for start in range(0, len(learnt), SPELLING_WORDS):
                _, symbol, contexts = _spelling_places(learnt[start:start + SPELLING_WORDS])
                for order, context in enumerate([np.zeros(len(symbol), np.int64), *contexts]):
                    cell, n = np.unique(context * SYMBOLS + symbol, return_counts=True)
                    columns = (np.full(len(cell), order), cell // SYMBOLS, cell % SYMBOLS, n)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["ord", "context", "symbol", "n"])


class Spelling:
    """Interpolated Pitman-Yor over symbols; in a context restaurant each symbol has one table. Sums to 1 over all words."""

    def __init__(self, rows: np.ndarray):
        parent = np.full((1, SYMBOLS), 1 / SYMBOLS)
        self.tables = []
        for order, size in enumerate([1, *SPELLING_CONTEXTS]):
            own = rows[rows[:, 0] == order]
            counts = np.zeros((size, SYMBOLS), dtype=np.float32)
            counts[own[:, 1], own[:, 2]] = own[:, 3]
            total = SPELLING_STRENGTH + counts.sum(axis=1, dtype=np.float64)
            kinds = (counts > 0).sum(axis=1)
            self.tables.append((np.maximum(counts - SPELLING_DISCOUNT, 0) / total[:, None].astype(np.float32),
                                (SPELLING_STRENGTH + SPELLING_DISCOUNT * kinds) / total))
        self.floor = parent[0, 0]

    def chances(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of the probability of each word."""
        if not words:
            return np.zeros(0)
        if len(words) > SPELLING_WORDS:
            return np.concatenate([self.chances(words[i:i + SPELLING_WORDS]) for i in range(0, len(words), SPELLING_WORDS)])
        word, symbol, contexts = _spelling_places(words)
        p = np.full(len(symbol), self.floor)
        for (own, rest), context in zip(self.tables, [np.zeros(len(symbol), np.int64), *contexts]):
            p = own[context, symbol] + rest[context] * p
        return np.bincount(word, np.log(p), len(words))


# Seating


def seat(counts: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that `counts` customers of a dish come to sit at, when a new table has the weight `opening` (fixed over the sweep) and the
    tables there have theirs less `discount` each. Blocks of a sixteenth of those seated are seated at once, single customers at first."""
    tables = np.minimum(counts, 1).astype(np.float64)
    active, n = np.flatnonzero(counts > 1), 1
    t, a, left = tables[active], opening[active], counts[active] - 1
    while len(active):
        block = max(1, n // 16)
        chance = a / (a + np.maximum(n - discount * t, 1e-9))
        t = t + (rng.random(len(t)) < chance if block == 1 else rng.binomial(np.minimum(block, left).astype(np.int64), chance))
        n, left = n + block, left - block
        done = left <= 0
        if done.any():
            tables[active[done]] = t[done]
            go = ~done
            active, t, a, left = active[go], t[go], a[go], left[go]
    return tables


def sweeps(row: np.ndarray, n: np.ndarray, once: np.ndarray, spelled: np.ndarray, context_tables: np.ndarray, totals: dict,
           rng: np.random.Generator, rounds: int = SWEEPS, burn_in: int = BURN_IN) -> tuple[np.ndarray, np.ndarray]:
    """Average tables of each cell, and of each word in the parent, over the sweeps after burn-in.

    A cell has `n` customers, at least two, for the word `row` in a context that has `context_tables` in all; `once` is in how many other
    contexts a word has one customer, and so one table. `totals` has the discounts, and the customers and tables of the parent.
    """
    words = len(spelled)
    (d1, d0), (s1, s0) = totals["discount"], STRENGTH
    to_context, to_parent = s1 + d1 * context_tables, s0 + d0 * totals["tables"]
    cell, word = np.ones(len(n)), np.ones(words)
    cell_sum, word_sum = np.zeros(len(n)), np.zeros(words)
    for r in range(rounds):
        customers = once + np.bincount(row, cell, words)
        parent = (np.maximum(customers - d0 * word, 0) + to_parent * spelled) / (s0 + totals["customers"])
        cell = seat(n, to_context * parent[row], d1, rng)
        word = seat(once + np.bincount(row, cell, words), to_parent * spelled, d0, rng)
        if r >= burn_in:
            cell_sum += cell
            word_sum += word
    return cell_sum / (rounds - burn_in), word_sum / (rounds - burn_in)


# Totals of contexts: a part keeps the contexts whose hashes it is dealt, and answers the lots

_TOTALS = "part int, lot int, keys binary, cells binary, customers binary"
_SEATED = "lot int, part int, keys binary, extra binary, tables binary, chances binary, sums binary"
_ANSWERS = "lot int, part int, cells binary, customers binary"


def _first_totals(lots: int):
    """What a lot knows of its contexts: in how many learnt pairs they stand, and with how many customers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lot, keys = _Lot(row), np.frombuffer(row["keys"], np.uint64)
                cells, customers = np.bincount(lot.at[lot.n > 0], minlength=len(keys)), np.bincount(lot.at, lot.n, len(keys))
                keys, cells, customers = keys[cells > 0], cells[cells > 0].astype(np.uint32), customers[cells > 0].astype(np.uint64)
                bounds = _parts(keys, lots)
                for part in np.flatnonzero(np.diff(bounds)):
                    own = slice(*bounds[part:part + 2])
                    yield _rows([{"part": int(part), "lot": row["lot"], "keys": keys[own].tobytes(), "cells": cells[own].tobytes(),
                                  "customers": customers[own].tobytes()}], _TOTALS)
    return run


def _summed_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with lot -1 for each part: its contexts, sorted, the learnt pairs and the customers of each."""
    for part, rows in _groups(batches, "part"):
        keys, at = np.unique(_joined(rows, "keys", np.uint64), return_inverse=True)
        cells, customers = (np.bincount(at, _joined(rows, c, k), len(keys)) for c, k in (("cells", np.uint32), ("customers", np.uint64)))
        yield _rows([{"part": part, "lot": -1, "keys": keys.tobytes(), "cells": cells.tobytes(), "customers": customers.tobytes()}], _TOTALS)


def _places(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `asked` stand among the sorted `keys`, and whether they do."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return at, keys[at] == asked


def _totals(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a part, and their tables and customers, from those of its `rows` that have lot -1: its own, and what the last seatings of the
    lots add to the one table of each pair."""
    keys, cells, customers = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for r in rows:
        if r["lot"] < 0 and r["cells"] is not None:
            keys, cells, customers = (np.frombuffer(r[c], k) for c, k in (("keys", np.uint64), ("cells", np.float64), ("customers", np.float64)))
            cells = cells.copy()
    for r in rows:
        if r["lot"] < 0 and r["cells"] is None:
            cells[_places(keys, np.frombuffer(r["keys"], np.uint64))[0]] += np.frombuffer(r["extra"], np.float32)
    return keys, cells, customers


def _renewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The totals of a part when the lots have told what they add."""
    for part, rows in _groups(batches, "part"):
        keys, cells, customers = _totals(rows)
        yield _rows([{"part": part, "lot": -1, "keys": keys.tobytes(), "cells": cells.tobytes(), "customers": customers.tobytes()}], _TOTALS)


def _answering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tables and customers of the contexts that each lot names, in its order; none for a context that was not learnt."""
    for part, rows in _groups(batches, "part"):
        keys, *totals = _totals(rows)
        for r in rows:
            if r["lot"] >= 0:
                at, known = _places(keys, np.frombuffer(r["keys"], np.uint64))
                found = [np.zeros(len(at), np.float32) for _ in totals]
                for out, values in zip(found, totals):
                    out[known] = values[at[known]]
                yield _rows([{"lot": r["lot"], "part": part, "cells": found[0].tobytes(), "customers": found[1].tobytes()}], _ANSWERS)


def _named(lots: int):
    """The contexts of a lot, told to the part of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.uint64)
                bounds = _parts(keys, lots)
                for part in np.flatnonzero(np.diff(bounds)):
                    yield _rows([{"lot": row["lot"], "part": int(part), "keys": keys[slice(*bounds[part:part + 2])].tobytes()}],
                                "lot int, part int, keys binary")
    return run


_ALL = "lot int, part int, slice long, " + ", ".join(f"{c} binary" for c in (
    "names", "sizes", "keys", "contexts", "learnt", "once", "spelled", "whole", "cells", "customers", "tables", "chances", "at"))


def _padded(df: DataFrame) -> DataFrame:
    """With all columns of `_ALL`, null where there are none."""
    kinds = dict(f.split() for f in _ALL.split(", "))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


# Model and scores


def train(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, object, dict]:
    """Takes (doc_id, text, held) and learns from all texts that are not held out. Gives the lots and asks (`_LOTS`), the totals of contexts
    (`_TOTALS`), the last seatings (`tables` of the pairs learnt more than once, `chances` of the words in the parent), the spelling, and totals
    (`lots`, `tokens`, `words`, `discount`, and `unseen`: the parent's weight of spelling)."""
    spark = rows.sparkSession
    lots = max(1, math.ceil(math.sqrt((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / LOT_BYTES)))
    # An ask is read again at the end, when the lots know the answers.
    counted = _stage(_dealt(rows.mapInArrow(_asking(lots), _ASKS), lots, "lot").mapInArrow(_counting(lots), _LOTS))
    own = counted.where("slice = -1 AND lot >= 0").select("lot", "names", "sizes", "keys", "contexts", "learnt", "ones", "twos")
    # As many rows as the spelling tables have cells, at most.
    spelling_rows = (own.mapInArrow(_spelling_counts, "ord long, context long, symbol long, n long")
                     .groupBy("ord", "context", "symbol").agg(F.sum("n").alias("n")))
    spelling = spark.sparkContext.broadcast(Spelling(np.array([tuple(r) for r in spelling_rows.collect()], dtype=np.int64).reshape(-1, 4)))
    contexts = _stage(_dealt(own.mapInArrow(_first_totals(lots), _TOTALS), lots, "part").mapInArrow(_summed_totals, _TOTALS))

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What sweeps need of a lot: its learnt words, in how many contexts each has one customer, and its pairs with more; and how many
        words, pairs and customers there are."""
        for batch in batches:
            for row in batch.to_pylist():
                lot = _Lot(row)
                known, many = lot.total > 0, lot.n > 1
                spelled = spelling.value.chances([w for w, k in zip(lot.words, known.tolist()) if k]).astype(np.float32)
                sizes, once = (np.bincount(lot.of[some], minlength=len(known))[known].astype(np.uint32) for some in (many, lot.n == 1))
                keys, at, _ = _by_part(np.frombuffer(row["keys"], np.uint64)[lot.at[many]], lots)
                yield _rows([{"lot": row["lot"], "part": -1, "sizes": sizes.tobytes(), "once": once.tobytes(), "keys": keys.tobytes(),
                              "contexts": _short(at, len(keys)), "learnt": lot.n[many].tobytes(), "spelled": spelled.tobytes(),
                              "whole": np.array([known.sum(), (lot.n > 0).sum(), lot.n.sum()], np.float64).tobytes()}], _ALL)

    cells = _stage(own.mapInArrow(prepared, _ALL))
    sums = lambda df, c, n: np.array([np.frombuffer(r[0], np.float64) for r in df.select(c).collect()]).reshape(-1, n).sum(axis=0)
    words, pairs, tokens = sums(cells, "whole", 3)
    ones, twos = own.agg(F.sum("ones"), F.sum("twos")).first()
    rate = lambda one, two, otherwise: one / (one + 2 * two) if one and two else otherwise

    def seated(totals: dict, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sweeps of a lot. What each part is told of its contexts; then a row with part -1 that has the sums, and the last seatings."""
            for lot, rows in _groups(batches, "lot"):
                of = lambda c, k: np.frombuffer(rows[0][c], k)
                spelled = np.exp(of("spelled", np.float32).astype(float))
                n, keys = of("learnt", np.uint64).astype(np.int64), of("keys", np.uint64)
                at, bounds = _long(rows[0]["contexts"], len(n)), _parts(keys, lots)
                known = _joined(rows[1:], "cells", np.float32).astype(float)
                row, once = np.repeat(np.arange(len(spelled)), of("sizes", np.uint32)), of("once", np.uint32).astype(np.int64)
                cell, word = sweeps(row, n, once, spelled, known[at], totals, np.random.default_rng([lot, totals["pass"]]))
                extra = np.bincount(at, cell - 1, len(keys)).astype(np.float32)
                customers = once + np.bincount(row, cell, len(spelled))
                whole = np.round(customers)
                told = np.array([customers.sum(), word.sum(), (whole == 1).sum(), (whole == 2).sum()], np.float64)
                for part in np.flatnonzero(np.diff(bounds)):
                    some = slice(*bounds[part:part + 2])
                    yield _rows([{"lot": lot, "part": int(part), "keys": keys[some].tobytes(), "extra": extra[some].tobytes()}], _SEATED)
                seats = {"tables": cell.tobytes(), "chances": np.stack([customers, word]).tobytes()} if last else {}
                yield _rows([{"lot": lot, "part": -1, "sums": told.tobytes(), **seats}], _SEATED)
        return run

    totals = {"customers": pairs, "tables": words, "discount": (rate(ones, twos, DISCOUNT[0]), DISCOUNT[1]), "pass": 0}
    asked, now = cells.mapInArrow(_named(lots), "lot int, part int, keys binary"), contexts
    for i in range(PASSES + 1):
        before = totals
        # A seating that is staged is drawn once, so all later steps see the same one.
        told = _stage(_dealt(_padded(cells).unionByName(_padded(answered(now, asked, lots).drop("customers"))), lots, "lot", "part")
                     .mapInArrow(seated(totals, i == PASSES), _SEATED))
        customers, tables, one, two = sums(told.where("part = -1"), "sums", 4)
        totals = {"customers": customers, "tables": tables, "discount": (before["discount"][0], rate(one, two, DISCOUNT[1])), "pass": i + 1}
        now = contexts.unionByName(told.where("part >= 0").select("part", F.lit(-1).alias("lot"), "keys", "extra"), allowMissingColumns=True)
    d0, s0 = before["discount"][1], STRENGTH[1]  # that which the last seatings were drawn with
    totals |= {"lots": lots, "words": int(words), "tokens": int(tokens), "discount": before["discount"],
               "unseen": (s0 + d0 * totals["tables"]) / (s0 + totals["customers"])}
    return counted, _stage(_dealt(now, lots, "part").mapInArrow(_renewed, _TOTALS)), told, spelling, totals


def answered(contexts: DataFrame, asked: DataFrame, lots: int) -> DataFrame:
    """(`_ANSWERS`): tables and customers of the contexts that the lots name in `asked` (lot, part, keys)."""
    if "extra" not in contexts.columns:
        contexts = contexts.withColumn("extra", F.lit(None).cast("binary"))
    return _dealt(contexts.unionByName(asked, allowMissingColumns=True), lots, "part", "lot").mapInArrow(_answering, _ANSWERS)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document `doc_id`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`; learns from ids whose crc32 mod 10
    is not 0.

    Null and empty texts are one end token. Rows that repeat count and are scored as often. Rows without id are learnt from. Without
    anything to learn from, all tokens are unknown: the base score is log10(1) each and the score is that of untrained spelling. An
    empty table gives an empty result; other columns are ignored.
    """
    read = keyed_texts(docs, id_col, text_col)
    rows = read.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id", 10, 0).alias("held"))
    counted, contexts, told, spelling, totals = train(rows)
    lots, n_all, (d1, d0), (s1, s0) = totals["lots"], totals["tokens"], totals["discount"], STRENGTH
    divisor = n_all + BASE_ADD * (totals["words"] + 1)
    replied = "slice long, lot int, sizes binary, logs binary, counts binary"

    def replying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each ask the logarithm of each pair's probability, and the count of each word."""
        for _, rows in _groups(batches, "lot"):
            own, seats = _Lot(rows[0]), rows[1]
            answers = [r for r in rows if r["cells"] is not None]
            tables, guests = (_joined(answers, c, np.float32).astype(float)[own.at] for c in ("cells", "customers"))
            backoff = (s1 + d1 * tables) / (s1 + guests)
            sat = np.minimum(own.n, 1).astype(float)
            sat[own.n > 1] = np.frombuffer(seats["tables"], np.float64)
            customers, word_tables = np.frombuffer(seats["chances"], np.float64).reshape(2, -1)
            known, spelled = own.total > 0, spelling.value.chances(own.words)
            chance = totals["unseen"] * np.exp(spelled)
            chance[known] += (customers - d0 * word_tables) / (s0 + totals["customers"])
            with np.errstate(divide="ignore"):
                logs = np.log10((own.n - d1 * sat) / (s1 + guests) + backoff * chance[own.of])
            # A long word's spelling has no probability above 0 in doubles, so it stays a logarithm.
            new = ~known[own.of]
            logs[new] = np.log10(backoff[new] * totals["unseen"]) + spelled[own.of[new]] / np.log(10)
            logs = logs.astype(np.float32)
            for r in rows:
                if r["at"] is not None:
                    sizes = np.frombuffer(r["sizes"], np.uint32)
                    pairs = np.cumsum(_long(r["at"], int(sizes.sum())), dtype=np.int64)
                    firsts = pairs[_ranges(sizes)[:-1]]
                    yield _rows([{"slice": r["slice"], "lot": r["lot"], "sizes": r["sizes"], "logs": logs[pairs].tobytes(),
                                  "counts": own.total[own.of[firsts]].tobytes()}], replied)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The documents of a slice, from what it has kept and what it was told."""
        for _, rows in _groups(batches, "slice"):
            ids, nulls = np.frombuffer(rows[0]["ids"], np.int64), np.frombuffer(rows[0]["nulls"], bool)
            sums = np.zeros((4, len(ids)))
            for kept, reply in zip(rows[1::2], rows[2::2]):
                if kept["texts"] is None:
                    kept, reply = reply, kept
                occurs = np.frombuffer(kept["occurs"], np.uint32)
                texts = _long(kept["texts"], int(occurs.sum()))
                count = np.repeat(np.frombuffer(reply["counts"], np.int64), np.frombuffer(reply["sizes"], np.uint32))
                for out, each in zip(sums, (None, count > 0, np.log10((count + BASE_ADD) / divisor), np.frombuffer(reply["logs"], np.float32))):
                    out += np.bincount(texts, None if each is None else np.repeat(each, occurs), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), *[pa.array(c.astype(np.int64)) for c in sums[:2]], *map(pa.array, sums[2:])],
                                             ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    # Part -2 and -1 bring a lot's row and its seatings before all else.
    own = counted.where("slice = -1 AND lot >= 0").select("lot", F.lit(-2).alias("part"), "names", "sizes", "keys", "contexts", "learnt")
    seats = told.where("part = -1").select("lot", "part", "tables", "chances")
    asks = counted.where("slice >= 0 AND lot >= 0").select("lot", "slice", "sizes", "at", F.lit(lots).alias("part"))
    replies = counted.where("slice >= 0").select("slice", "lot", "occurs", "texts", "ids", "nulls")
    for i in range(min(ROUNDS, lots)):
        now = F.col("lot") % ROUNDS == i
        answers = answered(contexts, own.where(now).select("lot", "keys").mapInArrow(_named(lots), "lot int, part int, keys binary"), lots)
        some = [own.drop("keys").where(now), seats.where(now), answers, asks.where(now)]
        met = _padded(some[0]).unionByName(_padded(some[1])).unionByName(_padded(some[2])).unionByName(_padded(some[3]))
        replies = replies.unionByName(_stage(_dealt(met, lots, "lot", "part").mapInArrow(replying, replied)), allowMissingColumns=True)
    # A slice's number has its partition above 32 bits.
    round_of = (F.shiftright("slice", 32) + F.col("slice") % (1 << 32)) % ROUNDS
    found = None
    for i in range(min(ROUNDS, lots)):
        some = _stage(_dealt(replies.where(round_of % min(ROUNDS, lots) == i), lots, "slice", "lot")
                      .mapInArrow(summed, "doc_id long, n_tokens long, n_known long, base_score double, score double"))
        found = some if found is None else found.unionByName(some)
    return found.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
                        "base_score", "score")
