"""Removal of repeated word windows, found by recompression.

Every text is parsed into symbols by rounds: runs of one word become a symbol, then in each round a hash bit deals all symbols into left
and right ones, and each left symbol followed by a right one becomes a new symbol. A symbol's name is a hash of what it stands for, so it
is global without a dictionary: equal substrings get equal symbols wherever they occur, but for their edges. How far the edges reach
is carried along: `low` to `high` are the words that a symbol's place in the parse depends on.

Each window of `width` words is represented by a symbol that depends on words of the window only, of the highest round that has one.
Equal windows have the same symbol at the same place. So windows that share one occurrence of a symbol form a group, one row, and Spark
rounds name, count and verify:

1. Symbols are counted globally. Groups whose symbol occurs once are unique and go no further.
2. Groups of one symbol and the same words form a class. All but its first one are repeats, without a look at their windows.
3. The first groups of symbols with several classes, at the edges of repeats, are opened into windows, which are compared by their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import as_bytes, keyed_texts, salted_join, slices, stage

WIDTH = 20
ROUNDS = 4
RUN_CAP = 4  # longer runs of one word stay single words, since a run symbol must fit into a window
SYMBOL_CAP = 10  # symbols of more words are not joined any further

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_FAR = 1 << 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = [_mix(np.arange(1 << 8, dtype=np.uint64) + base) for base in _BASES]
PIECE_BYTES = 1 << 20
_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2... modulo 2^64; kept, since every piece needs the same ones."""
    known = _KNOWN.get(int(base))
    if known is None or len(known) < n:
        known = _KNOWN[int(base)] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, PIECE_BYTES) - 1, base))), dtype=np.uint64)
    return known[:n]


def _word_end(data: np.ndarray, at: int) -> int:
    """The first blank from `at` on, or the end."""
    while at < len(data):
        part = data[at:at + 4096]
        blank = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
        if len(blank):
            return at + int(blank[0])
        at += len(part)
    return len(data)


@dataclass
class Words:
    """The words of several texts one after the other: two 64-bit hashes each, and where each text starts (and the last one ends)."""

    hashes: tuple[np.ndarray, np.ndarray]
    starts: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """Words are separated by ASCII blanks. Both hashes are polynomials over random numbers for the bytes."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    first_byte = np.cumsum([0, *(len(t) + 1 for t in texts)])
    found, begins = [[], []], []
    for left in range(0, len(data), PIECE_BYTES):
        # A piece goes on to the end of its last word and starts behind that of the piece before.
        lead = _word_end(data, left) if left else 0
        end = _word_end(data, min(left + PIECE_BYTES, len(data)))
        part = data[lead:end]
        solid = ~((part == 32) | ((part >= 9) & (part <= 13)))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
        begin, stop = edges[::2], edges[1::2]
        begins.append(begin + lead)
        for i, base in enumerate(_BASES):
            power, back = _powers(base, len(part)), _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(part))
            total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[i][part] * power, dtype=np.uint64)))
            found[i].append(_mix((total[stop] - total[begin]) * back[begin] + (stop - begin).astype(np.uint64)))
    return Words((np.concatenate(found[0]), np.concatenate(found[1])), np.searchsorted(np.concatenate(begins), first_byte))


class Spans:
    """Hashes of any span of words, from prefix sums."""

    def __init__(self, hashes: tuple[np.ndarray, ...]):
        n = len(hashes[0])
        self.sums, self.back = [], []
        for h, base in zip(hashes, _BASES):
            self.sums.append(np.concatenate(([np.uint64(0)], np.cumsum(h * _powers(base, n), dtype=np.uint64))))
            self.back.append(_powers(np.uint64(pow(int(base), -1, 1 << 64)), n + 1))

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [_mix((s[end] - s[start]) * b[start] + (end - start).astype(np.uint64)) for s, b in zip(self.sums, self.back)]


@dataclass
class Symbols:
    """A round's parse. Texts are kept apart by symbols of name 0 and no words, whose reach is endless."""

    name: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def merged(self, first: np.ndarray, last: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
        """The symbols `first` to `last` of each new one as one symbol."""
        total = np.concatenate(([0], np.cumsum(self.size)))
        return Symbols(name, total[last + 1] - total[first], low, high)


def parsed_words(words: Words) -> Symbols:
    n, gaps = len(words.hashes[0]), words.starts
    at = np.arange(n, dtype=np.int64)
    name = np.maximum(words.hashes[0], np.uint64(1))
    return Symbols(np.insert(name, gaps, 0), np.insert(np.ones(n, np.int64), gaps, 0), np.insert(at, gaps, -_FAR), np.insert(at + 1, gaps, _FAR))


def _neighbours(a: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([end], a[:-1])), np.concatenate((a[1:], [end]))


def join_runs(s: Symbols, cap: int = RUN_CAP) -> Symbols:
    """Runs of 2 to `cap` equal words become symbols."""
    n = len(s.name)
    at = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], (s.name[1:] != s.name[:-1]) | (s.name[1:] == 0))))
    length = np.diff(np.append(first, n))
    run = np.repeat(np.arange(len(first)), length)
    short = length <= cap
    (left_low, _), (_, right_high) = _neighbours(s.low, -_FAR), _neighbours(s.high, _FAR)
    # A run that is joined, or a single word, depends on both neighbours; a word of a long run on `cap` more of it to the right, or, near
    # its end, on the end and as many to the left.
    last = first + length - 1
    low, high = left_low.copy(), right_high.copy()
    long_at = at[~short[run]]
    end = last[run[long_at]]
    inside = end - long_at >= cap
    low[long_at] = np.where(inside, s.low[long_at], s.low[end - cap])
    high[long_at] = np.where(inside, s.high[np.minimum(long_at + cap, n - 1)], right_high[end])
    heads = np.sort(np.concatenate((first[short], long_at)))
    tails = np.append(heads[1:], n) - 1
    count = (tails - heads + 1).astype(np.uint64)
    name = np.where(count > 1, np.maximum(_mix(s.name[heads] * _M2 + count), np.uint64(1)), s.name[heads])
    low, high = low[heads], high[tails]
    own = s.name[heads] == 0
    low[own], high[own] = -_FAR, _FAR
    return s.merged(heads, tails, name, low, high)


def join_pairs(s: Symbols, turn: int, cap: int = SYMBOL_CAP) -> Symbols:
    """Left symbols followed by a right one become one symbol; both sides are a bit of the name's hash in this turn."""
    n = len(s.name)
    active = (s.name != 0) & (s.size <= cap)
    salt = _mix(np.array([turn], np.uint64))
    right = _mix(s.name + salt) & np.uint64(1) == 1
    is_left, is_right = active & ~right, active & right
    pairs = np.concatenate((is_left[:-1] & is_right[1:], [False])) if n else np.zeros(0, bool)
    joined = np.concatenate(([False], pairs[:-1])) if n else pairs
    (left_low, right_low), (left_high, right_high) = _neighbours(s.low, -_FAR), _neighbours(s.high, _FAR)
    low, high = s.low.copy(), s.high.copy()
    # A left symbol depends on the next one (which it is joined to or which isn't a right one), a right symbol that stays alone on the one before.
    low[is_left], high[is_left] = np.minimum(s.low, right_low)[is_left], np.maximum(s.high, right_high)[is_left]
    alone = is_right & ~joined
    low[alone], high[alone] = np.minimum(s.low, left_low)[alone], np.maximum(s.high, left_high)[alone]
    heads = np.flatnonzero(~joined)
    tails = heads + pairs[heads]
    name = np.where(pairs[heads], np.maximum(_mix(s.name[heads] * _M1 + _mix(s.name[tails] ^ salt)), np.uint64(1)), s.name[heads])
    return s.merged(heads, tails, name, low[heads], high[heads])


def window_symbols(words: Words, width: int = WIDTH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the name of the symbol that represents it and a number of the symbol's occurrence; -1 where no window is."""
    n = len(words.hashes[0])
    parses = [parsed_words(words)]
    parses.append(join_runs(parses[0]))
    for turn in range(1, rounds + 1):
        parses.append(join_pairs(parses[-1], turn))
    name, owner = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
    ends = np.repeat(words.starts[1:], np.diff(words.starts))
    wanted = np.arange(n) + width <= ends
    base = 0
    for level in range(len(parses) - 1, -1, -1):
        s = parses[level]
        open_before = np.concatenate(([0], np.cumsum(wanted)))
        if not open_before[-1]:
            break
        # The windows inside of which the symbol and all it depends on lie.
        begin, end = np.maximum(s.high - width, 0), np.minimum(s.low + 1, n)
        use = np.flatnonzero((s.high - s.low <= width) & (s.low >= 0) & (begin < end))
        use = use[open_before[end[use]] > open_before[begin[use]]]
        # Longer symbols are rarer; written in rising order, the last one stays.
        use = use[np.lexsort((s.name[use], s.size[use]))]
        span = end[use] - begin[use]
        which = np.repeat(use, span)
        to = np.arange(len(which)) - np.repeat(np.cumsum(span) - span, span) + np.repeat(begin[use], span)
        free = wanted[to]
        which, to = which[free], to[free]
        owner[to] = base + which
        name[to] = _mix(s.name[which] + np.uint64(level))
        wanted[to] = False
        base += len(s.name)
    return name, owner


@dataclass
class Groups:
    """Windows that share one symbol occurrence: the text they are in, first start, number, symbol, and hash of all their words."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    symbol: np.ndarray
    content: np.ndarray


def window_groups(texts: list[bytes], width: int = WIDTH, rounds: int = ROUNDS) -> Groups:
    words = words_of(texts)
    name, owner = window_symbols(words, width, rounds)
    head = np.flatnonzero((owner >= 0) & np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    change = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(1, np.int64)
    windows = change[np.searchsorted(change, head, side="right")] - head
    content = Spans(words.hashes).of(head, head + windows + width - 1)
    text = np.searchsorted(words.starts, head, side="right") - 1
    return Groups(text, head - words.starts[text], windows, name[head], content[0] ^ _mix(content[1]))


def _identified(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text` (null: empty) and `version`, which tells texts of one id apart."""
    keyed = keyed_texts(docs)
    return keyed.withColumn("version", F.xxhash64("text"))


def _place() -> Column:
    """Where a window starts, in the order that says which one is first: rows without id last."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "start")


def symbol_groups(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    """(doc_id, version, start, windows, symbol, content) of all window groups of all texts."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            g = window_groups(as_bytes(part.column("text")), width, rounds)
            of = pa.array(g.text)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(of), part.column("version").take(of), pa.array(g.start.astype(np.int32)),
                 pa.array(g.windows.astype(np.int32)), pa.array(g.symbol.view(np.int64)), pa.array(g.content.view(np.int64))],
                ["doc_id", "version", "start", "windows", "symbol", "content"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _identified(docs).mapInArrow(parse, f"doc_id {id_type}, version long, start int, windows int, symbol long, content long")


def shared_groups(docs: DataFrame, width: int, rounds: int) -> DataFrame:
    """Round 1: staged groups whose symbol occurs at least twice."""
    groups = symbol_groups(docs, width, rounds)
    shared = stage(groups.groupBy("symbol").agg(F.count("*").alias("n")).where("n > 1"))
    return stage(salted_join(groups, shared, ["symbol"], ["doc_id", "start"]).drop("n"))


def _with_lists(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """The documents with the places (start, windows) in them as a list."""
    lists = (places.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "windows")).alias("places"))
             .select(F.col("doc_id").alias("of_id"), F.col("version").alias("of_version"), "places"))
    texts = _identified(docs)
    return texts.join(lists, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("version") == F.col("of_version")), how).drop("of_id", "of_version")


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and numbers of windows of each row's list."""
    for row in column:
        held = row.values
        yield ((np.zeros(0, np.int64),) * 2 if held is None else
               (held.field("start").to_numpy().astype(np.int64), held.field("windows").to_numpy().astype(np.int64)))


def opened_windows(docs: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """(doc_id, version, start, first, second) of each window of the groups `places`, with a 128-bit hash of its words."""

    def open_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = words_of(as_bytes(part.column("text")))
            spans, starts, of = Spans(words.hashes), [], []
            for i, (start, windows) in enumerate(_lists(part.column("places"))):
                every = np.unique(np.repeat(start, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
                starts.append(every)
                of.append(np.full(len(every), i))
            start, of = np.concatenate(starts), np.concatenate(of)
            at = start + words.starts[of]
            first, second = spans.of(at, at + width)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(of)), part.column("version").take(pa.array(of)), pa.array(start.astype(np.int32)),
                 pa.array(first.view(np.int64)), pa.array(second.view(np.int64))], ["doc_id", "version", "start", "first", "second"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _with_lists(docs, places, "inner").mapInArrow(open_groups, f"doc_id {id_type}, version long, start int, first long, second long")


def repeated_windows(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """Staged (doc_id, version, start, windows): the windows whose words also start earlier, some places in more than one row."""
    live, place = shared_groups(docs, width, rounds), ["doc_id", "version", "start", "windows"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "start", "version", "windows"))
    classes = stage(live.groupBy("symbol", "content").agg(F.count("*").alias("n"), first.alias("first")))
    earliest = F.struct("first.unnamed", "first.doc_id", "first.start")
    # Another text of the same id may hold the words at the same place. That is no repeat, so it is looked at like a first group.
    met = stage(salted_join(live, classes.where("n > 1"), ["symbol", "content"], ["doc_id", "start"])
                .select(*place, (_place() > earliest).alias("later"), (F.col("version") != F.col("first.version")).alias("tied"))
                .where("later OR tied"))
    several = stage(classes.groupBy("symbol").agg(F.count("*").alias("n")).where("n > 1"))
    unclear = salted_join(classes.select("symbol", "first"), several, ["symbol"], ["first"]).select(*(f"first.{c}" for c in place))
    tied = met.where("NOT later").select(*place)
    opened = stage(opened_windows(docs, unclear.union(tied), width))
    named = stage(opened.groupBy("first", "second").agg(F.count("*").alias("n"), F.min(_place()).alias("earliest")).where("n > 1"))
    repeats = (salted_join(opened, named, ["first", "second"], ["doc_id", "start"]).where(_place() > F.col("earliest"))
               .select("doc_id", "version", "start", F.lit(1).alias("windows")))
    return stage(met.where("later").select(*place).union(repeats))


def kept_words(text: bytes, start: np.ndarray, windows: np.ndarray, width: int) -> tuple[int, list[bytes]]:
    """Number of words, and those that no window covers."""
    words = text.split()
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + windows + width - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), [w for w, out in zip(words, gone.tolist()) if not out] if gone.any() else words


def without_repeats(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """`doc_id`, `n_words`, `n_removed` and `kept` (the kept words joined by one space) of each row.

    Removed is each word covered by a window of `width` words whose words also start earlier: under a smaller id, or under the same id at
    an earlier word. So rows that repeat id and text fare alike and don't remove each other. Rows without id come last and count as one
    document. Null texts have no words. An empty table gives an empty result; other columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [kept_words(t, *p, width) for t, p in zip(as_bytes(part.column("text")), _lists(part.column("places")))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(k) for n, k in rows], pa.int64()),
                 pa.array([b" ".join(k) for _, k in rows], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return (_with_lists(docs, repeated_windows(docs, width, rounds), "left").select("doc_id", "text", "places")
            .mapInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept string"))
