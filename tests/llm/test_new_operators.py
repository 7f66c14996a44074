"""Spelling variants, importance resampling and recompression against plain readings of their rules."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from scholia.llm import importance, recompression, spelling
from scholia.llm.common import numbered, salted_join

SCHEMA = "doc_id long, text string, source string, n int, word string, row string, start string, places string, version int, line string, letters int"
CLASH = ("s", 1, "c", "c", "c", "c", 1, "c", 1)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], SCHEMA).repartition(parts)


def texts(seed, n=70):
    """Texts with shared passages, periodic stretches, misspellings, nulls, repeated rows and ids."""
    pick = random.Random(seed)
    stems = ["".join(pick.choice("abcdeéß") for _ in range(pick.randint(1, 10))) for _ in range(50)] + ["a", "b", "of"] * 8
    passages = [[pick.choice(stems) for _ in range(pick.randint(20, 90))] for _ in range(6)] + [["a"] * 60, ["a", "b"] * 40, ["a", "a", "b"] * 20]
    rows = []
    for i in range(n):
        words = []
        for _ in range(pick.randint(0, 5)):
            words += [pick.choice(stems) for _ in range(pick.randint(0, 15))] + pick.choice(passages)[pick.randint(0, 10):]
        blanks = [pick.choice([" ", "\n", "  ", "\t", ", ", "\n\n", "\x0b"]) for _ in words]
        rows.append((None if i % 11 == 0 else 3 if i % 13 == 0 else i, "".join(w + b for w, b in zip(words, blanks))))
    return [*rows, rows[5], rows[5], rows[11], (200, None), (201, ""), (202, " \n\t "), (203, "Ünïcode " * 40 + "ÀÉÎÕØ" * 900), (204, "x" * 5000)]


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [(1, "x")]).limit(0)


# ---- recompression ----

def plain_removal(rows, width):
    first, words = {}, [(t or "").encode().split() for _, t in rows]
    place = lambda i, s: (rows[i][0] is None, rows[i][0] or 0, s)
    for i, ws in enumerate(words):
        for s in range(len(ws) - width + 1):
            key = tuple(ws[s:s + width])
            first[key] = min(first.get(key, place(i, s)), place(i, s))
    out = []
    for i, ws in enumerate(words):
        gone = [False] * len(ws)
        for s in range(len(ws) - width + 1):
            if first[tuple(ws[s:s + width])] < place(i, s):
                gone[s:s + width] = [True] * width
        out.append((rows[i][0], len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,width,rounds", [(1, 20, 4), (2, 20, 4), (3, 12, 3), (4, 20, 6), (5, 2, 1)])
def test_repeated_windows_are_removed(spark, seed, width, rounds):
    rows = texts(seed)
    got = recompression.without_repeats(frame(spark, rows), width, rounds).collect()
    assert sorted(map(tuple, got), key=repr) == plain_removal(rows, width)


@pytest.mark.parametrize("seed", range(6))
def test_equal_windows_have_equal_symbols(seed):
    held = [(t or "").encode() for _, t in texts(seed)]
    words, flat = recompression.words_of(held), [w for t in held for w in t.split()]
    assert len(flat) == len(words.hashes[0])
    assert len(set(zip(*(h.tolist() for h in words.hashes)))) == len(set(flat))
    name, owner = recompression.window_symbols(words)
    seen = {}
    for begin, end in zip(words.starts, words.starts[1:]):
        for s in range(begin, end):
            assert (owner[s] >= 0) == (s + 20 <= end)
            if owner[s] >= 0:
                assert seen.setdefault(tuple(flat[s:s + 20]), name[s]) == name[s]
    groups = recompression.window_groups(held)
    assert groups.windows.sum() == (owner >= 0).sum()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    held = [(t or "").encode() for _, t in texts(7)]
    whole = recompression.words_of(held)
    monkeypatch.setattr(recompression, "PIECE_BYTES", 97)
    pieces = recompression.words_of(held)
    assert all((a == b).all() for a, b in zip(whole.hashes, pieces.hashes)) and (whole.starts == pieces.starts).all()


def test_recompression_of_nothing(none):
    assert recompression.without_repeats(none).count() == 0


# ---- spelling ----

def plain_variants(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and one_edit(v, w)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def misspelt(seed):
    pick = random.Random(seed)
    words = ["".join(pick.choice("abcdé") for _ in range(pick.randint(6, 9))) for _ in range(40)] + ["aaaaaaaa", "ÀÀÀÀÀÀÀÀ", "Ünïcodeß"]
    rows = []
    for i in range(60):
        some = []
        for _ in range(60):
            w = pick.choice(words[:8] if pick.random() < .8 else words)
            if pick.random() < .1:
                at = pick.randrange(len(w))
                w = pick.choice([w[:at] + w[at + 1:], w[:at] + pick.choice("abcéÿ") + w[at:], w[:at] + pick.choice("abcéÿ") + w[at + 1:], w.upper()])
            some.append(w)
        rows.append((None if i % 9 == 0 else i % 50, pick.choice([" ", "-", "7"]).join(some)))
    return [*rows, rows[3], (500, None), (501, ""), (502, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 3001 + " " + "a" * 3001)]


@pytest.mark.parametrize("seed,budget", [(1, spelling.ROUND_BYTES), (2, 64), (3, 256)])
def test_variants(spark, seed, budget):
    rows = misspelt(seed)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame(spark, rows), budget=budget).collect()}
    assert got == plain_variants(rows)


def test_forms_are_followed_to_the_root(spark):
    counts = {"aaaaaaaa": 20_000, "aaaaaaab": 2_000, "aaaaaabb": 200, "aaaaabbb": 20, "aaaabbbb": 2}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    got = {r.word: (r.form, r.root) for r in spelling.variants(frame(spark, rows), every=1 << 40).collect()}
    words = list(counts)
    assert got == {w: (words[i - 1] if i else None, words[0]) for i, w in enumerate(words)}


def test_filters_hold_every_word_and_stay_in_bounds(spark):
    sizes = {7: 5000, 8: 100, 9: 1, 40: 3}
    all_rounds = list(spelling.rounds(sizes, 1024))
    assert all(f.bits.nbytes <= 1024 for f in all_rounds)
    pick = random.Random(1)
    words = {k: ["".join(pick.choice("abcdefgh") for _ in range(k)) for _ in range(n)] for k, n in sizes.items()}
    table = spark.createDataFrame([(w, k) for k, some in words.items() for w in some], "word string, letters int")
    held = {k: np.zeros(n, bool) for k, n in sizes.items()}
    for empty in all_rounds:
        filters = spelling.filled(empty, table)
        for k in filters.blocks:
            held[k] |= filters.holds(spelling._mix(spelling.hashes_of(spelling.codes_of(words[k], k))), k)
    assert all(h.all() for h in held.values())


def test_no_variants_of_nothing(none):
    assert spelling.variants(none).count() == 0


# ---- importance ----

def plain_resample(rows, target, ngrams, share=10, least=20, buckets=10_000):
    def features(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
        return len(words), [zlib.crc32(b" ".join(words[i:i + k])) % buckets for k in range(1, ngrams + 1) for i in range(len(words) - k + 1)]

    own, wanted = [features(t) for _, t in rows], [features(t) for t in target]
    s = collections.Counter(b for _, f in own for b in f)
    t = collections.Counter(b for _, f in wanted for b in f)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    out = []
    for (i, _), (n_words, f) in zip(rows, own):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[:share * len(able) // 100]
    return out, [(r[0], r[3], k) for k, r in enumerate(drawn, 1)]


@pytest.mark.parametrize("ngrams,share,buckets", [(1, 10, 10_000), (2, 60, 10_000), (3, 100, 70_000)])
def test_resample(spark, ngrams, share, buckets):
    rows, target = texts(1), ["of a b of", None, "abc dé\nof a b", "x"]
    got = importance.resample(frame(spark, rows), frame(spark, list(enumerate(target))), share, ngrams=ngrams, buckets=buckets).collect()
    every, drawn = plain_resample(rows, target, ngrams, share, buckets=buckets)
    key = lambda r: repr(tuple(r))
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got], key=key) == sorted(every, key=key)
    assert sorted([(r.doc_id, r.score, r["rank"]) for r in got if r["rank"]], key=lambda r: r[2]) == drawn


def test_lines_are_counted_once(spark):
    lines = importance.distinct_lines(frame(spark, [(1, "same line\nother"), (2, "same line"), (3, "same line\nsame line\n")]), 1, 100).collect()
    assert sorted(r.n for r in lines) == [1, 1, 4] and sum(r.n * r.words for r in lines) == 9


def test_nothing_to_draw(spark, none):
    assert importance.resample(none, none).count() == 0
    few = importance.resample(frame(spark, [(1, "a b c"), (None, None)]), none).collect()
    assert [r["rank"] for r in few] == [None, None] and sorted(r.n_features for r in few) == [0, 3]


# ---- helpers ----

def test_salted_join_and_numbering(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 7) END AS key")
    facts = rows.groupBy("key").count().withColumnRenamed("count", "n")
    assert salted_join(rows, facts, ["key"], ["id"], heavy=4).count() == 5000
    got = numbered(rows, [rows.key.desc(), rows.id.asc()], "place").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == [r.id for r in sorted(rows.collect(), key=lambda r: (tuple(-ord(c) for c in r.key) + (0,) * 9, r.id))]
    assert sorted(r.place for r in got) == list(range(1, 5001))
