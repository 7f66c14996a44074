"""The contexts of the language model are whole preceding words, however rare."""

import math
import random
import zlib

import numpy as np

from scholia.llm import language_model


def _ids(held: bool, start: int, n: int) -> list[int]:
    return [i for i in range(start, start + 100 * n) if (zlib.crc32(str(i).encode()) % 10 == 0) == held][:n]


def test_words_with_one_ending_are_contexts_of_their_own(spark):
    rng = random.Random(1)
    texts = ["cat meows", "hat falls", "mat lies"] * 40 + [f"{rng.choice('abc')}{i}at once{i}" for i in range(60)]
    asked = ["cat meows", "cat falls", "hat falls", "hat meows", "", None, "dog barks", "cat"]
    rows = [*zip(_ids(False, 0, len(texts)), texts), *zip(_ids(True, 10**6, len(asked)), asked)]
    got = {r.doc_id: r for r in language_model.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    score = {t: got[i].score for i, t in rows[len(texts):]}
    # Classes of two last bytes have "cat" and "hat" in one restaurant, where both scores are the same.
    assert score["cat meows"] > score["cat falls"] + 0.5 and score["hat falls"] > score["hat meows"] + 0.5
    assert score[""] == score[None] and len(got) == len(rows) and all(math.isfinite(r.score) for r in got.values())


def test_the_context_of_a_token_is_the_word_before_it():
    vocabulary, number, context, text = language_model.tokens_of([b"A bat sat", b"", b"hat"])
    pairs = [(vocabulary[c], vocabulary[w], t) for c, w, t in zip(context, number, text.tolist())]
    assert pairs == [(b" ", b"a", 0), (b"a", b"bat", 0), (b"bat", b"sat", 0), (b"sat", b"", 0), (b" ", b"", 1), (b" ", b"hat", 2), (b"hat", b"", 2)]


def test_predictions_of_all_words_after_a_context_sum_to_one(spark):
    words = [f"w{i}" for i in range(12)]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words) for _ in range(9))) for i in _ids(False, 0, 60)]
    rows += list(zip(_ids(True, 10**6, len(words)), words)) + [(_ids(True, 2 * 10**6, 1)[0], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.scores(docs).collect()}
    read = docs.selectExpr("doc_id", "text", "crc32(cast(cast(doc_id as string) as binary)) % 10 = 0 AS held")
    counted, contexts, told, spelling, totals = language_model.train(read)
    (d1, d0), (s1, s0) = totals["discount"], language_model.STRENGTH
    start = language_model._names([language_model.START])[0]
    rows_of = lambda df: [r.asDict() for r in df.collect()]
    table = {k: (c, n) for r in rows_of(contexts) for k, c, n in zip(*(np.frombuffer(r[c], t).tolist() for c, t in (
        ("keys", np.uint64), ("cells", np.float64), ("customers", np.float64))))}
    tables, customers = table[int(start)]
    assert customers == 60
    total = 0.0
    seats = {r["lot"]: r for r in rows_of(told.where("part = -1"))}
    for r in rows_of(counted.where("slice = -1 AND lot >= 0")):
        lot, own = language_model._Lot(r), np.frombuffer(r["keys"], np.uint64)
        known = lot.total > 0
        guests, own_tables = np.frombuffer(seats[r["lot"]]["chances"], np.float64).reshape(2, -1)
        sat = np.minimum(lot.n, 1).astype(float)
        sat[lot.n > 1] = np.frombuffer(seats[r["lot"]]["tables"], np.float64)
        here = (own[lot.at] == start) & (lot.n > 0)
        total += ((lot.n - d1 * sat)[here]).sum() / (s1 + customers)
        total += (s1 + d1 * tables) / (s1 + customers) * ((guests - d0 * own_tables).sum() / (s0 + totals["customers"]) if known.any() else 0)
    # What is left is spelling's, which sums to 1 over all words.
    total += (s1 + d1 * tables) / (s1 + customers) * totals["unseen"]
    assert math.isclose(total, 1, rel_tol=1e-5) and len(got) == len(rows)


def test_numbers_are_packed_in_two_bytes_or_four():
    for most in (5, 65_535, 65_536, 10**6):
        values = np.array([0, 1, most])
        assert (language_model._long(language_model._short(values, most), 3) == values).all()
