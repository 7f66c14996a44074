"""Detectors on hand-written rows, one per branch, and the windows of T17 against a plain reading of the rule."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scholia import fixed_values as V
from scholia.functions import text as X
from scholia.operators import signals as S

COLUMNS = "stem string, option_a string, option_b string, option_c string, explanation string, stored string"


def run(spark, detector, *rows, **kw):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + COLUMNS)
    return [r.asDict() for r in detector(df, **kw).orderBy("i").collect()]


def item(explanation, a="first option text", b="second option text", c="third option text", stem="Which one is it?", stored="A"):
    return (stem, a, b, c, explanation, stored)


def test_four_pass(spark):
    rows = run(spark, S.four_pass,
               item("The correct answer is B because of that."), item("Here second option text holds. More."),
               item("Valuations declined sharply. Then recovering.", "declining valuation", "rising prices", "none at all"),
               item("It is 12.5% overall, which fits.", "10%", "12.5%", "3"), item("Too short."), item(None),
               item("Nothing relevant whatsoever here.", "", "", ""), item("The third option text and first option text tie.", "tie one x", "tie one x", "zzzz"))
    assert [(r["letter"], r["pass_no"]) for r in rows] == [("B", 1), ("B", 2), ("A", 3), ("B", 4), (None, 0), (None, 0), (None, 0), (None, 0)]
    assert rows[0]["confidence"] == 1.0 and rows[1]["confidence"] == 0.9 and rows[3]["confidence"] == 0.4


def test_explanation_of_14_and_15_characters(spark):
    rows = run(spark, S.four_pass, item("answer is A ok"), item("answer is A oky"))
    assert [r["letter"] for r in rows] == [None, "A"]


def test_option_of_8_and_9_characters(spark):
    rows = run(spark, S.four_pass, item("So abcdefgh it goes.", "abcdefgh", "zz", "yy"), item("So abcdefghi it goes.", "abcdefghi", "zz", "yy"))
    assert [r["pass_no"] for r in rows] == [3, 2]


def test_opinion_letter(spark):
    rows = run(spark, S.opinion_letter,
               item("Answer: B. Because."), item("Choice C is correct here."), item("B is incorrect as shown."),
               item("B is incorrect as shown.", stem="Which is least accurate?"),
               item("The second option text is what holds. Yes."), item("Cats purring loudly. Dogs barking.", "cats purring loudly", "dogs barking", "fish floating upward", stem="Each is true except"))
    assert [r["letter"] for r in rows] == ["B", "C", None, "B", "B", "C"]
    assert rows[4]["confidence"] == 0.9 and rows[5]["confidence"] == 0.9


def test_framing_and_negation(spark):
    rows = run(spark, S.framing_letter, item("b) is correct"), item("only c"), item("only c, but c is wrong"), item("nothing"))
    assert [r["letter"] for r in rows] == ["B", "C", None, None]


def test_conclusion(spark):
    rows = run(spark, S.conclusion_letter, item("It sums to 45.5%.", "45.5 %", "12", "7", stored="B"), item("Long text. So it is second option text", stored="A"),
               item("Long text. first option text or second option text", stored="C"))
    assert [(r["letter"], r["reason"]) for r in rows] == [("A", "final_number"), ("B", "last_sentence"), (None, None)]


def test_opening_phrase_default(spark):
    rows = run(spark, S.opening_phrase_letter, item("second option text is right."), item("c is right though"), item("no hint"))
    assert [(r["letter"], r["pass_no"]) for r in rows] == [("B", 1), ("C", 2), ("A", 0)]


def test_arbitration(spark):
    rows = run(spark, S.arbitrate, item("the correct answer is b"), item("the correct answer is a"), item("nothing to see"), item("x", stored="Q"),
               item("second option text is it. first option text too.", stored="A"))
    assert [r["result"] for r in rows] == ["mismatch", "ok", "no_signal", "no_signal", "blocked"]


def proximity(text, option, cues, window):
    low, core = text.lower(), option.strip().lower()
    core = re.sub(r"\.+$", "", core)[:40]
    opening = core[:20]
    at = [m.start() for m in re.finditer("(?=" + re.escape(opening) + ")", low)] if opening else []
    if not at and opening:
        for w in [w for w in re.findall("[a-z]+", core) if len(w) > 3][:3]:
            at += [m.start() for m in re.finditer(re.escape(w), low)]
    return sum(any(c in low[max(0, p - window):p + window] for c in cues) for p in at)


@pytest.mark.parametrize("window", [10, 100])
def test_proximity(spark, window):
    rows = [("Rates rise. It is not rates rise, rates rise.", "Rates rise."), ("Higher bonds. bonds are wrong; yields too, bonds", "bonds yields spread"),
            ("aaaaaaaaaaaaaaaaaaaaaaaa incorrect", "aaaaaaaaaaaaaaaaaaaa"), ("nothing", "absent words"), ("é" * 120 + " is not éclair option", "éclair option"), ("x", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, o string")
    got = [r.n for r in df.select("i", S.proximity_score(F.col("t"), F.col("o"), V.NEGATION_CUES, window).alias("n")).orderBy("i").collect()]
    assert got == [proximity(t, o, V.NEGATION_CUES, window) for t, o in rows]


def test_flag_verdicts(spark):
    rows = [(2, 0, False, .5), (1, 1, False, .5), (1, 0, True, .5), (0, 1, True, .5), (1, 0, False, .5), (0, 0, True, .85), (0, 0, True, .8), (0, 9, False, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n int, a int, v boolean, c double")
    got = [r.x for r in df.select("i", S.flag_verdict(F.col("n"), F.col("a"), F.col("v"), F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == ["LIKELY_REAL"] * 4 + ["UNCERTAIN"] * 2 + ["LIKELY_FALSE_POSITIVE"] * 2


def test_ligatures_are_whole_words(spark):
    cases = {"combination of ination": "combination of inflation", "poor oor floor": "poor floor floor", "Oor uctuates": "Floor fluctuates", "oor oor": "floor floor"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("x", X.repair_ligatures(F.col("t")))
    got = {r.t: r.x for r in df.collect()}
    assert got == cases
    again = spark.createDataFrame([(v,) for v in cases.values()], "t string").select(X.repair_ligatures(F.col("t")).alias("x"), "t")
    assert all(r.t == r.x for r in again.collect())


def test_untriple(spark):
    cases = {"QQQUUUAAANNNTTT": "QUANT", "plain heading text": "plain heading text", "AAA": "AAA", "": ""}
    got = {r.t: r.x for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.untriple(F.col("t")).alias("x")).collect()}
    assert got == cases


def test_plain_words_let_every_match_through(spark):
    """The words looked for before a pattern never hide a match, and every pattern has some."""
    patterns = [*V.LETTER_PATTERNS, *V.NEGATION_PATTERNS]
    assert set(patterns) == set(V.PATTERN_WORDS)
    rng = random.Random(5)
    parts = ["a", "b", "C", " ", " is ", "the ", "correct", "Incorrect", "ly", ", ", "because ", "answer", "ed", "choice", "option", "response", ". ", "best ",
             "most likely", "select ", "choose ", "not ", "never", "wrong", "'s ", " a ", " ", "\n", "é"]
    made = ["correct Option is B", "answered is c", "A is the correct", "b. correct because", "c is best answer", "a most likely is", "b is most likely", "Select C",
            "choose a", "B is not the best", "c is never", "not a", "incorrectly, because b", "a's wrong", "c is a wrong"]
    texts = made + ["".join(rng.choice(parts) for _ in range(rng.choice([3, 6, 30]))) for _ in range(2000)]
    low = F.lower("t")
    hidden = [low.rlike("(?U)" + p) & ~S.may_match(low, p) for p in patterns]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        *[F.sum(h.cast("int")).alias(f"h{i}") for i, h in enumerate(hidden)], *[F.sum(low.rlike("(?U)" + p).cast("int")).alias(f"n{i}") for i, p in enumerate(patterns)]).first()
    assert not any(got[:len(patterns)]) and all(got[len(patterns):])


def test_arbitration_searches_the_letters_called_wrong_once(spark):
    rows = spark.createDataFrame([("s", "a", "b", "c", "B is not correct.", "B")], "stem string, option_a string, option_b string, option_c string, explanation string, stored string")
    plan = S.arbitrate(rows)._jdf.queryExecution().analyzed().toString()
    assert plan.count(V.NEGATION_PATTERNS[3]) == 1
