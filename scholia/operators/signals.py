"""Answer-signal detectors: which letter does an explanation support?

Each detector takes a DataFrame with the columns of `Fields` and adds its result columns. The steps are separate columns, so
Spark evaluates every sentence split and token list once per row, inside one stage and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia import fixed_values as V
from scholia.functions import text as X
from scholia.functions.similarity import option_support

LETTERS = ("A", "B", "C")


@dataclass(frozen=True)
class Fields:
    stem: str = "stem"
    a: str = "option_a"
    b: str = "option_b"
    c: str = "option_c"
    explanation: str = "explanation"
    stored: str = "stored"

    def options(self) -> list[Column]:
        return [X.strip(X.blank_if_null(F.col(name))) for name in (self.a, self.b, self.c)]

    def text(self) -> Column:
        return X.strip(X.blank_if_null(F.col(self.explanation)))

    def option_of(self, letter: Column) -> Column:
        a, b, c = self.options()
        return F.when(letter == "A", a).when(letter == "B", b).when(letter == "C", c).otherwise(F.lit(""))


FIELDS = Fields()


def first_letter(tests: list[Column]) -> Column:
    """First of A, B, C whose test holds, or null."""
    return reduce(lambda chain, lt: chain.when(lt[1], F.lit(lt[0])), zip(LETTERS, tests), F)


def highest(scores: list[Column]) -> Column:
    """Letter of the highest score; the first one wins a tie."""
    a, b, c = scores
    return F.when((a >= b) & (a >= c), "A").when(b >= c, "B").otherwise("C")


def lowest(scores: list[Column]) -> Column:
    a, b, c = scores
    return F.when((a <= b) & (a <= c), "A").when(b <= c, "B").otherwise("C")


def _each(df: DataFrame, prefix: str, make: Callable[[int], Column]) -> DataFrame:
    return df.withColumns({f"{prefix}{i}": make(i) for i in range(3)})


def _cols(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(3)]


def _without(df: DataFrame, kept: list[str], *added: str) -> DataFrame:
    """Keep the input columns and the results, dropping the steps between.

    The results pass through a one-row `inline`: a later filter on them stays above it, instead of being pushed down
    through the steps, where every step would be evaluated again at each place it is mentioned.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*added))))


def explicit_letter(text: Column, loose: bool = False) -> Column:
    """Letter that the text states outright, A before B before C."""
    verbs = "(?:choose|select|answer)\\s*[:\\s]+{L}" if loose else "(?:choose|select)\\s+{L}\\b|(?:answer|option|choice)\\s*:\\s*{L}\\b"
    ending = "correct|right|best" if loose else "correct|right|best|answer"
    pattern = ("(?iU)\\b(?:correct\\s+answer\\s+is\\s+{L}|answer\\s+is\\s+{L}|{L}\\s+is\\s+(?:the\\s+)?(?:" + ending + ")|" + verbs + ")\\b")
    return first_letter([text.rlike(pattern.replace("{L}", letter)) for letter in LETTERS])


def four_pass(df: DataFrame, f: Fields = FIELDS, min_share: float = 0.5, loose: bool = False,
              out: tuple[str, str, str] = ("letter", "pass_no", "confidence")) -> DataFrame:
    """Stated letter (1.0), option text in the first sentence (0.9), stemmed word overlap with the first three sentences
    (its share), numbers (0.4). A `min_share` of 0 accepts any overlap at all."""
    kept = df.columns
    df = df.withColumns({"_text": f.text(), **{f"_o{i}": o for i, o in enumerate(f.options())}})
    df = df.withColumn("_sentences", X.sentences(F.col("_text")))
    df = df.withColumns({"_first": F.lower(F.get("_sentences", F.lit(0))), "_focus": F.array_join(F.slice("_sentences", 1, 3), " ")})
    df = df.withColumns({"_stems": X.stemmed_tokens(F.col("_focus")), "_raw": X.words(F.col("_focus"), "[a-z]+")})
    df = _each(df, "_t", lambda i: X.stemmed_tokens(F.col(f"_o{i}")))
    df = _each(df, "_m", lambda i: F.size(F.filter(
        F.col(f"_t{i}"), lambda w: F.array_contains(F.col("_stems"), w) | X.close_word(w, F.col("_raw")))))
    df = _each(df, "_s", lambda i: F.when(F.size(f"_t{i}") == 0, 0.0).otherwise(F.col(f"_m{i}") / F.size(f"_t{i}")))
    best = F.greatest(*_cols("_s"))
    tied = reduce(lambda a, b: a + b, [(s == best).cast("int") for s in _cols("_s")])
    # Among tied options the one with more matched words wins, provided the tie is not exact there too.
    held = [F.when(s == best, m).otherwise(-1) for s, m in zip(_cols("_s"), _cols("_m"))]
    least_held = F.least(*[F.when(s == best, m) for s, m in zip(_cols("_s"), _cols("_m"))])
    third = F.when((best >= min_share) & (best > 0) & ((tied == 1) | (F.greatest(*held) > least_held)), highest(held))
    option = lambda i: X.strip(F.regexp_replace(F.lower(F.col(f"_o{i}")), "\\.+$", ""))
    second = first_letter([(F.length(option(i)) > 8) & F.contains(F.col("_first"), option(i)) for i in range(3)])
    # The numeric pass looks at the opening 400 characters by definition.
    fourth = first_letter([X.numbers_within(F.col(f"_o{i}"), F.substring("_text", 1, 400)) for i in range(3)])
    df = df.withColumns({"_p1": explicit_letter(F.col("_text"), loose), "_p2": second, "_p3": third, "_p4": fourth, "_best": best})
    usable = F.length("_text") >= 15
    letter, number, confidence = out
    return _without(df.withColumns({
        letter: F.when(usable, F.coalesce("_p1", "_p2", "_p3", "_p4")),
        number: F.when(~usable, 0).when(F.col("_p1").isNotNull(), 1).when(F.col("_p2").isNotNull(), 2)
        .when(F.col("_p3").isNotNull(), 3).when(F.col("_p4").isNotNull(), 4).otherwise(0),
        confidence: F.when(~usable, 0.0).when(F.col("_p1").isNotNull(), 1.0).when(F.col("_p2").isNotNull(), 0.9)
        .when(F.col("_p3").isNotNull(), F.col("_best")).when(F.col("_p4").isNotNull(), 0.4).otherwise(0.0)}), kept, *out)


def audit_class(stored: Column, letter: Column, pass_no: Column) -> Column:
    """What a stored letter and a four-pass result call for. Disagreement of the numeric pass is too weak to count."""
    agrees = letter == F.upper(X.strip(X.blank_if_null(stored)))
    return (F.when(letter.isNull(), "no_signal").when(agrees, "ok").when(pass_no == 1, "p1_fix").when(pass_no == 2, "p2_fix")
            .when(pass_no == 3, "p3_flag").otherwise("ok"))


def _core_overlap(df: DataFrame, f: Fields) -> DataFrame:
    """Distinct-word overlap share of each option with the first two sentences, as _v0.._v2."""
    df = df.withColumn("_core", F.array_distinct(X.plain_tokens(X.first_sentences(F.col(f.explanation), 2))))
    df = _each(df, "_w", lambda i: F.array_distinct(X.plain_tokens(f.options()[i])))
    return _each(df, "_v", lambda i: F.when(F.size(f"_w{i}") == 0, 0.0).otherwise(
        F.size(F.array_intersect(F.col(f"_w{i}"), F.col("_core"))) / F.size(f"_w{i}")))


def is_negated(stem: Column, pattern: str = V.NEGATED_STEM) -> Column:
    return X.blank_if_null(stem).rlike("(?iU)\\b(?:" + pattern + ")\\b")


def has_overlap(df: DataFrame, f: Fields = FIELDS, out: str = "has_signal") -> DataFrame:
    """Whether any option shares a word with the opening of the explanation; rows without one need a closer look."""
    kept = df.columns
    return _without(_core_overlap(df, f).withColumn(out, F.greatest(*_cols("_v")) > 0), kept, out)


def overlap_letter(df: DataFrame, f: Fields = FIELDS, out: str = "letter") -> DataFrame:
    """Option with the most overlap, or the least for "least accurate" questions."""
    kept = df.columns
    df = _core_overlap(df, f)
    return _without(df.withColumn(out, F.when(is_negated(F.col(f.stem)), lowest(_cols("_v"))).otherwise(highest(_cols("_v")))), kept, out)


def may_match(low: Column, pattern: str, words: dict[str, list[str]] = V.PATTERN_WORDS) -> Column:
    """Whether the text holds any plain word of the pattern. Most texts hold none, and a pattern is dear to search a whole text with;
    a pattern without listed words is always searched."""
    return reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in words.get(pattern, [""])])


def pattern_letter(text: Column, patterns: list[str] = V.LETTER_PATTERNS) -> Column:
    """Letter of the first listed pattern that occurs."""
    return X.let(F.lower(X.blank_if_null(text)), lambda low: _pattern_letter(low, patterns))


def _pattern_letter(low: Column, patterns: list[str] = V.LETTER_PATTERNS) -> Column:
    found = F.array(*[F.when(may_match(low, p), F.regexp_extract(low, "(?U)" + p, 1)).otherwise("") for p in patterns])
    return F.upper(F.get(F.filter(found, lambda l: l != ""), F.lit(0)))


def negated_letters(text: Column, patterns: list[str] = V.NEGATION_PATTERNS) -> Column:
    """Sorted distinct letters that the text calls wrong."""
    return X.let(F.lower(X.blank_if_null(text)), lambda low: _negated_letters(low, patterns))


def _negated_letters(low: Column, patterns: list[str] = V.NEGATION_PATTERNS) -> Column:
    found = F.array(*[F.when(may_match(low, p), F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(1)))
                      .otherwise(F.array().cast("array<string>")) for p in patterns])
    return F.transform(F.array_sort(F.array_distinct(F.flatten(found))), F.upper)


def _lowered(df: DataFrame, f: Fields) -> DataFrame:
    """With the small letters of the text in `_low` and the letters that it calls wrong in `_negated`, each reckoned once."""
    return (df.withColumn("_low", F.lower(X.blank_if_null(F.col(f.explanation))))
            .withColumn("_negated", _negated_letters(F.col("_low"))))


def framing_letter(df: DataFrame, f: Fields = FIELDS, out: str = "letter") -> DataFrame:
    """"A) correct" or, unless A is called wrong somewhere, "only A" / "A only"."""
    return _framing_letter(_lowered(df, f), f, out).drop("_low", "_negated")


def _framing_letter(df: DataFrame, f: Fields, out: str) -> DataFrame:
    low = F.col("_low")
    told = F.contains(low, F.lit("correct"))

    def test(i: int) -> Column:
        letter = LETTERS[i].lower()
        framed = told & low.rlike(f"(?U)\\b{letter}(?:\\)|\\b)\\W{{0,10}}(?:is )?correct")
        only = ((F.contains(low, F.lit(f"only {letter}")) | F.contains(low, F.lit(f"{letter} only")))
                & low.rlike(f"(?U)\\bonly {letter}\\b|\\b{letter} only\\b"))
        return (f.options()[i] != "") & (framed | (only & ~F.array_contains("_negated", LETTERS[i])))

    return df.withColumn(out, first_letter([test(i) for i in range(3)]))


def opinion_letter(df: DataFrame, f: Fields = FIELDS, out: tuple[str, str] = ("letter", "confidence")) -> DataFrame:
    """Stated letter in the opening 500 characters ("X is incorrect" only counts for negated questions), else option text or
    word overlap in the first two sentences, turned round for negated questions; accepted from 0.7."""
    kept = df.columns
    opening = F.substring(F.col(f.explanation), 1, 500)
    negated = is_negated(F.col(f.stem), V.NEGATED_STEM_WIDE)
    take = lambda p: F.nullif(F.upper(F.regexp_extract(opening, "(?imU)" + p, 1)), F.lit(""))
    wrong = take("\\b(?:choice\\s+)?([ABC])\\s+is\\s+(?:incorrect|not\\s+accurate|inaccurate|wrong|false)\\b")
    stated = F.coalesce(
        take("(?:^|\\n)\\s*(?:The\\s+)?(?:correct\\s+)?answer\\s*(?:is|:)\\s*([ABC])[.\\s]"),
        take("\\b(?:choice\\s+)?([ABC])\\s+is\\s+correct\\b"),
        take("\\b([ABC])\\s+is\\s+the\\s+correct\\s+answer\\b"),
        take("\\bthe\\s+correct\\s+answer\\s+is\\s+([ABC])\\b"),
        F.when(negated, wrong),
        take("\\b([ABC])\\s+is\\s+the\\s+(?:best|only\\s+)?(?:correct\\s+)?(?:answer|choice|option|statement)\\b"))
    df = df.withColumns({"_negated": negated, "_stated": stated,
                         "_core": X.repair_ligatures(F.lower(X.first_sentences(F.col(f.explanation), 2)))})
    df = df.withColumn("_words", X.stemmed_tokens(F.col("_core")))
    df = _each(df, "_o", lambda i: X.repair_ligatures(F.lower(f.options()[i])))
    df = _each(df, "_t", lambda i: X.stemmed_tokens(F.col(f"_o{i}")))
    df = _each(df, "_s", lambda i: F.when((F.size(f"_t{i}") == 0) | (F.length(f"_o{i}") < 8), 0.0)
               .when(F.contains(F.col("_core"), F.substring(f"_o{i}", 1, 40)), 1.0)
               .otherwise(F.size(F.filter(F.col(f"_t{i}"), lambda w: F.array_contains(F.col("_words"), w))) / F.size(f"_t{i}")))
    s, (letter, confidence) = _cols("_s"), out
    low, high = F.least(*s), F.greatest(*s)
    turned = F.col("_negated") & (low < 0.4) & (high > 0.5)
    plain = ~F.col("_negated") & (high >= 0.5) & (0.9 * high >= 0.7)
    return _without(df.withColumns({
        letter: F.coalesce(F.col("_stated"), F.when(turned, lowest(s)).when(plain, highest(s))),
        confidence: F.when(F.col("_stated").isNotNull(), 1.0).when(turned, 0.9).when(plain, 0.9 * high).otherwise(0.0)}), kept, *out)


def _key(option: Column, length: int) -> Column:
    return F.rtrim(F.substring(X.alnum_form(option), 1, length))


def weighted_text_letter(df: DataFrame, f: Fields = FIELDS, out: str = "letter") -> DataFrame:
    """Option openings (50/30/20 characters) found in the first sentence (4/3/2), the first five (2/1) and the whole text (1);
    letters called wrong are out and the winner needs a lead of two."""
    kept = df.columns
    return _weighted_text_letter(_lowered(df, f), f, out, kept)


def _weighted_text_letter(df: DataFrame, f: Fields, out: str, kept: list[str]) -> DataFrame:
    df = df.withColumn("_split", X.sentences(F.col(f.explanation), 5))
    df = df.withColumns({"_first": F.lower(F.get("_split", F.lit(0))), "_five": F.lower(F.array_join("_split", " "))})
    for n in (50, 30, 20):
        df = _each(df, f"_k{n}_", lambda i, n=n: _key(f.options()[i], n))

    def score(i: int) -> Column:
        within = lambda n, least, where: (F.length(f"_k{n}_{i}") >= least) & F.contains(F.col(where), F.col(f"_k{n}_{i}"))
        first = F.when(within(50, 10, "_first"), 4).when(within(30, 8, "_first"), 3).when(within(20, 6, "_first"), 2).otherwise(0)
        five = F.when(within(50, 10, "_five"), 2).when(within(30, 8, "_five"), 1).otherwise(0)
        whole = F.when(within(50, 10, "_low"), 1).otherwise(0)
        barred = (F.array_contains("_negated", LETTERS[i]) | (F.length(f.options()[i]) < 5) | (F.length(f"_k50_{i}") < 5))
        return F.when(barred, 0).otherwise(first + five + whole)

    df = _each(df, "_s", score)
    ranked = F.array_sort(F.array(*_cols("_s")))
    top, second = F.get(ranked, F.lit(2)), F.get(ranked, F.lit(1))
    return _without(df.withColumn(out, F.when((top > 0) & ((second == 0) | (top - second >= 2)), highest(_cols("_s")))), kept, out)


def opening_hit_letter(df: DataFrame, f: Fields = FIELDS, out: str = "letter") -> DataFrame:
    """Option openings of 50 (strong) or 30 characters in the first three sentences or the opening 400 / 300 characters."""
    kept = df.columns
    df = df.withColumns({"_low": F.lower(X.blank_if_null(F.col(f.explanation))),
                         "_three": F.lower(X.first_sentences(F.col(f.explanation), 3))})
    df = _each(df, "_k5", lambda i: _key(f.options()[i], 50))
    df = _each(df, "_k3", lambda i: _key(f.options()[i], 30))

    def hit(i: int) -> Column:
        found = lambda key, n: F.contains(F.col("_three"), F.col(key)) | F.contains(F.substring("_low", 1, n), F.col(key))
        return (F.when((F.length(f.options()[i]) < 6) | (F.col("_low") == ""), 0)
                .when(found(f"_k5{i}", 400), 2).when(found(f"_k3{i}", 300), 1).otherwise(0))

    df = _each(df, "_h", hit)
    return _without(df.withColumn(out, F.when(F.greatest(*_cols("_h")) > 0, highest(_cols("_h")))), kept, out)


def conclusion_letter(df: DataFrame, f: Fields = FIELDS, out: tuple[str, str] = ("letter", "reason")) -> DataFrame:
    """Disagreement of the stored letter with the closing number or with the one option inside the last sentence."""
    kept = df.columns
    df = df.withColumns({"_number": X.final_number(F.col(f.explanation)), "_last": X.option_form(X.last_sentence(F.col(f.explanation)))})
    df = _each(df, "_f", lambda i: X.option_form(f.options()[i]))
    by_number = F.when(F.length("_number") >= 2, first_letter([X.compact_number(o) == F.col("_number") for o in f.options()]))
    inside = [(F.length(c) >= 3) & F.contains(F.col("_last"), c) for c in _cols("_f")]
    count = reduce(lambda a, b: a + b, [t.cast("int") for t in inside])
    df = df.withColumns({"_n": by_number, "_s": F.when(count == 1, first_letter(inside))})
    usable = (F.length(f.text()) >= 15) & F.col(f.stored).isin(*LETTERS)
    number, sentence = usable & (F.col("_n") != F.col(f.stored)), usable & (F.col("_s") != F.col(f.stored))
    letter, reason = out
    return _without(df.withColumns({letter: F.when(number, F.col("_n")).when(sentence, F.col("_s")),
                                    reason: F.when(number, "final_number").when(sentence, "last_sentence")}), kept, *out)


def opening_phrase_letter(df: DataFrame, f: Fields = FIELDS, out: tuple[str, str] = ("letter", "pass_no")) -> DataFrame:
    """Longest option opening (eight words) in the first 300 characters, then a stated letter, else A with pass 0."""
    kept = df.columns
    df = df.withColumn("_start", F.lower(F.substring(X.blank_if_null(F.col(f.explanation)), 1, 300)))
    phrase = lambda i: F.array_join(F.slice(F.split(F.lower(f.options()[i]), "\\s+"), 1, 8), " ")
    df = _each(df, "_p", phrase)
    df = _each(df, "_l", lambda i: F.when((F.length(f"_p{i}") >= 5) & F.contains(F.col("_start"), F.col(f"_p{i}")), F.length(f"_p{i}")).otherwise(0))
    take = lambda p: F.nullif(F.upper(F.regexp_extract(F.col(f.explanation), "(?iU)" + p, 1)), F.lit(""))
    df = df.withColumn("_stated", F.coalesce(take("\\b([ABC])\\s+is\\s+(?:correct|right)"), take("\\b(?:correct answer|answer)\\s+is\\s+([ABC])\\b")))
    letter, number = out
    hit = F.greatest(*_cols("_l")) > 0
    return _without(df.withColumns({letter: F.when(hit, highest(_cols("_l"))).otherwise(F.coalesce("_stated", F.lit("A"))),
                                    number: F.when(hit, 1).when(F.col("_stated").isNotNull(), 2).otherwise(0)}), kept, *out)


def arbitrate(df: DataFrame, f: Fields = FIELDS, out: tuple[str, str, str] = ("result", "method", "detected")) -> DataFrame:
    """First of stated letter, framing and option text that disagrees with the stored letter; a text disagreement is blocked
    where the stored option itself opens the explanation."""
    kept = df.columns
    df = _lowered(df, f)
    df = _framing_letter(df.withColumn("_p1", _pattern_letter(F.col("_low"))), f, "_ex")
    df = _weighted_text_letter(df, f, "_p2", [*kept, "_p1", "_ex"])
    stored = F.upper(X.strip(X.blank_if_null(F.col(f.stored))))
    df = df.withColumns({"_stored": stored, "_option": X.alnum_form(f.option_of(stored)),
                         "_two": F.lower(X.first_sentences(F.col(f.explanation), 2))})
    result, method, detected = out
    apart = lambda c: F.col(c) != F.col("_stored")
    valid = F.col("_stored").isin(*LETTERS)
    agreed = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == F.col("_stored"), F.lit(False)) for c in ("_p1", "_ex", "_p2")])
    df = df.withColumn(method, F.when(valid, F.when(apart("_p1"), "P1").when(apart("_ex"), "EXPLICIT").when(apart("_p2"), "P2")))
    blocked = (F.col(method) == "P2") & (F.length("_option") >= 15) & F.contains(F.col("_two"), F.substring("_option", 1, 30))
    return _without(df.withColumns({
        detected: F.when(F.col(method) == "P1", F.col("_p1")).when(F.col(method) == "EXPLICIT", F.col("_ex")).when(F.col(method) == "P2", F.col("_p2")),
        result: F.when(~valid, "no_signal").when(F.col(method).isNull(), F.when(agreed, "ok").otherwise("no_signal"))
        .when(blocked, "blocked").otherwise("mismatch")}), kept, *out)


def triple_confirmation(voted: Column, stored: Column, text_letter: Column, agreement: Column, similarity: Column) -> Column:
    """Verdict from the voted letter, the stored one and the letter that the explanation supports."""
    band = F.when(agreement >= 0.8, "HIGH").when(agreement >= 0.5, "MEDIUM").otherwise("LOW")
    return (F.when(stored == voted, "matched")
            .when(text_letter.isNull(), F.when((agreement >= 0.8) & (similarity >= 0.99), "MEDIUM-CACHE").otherwise(F.concat(F.lit("ambiguous-"), band)))
            .when(text_letter == voted, "HIGH-CONFIRMED").when(text_letter == stored, "matched")
            .otherwise(F.concat(F.lit("ambiguous-"), band)))


def corroboration(df: DataFrame, left: str, right: str, f: Fields = FIELDS, out: str = "verdict") -> DataFrame:
    """Which of two letters the explanation supports better, by more than 0.1."""
    kept = df.columns
    side = lambda letter: F.when(F.col(letter).isNull(), 0.0).otherwise(option_support(F.col(f.explanation), f.option_of(F.col(letter))))
    df = df.withColumns({"left_support": side(left), "right_support": side(right)})
    verdict = (F.when(F.col("right_support") > F.col("left_support") + 0.1, "right")
               .when(F.col("left_support") > F.col("right_support") + 0.1, "left").otherwise("ambiguous"))
    return _without(df.withColumn(out, verdict), kept, "left_support", "right_support", out)


def confirmed_by_text(letter: Column, text: Column, f: Fields = FIELDS) -> Column:
    """Whether the opening of the detected option occurs in the text."""
    option = f.option_of(letter)
    key = _key(option, 30)
    return F.coalesce((F.length(option) >= 8) & (F.length(key) >= 6) & F.contains(F.lower(text), key), F.lit(False))


def proximity_score(text: Column, option: Column, cues: list[str], window: int = 100) -> Column:
    """Occurrences of the option's opening (or else of its first three longer words) with a cue within `window` characters.

    The text is split at the occurrences and walked once with a running offset.
    """
    core = F.substring(F.regexp_replace(X.strip(F.lower(option)), "\\.+$", ""), 1, 40)
    cue_list = F.array(*[F.lit(c) for c in cues])

    def walk(low: Column, pieces: Column, is_hit: Callable[[Column], Column], lead: Callable[[Column], Column],
             step: Callable[[Column], Column]) -> Column:
        def near(at: Column) -> Column:
            around = F.substring(low, F.greatest(at - window, F.lit(0)) + 1, F.least(at, F.lit(window)) + window)
            return F.exists(cue_list, lambda c: F.contains(around, c)).cast("int")

        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("score"))
        return F.aggregate(pieces, start, lambda acc, p: F.struct(
            (acc["at"] + step(p)).alias("at"),
            (acc["score"] + F.when(is_hit(acc["at"]), near(acc["at"] + lead(p))).otherwise(0)).alias("score")))["score"]

    def score(s: Column) -> Column:
        low, opening = s["low"], s["opening"]
        ahead = F.split(low, F.concat(F.lit("(?=\\Q"), opening, F.lit("\\E)")))
        # Every cut lies before an occurrence; what precedes the first one is no hit.
        whole = walk(low, ahead, lambda at: (at > 0) | low.startswith(opening), lambda p: F.lit(0), F.length)

        def by_word(word: Column) -> Column:
            gaps = F.split(low, word)  # words are a-z only
            return walk(low, F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda at: F.lit(True), F.length,
                        lambda p: F.length(p) + F.length(word))

        single = F.aggregate(s["words"], F.lit(0), lambda total, w: total + by_word(w))
        return F.when(opening == "", 0).when(F.contains(low, opening), whole).otherwise(single)

    words = F.slice(F.filter(X.words(core, "[a-z]+"), lambda w: F.length(w) > 3), 1, 3)
    return X.let(F.struct(F.lower(X.blank_if_null(text)).alias("low"), F.substring(core, 1, 20).alias("opening"), words.alias("words")), score)


def polarity_inverted(option: Column, text: Column, pairs: list[tuple[str, str]] = V.OPPOSITES) -> Column:
    """The option says one thing and the opening 600 characters of the text the opposite."""
    left, right = F.lower(X.blank_if_null(option)), F.substring(F.lower(X.blank_if_null(text)), 1, 600)
    return reduce(lambda x, y: x | y, [left.rlike("(?U)" + a) & right.rlike("(?U)" + b) for a, b in pairs])


def flag_verdict(negation: Column, affirmation: Column, inverted: Column, confidence: Column) -> Column:
    return (F.when((negation >= 2) | ((negation >= 1) & ((affirmation >= 1) | inverted)) | (inverted & (affirmation >= 1)), "LIKELY_REAL")
            .when((negation == 1) | (inverted & (confidence >= 0.85)), "UNCERTAIN").otherwise("LIKELY_FALSE_POSITIVE"))


def flag_rank(negation: Column, affirmation: Column, inverted: Column, confidence: Column) -> Column:
    return negation + affirmation + inverted.cast("int") + confidence


def negation_suspect(option: Column, text: Column, confidence: Column, cues: list[str] = V.NEAR_NEGATION_CUES) -> Column:
    """A cue at most 50 characters before one of the option's first three words, two of the first four present, confidence 0.8."""
    def test(s: Column) -> Column:
        present = F.size(F.filter(F.slice(s["words"], 1, 4), lambda w: F.contains(s["low"], w)))
        near = F.exists(F.slice(s["words"], 1, 3), lambda w: F.regexp_like(s["low"], F.concat(F.lit("(?:" + "|".join(cues) + ").{0,50}"), w)))
        return (present >= 2) & near

    sides = F.struct(F.lower(X.blank_if_null(text)).alias("low"), X.words(option, "[a-z]{4,}").alias("words"))
    return (F.length(X.strip(X.blank_if_null(option))) >= 10) & (confidence >= 0.80) & X.let(sides, test)
