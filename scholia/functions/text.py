"""Text normalisation, tokens and segments. Every function maps Columns to a Column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia import fixed_values as V

# Not preceded / not followed by a letter, digit or underscore of any script.
WORD_START = "(?<![\\p{L}\\p{N}_])"
WORD_END = "(?![\\p{L}\\p{N}_])"
# Length for "all the rest" of an array; small enough that start + length stays an int.
REST = 1 << 30


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends (`trim` alone drops only blanks). What lies between is not scanned."""
    return F.btrim(text, F.lit(" \t\n\u000b\f\r"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def prefix_key(text: Column, length: int) -> Column:
    """Lower-cased text with collapsed white space, cut to `length`: a linkage key.

    The opening is normalised first; the whole text only where that leaves less than a key, or where a capital sigma, whose small form
    depends on what follows, stands in the opening.
    """
    key = lambda t: F.substring(F.trim(F.regexp_replace(F.lower(without_tables(t)), "\\s+", " ")), 1, length)
    opening = F.substring(text, 1, 4 * length)
    return let(key(opening), lambda k: F.when((F.length(k) == length) & ~F.contains(opening, F.lit("\u03a3")), k).otherwise(key(text)))


def plain_key(text: Column, length: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "\\s+", " ")), 1, length)


def alnum_form(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and blanks turned into one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank_if_null(text)), "[^a-z0-9 ]", " "), " +", " "))


def without_tables(text: Column) -> Column:
    """Drop Markdown table lines and join what is left on one line."""
    lines = F.transform(F.split(blank_if_null(text), "\n"), strip)
    return F.array_join(F.filter(lines, lambda l: (l != "") & ~l.startswith("|")), " ")


def sanitize(text: Column) -> Column:
    """Drop NUL, the replacement character, soft hyphens and zero-width spaces; strip. Few texts have one, so they are looked for first."""
    dropped = "\u0000�­​"
    clean = lambda t: F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in dropped]), F.translate(t, dropped, "")).otherwise(t)
    return strip(let(blank_if_null(text), clean))


def tidy_lines(text: Column) -> Column:
    """`sanitize`, then line breaks with their surroundings become one blank and blanks collapse."""
    return F.regexp_replace(strip(F.regexp_replace(sanitize(text), "\\s*\\n\\s*", " ")), "  +", " ")


def repair_ligatures(text: Column, words: dict[str, str] = V.LIGATURE_REPAIRS,
                     beginnings: dict[str, str] = V.LIGATURE_PREFIX_REPAIRS) -> Column:
    """Restore words that lost a ligature: whole words only, so the repair is idempotent and leaves 'combination' alone.

    A plain substring test comes before each pattern, so a text pays for the few repairs that it may need.
    """
    def cases(table: dict[str, str], end: str) -> list[Column]:
        return [F.struct(F.lit(b).alias("bad"), F.lit(WORD_START + b + end).alias("pattern"), F.lit(g).alias("good"))
                for bad, good in table.items() for b, g in ((bad, good), (bad.capitalize(), good.capitalize()))]

    repairs = F.array(*cases(words, WORD_END), *cases(beginnings, ""))
    return F.aggregate(repairs, text, lambda acc, r: F.when(
        F.contains(acc, r["bad"]), F.regexp_replace(acc, r["pattern"], r["good"])).otherwise(acc))


def words(text: Column, pattern: str = "[a-z0-9]{3,}") -> Column:
    return F.regexp_extract_all(F.lower(blank_if_null(text)), F.lit(pattern), F.lit(0))


def bag_words(text: Column) -> Column:
    """Significant words, duplicates kept."""
    return words(text, "[a-z0-9]{3,}")


def multiset(words: Column) -> Column:
    """A bag as a sorted set: the k-th further occurrence of a word is the element "word#k", so the size of the intersection of two such
    sets is the sum of the smaller counts. Repeats are found as runs in the sorted words, joined into one text."""
    runs = "(?<![^\u0001])([^\u0001]++)(?:\u0001\\1(?![^\u0001]))++"
    repeated = lambda s: F.regexp_extract_all(F.array_join(s, "\u0001"), F.lit(runs), F.lit(0))
    more = lambda r: let(F.split(r, "\u0001"), lambda w: F.transform(
        F.sequence(F.lit(2), F.size(w)), lambda k: F.concat_ws("#", F.get(w, F.lit(0)), k.cast("string"))))
    return let(F.sort_array(words), lambda s: F.sort_array(F.concat(F.array_distinct(s), F.flatten(F.transform(repeated(s), more)))))


def ligature_free_words(text: Column) -> Column:
    """Words with ligature letters removed, at least two characters long; a lost glyph makes no difference."""
    return F.filter(F.transform(words(text, "[a-z0-9]+"), lambda w: F.regexp_replace(w, V.LIGATURES, "")),
                    lambda w: F.length(w) >= 2)


def support_words(text: Column, stop: list[str] = V.SUPPORT_STOP_WORDS) -> Column:
    return F.filter(words(text, "[a-z0-9]{4,}"), lambda w: ~w.isin(stop))


def stem(word: Column, suffixes: list[str] = V.STEM_SUFFIXES) -> Column:
    """Cut the first listed suffix that leaves more than four characters."""
    chain = F
    for suffix in suffixes:
        chain = chain.when((F.length(word) > len(suffix) + 4) & word.endswith(suffix),
                           F.substring(word, F.lit(1), F.length(word) - len(suffix)))
    return chain.otherwise(word)


def stemmed_tokens(text: Column, stop: list[str] = V.STOP_WORDS) -> Column:
    kept = F.filter(words(text, "[a-z]+"), lambda w: (F.length(w) > 3) & ~w.isin(stop))
    return F.transform(kept, lambda w: stem(w))


def plain_tokens(text: Column, stop: list[str] = V.PLAIN_STOP_WORDS) -> Column:
    return F.filter(words(text, "[a-z]+"), lambda w: (F.length(w) > 2) & ~w.isin(stop))


def close_word(word: Column, candidates: Column) -> Column:
    """Whether some candidate equals `word`, extends it or is extended by it, or agrees at 85 % of the positions."""

    def same_positions(other: Column) -> Column:
        span = F.least(F.length(word), F.length(other))
        return F.size(F.filter(F.sequence(F.lit(1), span),
                               lambda i: F.substring(word, i, F.lit(1)) == F.substring(other, i, F.lit(1))))

    def close(other: Column) -> Column:
        longest = F.greatest(F.length(word), F.length(other))
        return (other.startswith(word) | word.startswith(other)
                | ((F.length(word) >= 6) & (F.length(other) >= 6) & (same_positions(other) / longest >= 0.85)))

    return F.when(F.length(word) < 5, F.array_contains(candidates, word)).otherwise(F.exists(candidates, close))


def sentences(text: Column, most: int | None = None) -> Column:
    """All sentences, or the first `most` of them, with what follows left unread."""
    cut = F.split(strip(blank_if_null(text)), "(?<=[.!?])\\s+", most + 1 if most else -1)
    return F.slice(cut, 1, most) if most else cut


def first_sentences(text: Column, n: int) -> Column:
    return F.array_join(sentences(text, n), " ")


def last_sentence(text: Column) -> Column:
    """The last sentence; a full stop between digits does not end one."""
    parts = F.filter(F.split(strip(blank_if_null(text)), "(?<![0-9])\\.(?![0-9])\\s+"), lambda p: strip(p) != "")
    return F.coalesce(strip(F.get(parts, F.size(parts) - 1)), strip(text))


def untriple(text: Column) -> Column:
    """Undo tripled characters where at least a sixth of the opening sample is tripled."""
    sample = F.replace(F.substring(text, 1, 60), F.lit(" "), F.lit(""))
    steps = F.sequence(F.lit(1), F.greatest(F.length(sample) - 2, F.lit(1)), F.lit(3))
    triples = F.size(F.filter(steps, lambda i: (F.substring(sample, i, F.lit(1)) == F.substring(sample, i + 1, F.lit(1)))
                              & (F.substring(sample, i + 1, F.lit(1)) == F.substring(sample, i + 2, F.lit(1)))
                              & (F.length(F.substring(sample, i + 2, F.lit(1))) > 0)))
    tripled = (F.length(text) >= 9) & (triples > 0) & (triples >= F.floor(F.length(sample) / 6))
    return F.when(tripled, F.regexp_replace(text, "(.)\\1\\1", "$1")).otherwise(text)


def numbers(text: Column) -> Column:
    """Distinct numeric tokens: digits with commas dropped, an optional fraction and % / bps / pp."""
    raw = F.regexp_extract_all(F.lower(blank_if_null(text)), F.lit("[0-9,]+\\.?[0-9]*\\s*(?:%|bps?|pp)?"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(raw, lambda n: strip(F.replace(n, F.lit(","), F.lit("")))),
                                     lambda n: n != ""))


def numbers_within(part: Column, whole: Column) -> Column:
    """Whether `part` has numbers and all of them occur in `whole`."""
    return let(numbers(part), lambda p: (F.size(p) > 0) & (F.size(F.array_except(p, numbers(whole))) == 0))


def final_number(text: Column) -> Column:
    """Numeric token that ends the text, without inner white space; '' if there is none."""
    return compact_number(F.regexp_extract(strip(blank_if_null(text)), "([$]?-?[0-9,]+\\.?[0-9]*\\s*%?)\\.?\\s*$", 1))


def compact_number(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(strip(blank_if_null(text)), "\\.+$", ""), "\\s+", ""))


def option_form(text: Column) -> Column:
    """Lower case, collapsed, without closing full stops."""
    return F.lower(collapse(F.regexp_replace(strip(blank_if_null(text)), "\\.+$", "")))


def first_rule(text: Column, rules: list[tuple[list[str], str]], default: Column) -> Column:
    """Label of the first rule with a keyword inside the lower-cased text. The rule list is part of the plan, so keep it short."""
    low = F.lower(blank_if_null(text))
    chain = F
    for keywords, label in rules:
        hit = reduce(lambda a, b: a | b, [low.contains(k) for k in keywords])
        chain = chain.when(hit, F.lit(label))
    return chain.otherwise(default)


def alias_topic(raw: Column, aliases: dict[str, str], noise: str | None = None) -> Column:
    """Canonical topic of the first alias inside `raw`, else `raw` itself, stripped."""
    cleaned = F.lower(strip(blank_if_null(raw)))
    if noise:
        cleaned = strip(F.regexp_replace(cleaned, noise, ""))
    return first_rule(cleaned, [([k], v) for k, v in aliases.items()], strip(blank_if_null(raw)))


def range_label(number: Column, bounds: list[tuple[int, str]], last: str) -> Column:
    """Label of the first inclusive upper bound that holds `number`; null counts as the lowest."""
    chain = F.when(number.isNull(), F.lit(bounds[0][1]))
    for bound, label in bounds:
        chain = chain.when(number <= bound, F.lit(label))
    return chain.otherwise(F.lit(last))


def first_line(text: Column, limit: int = 120) -> Column:
    line = strip(F.get(F.split(text, "\n"), F.lit(0)))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def snippet(stem_text: Column, explanation: Column) -> Column:
    return F.concat(F.lit("Q: "), F.substring(stem_text, 1, 60), F.lit("… | Expl: "), F.substring(explanation, 1, 80), F.lit("…"))


def hard_breaks(text: Column) -> Column:
    """Escape the currency sign and turn single line breaks into Markdown hard breaks; blank lines stay."""
    return F.regexp_replace(F.replace(text, F.lit("$"), F.lit("\\$")), "(?<!\\n)\\n(?!\\n)", "  \n")


def insert_block(text: Column, block: Column, marker: str = "the following\\s+\\w+\\s*:") -> Column:
    """Put `block` behind the first marker; append it without a marker; leave the text alone if it is already there."""
    pattern = f"(?is)^(.*?{marker})\\s*(.+)$"
    head, tail = strip(F.regexp_extract(text, pattern, 1)), strip(F.regexp_extract(text, pattern, 2))
    gap = F.lit("\n\n")
    return (F.when(F.contains(text, block), text)
            .when(text.rlike(pattern), F.concat(head, gap, block, gap, tail))
            .otherwise(F.concat(text, gap, block)))


def ends_dangling(text: Column) -> Column:
    """Non-empty text that does not end in closing punctuation."""
    bare = strip(blank_if_null(text))
    return (bare != "") & ~bare.rlike("[.?!:)”’\"]$")


def has_table(text: Column) -> Column:
    return F.contains(text, F.lit("\n|")) | F.contains(text, F.lit("|---"))


def has_list(text: Column, numbered: bool = False) -> Column:
    dashes = F.contains(text, F.lit("\n-"))
    return dashes | F.contains(text, F.lit("\n1.")) if numbered else dashes


def segment_blocks(text: Column, marker: str) -> Column:
    """Blocks of a long text, one behind each marker; what precedes the first marker is dropped."""
    parts = F.split(text, marker)
    return F.slice(parts, 2, REST)


def answer_key(text: Column, number_letter: str = "([0-9]{1,3})\\.\\s+(?:Answer\\s*[=:]\\s*)?([A-C])\\b") -> Column:
    """Every 'N. X' or 'N. Answer = X' of a text as an array of (number, letter)."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(number_letter), F.lit(1)).alias("number"),
                        F.regexp_extract_all(text, F.lit(number_letter), F.lit(2)).alias("letter"))


_EDGE = "[^\\p{L}\\p{N}_]"
# Patterns of a worked solution that marks its options, in the order in which they count.
MARKED_CORRECT = [f"(?i)(?:^|{_EDGE})([ABC])[.)]\\s+Correct(?:$|{_EDGE})", f"(?i)(?:^|{_EDGE})([ABC])\\s+Correct(?:$|{_EDGE})"]
MARKED_INCORRECT = f"(?i)(?:^|{_EDGE})@[.)]\\s+Incorrect(?:$|{_EDGE})"
MARKED_REASON = "(?i)[ABC][.)]\\s+Correct[.:\\s]+([^.]{10,100}\\.)"
# From the first option label on to the first "correct" behind it, and the last label in there.
BEFORE_CORRECT = f"(?is)((?:^|{_EDGE})[abc][.)](?:\\s(?:.*?{_EDGE})??)?)correct(?:$|{_EDGE})"
LAST_LABEL = f"(?is)^(?:.*{_EDGE})?([abc])[.)](?:\\s|$)"


def marked_letter(text: Column) -> Column:
    """Option that a solution marks as correct ("B. Correct", "B correct"); else the one left when two are marked incorrect; else the
    last option label before the first "correct" that has one; null without any."""
    whole = blank_if_null(text)
    found = lambda c, p: F.nullif(F.upper(F.regexp_extract(c, p, 1)), F.lit(""))
    letters = F.array(*[F.lit(l) for l in "ABC"])
    open_letters = F.array_compact(F.array(*[F.when(~whole.rlike(MARKED_INCORRECT.replace("@", l)), l) for l in "ABC"]))
    left = F.when(F.size(open_letters) == F.size(letters) - 2, F.get(open_letters, F.lit(0)))
    return F.coalesce(*[found(whole, p) for p in MARKED_CORRECT], left, found(F.regexp_extract(whole, BEFORE_CORRECT, 1), LAST_LABEL))


def marked_reason(text: Column) -> Column:
    """Sentence of 10 to 100 characters behind the mark of the correct option; '' without a mark or a sentence."""
    whole = blank_if_null(text)
    marked = whole.rlike(MARKED_CORRECT[0]) | whole.rlike(MARKED_CORRECT[1])
    return F.when(marked, collapse(F.regexp_extract(whole, MARKED_REASON, 1))).otherwise("")
