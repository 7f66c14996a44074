"""Personal data: fixed patterns, and bootstrapped contextual extraction, in DataFrame functions only.

The spans of the fixed patterns are seeds. A seed's surroundings (the words before it) and shape induce lexical patterns; patterns
and instances (the identifier-like strings they surround) form a bipartite graph. Each round scores patterns by the share of known
ones among their distinct instances, and instances by the patterns that surround them; instances above a bound become known. Patterns
of high confidence that many different seeds support then mark identifiers that no fixed pattern finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import let
from scholia.llm.common import keyed_texts, salted_join, stage

# The base patterns, in a form without backtracking that has the same matches. A run of local-part characters can only
# begin a match at its first character or right after the match before; a card has 16 digits or more.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "context")
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

# A word with a digit or an at sign.
IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SUPPORT = 3  # different known instances that a pattern needs
CONFIDENCE = 0.8
MATCH_BLOCK = 256
# Two whole words at the end of a text; and a text that has two words after its first blank, so that both are whole.
TWO_WORDS = r"(?<!\S)\S++\s++\S++\s*+$"
LAST_WORD = r"(?<!\S)(\S++)\s*+$"
HAS_TWO_WORDS = r"\s\S++\s++\S"


def matches(text: Column, pattern: str, hint: Column) -> Column:
    """(start, end, found, two, one) of all matches, in code points: the pieces between matches tell where they stand, and which two
    words, or one, precede them (lower-cased; what is glued to a match counts as a word). Words are whole unless a word holds three matches.

    The text is searched once, and ends are sums over whole blocks of matches and the rest of a block, so a long text with many
    matches costs little more than its length.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    block = lambda i: F.floor(i / MATCH_BLOCK).cast("int")

    def placed(pieces: Column, steps: Column, sums: Column) -> Column:
        def one(m, i):
            end = total(F.slice(sums, F.lit(1), block(i))) + total(F.slice(steps, block(i) * MATCH_BLOCK + 1, i % MATCH_BLOCK + 1))
            return F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("found"), *preceding(pieces, i))
        return F.transform(pieces["found"], one)

    def preceding(pieces: Column, i: Column) -> tuple[Column, Column]:
        gap = F.get(pieces["gaps"], i)
        piece = lambda name, back: F.coalesce(F.get(pieces[name], i - back), F.lit(""))
        longer = F.concat(piece("gaps", 2), piece("found", 2), piece("gaps", 1), piece("found", 1), gap)
        left = F.when(gap.rlike(HAS_TWO_WORDS), gap).otherwise(longer)
        two = F.trim(F.regexp_replace(F.regexp_extract(left, TWO_WORDS, 0), r"\s+", " "))
        return F.lower(two).alias("two"), F.lower(F.regexp_extract(left, LAST_WORD, 1)).alias("one")

    def steps_of(pieces: Column) -> Column:
        return F.zip_with(F.slice(pieces["gaps"], F.lit(1), F.size(pieces["found"])), pieces["found"], lambda g, m: F.char_length(g) + F.char_length(m))

    def sums_of(steps: Column) -> Column:
        blocks = F.sequence(F.lit(0), block(F.size(steps)))
        return F.transform(blocks, lambda b: total(F.slice(steps, b * MATCH_BLOCK + 1, F.lit(MATCH_BLOCK))))

    located = let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda pieces: let(
        steps_of(pieces), lambda steps: let(sums_of(steps), lambda sums: placed(pieces, steps, sums))))
    none = F.array().cast("array<struct<start:int,end:int,found:string,two:string,one:string>>")
    return F.when(hint, located).otherwise(none)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(number), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$"),
    "card": lambda m: F.char_length(digits(m)).between(16, 19) & luhn(digits(m)),
    "phone": lambda m: F.char_length(digits(m)).between(8, 15),
}
HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike("[0-9][ -]?[0-9]"),
         "phone": lambda t: t.contains("+")}


def valid_matches(text: Column, kind: str) -> Column:
    return F.filter(matches(text, PATTERNS[kind], HINTS[kind](text)), lambda m: VALID[kind](m["found"]))


def numbered(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def shape(found: Column) -> Column:
    """Runs of letters as a; runs of up to 3, up to 7 and more digits as C, B and A."""
    out = F.regexp_replace(F.regexp_replace(found, r"\p{L}+", "a"), "[0-9]{8,}", "A")
    return F.regexp_replace(F.regexp_replace(out, "[0-9]{4,}", "B"), "[0-9]+", "C")


def _mentions() -> Column:
    """Seeds, and identifier-like words that touch no seed: (start, end, instance, seed, patterns)."""
    seeds = F.flatten(F.array(*(F.transform(F.col(k), lambda m: m.withField("seed", F.lit(True))) for k in PATTERNS)))
    words = F.transform(F.col("words"), lambda m: m.withField("seed", F.lit(False)))
    free = F.filter(words, lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))

    def described(m):
        instance = F.regexp_replace(m["found"], r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$", "")
        form = shape(instance)
        patterns = F.array_distinct(F.array(F.concat_ws("\t", m["two"], form), F.concat_ws("\t", m["one"], form)))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), instance.alias("instance"), m["seed"].alias("seed"),
                        patterns.alias("patterns"))

    return F.transform(F.concat(seeds, free), described)


def learned_patterns(mentions: DataFrame) -> DataFrame:
    """Patterns of high confidence (`pattern`, `confidence`) from mentions (`instance`, `seed`, `patterns`), scored round by round until
    no instance becomes known. Known instances are never forgotten, so this ends."""
    edges = stage(mentions.select(F.explode("patterns").alias("pattern"), "instance").distinct())
    known = stage(mentions.where("seed").select("instance").distinct())
    size = known.count()
    while True:
        marked = edges.join(known.withColumn("known", F.lit(1)), "instance", "left")
        strong = stage(marked.groupBy("pattern").agg(F.count("known").alias("support"), F.count(F.lit(1)).alias("n"))
                       .withColumn("confidence", F.col("support") / F.col("n"))
                       .where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)))
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        scored = edges.join(strong, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("score"))
        grown = stage(known.union(scored.where(F.col("score") >= CONFIDENCE).select("instance")).distinct())
        before, size, known = size, grown.count(), grown
        if size == before:
            return strong.select("pattern", "confidence")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id` and `spans`, an array of (kind, start, end) by kind, then start; kinds number `KINDS`.

    Null and empty texts have no spans. Repeated rows stay repeated and each has its spans; rows without id too. Whole texts stay where
    they are read; only identifier-like words and their surroundings are shuffled. Other columns are ignored.
    """
    text = F.col("text")
    read = keyed_texts(docs, id_col, text_col)
    held = read.select("doc_id", "text", *(valid_matches(text, k).alias(k) for k in PATTERNS),
                       matches(text, IDENTIFIER, text.rlike("[0-9@]")).alias("words"))
    base = F.flatten(F.array(*(numbered(F.col(k), i) for i, k in enumerate(PATTERNS))))
    rows = stage(held.withColumn("base", base).select(F.monotonically_increasing_id().alias("row"), "doc_id", "base",
                                                      _mentions().alias("mentions")))
    mentions = stage(rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*"))
    strong = stage(learned_patterns(mentions))
    free = mentions.where("not seed").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    counted = free.groupBy("pattern").agg(F.count("*").alias("n")).join(strong.select("pattern"), "pattern")
    found = stage(salted_join(free, stage(counted), ["pattern"], ["row", "start"]).select("row", "start", "end").distinct())
    # The spans of one text.
    added = stage(found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        F.lit(len(PATTERNS)).alias("kind"), "start", "end"))).alias("added")))
    return (rows.select("row", "doc_id", "base").join(added, "row", "left")
            .select("doc_id", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")).alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the fixed kinds, the SHA-256 of their spans and all spans as text."""
    def written(spans):
        names = F.array(*(F.lit(k) for k in KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def count(k):
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)),
                        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
