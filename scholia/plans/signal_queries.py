"""Answer signals of the question items: detectors, audits and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia import fixed_values as V
from scholia.functions import text as X
from scholia.operators import grouping as G
from scholia.operators import signals as S
from scholia.plans import sql_text as Q
from scholia.plans.registry import query
from scholia.plans.tables import ITEMS, Tables, sql_sentences, sql_strip

OPTIONS = ("option_a", "option_b", "option_c")


def _first_letter(tests) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN '{l}'" for l, t in zip("ABC", tests)) + " END"


def _explicit(expr: str, loose: bool) -> str:
    verbs = "(?:choose|select|answer)\\s*[:\\s]+{L}" if loose else "(?:choose|select)\\s+{L}\\b|(?:answer|option|choice)\\s*:\\s*{L}\\b"
    ending = "correct|right|best" if loose else "correct|right|best|answer"
    pattern = f"(?i)\\b(?:correct\\s+answer\\s+is\\s+{{L}}|answer\\s+is\\s+{{L}}|{{L}}\\s+is\\s+(?:the\\s+)?(?:{ending})|{verbs})\\b"
    return _first_letter([f"regexp_matches({expr}, '{pattern.replace('{L}', l)}')" for l in "ABC"])


def _four_pass(min_share: float, loose: bool) -> str:
    """Common table expressions ending in `signal`."""
    o = [f"o{i}" for i in range(3)]
    matched = [f"len(list_filter(t{i}, lambda w: list_contains(stems, w) OR {Q.close('w', 'raw')}))" for i in range(3)]
    option = [sql_strip(f"regexp_replace(lower({x}), '\\.+$', '')") for x in o]
    return ITEMS + f""", i1 AS (SELECT *, {sql_strip('explanation')} AS txt, {sql_strip('option_a')} AS o0, {sql_strip('option_b')} AS o1, {sql_strip('option_c')} AS o2 FROM items),
 i2 AS (SELECT *, {sql_sentences('txt')} AS s FROM i1),
 i3 AS (SELECT *, lower(s[1]) AS first, array_to_string(s[1:3], ' ') AS focus FROM i2),
 i4 AS (SELECT *, {Q.stemmed('focus')} AS stems, {Q.words('focus', '[a-z]+')} AS raw, {', '.join(f"{Q.stemmed(f'o{i}')} AS t{i}" for i in range(3))} FROM i3),
 i5 AS (SELECT *, {', '.join(f'{m} AS m{i}' for i, m in enumerate(matched))} FROM i4),
 i6 AS (SELECT *, {', '.join(f"CASE WHEN len(t{i}) = 0 THEN 0.0::DOUBLE ELSE m{i}::DOUBLE / len(t{i}) END AS s{i}" for i in range(3))} FROM i5),
 i7 AS (SELECT *, greatest(s0, s1, s2) AS best FROM i6),
 i8 AS (SELECT *, {', '.join(f"CASE WHEN s{i} = best THEN m{i} ELSE -1 END AS h{i}" for i in range(3))},
   (s0 = best)::INT + (s1 = best)::INT + (s2 = best)::INT AS tied FROM i7),
 i9 AS MATERIALIZED (SELECT *, {_explicit('txt', loose)} AS p1, {_first_letter([f"length({x}) > 8 AND contains(first, {x})" for x in option])} AS p2,
   CASE WHEN best >= {min_share} AND best > 0 AND (tied = 1 OR greatest(h0, h1, h2) > least(CASE WHEN h0 >= 0 THEN h0 ELSE 9999 END, CASE WHEN h1 >= 0 THEN h1 ELSE 9999 END, CASE WHEN h2 >= 0 THEN h2 ELSE 9999 END))
        THEN {Q.highest('h0', 'h1', 'h2')} END AS p3,
   {_first_letter([Q.numbers_within(x, 'substr(txt, 1, 400)') for x in o])} AS p4 FROM i8),
 signal AS MATERIALIZED (SELECT doc_id, topic, stem, option_a, option_b, option_c, explanation, stored,
   CASE WHEN length(txt) >= 15 THEN coalesce(p1, p2, p3, p4) END AS letter,
   CASE WHEN length(txt) < 15 THEN 0 WHEN p1 IS NOT NULL THEN 1 WHEN p2 IS NOT NULL THEN 2 WHEN p3 IS NOT NULL THEN 3 WHEN p4 IS NOT NULL THEN 4 ELSE 0 END AS pass_no,
   CASE WHEN length(txt) < 15 THEN 0.0::DOUBLE WHEN p1 IS NOT NULL THEN 1.0::DOUBLE WHEN p2 IS NOT NULL THEN 0.9::DOUBLE WHEN p3 IS NOT NULL THEN best WHEN p4 IS NOT NULL THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM i9)"""


_SIGNAL = _four_pass(0.5, False)
_CLASS = ("CASE WHEN letter IS NULL THEN 'no_signal' WHEN letter = stored THEN 'ok' WHEN pass_no = 1 THEN 'p1_fix' WHEN pass_no = 2 THEN 'p2_fix' "
          "WHEN pass_no = 3 THEN 'p3_flag' ELSE 'ok' END")


@query("T1", f"WITH {_SIGNAL} SELECT doc_id, letter, pass_no, confidence FROM signal")
def four_pass_letters(t: Tables):
    return S.four_pass(t.items()).select("doc_id", "letter", "pass_no", "confidence")


@query("T2", f"WITH {_four_pass(0.0, True)} SELECT doc_id, letter, pass_no, confidence FROM signal")
def loose_letters(t: Tables):
    return S.four_pass(t.items(), min_share=0.0, loose=True).select("doc_id", "letter", "pass_no", "confidence")


@query("T21", f"WITH {_SIGNAL} SELECT doc_id, stored, letter AS detected, {_CLASS} AS class FROM signal")
def audit_rows(t: Tables):
    return (S.four_pass(t.items()).select("doc_id", "stored", F.col("letter").alias("detected"),
                                          S.audit_class(F.col("stored"), F.col("letter"), F.col("pass_no")).alias("class")))


@query("A13 A14", f"""WITH {_SIGNAL}, c AS MATERIALIZED (SELECT topic, {_CLASS} AS class FROM signal)
SELECT topic, count(*) AS total, count(*) FILTER (class = 'ok') AS ok, count(*) FILTER (class = 'p1_fix') AS p1_fixes, count(*) FILTER (class = 'p2_fix') AS p2_fixes,
  count(*) FILTER (class = 'p3_flag') AS p3_flags, count(*) FILTER (class = 'no_signal') AS no_signal FROM c GROUP BY topic""")
def audit_summary(t: Tables):
    rows = S.four_pass(t.items()).select("topic", S.audit_class(F.col("stored"), F.col("letter"), F.col("pass_no")).alias("class"))
    count = lambda c: F.count_if(F.col("class") == c)
    return rows.groupBy("topic").agg(F.count("*").alias("total"), count("ok").alias("ok"), count("p1_fix").alias("p1_fixes"),
                                     count("p2_fix").alias("p2_fixes"), count("p3_flag").alias("p3_flags"), count("no_signal").alias("no_signal"))


@query("A13 T1", f"""WITH {_SIGNAL}
SELECT topic, count(*) AS total, count(*) FILTER (short) AS no_explanation, count(*) FILTER (NOT short AND letter IS NULL) AS no_signal,
  {", ".join(f"count(*) FILTER (NOT short AND pass_no = {n} AND letter {op} stored) AS p{n}_{name}" for n in (1, 2, 3, 4) for op, name in (("=", "ok"), ("<>", "wrong")))}
FROM (SELECT *, length({sql_strip('explanation')}) < 15 AS short FROM signal) GROUP BY topic""")
def audit_passes(t: Tables):
    return G.pass_summary(S.four_pass(t.items()), "topic")


_BUCKETS = " UNION ALL ".join(
    [f"SELECT 'bucket' AS kind, {lo}::DOUBLE AS bound, count(*) FILTER (confidence >= {lo}::DOUBLE AND confidence < {hi}::DOUBLE) AS n FROM flags" for lo, hi in V.CONFIDENCE_BUCKETS]
    + [f"SELECT 'at_least', {x}::DOUBLE, count(*) FILTER (confidence >= {x}::DOUBLE) FROM flags" for x in V.CONFIDENCE_THRESHOLDS])


def _flags(t: Tables):
    rows = S.four_pass(t.items())
    return rows.where(S.audit_class(F.col("stored"), F.col("letter"), F.col("pass_no")) == "p3_flag")


@query("A12", f"WITH {_SIGNAL}, flags AS MATERIALIZED (SELECT * FROM signal WHERE {_CLASS} = 'p3_flag') {_BUCKETS}")
def confidence_histogram(t: Tables):
    return G.confidence_histogram(_flags(t), "confidence")


def _core(n: int) -> str:
    cols = ", ".join(f"list_distinct({Q.plain(o)}) AS w{i}" for i, o in enumerate(OPTIONS))
    return ITEMS + f""", core AS (SELECT *, list_distinct({Q.plain(Q.first_n('explanation', n))}) AS cw, {cols} FROM items),
 shares AS (SELECT *, {', '.join(f"CASE WHEN len(w{i}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(w{i}, cw))::DOUBLE / len(w{i}) END AS v{i}" for i in range(3))} FROM core)"""


@query("T3", f"WITH {_core(2)} SELECT doc_id, greatest(v0, v1, v2) > 0 AS has_signal FROM shares")
def overlap_gate(t: Tables):
    return S.has_overlap(t.items()).select("doc_id", "has_signal")


@query("T4", f"WITH {_core(2)} SELECT doc_id, CASE WHEN regexp_matches(stem, '(?i)\\b(?:{V.NEGATED_STEM})\\b') THEN {Q.lowest('v0', 'v1', 'v2')} ELSE {Q.highest('v0', 'v1', 'v2')} END AS letter FROM (SELECT * REPLACE (CASE WHEN doc_id % 4 = 0 THEN stem || ' Which is least likely?' ELSE stem END AS stem) FROM shares)")
def overlap_letters(t: Tables):
    asked = F.when(F.col("doc_id") % 4 == 0, F.concat("stem", F.lit(" Which is least likely?"))).otherwise(F.col("stem"))
    return S.overlap_letter(t.items().withColumn("stem", asked)).select("doc_id", "letter")


@query("T5 T7", f"WITH {ITEMS} SELECT doc_id, coalesce({Q.letter_patterns('explanation')}, '') AS stated, array_to_string({Q.negated_letters('explanation')}, '') AS negated FROM items")
def stated_letters(t: Tables):
    return t.items().select("doc_id", F.coalesce(S.pattern_letter(F.col("explanation")), F.lit("")).alias("stated"),
                            F.array_join(S.negated_letters(F.col("explanation")), "").alias("negated"))


def _opinion() -> str:
    take = lambda pattern: f"nullif(upper(regexp_extract(opening, '(?im){pattern}', 1)), '')"
    share = lambda i: (f"CASE WHEN len(t{i}) = 0 OR length(o{i}) < 8 THEN 0.0::DOUBLE WHEN contains(core, substr(o{i}, 1, 40)) THEN 1.0::DOUBLE "
                       f"ELSE len(list_filter(t{i}, lambda w: list_contains(ws, w)))::DOUBLE / len(t{i}) END AS s{i}")
    return ITEMS + f""", q AS (SELECT doc_id, substr(explanation, 1, 500) AS opening, regexp_matches(CASE WHEN doc_id % 4 = 0 THEN stem || ' Which is least likely?' ELSE stem END, '(?i)\\b(?:{V.NEGATED_STEM_WIDE})\\b') AS negated,
   {Q.repaired(f"lower({Q.first_n('explanation', 2)})")} AS core, {', '.join(f"{Q.repaired(f'lower({o})')} AS o{i}" for i, o in enumerate(OPTIONS))} FROM items),
 tk AS (SELECT *, {Q.stemmed('core')} AS ws, {', '.join(f"{Q.stemmed(f'o{i}')} AS t{i}" for i in range(3))} FROM q),
 sc AS (SELECT *, {', '.join(share(i) for i in range(3))}, coalesce({take('(?:^|\\n)\\s*(?:The\\s+)?(?:correct\\s+)?answer\\s*(?:is|:)\\s*([ABC])[.\\s]')},
   {take('\\b(?:choice\\s+)?([ABC])\\s+is\\s+correct\\b')}, {take('\\b([ABC])\\s+is\\s+the\\s+correct\\s+answer\\b')}, {take('\\bthe\\s+correct\\s+answer\\s+is\\s+([ABC])\\b')},
   CASE WHEN negated THEN {take('\\b(?:choice\\s+)?([ABC])\\s+is\\s+(?:incorrect|not\\s+accurate|inaccurate|wrong|false)\\b')} END,
   {take('\\b([ABC])\\s+is\\s+the\\s+(?:best|only\\s+)?(?:correct\\s+)?(?:answer|choice|option|statement)\\b')}) AS stated FROM tk),
 hl AS (SELECT *, greatest(s0, s1, s2) AS hi, negated AND least(s0, s1, s2) < 0.4::DOUBLE AND greatest(s0, s1, s2) > 0.5::DOUBLE AS turned,
   NOT negated AND greatest(s0, s1, s2) >= 0.5::DOUBLE AND 0.9::DOUBLE * greatest(s0, s1, s2) >= 0.7::DOUBLE AS plain FROM sc)"""


@query("T6 T5", f"""WITH {_opinion()} SELECT doc_id, coalesce(stated, CASE WHEN turned THEN {Q.lowest('s0', 's1', 's2')} WHEN plain THEN {Q.highest('s0', 's1', 's2')} END) AS letter,
  CASE WHEN stated IS NOT NULL THEN 1.0::DOUBLE WHEN turned THEN 0.9::DOUBLE WHEN plain THEN 0.9::DOUBLE * hi ELSE 0.0::DOUBLE END AS confidence FROM hl""")
def opinion_letters(t: Tables):
    """Every fourth question is negated, so that the rules turn round."""
    asked = F.when(F.col("doc_id") % 4 == 0, F.concat("stem", F.lit(" Which is least likely?"))).otherwise(F.col("stem"))
    return S.opinion_letter(t.items().withColumn("stem", asked)).select("doc_id", "letter", "confidence")


def _weighted() -> str:
    keys = ", ".join(f"{Q.key(o, n)} AS k{n}_{i}" for i, o in enumerate(OPTIONS) for n in (50, 30, 20))

    def score(i: int) -> str:
        hit = lambda n, least, where: f"(length(k{n}_{i}) >= {least} AND contains({where}, k{n}_{i}))"
        return (f"CASE WHEN list_contains(neg, '{'ABC'[i]}') OR length({sql_strip(OPTIONS[i])}) < 5 OR length(k50_{i}) < 5 THEN 0 ELSE "
                f"(CASE WHEN {hit(50, 10, 'f1')} THEN 4 WHEN {hit(30, 8, 'f1')} THEN 3 WHEN {hit(20, 6, 'f1')} THEN 2 ELSE 0 END) + "
                f"(CASE WHEN {hit(50, 10, 'f5')} THEN 2 WHEN {hit(30, 8, 'f5')} THEN 1 ELSE 0 END) + (CASE WHEN {hit(50, 10, 'fa')} THEN 1 ELSE 0 END) END AS s{i}")

    return ITEMS + f""", k AS (SELECT *, {keys}, {Q.negated_letters('explanation')} AS neg, lower(explanation) AS fa,
   lower(({sql_sentences(sql_strip('explanation'))})[1]) AS f1, lower({Q.first_n('explanation', 5)}) AS f5 FROM items),
 sc AS (SELECT *, {', '.join(score(i) for i in range(3))} FROM k),
 weighted AS MATERIALIZED (SELECT *, CASE WHEN greatest(s0, s1, s2) > 0 AND (list_sort([s0, s1, s2])[2] = 0 OR greatest(s0, s1, s2) - list_sort([s0, s1, s2])[2] >= 2)
   THEN {Q.highest('s0', 's1', 's2')} END AS p2 FROM sc)"""


@query("T8", f"WITH {_weighted()} SELECT doc_id, coalesce(p2, '') AS letter FROM weighted")
def weighted_text_letters(t: Tables):
    return S.weighted_text_letter(t.items()).select("doc_id", F.coalesce("letter", F.lit("")).alias("letter"))


def _framing(neg: str) -> str:
    return _first_letter([f"{sql_strip(o)} <> '' AND (regexp_matches(lower(explanation), '\\b{l}(?:\\)|\\b)[^\\p{{L}}\\p{{N}}_]{{0,10}}(?:is )?correct') OR "
                          f"(regexp_matches(lower(explanation), '\\bonly {l}\\b|\\b{l} only\\b') AND NOT list_contains({neg}, '{l.upper()}')))"
                          for l, o in zip("abc", OPTIONS)])


@query("T9", f"WITH {ITEMS} SELECT doc_id, coalesce({_framing(Q.negated_letters('explanation'))}, '') AS letter FROM items")
def framed_letters(t: Tables):
    return S.framing_letter(t.items()).select("doc_id", F.coalesce("letter", F.lit("")).alias("letter"))


def _hits(i: int) -> str:
    o = OPTIONS[i]
    found = lambda n, k: f"(contains(f3, {Q.key(o, n)}) OR contains(substr(lower(explanation), 1, {k}), {Q.key(o, n)}))"
    return f"CASE WHEN length({sql_strip(o)}) < 6 OR explanation = '' THEN 0 WHEN {found(50, 400)} THEN 2 WHEN {found(30, 300)} THEN 1 ELSE 0 END AS h{i}"


_HITS = ITEMS + f""", hits AS (SELECT *, {', '.join(_hits(i) for i in range(3))} FROM (SELECT *, lower({Q.first_n('explanation', 3)}) AS f3 FROM items))"""


@query("T10", f"WITH {_HITS} SELECT doc_id, CASE WHEN greatest(h0, h1, h2) > 0 THEN {Q.highest('h0', 'h1', 'h2')} ELSE '' END AS letter FROM hits")
def opening_hits(t: Tables):
    return S.opening_hit_letter(t.items()).select("doc_id", F.coalesce("letter", F.lit("")).alias("letter"))


_FORMS = [Q.option_form(o) for o in OPTIONS]
_CLOSED = ITEMS + f""", closed AS (SELECT doc_id, stored, option_a, option_b, CASE WHEN doc_id % 6 = 1 THEN (doc_id % 50) || '.5%' ELSE option_c END AS option_c,
   explanation || CASE doc_id % 3 WHEN 0 THEN ' Hence ' || option_b ELSE ' Hence ' || (doc_id % 50) || '.5 %.' END AS explanation FROM items),
 concl AS (SELECT *, {Q.final_number('explanation')} AS num, {Q.option_form(Q.last_sentence('explanation'))} AS last FROM closed),
 sig AS (SELECT *, CASE WHEN length(num) >= 2 THEN {_first_letter([f"{Q.compact_number(o)} = num" for o in OPTIONS])} END AS n,
   CASE WHEN {' + '.join(f"CAST(length({f}) >= 3 AND contains(last, {f}) AS INT)" for f in _FORMS)} = 1 THEN {_first_letter([f"length({f}) >= 3 AND contains(last, {f})" for f in _FORMS])} END AS s FROM concl)"""


@query("T11", f"""WITH {_CLOSED} SELECT doc_id, CASE WHEN NOT ok THEN '' WHEN n <> stored THEN n WHEN s <> stored THEN s ELSE '' END AS letter,
  CASE WHEN NOT ok THEN '' WHEN n <> stored THEN 'final_number' WHEN s <> stored THEN 'last_sentence' ELSE '' END AS reason FROM (SELECT *, length({sql_strip('explanation')}) >= 15 AS ok FROM sig)""")
def conclusion_letters(t: Tables):
    number = F.concat((F.col("doc_id") % 50).cast("string"), F.lit(".5"))
    rows = t.items().withColumns({
        "explanation": F.concat("explanation", F.lit(" Hence "), F.when(F.col("doc_id") % 3 == 0, F.col("option_b")).otherwise(F.concat(number, F.lit(" %.")))),
        "option_c": F.when(F.col("doc_id") % 6 == 1, F.concat(number, F.lit("%"))).otherwise(F.col("option_c"))})
    return S.conclusion_letter(rows).select("doc_id", F.coalesce("letter", F.lit("")).alias("letter"), F.coalesce("reason", F.lit("")).alias("reason"))


_PHRASE = [f"array_to_string((string_split_regex(lower({sql_strip(o)}), '\\s+'))[1:8], ' ')" for o in OPTIONS]


@query("T12", f"""WITH {ITEMS}, l AS (SELECT *, {', '.join(f"CASE WHEN length({p}) >= 5 AND contains(lower(substr(explanation, 1, 300)), {p}) THEN length({p}) ELSE 0 END AS l{i}" for i, p in enumerate(_PHRASE))},
   upper(coalesce(nullif(regexp_extract(explanation, '(?i)\\b([ABC])\\s+is\\s+(?:correct|right)', 1), ''), nullif(regexp_extract(explanation, '(?i)\\b(?:correct answer|answer)\\s+is\\s+([ABC])\\b', 1), ''))) AS st FROM items)
SELECT doc_id, CASE WHEN greatest(l0, l1, l2) > 0 THEN {Q.highest('l0', 'l1', 'l2')} ELSE coalesce(st, 'A') END AS letter,
  CASE WHEN greatest(l0, l1, l2) > 0 THEN 1 WHEN st IS NOT NULL THEN 2 ELSE 0 END AS pass_no FROM l""")
def opening_phrases(t: Tables):
    return S.opening_phrase_letter(t.items()).select("doc_id", "letter", "pass_no")


_ARB = _weighted() + f""", a1 AS (SELECT *, {Q.letter_patterns('explanation')} AS p1, {_framing('neg')} AS ex, CASE stored WHEN 'A' THEN option_a WHEN 'B' THEN option_b ELSE option_c END AS so FROM weighted),
 a2 AS (SELECT *, CASE WHEN p1 <> stored THEN 'P1' WHEN ex <> stored THEN 'EXPLICIT' WHEN p2 <> stored THEN 'P2' END AS method FROM a1),
 a3 AS MATERIALIZED (SELECT *, CASE method WHEN 'P1' THEN p1 WHEN 'EXPLICIT' THEN ex WHEN 'P2' THEN p2 END AS detected,
   CASE WHEN method IS NULL THEN CASE WHEN coalesce(p1 = stored, false) OR coalesce(ex = stored, false) OR coalesce(p2 = stored, false) THEN 'ok' ELSE 'no_signal' END
     WHEN method = 'P2' AND length({Q.alnum('so')}) >= 15 AND contains(lower({Q.first_n('explanation', 2)}), substr({Q.alnum('so')}, 1, 30)) THEN 'blocked' ELSE 'mismatch' END AS result FROM a2)"""


@query("T13", f"WITH {_ARB} SELECT doc_id, coalesce(method, '') AS method, coalesce(detected, '') AS detected, result FROM a3")
def arbitrated_signals(t: Tables):
    return S.arbitrate(t.items()).select("doc_id", F.coalesce("method", F.lit("")).alias("method"), F.coalesce("detected", F.lit("")).alias("detected"), "result")


@query("T13 A13", f"WITH {_ARB} SELECT result, coalesce(method, '') AS method, count(*) AS n FROM a3 GROUP BY ALL")
def arbitration_summary(t: Tables):
    return S.arbitrate(t.items()).groupBy("result", F.coalesce("method", F.lit("")).alias("method")).agg(F.count("*").alias("n"))


def _supported(letter: str) -> str:
    option = f"(CASE {letter} WHEN 'A' THEN option_a WHEN 'B' THEN option_b WHEN 'C' THEN option_c ELSE '' END)"
    return f"CASE WHEN {letter} IS NULL OR len({Q.support('explanation')}) = 0 THEN 0.0::DOUBLE ELSE {Q.contained(Q.support(option), Q.support('explanation'))} END"


@query("T15", f"""WITH {_SIGNAL}, sup AS (SELECT doc_id, {_supported('stored')} AS l, {_supported('letter')} AS r FROM signal)
SELECT doc_id, round_even(l, 6) AS left_support, round_even(r, 6) AS right_support, CASE WHEN r > l + 0.1::DOUBLE THEN 'right' WHEN l > r + 0.1::DOUBLE THEN 'left' ELSE 'ambiguous' END AS verdict FROM sup""")
def corroborated_letters(t: Tables):
    rows = S.corroboration(S.four_pass(t.items()), "stored", "letter")
    return rows.select("doc_id", F.bround("left_support", 6).alias("left_support"), F.bround("right_support", 6).alias("right_support"), "verdict")


@query("T16", f"""WITH {_SIGNAL}, o AS (SELECT *, CASE letter WHEN 'A' THEN option_a WHEN 'B' THEN option_b WHEN 'C' THEN option_c ELSE '' END AS op FROM signal)
SELECT doc_id, length({sql_strip('op')}) >= 8 AND length({Q.key('op', 30)}) >= 6 AND contains(lower(explanation), {Q.key('op', 30)}) AS confirmed FROM o""")
def confirmed_letters(t: Tables):
    return S.four_pass(t.items()).select("doc_id", S.confirmed_by_text(F.col("letter"), F.col("explanation")).alias("confirmed"))


def _cued(t: Tables):
    """Items with polarity and negation wording around the stored option."""
    opt = S.FIELDS.option_of(F.col("stored"))
    word = F.get(X.words(opt, "[a-z]{4,}"), F.lit(0))
    tail = (F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" It is not "), F.coalesce(word, F.lit("so")), F.lit(" and the lower value is negative.")))
            .when(F.col("doc_id") % 5 == 1, F.lit(" It decreases after the fall.")).otherwise(F.lit("")))
    lift = F.when(F.col("doc_id") % 5 <= 1, F.lit(" increasing higher before")).otherwise(F.lit(""))
    return t.items().withColumns({"stored_option": F.concat(opt, lift), "explanation": F.concat(F.col("explanation"), tail)})


_CUED = ITEMS + f""", c1 AS (SELECT *, {sql_strip("CASE stored WHEN 'A' THEN option_a WHEN 'B' THEN option_b ELSE option_c END")} AS opt FROM items),
 cued AS (SELECT doc_id, opt || CASE WHEN doc_id % 5 <= 1 THEN ' increasing higher before' ELSE '' END AS stored_option, explanation ||
   CASE doc_id % 5 WHEN 0 THEN ' It is not ' || coalesce(({Q.words('opt', '[a-z]{4,}')})[1], 'so') || ' and the lower value is negative.' WHEN 1 THEN ' It decreases after the fall.' ELSE '' END AS explanation FROM c1)"""


def _opposite_tests() -> str:
    return " OR ".join(f"(regexp_matches(lower(stored_option), '{a}') AND regexp_matches(substr(lower(explanation), 1, 600), '{b}'))" for a, b in V.OPPOSITES)


@query("T18", f"WITH {_CUED} SELECT doc_id, {_opposite_tests()} AS inverted FROM cued")
def inverted_polarity(t: Tables):
    return _cued(t).select("doc_id", S.polarity_inverted(F.col("stored_option"), F.col("explanation")).alias("inverted"))


_CUES = "|".join(V.NEAR_NEGATION_CUES)


@query("T20", f"""WITH {_CUED} SELECT doc_id, length({sql_strip('stored_option')}) >= 10 AND
   len(list_filter(({Q.words('stored_option', '[a-z]{4,}')})[1:4], lambda w: contains(lower(explanation), w))) >= 2 AND
   len(list_filter(({Q.words('stored_option', '[a-z]{4,}')})[1:3], lambda w: regexp_matches(lower(explanation), '(?:{_CUES}).{{0,50}}' || w))) > 0 AS suspect FROM cued""")
def negation_suspects(t: Tables):
    return _cued(t).select("doc_id", S.negation_suspect(F.col("stored_option"), F.col("explanation"), F.lit(0.9)).alias("suspect"))


def _triaged(t: Tables):
    flags = _flags(t)
    stored, detected = S.FIELDS.option_of(F.col("stored")), S.FIELDS.option_of(F.col("letter"))
    return (flags.withColumns({"negation": S.proximity_score(F.col("explanation"), stored, V.NEGATION_CUES),
                               "affirmation": S.proximity_score(F.col("explanation"), detected, V.AFFIRMATION_CUES),
                               "inverted": S.polarity_inverted(stored, F.col("explanation"))})
            .withColumn("verdict", S.flag_verdict(F.col("negation"), F.col("affirmation"), F.col("inverted"), F.col("confidence"))))


def _near(cues: str) -> str:
    """Whether a cue stands within 100 characters of `spot`."""
    around = "substr(low, greatest(spot - 100, 0) + 1, least(spot, 100) + 100)"
    return f"len(list_filter({Q.quoted(cues)}, lambda c: contains({around}, c))) > 0"


def _proximity(name: str, option: str, cues: list[str]) -> str:
    """Tables {name}_whole (hits of the option's opening) and {name}_words (hits of its first longer words), both as doc_id, n."""
    core = f"substr(regexp_replace({sql_strip(f'lower({option})')}, '\\.+$', ''), 1, 40)"
    return f"""{name}_o AS (SELECT doc_id, lower(explanation) AS low, substr({core}, 1, 20) AS opening,
   list_filter({Q.words(core, '[a-z]+')}, lambda w: length(w) > 3)[1:3] AS ws FROM flagged),
 {name}_at AS (SELECT doc_id, low, unnest(list_filter(range(0, length(low)), lambda i: substr(low, i + 1, length(opening)) = opening)) AS spot FROM {name}_o WHERE opening <> '' AND contains(low, opening)),
 {name}_w AS (SELECT doc_id, low, k, w, string_split(low, w) AS gaps FROM (SELECT doc_id, low, unnest(ws) AS w, unnest(range(0, len(ws))) AS k FROM {name}_o WHERE opening <> '' AND NOT contains(low, opening))),
 {name}_wat AS (SELECT doc_id, low, CAST(list_sum(list_transform(gaps[1:g], lambda p: length(p))) + (g - 1) * length(w) AS BIGINT) AS spot FROM (SELECT *, unnest(range(1, len(gaps))) AS g FROM {name}_w)),
 {name} AS (SELECT doc_id, count(*) FILTER ({_near(cues)}) AS n FROM (SELECT doc_id, low, spot FROM {name}_at UNION ALL SELECT doc_id, low, spot FROM {name}_wat) GROUP BY doc_id)"""


_FLAG_OPTION = lambda letter: f"(CASE {letter} WHEN 'A' THEN option_a WHEN 'B' THEN option_b WHEN 'C' THEN option_c ELSE '' END)"
_TRIAGED = f"""{_SIGNAL}, flagged AS MATERIALIZED (SELECT * FROM signal WHERE {_CLASS} = 'p3_flag'), {_proximity('neg_', _FLAG_OPTION('stored'), V.NEGATION_CUES)},
 {_proximity('aff_', _FLAG_OPTION('letter'), V.AFFIRMATION_CUES)},
 rated AS (SELECT doc_id, confidence, CAST(coalesce(neg_.n, 0) AS INTEGER) AS negation, CAST(coalesce(aff_.n, 0) AS INTEGER) AS affirmation,
   {_opposite_tests().replace('stored_option', _FLAG_OPTION('stored'))} AS inverted FROM flagged LEFT JOIN neg_ USING (doc_id) LEFT JOIN aff_ USING (doc_id)),
 triaged AS (SELECT *, CASE WHEN negation >= 2 OR (negation >= 1 AND (affirmation >= 1 OR inverted)) OR (inverted AND affirmation >= 1) THEN 'LIKELY_REAL'
   WHEN negation = 1 OR (inverted AND confidence >= 0.85::DOUBLE) THEN 'UNCERTAIN' ELSE 'LIKELY_FALSE_POSITIVE' END AS verdict FROM rated)"""


@query("T17 T19", f"WITH {_TRIAGED} SELECT doc_id, negation, affirmation, inverted, verdict FROM triaged")
def triaged_flags(t: Tables):
    return _triaged(t).select("doc_id", "negation", "affirmation", "inverted", "verdict")


@query("O7 T19", f"""WITH {_TRIAGED}, r AS (SELECT *, negation + affirmation + CAST(inverted AS INTEGER) + confidence AS rank_score FROM triaged)
SELECT doc_id, verdict, confidence, round_even(rank_score, 6) AS rank_score FROM r ORDER BY r.rank_score DESC, doc_id LIMIT 40""")
def flags_for_review(t: Tables):
    rows = _triaged(t)
    score = S.flag_rank(F.col("negation"), F.col("affirmation"), F.col("inverted"), F.col("confidence"))
    return G.rank_flags(rows, score, "doc_id", 40).select("doc_id", "verdict", "confidence", F.bround("rank_score", 6).alias("rank_score"))


@query("U5", f"""WITH {ITEMS} SELECT doc_id, array_to_string(list_sort(list_filter(['A', 'B', 'C'], lambda x: NOT list_contains({Q.negated_letters('explanation')}, x))), '') AS candidates FROM items""")
def letters_left(t: Tables):
    left = F.array_except(F.array(F.lit("A"), F.lit("B"), F.lit("C")), S.negated_letters(F.col("explanation")))
    return t.items().select("doc_id", F.array_join(F.array_sort(left), "").alias("candidates"))
