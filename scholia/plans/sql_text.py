"""SQL fragments that mirror the text functions, for the DuckDB side of the named queries."""

from __future__ import annotations

from scholia import fixed_values as V
from scholia.plans.tables import sql_sentences, sql_strip


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def words(expr: str, pattern: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{pattern}')"


def alnum(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({expr}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def without_tables(expr: str) -> str:
    lines = f"list_transform(string_split({expr}, chr(10)), lambda l: {sql_strip('l')})"
    return f"array_to_string(list_filter({lines}, lambda l: l <> '' AND NOT starts_with(l, '|')), ' ')"


def prefix_key(expr: str, n: int) -> str:
    return f"substr(trim(regexp_replace(lower({without_tables(expr)}), '\\s+', ' ', 'g')), 1, {n})"


def stem(w: str) -> str:
    cases = " ".join(f"WHEN length({w}) > {len(s) + 4} AND ends_with({w}, '{s}') THEN left({w}, length({w}) - {len(s)})"
                     for s in V.STEM_SUFFIXES)
    return f"CASE {cases} ELSE {w} END"


def stemmed(expr: str) -> str:
    kept = f"list_filter({words(expr, '[a-z]+')}, lambda w: length(w) > 3 AND NOT list_contains({quoted(V.STOP_WORDS)}, w))"
    return f"list_transform({kept}, lambda w: {stem('w')})"


def plain(expr: str) -> str:
    return f"list_filter({words(expr, '[a-z]+')}, lambda w: length(w) > 2 AND NOT list_contains({quoted(V.PLAIN_STOP_WORDS)}, w))"


def support(expr: str) -> str:
    return f"list_filter({words(expr, '[a-z0-9]{4,}')}, lambda w: NOT list_contains({quoted(V.SUPPORT_STOP_WORDS)}, w))"


def ligature_free(expr: str) -> str:
    return f"list_filter(list_transform({words(expr, '[a-z0-9]+')}, lambda w: regexp_replace(w, '{V.LIGATURES}', '', 'g')), lambda w: length(w) >= 2)"


def close(w: str, others: str) -> str:
    same = f"len(list_filter(range(1, least(length({w}), length(e)) + 1), lambda i: substr({w}, i, 1) = substr(e, i, 1)))"
    return (f"CASE WHEN length({w}) < 5 THEN list_contains({others}, {w}) ELSE len(list_filter({others}, lambda e: starts_with(e, {w}) OR starts_with({w}, e) "
            f"OR (length({w}) >= 6 AND length(e) >= 6 AND {same}::DOUBLE / greatest(length({w}), length(e)) >= 0.85))) > 0 END")


def first_n(expr: str, n: int) -> str:
    return f"array_to_string(({sql_sentences(sql_strip(expr))})[1:{n}], ' ')"


def last_sentence(expr: str) -> str:
    """A full stop between other than digits, then white space; the stop is dropped."""
    cut = f"regexp_replace(regexp_replace({sql_strip(expr)}, '(^|[^0-9])\\.(\\s+)', '\\1' || chr(1), 'g'), '(^|[^0-9])\\.(\\s+)', '\\1' || chr(1), 'g')"
    return sql_strip(f"list_extract(list_filter(string_split({cut}, chr(1)), lambda p: {sql_strip('p')} <> ''), -1)")


def option_form(expr: str) -> str:
    stripped = f"regexp_replace({sql_strip(expr)}, '\\.+$', '')"
    return f"lower(trim(regexp_replace({stripped}, '\\s+', ' ', 'g')))"


def compact_number(expr: str) -> str:
    return f"lower(regexp_replace(regexp_replace({sql_strip(expr)}, '\\.+$', ''), '\\s+', '', 'g'))"


def final_number(expr: str) -> str:
    found = f"regexp_extract({sql_strip(expr)}, '([$]?-?[0-9,]+\\.?[0-9]*\\s*%?)\\.?\\s*$', 1)"
    return compact_number(found)


def numbers(expr: str) -> str:
    raw = f"regexp_extract_all(lower({expr}), '[0-9,]+\\.?[0-9]*\\s*(?:%|bps?|pp)?')"
    tidy = sql_strip("replace(n, ',', '')")
    return f"list_distinct(list_filter(list_transform({raw}, lambda n: {tidy}), lambda n: n <> ''))"


def numbers_within(part: str, whole: str) -> str:
    return f"(len({numbers(part)}) > 0 AND list_has_all({numbers(whole)}, {numbers(part)}))"


def set_similarity(a: str, b: str) -> str:
    left, right = f"list_distinct({words(a, '[a-z]+')})", f"list_distinct({words(b, '[a-z]+')})"
    return (f"CASE WHEN len({left}) = 0 OR len({right}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({left}, {right}))::DOUBLE "
            f"/ greatest(len({left}), len({right})) END")


def contained(probe: str, ref: str) -> str:
    """Share of a word list that another covers, counting repeats."""
    shared = f"list_sum(list_transform(list_distinct({probe}), lambda w: least(len(list_filter({probe}, lambda x: x = w)), len(list_filter({ref}, lambda x: x = w)))))"
    return f"CASE WHEN len({probe}) = 0 THEN 0.0::DOUBLE ELSE coalesce({shared}, 0)::DOUBLE / len({probe}) END"


def highest(a: str, b: str, c: str) -> str:
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 'A' WHEN {b} >= {c} THEN 'B' ELSE 'C' END"


def lowest(a: str, b: str, c: str) -> str:
    return f"CASE WHEN {a} <= {b} AND {a} <= {c} THEN 'A' WHEN {b} <= {c} THEN 'B' ELSE 'C' END"


def key(option: str, n: int) -> str:
    return f"rtrim(substr({alnum(option)}, 1, {n}))"


def letter_patterns(expr: str) -> str:
    found = ", ".join(f"nullif(regexp_extract(lower({expr}), '{p}', 1), '')" for p in V.LETTER_PATTERNS)
    return f"upper(coalesce({found}))"


def negated_letters(expr: str) -> str:
    found = ", ".join(f"regexp_extract_all(lower({expr}), '{p.replace(chr(39), chr(39) * 2)}', 1)" for p in V.NEGATION_PATTERNS)
    return f"list_transform(list_sort(list_distinct(flatten([{found}]))), lambda x: upper(x))"


def repaired(expr: str) -> str:
    edge = "[^\\p{L}\\p{N}_]"
    for bad, good in V.LIGATURE_REPAIRS.items():
        for b, g in ((bad, good), (bad.capitalize(), good.capitalize())):
            for _ in range(2):  # neighbours share the character between them
                expr = f"regexp_replace({expr}, '(^|{edge}){b}($|{edge})', '\\1{g}\\2', 'g')"
    for bad, good in V.LIGATURE_PREFIX_REPAIRS.items():
        for b, g in ((bad, good), (bad.capitalize(), good.capitalize())):
            expr = f"regexp_replace({expr}, '(^|{edge}){b}', '\\1{g}', 'g')"
    return expr
