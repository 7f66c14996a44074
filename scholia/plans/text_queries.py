"""Normalisation, tokens, segments and record checks over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia import fixed_values as V
from scholia.functions import similarity as Sim
from scholia.functions import text as X
from scholia.operators import filters as Fl
from scholia.operators import segmentation as Seg
from scholia.plans import sql_text as Q
from scholia.plans.registry import query
from scholia.plans.tables import BOOKLETS, ITEMS, Tables, sql_sentences, sql_strip


def _docs(t: Tables):
    return t.raw("documents").select("doc_id", "text", "lang", "source")


@query("X1 X3", f"SELECT doc_id, {Q.prefix_key('text', 120)} AS key_120, {Q.prefix_key('text', 60)} AS key_60, md5({Q.without_tables('text')}) AS body FROM documents")
def prefix_keys(t: Tables):
    return _docs(t).select("doc_id", X.prefix_key(F.col("text"), 120).alias("key_120"), X.prefix_key(F.col("text"), 60).alias("key_60"),
                           F.md5(X.without_tables(F.col("text"))).alias("body"))


@query("X2", f"SELECT doc_id, md5({Q.alnum('text')}) AS form, CAST(length({Q.alnum('text')}) AS INTEGER) AS n FROM documents")
def alphanumeric_forms(t: Tables):
    return (_docs(t).select("doc_id", X.alnum_form(F.col("text")).alias("form"))
            .select("doc_id", F.md5("form").alias("form"), F.length("form").alias("n")))


_SANITIZED = sql_strip("regexp_replace(@, '[\\x{FFFD}\\x{00AD}\\x{200B}\\x00]', '', 'g')")


@query("X4", f"""SELECT page_id, md5({_SANITIZED.replace('@', 'html')}) AS clean,
  md5(regexp_replace({sql_strip("regexp_replace(" + _SANITIZED.replace('@', 'html') + ", '\\s*\\n\\s*', ' ', 'g')")}, '  +', ' ', 'g')) AS tidy FROM pages""")
def sanitized_pages(t: Tables):
    return t.raw("pages").select("page_id", F.md5(X.sanitize(F.col("html"))).alias("clean"), F.md5(X.tidy_lines(F.col("html"))).alias("tidy"))


@query("X5", f"SELECT doc_id, md5({Q.repaired('text')}) AS repaired, {Q.repaired('text')} <> text AS changed FROM (SELECT doc_id, text || ' Reation of oor, oor and cash ow; combination uctuates' AS text FROM documents)")
def repaired_ligatures(t: Tables):
    damaged = F.concat("text", F.lit(" Reation of oor, oor and cash ow; combination uctuates"))
    return (_docs(t).select("doc_id", damaged.alias("text")).withColumn("fixed", X.repair_ligatures(F.col("text")))
            .select("doc_id", F.md5("fixed").alias("repaired"), (F.col("fixed") != F.col("text")).alias("changed")))


@query("X6 X7 X9", f"""SELECT doc_id, CAST(len(b) AS INTEGER) AS bag_size, md5(array_to_string(list_sort(b), ' ')) AS bag,
  CAST(len(l) AS INTEGER) AS ligature_free_size, md5(array_to_string(list_sort(l), ' ')) AS ligature_free_bag, CAST(len(p) AS INTEGER) AS plain_size
FROM (SELECT doc_id, {Q.words('text', '[a-z0-9]{3,}')} AS b, {Q.ligature_free('text')} AS l, {Q.plain('text')} AS p FROM documents)""")
def word_bags(t: Tables):
    return (_docs(t).select("doc_id", X.bag_words(F.col("text")).alias("b"), X.ligature_free_words(F.col("text")).alias("l"),
                            X.plain_tokens(F.col("text")).alias("p"))
            .select("doc_id", F.size("b").alias("bag_size"), F.md5(Sim.word_count_text(F.col("b"))).alias("bag"),
                    F.size("l").alias("ligature_free_size"), F.md5(Sim.word_count_text(F.col("l"))).alias("ligature_free_bag"),
                    F.size("p").alias("plain_size")))


@query("X8 X9", f"""SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({Q.stemmed('text')}) AS token FROM documents) GROUP BY token""")
def stemmed_token_counts(t: Tables):
    word = F.col("word")  # one row per word, so the stemmer is compiled rather than run inside a lambda
    per_doc = (_docs(t).select("doc_id", F.explode(X.words(F.col("text"), "[a-z]+")).alias("word"))
               .where((F.length(word) > 3) & ~word.isin(V.STOP_WORDS)).select("doc_id", X.stem(word).alias("token"))
               .groupBy("token", "doc_id").agg(F.count("*").alias("n")))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


_CLOSE = f"list_filter({Q.stemmed('option_a')}, lambda w: {Q.close('w', Q.words('stem', '[a-z]+'))})"


@query("X10", f"WITH {ITEMS} SELECT doc_id, CAST(len({Q.stemmed('option_a')}) AS INTEGER) AS tokens, CAST(len({_CLOSE}) AS INTEGER) AS close FROM items")
def close_option_words(t: Tables):
    rows = t.items().select("doc_id", X.stemmed_tokens(F.col("option_a")).alias("w"), X.words(F.col("stem"), "[a-z]+").alias("s"))
    return rows.select("doc_id", F.size("w").alias("tokens"), F.size(F.filter("w", lambda w: X.close_word(w, F.col("s")))).alias("close"))


@query("X11 X12 X13 X14", f"""WITH {ITEMS} SELECT doc_id, {Q.set_similarity('stem', 'explanation')} AS stem_similarity,
  {Q.contained(Q.words('option_b', '[a-z0-9]{3,}'), Q.words('stem', '[a-z0-9]{3,}'))} AS containment,
  CASE WHEN len({Q.support('explanation')}) = 0 THEN 0.0::DOUBLE ELSE {Q.contained(Q.support('option_a'), Q.support('explanation'))} END AS support,
  round_even(({Q.set_similarity('option_a', 'option_b')} + {Q.set_similarity('option_b', 'option_c')} + {Q.set_similarity('option_c', 'option_a')}) / 3.0, 9) AS option_similarity
FROM items""")
def field_similarities(t: Tables):
    c = F.col
    return t.items().select(
        "doc_id", Sim.word_set_similarity(c("stem"), c("explanation")).alias("stem_similarity"),
        Sim.bag_containment(X.bag_words(c("option_b")), X.bag_words(c("stem"))).alias("containment"),
        Sim.option_support(c("explanation"), c("option_a")).alias("support"),
        F.bround(Sim.mean_option_similarity([c("option_a"), c("option_b"), c("option_c")], [c("option_b"), c("option_c"), c("option_a")]), 9)
        .alias("option_similarity"))


@query("X16", f"""SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, s[1] AS first, md5(array_to_string(s[1:3], ' ')) AS first_three, md5({Q.last_sentence('text')}) AS last
FROM (SELECT doc_id, text, {sql_sentences(sql_strip('text'))} AS s FROM documents)""")
def sentence_parts(t: Tables):
    return (_docs(t).select("doc_id", "text", X.sentences(F.col("text")).alias("s"))
            .select("doc_id", F.size("s").alias("sentences"), F.get("s", F.lit(0)).alias("first"),
                    F.md5(F.array_join(F.slice("s", 1, 3), " ")).alias("first_three"), F.md5(X.last_sentence(F.col("text"))).alias("last")))


# Without back references: of a run of n equal characters, a third stays and what is left over a multiple of three.
@query("X17", f"""WITH h AS (SELECT doc_id, {sql_strip("split_part(text, chr(10), 1)")} AS h FROM documents),
 d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(h, '(.)', '\\1\\1\\1', 'g') ELSE h END AS d FROM h),
 s AS (SELECT doc_id, d, replace(substr(d, 1, 60), ' ', '') AS s FROM d),
 n AS (SELECT doc_id, d, s, len(list_filter(range(1, greatest(length(s) - 2, 1) + 1, 3), lambda i: substr(s, i, 1) = substr(s, i + 1, 1)
         AND substr(s, i + 1, 1) = substr(s, i + 2, 1) AND length(substr(s, i + 2, 1)) > 0)) AS triples FROM s),
 c AS (SELECT doc_id, i, chars[i] AS ch FROM (SELECT doc_id, chars, unnest(range(1, len(chars) + 1)) AS i
         FROM (SELECT doc_id, regexp_extract_all(d, '.') AS chars FROM d))),
 r AS (SELECT doc_id, i, ch, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS run FROM c),
 p AS (SELECT doc_id, i, ch, row_number() OVER (PARTITION BY doc_id, ch, run ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id, ch, run) AS size FROM r),
 u AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) AS u FROM p WHERE k % 3 = 0 OR k >= size // 3 * 3 GROUP BY doc_id)
SELECT n.doc_id, CASE WHEN length(d) >= 9 AND triples > 0 AND triples >= floor(length(s) / 6) THEN u ELSE d END AS restored
FROM n LEFT JOIN u ON u.doc_id = n.doc_id""")
def untripled_headings(t: Tables):
    """Headings whose characters were tripled on every other document, restored."""
    heading = X.strip(F.get(F.split(F.col("text"), "\n"), F.lit(0)))
    damaged = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(heading, "(.)", "$1$1$1")).otherwise(heading)
    return _docs(t).select("doc_id", damaged.alias("damaged")).select("doc_id", X.untriple(F.col("damaged")).alias("restored"))


@query("X18 X19", f"""WITH {ITEMS} SELECT doc_id, array_to_string(list_sort({Q.numbers('n')}), ' ') AS numbers, {Q.numbers_within("CAST(doc_id % 100 AS VARCHAR) || '%'", 'n')} AS within,
  {Q.final_number('n')} AS final_number FROM (SELECT doc_id, explanation || ' It rose by 1,2' || (doc_id % 10) || '0.5 bps to ' || (doc_id % 100) || '%. It cost $' || doc_id || '.50' AS n FROM items)""")
def numeric_tokens(t: Tables):
    text = F.concat("explanation", F.lit(" It rose by 1,2"), (F.col("doc_id") % 10).cast("string"), F.lit("0.5 bps to "),
                    (F.col("doc_id") % 100).cast("string"), F.lit("%. It cost $"), F.col("doc_id").cast("string"), F.lit(".50"))
    return (t.items().select("doc_id", text.alias("n"))
            .select("doc_id", F.array_join(F.array_sort(X.numbers(F.col("n"))), " ").alias("numbers"),
                    X.numbers_within(F.concat((F.col("doc_id") % 100).cast("string"), F.lit("%")), F.col("n")).alias("within"),
                    X.final_number(F.col("n")).alias("final_number")))


_ALIASES = {"click": "interaction", "view": "interaction", "error": "failure", "purchase": "sale"}


@query("X20", """SELECT event_id, CASE WHEN contains(r, 'click') THEN 'interaction' WHEN contains(r, 'view') THEN 'interaction' WHEN contains(r, 'error') THEN 'failure'
  WHEN contains(r, 'purchase') THEN 'sale' ELSE raw END AS topic FROM (SELECT event_id, 'Type: ' || event_type AS raw, lower('Type: ' || event_type) AS r FROM events)""")
def canonical_topics(t: Tables):
    return t.raw("events").select("event_id", X.alias_topic(F.concat(F.lit("Type: "), F.col("event_type")), _ALIASES, "practice pack|answers|questions").alias("topic"))


_RULES = [(["tion of", "ment de"], "first"), (["und", "der "], "second"), (["que ", "las "], "third")]


@query("X21", """SELECT doc_id, CASE WHEN contains(lower(text), 'tion of') OR contains(lower(text), 'ment de') THEN 'first'
  WHEN contains(lower(text), 'und') OR contains(lower(text), 'der ') THEN 'second' WHEN contains(lower(text), 'que ') OR contains(lower(text), 'las ') THEN 'third' ELSE 'other' END AS topic FROM documents""")
def keyword_topics(t: Tables):
    return _docs(t).select("doc_id", X.first_rule(F.col("text"), _RULES, F.lit("other")).alias("topic"))


@query("X22", "SELECT p_partkey, CASE " + " ".join(f"WHEN p_size <= {b} THEN '{l}'" for b, l in V.MODULE_BOUNDS)
       + f" ELSE '{V.LAST_MODULE_TOPIC}' END AS topic FROM (SELECT p_partkey, p_size * 2 AS p_size FROM part)")
def module_topics(t: Tables):
    return t.raw("part").select("p_partkey", X.range_label(F.col("p_size") * 2, V.MODULE_BOUNDS, V.LAST_MODULE_TOPIC).alias("topic"))


@query("X23", f"""WITH {ITEMS} SELECT doc_id, CASE WHEN length(l) > 120 THEN substr(l, 1, 120) || '…' ELSE l END AS line,
  'Q: ' || substr(stem, 1, 60) || '… | Expl: ' || substr(explanation, 1, 80) || '…' AS snippet
FROM (SELECT doc_id, stem, explanation, {sql_strip("string_split(text, chr(10))[1]")} AS l FROM items)""")
def previews(t: Tables):
    return (t.items()
            .select("doc_id", X.first_line(F.col("text"), 120).alias("line"), X.snippet(F.col("stem"), F.col("explanation")).alias("snippet")))


_BREAKS = "replace(text, '$', '\\$')"
for _ in range(2):
    _BREAKS = f"regexp_replace({_BREAKS}, '([^\\n])\\n([^\\n])', '\\1  ' || chr(1) || '\\2', 'g')"
_BREAKS = f"replace(regexp_replace(regexp_replace({_BREAKS}, '^\\n([^\\n])', '  ' || chr(1) || '\\1'), '([^\\n])\\n$', '\\1  ' || chr(1)), chr(1), chr(10))"


@query("X24", f"SELECT doc_id, md5({_BREAKS}) AS prepared FROM documents")
def hard_break_text(t: Tables):
    return _docs(t).select("doc_id", F.md5(X.hard_breaks(F.col("text"))).alias("prepared"))


_INS = "'(?is)^(.*?{m})\\s*(.+)$'".format(m="[a-z]ent\\s+\\w+")


@query("X25", f"""SELECT doc_id, md5(CASE WHEN contains(text, block) THEN text
   WHEN regexp_matches(text, {_INS}) THEN {sql_strip(f"regexp_extract(text, {_INS}, 1)")} || chr(10) || chr(10) || block || chr(10) || chr(10) || {sql_strip(f"regexp_extract(text, {_INS}, 2)")}
   ELSE text || chr(10) || chr(10) || block END) AS patched FROM (SELECT doc_id, text, '| ' || doc_id || ' |' AS block FROM documents)""")
def inserted_blocks(t: Tables):
    block = F.concat(F.lit("| "), F.col("doc_id").cast("string"), F.lit(" |"))
    return _docs(t).select("doc_id", F.md5(X.insert_block(F.col("text"), block, "[a-z]ent\\s+\\w+")).alias("patched"))




@query("X26 F10", r"""WITH blocks AS (SELECT page_id, unnest(string_split_regex(html, '<p>')[2:]) AS block, unnest(range(1, len(string_split_regex(html, '<p>')))) AS no FROM pages),
 parts AS (SELECT page_id, no, trim(regexp_extract(block, '(?s)^(.*?)[.!?]', 1)) AS head, trim(regexp_extract(block, '(?s)^.*?[.!?]\s*(.*?)(?:</p>|<|$)', 1)) AS body FROM blocks)
SELECT page_id, CAST(no AS INTEGER) AS block_no, head, md5(body) AS body FROM parts WHERE length(head) >= 10 AND length(body) >= 2""")
def page_blocks(t: Tables):
    """Text blocks of a page behind their paragraph marker: opening sentence and body, incomplete ones dropped."""
    blocks = t.raw("pages").select("page_id", F.posexplode(X.segment_blocks(F.col("html"), "<p>")).alias("pos", "block"))
    return (blocks.select("page_id", (F.col("pos") + 1).alias("block_no"), F.trim(F.regexp_extract("block", "(?s)^(.*?)[.!?]", 1)).alias("head"),
                          F.trim(F.regexp_extract("block", "(?s)^.*?[.!?]\\s*(.*?)(?:</p>|<|$)", 1)).alias("body"))
            .where((F.length("head") >= 10) & (F.length("body") >= 2)).withColumn("body", F.md5("body")))


def _tidy(lines: str) -> str:
    clean = sql_strip(f"translate({lines}, '�' || chr(173) || chr(8203), '')")
    return f"regexp_replace({sql_strip(f"regexp_replace({clean}, '\\s*\\n\\s*', ' ', 'g')")}, '  +', ' ', 'g')"


def _part(state: str, drop: str = "") -> str:
    line = f"CASE WHEN pos = {state} THEN regexp_replace(line, '{drop}', '') ELSE line END" if drop else "line"
    return _tidy(f"coalesce(string_agg({line}, chr(10) ORDER BY pos) FILTER (WHERE part = '{state}'), '')")


_ITEM_SQL = f"""WITH {BOOKLETS}, l AS (SELECT doc, page_no, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM booklets),
 n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page_no, i) AS pos,
   CASE WHEN regexp_matches(line, '^[ \\t]*Question\\s+#\\d+\\s+of\\s+\\d+') THEN 'h' WHEN regexp_matches(line, '^[ \\t]*[ABC]\\)(?:\\s|$)') THEN regexp_extract(line, '[ABC]')
        WHEN regexp_matches(line, '^[ \\t]*(?i:explanation)[ \\t]*$') THEN 'e' ELSE '' END AS kind FROM l),
 b AS (SELECT *, sum(CASE WHEN kind = 'h' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos) AS block FROM n),
 a1 AS (SELECT doc, block, min(pos) FILTER (WHERE kind = 'A') AS a FROM b WHERE block > 0 GROUP BY ALL),
 b1 AS (SELECT b.doc, b.block, any_value(a) AS a, min(pos) FILTER (WHERE kind = 'B' AND pos > a) AS bb, min(pos) FILTER (WHERE kind = 'C' AND pos > a) AS c0,
               min(pos) FILTER (WHERE kind = 'e' AND pos > a) AS e FROM b JOIN a1 ON a1.doc = b.doc AND a1.block = b.block GROUP BY ALL),
 c1 AS (SELECT * FROM b1 WHERE bb < c0 AND (e IS NULL OR e > c0)),
 p AS (SELECT b.*, a, bb, c0, e, CASE WHEN pos < a THEN 's' WHEN pos < bb THEN 'a' WHEN pos < c0 THEN 'bb' WHEN e IS NULL OR pos < e THEN 'c0' ELSE 'e' END AS part
       FROM b JOIN c1 ON c1.doc = b.doc AND c1.block = b.block),
 f AS (SELECT doc, CAST(max(regexp_extract(line, '#([0-9]+)', 1)) FILTER (WHERE kind = 'h') AS BIGINT) AS number,
   {_tidy("string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE part = 's' AND kind <> 'h' AND NOT regexp_matches(line, '^[ \\t]*Question\\s+ID:\\s*[0-9]+'))")} AS stem,
   {_part('a', '^[ \\t]*A\\)')} AS option_a, {_part('bb', '^[ \\t]*B\\)')} AS option_b, {_part('c0', '^[ \\t]*C\\)')} AS option_c,
   {_tidy("regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE part = 'e' AND kind <> 'e'), ''), '(?s)\\(Module\\s+\\d+.*$', '')")} AS explanation,
   min(page_no) AS first_page, max(page_no) AS last_page FROM p GROUP BY doc, block)
SELECT * FROM f WHERE length(stem) >= 10 AND least(length(option_a), length(option_b), length(option_c)) >= 2"""


@query("X26 F10", _ITEM_SQL)
def extracted_items(t: Tables):
    """Whole items of the topics' booklets; most of them go over two pages."""
    return Seg.extract_items(t.booklets())


@query("X27", f"""WITH {ITEMS}, k AS (SELECT doc_id, (doc_id % 50 + 1) || '. ' || stored || ' ' || explanation || ' ' || (doc_id % 50 + 2) || '. Answer = ' || stored AS text FROM items),
 hits AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{{1,3}})\\.\\s+(?:Answer\\s*[=:]\\s*)?([A-C])\\b', 1)) AS number,
                 unnest(regexp_extract_all(text, '([0-9]{{1,3}})\\.\\s+(?:Answer\\s*[=:]\\s*)?([A-C])\\b', 2)) AS letter FROM k)
SELECT doc_id, CAST(number AS INTEGER) AS number, letter FROM hits""")
def answer_keys(t: Tables):
    text = F.concat((F.col("doc_id") % 50 + 1).cast("string"), F.lit(". "), F.col("stored"), F.lit(" "), F.col("explanation"), F.lit(" "),
                    (F.col("doc_id") % 50 + 2).cast("string"), F.lit(". Answer = "), F.col("stored"))
    return (t.items().select("doc_id", F.explode(X.answer_key(text)).alias("k"))
            .select("doc_id", F.col("k.number").cast("int").alias("number"), F.col("k.letter").alias("letter")))


_MARKS = """(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'A. Incorrect. ' || stem || ' B) incorrect.' WHEN 1 THEN explanation || ' ' || stored || '. Correct: ' || stem || '.'
  WHEN 2 THEN stored || ' correct' WHEN 3 THEN '(' || stored || ') ' || stem || ' This is correct.' ELSE explanation END AS m FROM items)"""


def _found(expr: str, pattern: str) -> str:
    return f"nullif(upper(regexp_extract({expr}, '{pattern}', 1)), '')"


_LEFT = "list_filter(['A', 'B', 'C'], lambda l: NOT CASE l " + " ".join(
    f"WHEN '{l}' THEN regexp_matches(m, '{X.MARKED_INCORRECT.replace('@', l)}')" for l in "ABC") + " END)"


@query("X27", f"""WITH {ITEMS} SELECT doc_id, coalesce({', '.join(_found('m', p) for p in X.MARKED_CORRECT)}, CASE WHEN len({_LEFT}) = 1 THEN ({_LEFT})[1] END,
    {_found(f"regexp_extract(m, '{X.BEFORE_CORRECT}', 1)", X.LAST_LABEL)}, '') AS letter,
  CASE WHEN {' OR '.join(f"regexp_matches(m, '{p}')" for p in X.MARKED_CORRECT)} THEN trim(regexp_replace(regexp_extract(m, '{X.MARKED_REASON}', 1), '\\s+', ' ', 'g')) ELSE '' END AS reason FROM {_MARKS}""")
def marked_letters(t: Tables):
    """Solutions that mark their options as correct or incorrect, in several ways."""
    c = F.col
    text = (F.when(c("doc_id") % 5 == 0, F.concat(F.lit("A. Incorrect. "), "stem", F.lit(" B) incorrect.")))
            .when(c("doc_id") % 5 == 1, F.concat("explanation", F.lit(" "), "stored", F.lit(". Correct: "), "stem", F.lit(".")))
            .when(c("doc_id") % 5 == 2, F.concat("stored", F.lit(" correct")))
            .when(c("doc_id") % 5 == 3, F.concat(F.lit("("), "stored", F.lit(") "), "stem", F.lit(" This is correct."))).otherwise(c("explanation")))
    rows = t.items().select("doc_id", text.alias("m"))
    return rows.select("doc_id", F.coalesce(X.marked_letter(F.col("m")), F.lit("")).alias("letter"), X.marked_reason(F.col("m")).alias("reason"))


# ---- Record checks ----

_TAILS = ["", " Consider the following table", " Use the following data: Which is right", " Given the following exhibit: 12 and 13.",
          " See the following figures | 1 |", " the following information."]


def _records(t: Tables):
    """Items whose stems end on an exhibit reference in several ways; some have bare names as options."""
    tail = F.get(F.array(*[F.lit(x) for x in _TAILS]), (F.col("doc_id") % 6).cast("int"))
    bare = F.col("doc_id") % 11 == 0
    option = lambda name, letter: F.when(bare, F.lit(f"Company {letter}")).otherwise(F.col(name)).alias(name)
    return t.items().select("doc_id", "topic", F.concat("stem", tail).alias("stem"), option("option_a", "A"), option("option_b", "B"),
                            option("option_c", "C"), "explanation", "stored")


_RECORDS = ITEMS + """, records AS (SELECT doc_id, topic, stem || list_extract(""" + Q.quoted(_TAILS) + """, CAST(doc_id % 6 + 1 AS INT)) AS stem,
  CASE WHEN doc_id % 11 = 0 THEN 'Company A' ELSE option_a END AS option_a, CASE WHEN doc_id % 11 = 0 THEN 'Company B' ELSE option_b END AS option_b,
  CASE WHEN doc_id % 11 = 0 THEN 'Company C' ELSE option_c END AS option_c, explanation, stored FROM items)"""


def _sql_bare(pattern: str) -> str:
    filled = f"list_filter([{', '.join(sql_strip(o) for o in ('option_a', 'option_b', 'option_c'))}], lambda o: o <> '')"
    return f"(len({filled}) > 0 AND len(list_filter({filled}, lambda o: NOT regexp_matches(o, '(?i){pattern}'))) = 0)"


_BARE, _BARE_WIDE = _sql_bare(V.NAME_ONLY_OPTION), _sql_bare(V.NAME_ONLY_OPTION_WIDE)
_INCOMPLETE = f"((regexp_matches(stem, '(?i){V.EXHIBIT_MENTION}') AND NOT contains(stem, '|')) OR ({_BARE} AND regexp_matches(stem, '(?i){V.DATA_WORD}')))"
_AFTER = sql_strip(f"regexp_extract({sql_strip('stem')}, '(?is){V.EXHIBIT_MENTION}(.*)$', 1)")
_TRULY = (f"(NOT contains(stem, '|') AND (regexp_matches({sql_strip('stem')}, '(?i){V.EXHIBIT_NOUN}[:.]?\\s*$') OR {_BARE} OR "
          f"(regexp_matches(stem, '(?i){V.EXHIBIT_MENTION}') AND (starts_with({_AFTER}, ':') OR {_AFTER} = ''))))")
_MISSING = f"(NOT contains(stem, '|') AND (regexp_matches(stem, '(?i){V.EXHIBIT_NOUN}{V.EXHIBIT_FLOW}') OR {_BARE_WIDE}))"


@query("F6 F7 F8", f"WITH {_RECORDS} SELECT doc_id, {_INCOMPLETE} AS incomplete, {_INCOMPLETE} AND {_TRULY} AS truly_incomplete, {_INCOMPLETE} AND NOT {_TRULY} AS false_positive, {_MISSING} AS truly_missing FROM records")
def incomplete_records(t: Tables):
    options = [F.col(o) for o in ("option_a", "option_b", "option_c")]
    rows = _records(t).select("doc_id", Fl.is_incomplete(F.col("stem"), options).alias("incomplete"),
                              Fl.is_truly_incomplete(F.col("stem"), options).alias("strict"), Fl.is_truly_missing(F.col("stem"), options).alias("truly_missing"))
    return rows.select("doc_id", "incomplete", (F.col("incomplete") & F.col("strict")).alias("truly_incomplete"),
                       (F.col("incomplete") & ~F.col("strict")).alias("false_positive"), "truly_missing")


_TABLE_REF = f"(regexp_matches(stem, '(?i){V.EXHIBIT_FLOW_WIDE}') AND NOT contains(stem, '|'))"
_SHORT = f"(length({sql_strip('explanation')}) < 50)"
_COMPLETENESS = f"CASE WHEN {_TABLE_REF} AND {_SHORT} THEN 'both' WHEN {_TABLE_REF} THEN 'table' WHEN {_SHORT} THEN 'explanation' ELSE 'ok' END"


@query("F9 A14", f"WITH {_RECORDS} SELECT topic, lacking, count(*) AS n FROM (SELECT topic, {_COMPLETENESS} AS lacking FROM records) GROUP BY ALL")
def completeness_by_topic(t: Tables):
    return (_records(t).select("topic", Fl.completeness(F.col("stem"), F.col("explanation")).alias("lacking"))
            .groupBy("topic", "lacking").agg(F.count("*").alias("n")))


@query("O9", f"""WITH {_RECORDS}, c AS (SELECT doc_id, {_COMPLETENESS} AS lacking, substr(stem, 1, 100) AS preview FROM records)
SELECT doc_id, lacking, preview, CAST(row_number() OVER (PARTITION BY lacking ORDER BY doc_id) AS INTEGER) AS place FROM c WHERE lacking <> 'ok' QUALIFY place <= 5""")
def completeness_samples(t: Tables):
    from scholia.operators.history import newest_rows
    rows = _records(t).select("doc_id", Fl.completeness(F.col("stem"), F.col("explanation")).alias("lacking"), F.substring("stem", 1, 100).alias("preview"))
    return newest_rows(rows.where(F.col("lacking") != "ok"), "lacking", [F.col("doc_id")], 5).withColumnRenamed("rank", "place")


_REASON = (f"CASE WHEN stored NOT IN ('A', 'B', 'C') THEN 'letter' WHEN length({sql_strip('stem')}) < 40 THEN 'stem' WHEN "
           + " OR ".join(f"length({sql_strip(o)}) < 20" for o in ("option_a", "option_b", "option_c"))
           + f" THEN 'option' WHEN length({sql_strip('explanation')}) < 15 THEN 'explanation' ELSE 'valid' END")


@query("F10", f"WITH {ITEMS} SELECT doc_id, {_REASON} AS reason FROM items")
def reject_reasons(t: Tables):
    reason = Fl.reject_reason(F.col("stem"), [F.col(o) for o in ("option_a", "option_b", "option_c")], F.col("stored"), F.col("explanation"),
                              min_stem=40, min_option=20)
    return t.items().select("doc_id", F.coalesce(reason, F.lit("valid")).alias("reason"))


@query("F11 F14", f"""SELECT doc_id, {sql_strip('text')} <> '' AND NOT regexp_matches({sql_strip('text')}, '[.?!:)”’"]$') AS dangling,
  contains(text, chr(10) || '|') OR contains(text, '|---') AS has_table, contains(text, chr(10) || '-') AS has_list FROM documents""")
def text_shape(t: Tables):
    return _docs(t).select("doc_id", X.ends_dangling(F.col("text")).alias("dangling"), X.has_table(F.col("text")).alias("has_table"),
                           X.has_list(F.col("text")).alias("has_list"))


@query("F2", "SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def document_by_id(t: Tables):
    return Fl.by_key(_docs(t).select("doc_id", "lang", "source"), "doc_id", 17)


@query("F3", """SELECT attempt_pos AS pos, doc_id, source FROM (SELECT event_id AS attempt_pos, CAST(json_extract_string(props, '$.k') AS INTEGER) AS q FROM events) JOIN documents ON doc_id = q""")
def questions_in_attempt_order(t: Tables):
    wanted = t.attempts().select(F.col("attempt_id").alias("pos"), F.col("question_id").cast("bigint").alias("doc_id"))
    return Fl.in_given_order(wanted, _docs(t).select("doc_id", "source"), "doc_id")


@query("F5", "SELECT doc_id FROM documents WHERE text ILIKE '%ation of%'")
def pattern_matches(t: Tables):
    return _docs(t).where(F.col("text").ilike("%ation of%")).select("doc_id")


_LOGIN = """CASE WHEN length(name) < 3 THEN 'too short' WHEN length(name) > 30 THEN 'too long' WHEN NOT regexp_matches(name, '^[A-Za-z0-9_À-ÿ]+$') THEN 'characters'
  WHEN length(suffix) <> 2 THEN 'suffix length' WHEN NOT regexp_matches(suffix, '^[A-Za-zÀ-ÿ]{2}$') THEN 'suffix characters' ELSE 'valid' END"""


@query("F13", f"""SELECT c_custkey, {_LOGIN} AS reason, lower(name) || lower(suffix) AS login FROM (SELECT c_custkey,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE replace(c_name, '#', '_') END AS name, substr(c_mktsegment, 1, CAST(1 + c_custkey % 2 AS INT)) AS suffix FROM customer)""")
def login_checks(t: Tables):
    rows = t.raw("customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("name"),
        F.substring(F.col("c_mktsegment"), F.lit(1), (1 + F.col("c_custkey") % 2).cast("int")).alias("suffix"))
    return rows.select("c_custkey", F.coalesce(Fl.login_reject_reason(F.col("name"), F.col("suffix")), F.lit("valid")).alias("reason"),
                       Fl.login_key(F.col("name"), F.col("suffix")).alias("login"))


_PHRASES = ["ation of", "the re", "und der", "que la"]


@query("F15", f"""SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'of') AS all_phrases,
  coalesce(list_extract(list_filter({Q.quoted(_PHRASES)}, lambda p: contains(lower(text), p)), 1), '') AS suspect FROM documents""")
def phrase_probes(t: Tables):
    return _docs(t).select("doc_id", Fl.has_all_phrases(F.col("text"), ["the", "of"]).alias("all_phrases"),
                           F.coalesce(Fl.first_phrase(F.col("text"), _PHRASES), F.lit("")).alias("suspect"))




@query("A16", f"WITH {ITEMS} SELECT stored, n, CAST(floor(100 * n / sum(n) OVER ()) AS INTEGER) AS pct FROM (SELECT stored, count(*) AS n FROM items GROUP BY stored)")
def letter_distribution(t: Tables):
    from scholia.operators.progress import letter_shares
    return letter_shares(t.items(), "stored")


@query("A21", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def extracted_counts(t: Tables):
    return t.raw("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("A19", f"""SELECT doc_id, key FROM (SELECT doc_id, {Q.prefix_key('text', 120)} AS key, row_number() OVER (PARTITION BY {Q.prefix_key('text', 120)} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def first_copies(t: Tables):
    from scholia.operators.grouping import keep_first
    return keep_first(_docs(t).select("doc_id", X.prefix_key(F.col("text"), 120).alias("key")), ["key"], "doc_id")
