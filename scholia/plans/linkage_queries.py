"""Linkage of unlabelled items to labelled ones, of benchmark passages to documents, and of answers to questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators import grouping as G
from scholia.operators import linkage as L
from scholia.plans import sql_text as Q
from scholia.plans.registry import query
from scholia.plans.tables import ITEMS, Tables


def _side(items, id_name: str):
    return items.select(F.col("doc_id").alias(id_name), "text", F.col("option_a").alias("a"), F.col("option_b").alias("b"), F.col("option_c").alias("c"))


def _sets(p: str, r: str) -> str:
    return "(" + " + ".join(f"({Q.set_similarity(f'{p}.option_{o}', f'{r}.option_{o}')})" for o in "abc") + ") / 3.0::DOUBLE"


_PREFIX = ITEMS + f""", k AS MATERIALIZED (SELECT doc_id, quality, option_a, option_b, option_c, unnest([120, 80, 60]) AS tier,
    unnest([{', '.join(Q.prefix_key('text', n) for n in (120, 80, 60))}]) AS key FROM items),
 hits AS (SELECT p.doc_id AS probe_id, r.doc_id AS ref_id, p.tier, {_sets('p', 'r')} AS rate, max(p.tier) OVER (PARTITION BY p.doc_id) AS top
          FROM k p JOIN k r ON p.key = r.key AND p.tier = r.tier WHERE p.quality IS NULL AND r.quality IS NOT NULL),
 prefix AS MATERIALIZED (SELECT probe_id, tier, ref_id FROM hits WHERE tier = top QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY rate DESC, ref_id) = 1)"""


@query("J4", f"WITH {_PREFIX} SELECT * FROM prefix")
def prefix_matches(t: Tables):
    return L.prefix_matches(_side(t.unlabelled(), "probe_id"), _side(t.labelled(), "ref_id"))


_VALID = _PREFIX + f""", valid AS (SELECT * FROM (SELECT probe_id, ref_id, tier, {Q.set_similarity(Q.prefix_key('p.text', 120), Q.prefix_key('r.text', 120))} AS similarity
  FROM prefix JOIN items p ON p.doc_id = probe_id JOIN items r ON r.doc_id = ref_id) WHERE similarity >= 0.4)"""


@query("J5", f"WITH {_VALID} SELECT * FROM valid")
def validated_prefix_matches(t: Tables):
    p, r = _side(t.unlabelled(), "probe_id"), _side(t.labelled(), "ref_id")
    return L.validated_matches(L.prefix_matches(p, r), p, r)


@query("J6", f"""WITH {_PREFIX}, p AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({Q.words('text', '[a-z]+')})) AS w FROM items WHERE quality IS NULL AND doc_id NOT IN (SELECT probe_id FROM prefix)),
 r AS MATERIALIZED (SELECT doc_id, unnest(list_distinct({Q.words('text', '[a-z]+')})) AS w FROM items WHERE quality IS NOT NULL),
 ps AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), rs AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1),
 c AS (SELECT p.doc_id AS probe_id, r.doc_id AS ref_id, count(*) AS n FROM p JOIN r USING (w) GROUP BY ALL)
SELECT probe_id, min(ref_id) AS ref_id FROM c JOIN ps ON ps.doc_id = probe_id JOIN rs ON rs.doc_id = ref_id WHERE c.n::DOUBLE / greatest(ps.n, rs.n) > 0.70::DOUBLE GROUP BY probe_id""")
def similar_fallbacks(t: Tables):
    p, r = _side(t.unlabelled(), "probe_id"), _side(t.labelled(), "ref_id")
    return L.similar_fallback(p.join(L.prefix_matches(p, r), "probe_id", "left_anti"), r)


def _bag_sql(probes: str, refs: str, accept: float = 0.5) -> str:
    """CTEs p (part, id, w, n), r, scored and bag: the best match per probe by brute force over shared words."""
    return f"""pw AS MATERIALIZED (SELECT part, id, w, count(*) AS n FROM (SELECT part, id, unnest({Q.words('txt', '[a-z0-9]{3,}')}) AS w FROM ({probes})) GROUP BY ALL),
 rw AS MATERIALIZED (SELECT part, id, w, count(*) AS n FROM (SELECT part, id, unnest({Q.words('txt', '[a-z0-9]{3,}')}) AS w FROM ({refs})) GROUP BY ALL),
 tot AS (SELECT part, id, sum(n) AS total FROM pw GROUP BY ALL),
 pairs AS (SELECT pw.part, pw.id AS probe_id, rw.id AS ref_id, sum(least(pw.n, rw.n)) AS shared FROM pw JOIN rw ON rw.part = pw.part AND rw.w = pw.w GROUP BY ALL),
 scored AS MATERIALIZED (SELECT probe_id, ref_id, shared::DOUBLE / total::DOUBLE AS score FROM pairs JOIN tot ON tot.id = probe_id)""" + f""",
 bag AS MATERIALIZED (SELECT probe_id, ref_id, score FROM scored WHERE score >= {accept} QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, ref_id) = 1)"""


_BENCH_BAG = _bag_sql("SELECT 0 AS part, item_id AS id, text AS txt FROM benchmark", "SELECT 0 AS part, doc_id AS id, text AS txt FROM documents")


@query("J7", f"WITH {_BENCH_BAG} SELECT item_id AS probe_id, coalesce(ref_id, -1) AS ref_id, coalesce(score, 0.0) AS score, CASE WHEN ref_id IS NULL THEN 'no_match' ELSE 'matched' END AS status FROM benchmark LEFT JOIN bag ON probe_id = item_id")
def passage_matches(t: Tables):
    probes = t.raw("benchmark").select(F.lit(0).alias("part"), F.col("item_id").alias("probe_id"), X.bag_words(F.col("text")).alias("words"))
    refs = t.raw("documents").select(F.lit(0).alias("part"), F.col("doc_id").alias("ref_id"), X.bag_words(F.col("text")).alias("words"))
    return L.bag_matches(probes, refs).select("probe_id", F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"), "status")


def _record_bags(t: Tables, labelled: bool, id_name: str):
    """Whole texts by topic, with or without a label."""
    rows = t.records().where(F.col("quality").isNotNull() if labelled else F.col("quality").isNull())
    return rows.select(F.col("topic").alias("part"), F.col("doc_id").alias(id_name), X.bag_words(F.col("text")).alias("words"))


_ITEM_BAG = ("lab AS (SELECT d.*, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), "
             + _bag_sql("SELECT source AS part, doc_id AS id, text AS txt FROM lab WHERE quality IS NULL",
                        "SELECT source AS part, doc_id AS id, text AS txt FROM lab WHERE quality IS NOT NULL"))


@query("J7", f"WITH {_ITEM_BAG} SELECT doc_id AS probe_id, source AS part, coalesce(ref_id, -1) AS ref_id, coalesce(score, 0.0) AS score, CASE WHEN ref_id IS NULL THEN 'no_match' ELSE 'matched' END AS status FROM lab LEFT JOIN bag ON probe_id = doc_id WHERE quality IS NULL")
def item_matches_in_topic(t: Tables):
    return (L.bag_matches(_record_bags(t, False, "probe_id"), _record_bags(t, True, "ref_id"))
            .select("probe_id", "part", F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"), "status"))


_RETRY = (_ITEM_BAG + """, pw2 AS MATERIALIZED (SELECT id, w, n FROM pw WHERE id NOT IN (SELECT probe_id FROM bag)),
 scored2 AS MATERIALIZED (SELECT probe_id, ref_id, shared::DOUBLE / total::DOUBLE AS score FROM
   (SELECT pw2.id AS probe_id, rw.id AS ref_id, sum(least(pw2.n, rw.n)) AS shared FROM pw2 JOIN rw ON rw.w = pw2.w GROUP BY ALL) JOIN tot ON tot.id = probe_id),
 bag2 AS (SELECT probe_id, ref_id, score FROM scored2 WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, ref_id) = 1)""")


@query("J18", f"WITH {_RETRY} SELECT doc_id AS probe_id, coalesce(b.ref_id, c.ref_id, -1) AS ref_id, coalesce(b.score, c.score, 0.0) AS score, CASE WHEN b.ref_id IS NULL THEN 2 ELSE 1 END AS round FROM lab LEFT JOIN bag b ON b.probe_id = doc_id LEFT JOIN bag2 c ON c.probe_id = doc_id WHERE quality IS NULL")
def retried_item_matches(t: Tables):
    p, r = _record_bags(t, False, "probe_id"), _record_bags(t, True, "ref_id")
    return (L.retry_matches(L.bag_matches(p, r), p, r)
            .select("probe_id", F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"), "round"))


def _gate_side(items, id_name: str):
    c = F.concat_ws(" ", "stem", "option_a", "option_b", "option_c")
    return items.select(F.col("topic").alias("part"), F.col("doc_id").alias(id_name), X.bag_words(c).alias("words"),
                        F.col("option_a").alias("a"), F.col("option_b").alias("b"), F.col("option_c").alias("c"))


@query("J8 X15")
def gated_item_matches(t: Tables):
    """Sequence ratios have no SQL form; the tests compare this with brute force."""
    return L.gated_matches(_gate_side(t.unlabelled(), "probe_id"), _gate_side(t.labelled(), "ref_id"))


def _stems(items, id_name: str):
    return items.select(F.col("doc_id").alias(id_name), F.col("stem").alias("text"))


_GRAM_LIST = "list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))"


def _gram_side(name: str, condition: str) -> str:
    return f"""{name}f AS (SELECT form, min(doc_id) AS id FROM (SELECT doc_id, {Q.alnum('stem')} AS form FROM items WHERE quality {condition}) GROUP BY form),
 {name} AS MATERIALIZED (SELECT id, unnest({_GRAM_LIST}) AS gram FROM (SELECT id, string_split(form, ' ') AS ws FROM {name}f) WHERE len(ws) >= 4)"""


@query("W9 J9", f"""WITH {ITEMS}, {_gram_side('p', 'IS NULL')}, {_gram_side('r', 'IS NOT NULL')}
SELECT * FROM (SELECT p.id AS probe_id, r.id AS ref_id, count(*) AS shared FROM p JOIN r USING (gram) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY probe_id ORDER BY shared DESC, ref_id) <= 30""")
def gram_candidates(t: Tables):
    return (L.gram_candidates(_stems(t.unlabelled(), "probe_id"), _stems(t.labelled(), "ref_id"), top=30)
            .select(F.col("p_rep").alias("probe_id"), F.col("r_rep").alias("ref_id"), "shared"))


@query("J9 W8 X15")
def gram_matches(t: Tables):
    """Sequence ratios have no SQL form; the tests compare this with brute force."""
    return L.gram_matches(_stems(t.unlabelled(), "probe_id"), _stems(t.labelled(), "ref_id"))


@query("J10 X15")
def fuzzy_matches(t: Tables):
    """Sequence ratios have no SQL form; the tests compare this with brute force."""
    return L.fuzzy_matches(_stems(t.unlabelled(), "probe_id"), _stems(t.labelled(), "ref_id"))


@query("W8 J7", f"""WITH {_BENCH_BAG} SELECT probe_id, ref_id, score, coalesce(nxt, 0.0) AS second FROM (
  SELECT probe_id, ref_id, score, lead(score) OVER (PARTITION BY probe_id ORDER BY score DESC, ref_id) AS nxt, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, ref_id) AS rn FROM scored WHERE score >= 0.5) WHERE rn = 1""")
def best_with_runner_up(t: Tables):
    probes = t.raw("benchmark").select(F.lit(0).alias("part"), F.col("item_id").alias("probe_id"), X.bag_words(F.col("text")).alias("words"))
    refs = t.raw("documents").select(F.lit(0).alias("part"), F.col("doc_id").alias("ref_id"), X.bag_words(F.col("text")).alias("words"))
    return L.best_match(L.overlap_pairs(probes, refs, 0.5)).drop("part")


# ---- Questions and answers ----

def _questions(t: Tables):
    rows = t.turns()
    q = rows.where(F.col("role") == "user").select((F.col("conv_id") % 10).alias("file"), F.col("conv_id").alias("topic"), F.col("turn").alias("number"), F.md5("text").alias("question"))
    a = rows.where(F.col("role") == "assistant").select(
        (F.col("conv_id") % 10).alias("file"), F.when(F.col("conv_id") % 4 == 0, -1).otherwise(F.col("conv_id")).alias("topic"),
        (F.col("turn") - 1).alias("number"), F.md5("text").alias("answer"))
    return q, a


_QA = """q AS (SELECT conv_id % 10 AS file, conv_id AS topic, turn AS number, md5(text) AS question FROM conversations WHERE role = 'user'),
 a AS (SELECT conv_id % 10 AS file, CASE WHEN conv_id % 4 = 0 THEN -1 ELSE conv_id END AS topic, turn - 1 AS number, md5(text) AS answer FROM conversations WHERE role = 'assistant')"""


@query("J11", f"""WITH {_QA}, one AS (SELECT file, number, min(answer) AS only_answer FROM a GROUP BY ALL HAVING count(*) = 1)
SELECT q.file, q.topic, q.number, question, coalesce(a.answer, only_answer, '') AS answer, CASE WHEN a.answer IS NOT NULL THEN 'topic' WHEN only_answer IS NOT NULL THEN 'number' ELSE 'none' END AS how
FROM q LEFT JOIN a ON a.file = q.file AND a.topic = q.topic AND a.number = q.number LEFT JOIN one ON one.file = q.file AND one.number = q.number""")
def paired_answers(t: Tables):
    q, a = _questions(t)
    return L.pair_answers(q, a).withColumns({"answer": F.coalesce("answer", F.lit("")), "how": F.coalesce("how", F.lit("none"))})


@query("J12", """WITH q AS (SELECT conv_id, md5(text) AS question, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'user'),
 a AS (SELECT conv_id, md5(text) AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant')
SELECT q.conv_id, q.place, question, answer FROM q JOIN a ON a.conv_id = q.conv_id AND a.place = q.place AND a.n = q.n""")
def aligned_turns(t: Tables):
    side = lambda role, name: t.turns().where(F.col("role") == role).select("conv_id", "turn", F.md5("text").alias(name))
    return L.align_by_position(side("user", "question"), side("assistant", "answer"), "conv_id", "turn").select("conv_id", "place", "question", "answer")


_PAGE_KEY = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query("J16", f"""WITH n AS (SELECT item_id, {_PAGE_KEY} AS txt FROM benchmark), r AS (SELECT item_id, trim(substr(txt, 1, 70)) AS pre, trim(right(txt, 70)) AS post, trim(substr(txt, 1, 50)) AS op FROM n),
 d AS MATERIALIZED (SELECT doc_id, {_PAGE_KEY} AS txt FROM documents),
 h AS (SELECT item_id, doc_id, contains(txt, pre) AND length(pre) >= 10 AS b, contains(txt, post) AND length(post) >= 10 AS a, contains(txt, op) AND length(op) >= 20 AS o, length(post) AS n FROM r, d),
 tiers AS (SELECT item_id, doc_id, CASE WHEN a AND b THEN 1 WHEN a AND n >= 15 THEN 2 WHEN o THEN 3 WHEN b THEN 4 END AS tier FROM h)
SELECT item_id AS record_id, tier, doc_id AS page_no FROM tiers WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tier, doc_id) = 1""")
def located_passages(t: Tables):
    """The document, taken as a page, that holds each benchmark passage."""
    flat = F.trim(F.regexp_replace(F.lower("text"), "\\s+", " "))
    records = t.raw("benchmark").select(F.lit(0).alias("part"), F.col("item_id").alias("record_id"), flat.alias("_t")).select(
        "part", "record_id", F.trim(F.substring("_t", 1, 70)).alias("before"), F.trim(F.right("_t", F.lit(70))).alias("after"), F.trim(F.substring("_t", 1, 50)).alias("opening"))
    pages = t.raw("documents").select(F.lit(0).alias("part"), F.col("doc_id").alias("page_no"), flat.alias("text"))
    return L.locate_pages(records, pages).select("record_id", "tier", "page_no")


_WORD_FLAT = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query("J16", f"""WITH r AS (SELECT item_id * 2 + back AS record_id, list_filter(string_split(left(CASE WHEN back = 0 THEN {_WORD_FLAT} ELSE trim(right({_WORD_FLAT}, 60)) END, 50), ' '), lambda w: w <> '')[1:8] AS ws
   FROM benchmark, (VALUES (0), (1)) v(back)),
 d AS (SELECT doc_id AS page_no, {_WORD_FLAT} AS txt FROM documents),
 h AS (SELECT record_id, page_no, len(ws) AS m, len(list_filter(ws, lambda w: contains(txt, w))) AS n8, len(list_filter(ws[1:4], lambda w: contains(txt, w))) AS n4 FROM r, d WHERE len(ws) > 0),
 k AS (SELECT record_id, page_no, CASE WHEN n8 >= least(6, m) THEN 1 WHEN n4 >= 3 THEN 2 END AS tier FROM h)
SELECT record_id, tier, page_no FROM k WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY tier, page_no) = 1""")
def word_hit_pages(t: Tables):
    """The first document, taken as a page, that holds most words of each benchmark passage's opening, and of its end."""
    flat = X.collapse(F.lower(X.blank_if_null(F.col("text"))))
    records = t.raw("benchmark").select(F.lit(0).alias("part"), "item_id", flat.alias("_t")).select("part", F.inline(F.array(
        F.struct((F.col("item_id") * 2).alias("record_id"), F.col("_t").alias("text")),
        F.struct((F.col("item_id") * 2 + 1).alias("record_id"), F.trim(F.right("_t", F.lit(60))).alias("text")))))
    pages = t.raw("documents").select(F.lit(0).alias("part"), F.col("doc_id").alias("page_no"), "text")
    return L.locate_by_words(records, pages).select("record_id", "tier", "page_no")


@query("J17", """SELECT doc_id, page_id FROM documents JOIN pages ON CAST(doc_id AS VARCHAR) = regexp_extract(url, '/([0-9]+)', 1) WHERE regexp_extract(source, 'src([0-9]+)', 1) <> ''""")
def pages_by_number(t: Tables):
    docs = t.raw("documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("name"))
    return L.resolve_by_key(docs, t.raw("pages").select("page_id", "url"), "name", "url", "Document ([0-9]+)", "/([0-9]+)").select("doc_id", "page_id")


_KNOWN = [("tion of the", "A", "B"), ("of the and", "B", "C"), ("for the", "C", "A"), ("und der", "A", "C"), ("que la", "B", "A")]


@query("J19", f"""WITH {ITEMS}, k(pattern, expected, right_letter) AS (VALUES {', '.join(str(p) for p in _KNOWN)}),
 f AS (SELECT pattern, expected, right_letter, arg_min(doc_id, doc_id) AS doc_id, arg_min(stored, doc_id) AS stored FROM k JOIN items ON contains(lower(text), pattern) GROUP BY ALL)
SELECT doc_id, pattern, expected, right_letter FROM f WHERE stored = expected""")
def known_corrections(t: Tables):
    return L.known_corrections(t.items(), "text", "stored", _KNOWN, "doc_id")


# ---- Plain joins and sets ----

@query("J1 A14", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' ELSE 'found' END AS status FROM
  (SELECT CAST(c_custkey AS BIGINT) AS id FROM customer) c LEFT JOIN documents d ON d.doc_id = c.id) GROUP BY status""")
def manifest_coverage(t: Tables):
    """Ids of a stage table found in the bank, and those without a record."""
    wanted = t.raw("customer").select(F.col("c_custkey").alias("doc_id"))
    bank = t.raw("documents").select("doc_id", F.lit(True).alias("found"))
    return (wanted.join(bank, "doc_id", "left").groupBy(F.when(F.col("found"), "found").otherwise("missing").alias("status")).agg(F.count("*").alias("n")))


@query("J2 U4", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def open_reviews(t: Tables):
    return t.raw("documents").select("doc_id", "source").join(t.raw("labels").select("doc_id"), "doc_id", "left_anti")


@query("J3", """SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS question_id, EXISTS (SELECT 1 FROM events w WHERE w.user_id = e.user_id AND w.value >= 35 AND
  json_extract_string(w.props, '$.k') = json_extract_string(e.props, '$.k')) AS was_wrong FROM events e""")
def wrong_set_flags(t: Tables):
    a = t.attempts()
    wrong = a.where(~F.col("is_correct")).select("user_id", "question_id").distinct().withColumn("was_wrong", F.lit(True))
    return (a.select("user_id", "question_id").distinct().join(wrong, ["user_id", "question_id"], "left")
            .withColumn("was_wrong", F.coalesce("was_wrong", F.lit(False))))


@query("U1", "SELECT 'document' AS kind, doc_id AS id, md5(text) AS text FROM documents UNION ALL SELECT 'benchmark', item_id, md5(text) FROM benchmark UNION ALL SELECT 'page', page_id, md5(html) FROM pages")
def all_sources(t: Tables):
    part = lambda name, key, col: t.raw(name).select(F.lit({"documents": "document", "pages": "page"}.get(name, name)).alias("kind"), F.col(key).alias("id"), F.md5(col).alias("text"))
    return part("documents", "doc_id", "text").unionByName(part("benchmark", "item_id", "text")).unionByName(part("pages", "page_id", "html"))


@query("U2", f"WITH {_QA} SELECT file, number FROM q INTERSECT SELECT file, number FROM a")
def shared_numbers(t: Tables):
    q, a = _questions(t)
    return q.select("file", "number").intersect(a.select("file", "number"))


@query("A19 J1", """SELECT turn, role, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY ALL""")
def distinct_turns(t: Tables):
    return t.turns().select("conv_id", "turn", "role").distinct().groupBy("turn", "role").agg(F.count("*").alias("n"))


# ---- Votes ----

_VOTES = ITEMS + """, votes AS (SELECT topic || '-' || (doc_id % 10) AS record, stored AS letter FROM items),
 c0 AS (SELECT record, letter, count(*) AS votes FROM votes GROUP BY ALL), c AS (SELECT *, sum(votes) OVER (PARTITION BY record) AS total FROM c0)"""


@query("A17", f"""WITH {_VOTES} SELECT record, letter, votes, CAST(total AS BIGINT) AS total, round_even(votes::DOUBLE / total::DOUBLE, 4) AS agreement,
  CASE WHEN votes::DOUBLE / total::DOUBLE >= 0.8 THEN 'HIGH' WHEN votes::DOUBLE / total::DOUBLE >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM c QUALIFY row_number() OVER (PARTITION BY record ORDER BY votes DESC, letter) = 1""")
def voted_letters(t: Tables):
    votes = t.items().select(F.concat_ws("-", "topic", (F.col("doc_id") % 10).cast("string")).alias("record"), F.col("stored").alias("letter"))
    return G.majority_vote(votes, "record", "letter")
