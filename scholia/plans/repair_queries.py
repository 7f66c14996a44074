"""Comparison and repair of linked items, and state, payload and page-cache operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions import scalars as M
from scholia.functions import similarity as Sim
from scholia.functions import text as X
from scholia.operators import grouping as G
from scholia.operators import history as H
from scholia.operators import linkage as L
from scholia.operators import repair as R
from scholia.operators import signals as S
from scholia.plans import sql_text as Q
from scholia.plans.linkage_queries import _PREFIX, _side
from scholia.plans.registry import query
from scholia.plans.tables import ATTEMPTS, ITEMS, SESSIONS, Tables, sql_sentences, sql_strip

FIELDS = ["stem", "option_a", "option_b", "option_c", "explanation"]


def _linked(t: Tables):
    """Unlabelled items next to the labelled item with the same opening, fields prefixed old_ / new_."""
    m = L.prefix_matches(_side(t.unlabelled(), "probe_id"), _side(t.labelled(), "ref_id")).select("probe_id", "ref_id")
    side = lambda items, id_name, tag: items.select(F.col("doc_id").alias(id_name), *[F.col(f).alias(f"{tag}_{f}") for f in [*FIELDS, "stored"]],
                                                    *([F.col("topic")] if tag == "old" else []))
    return m.join(side(t.unlabelled(), "probe_id", "old"), "probe_id").join(side(t.labelled(), "ref_id", "new"), "ref_id")


_LINKED = _PREFIX + f""", linked AS MATERIALIZED (SELECT probe_id, ref_id, p.topic, {', '.join(f'p.{f} AS old_{f}, r.{f} AS new_{f}' for f in [*FIELDS, 'stored'])}
  FROM prefix JOIN items p ON p.doc_id = probe_id JOIN items r ON r.doc_id = ref_id)"""


def _sql_bag(expr: str) -> str:
    return f"array_to_string(list_sort({Q.words(expr, '[a-z0-9]{3,}')}), ' ')"


def _sql_loose(expr: str) -> str:
    return f"array_to_string(list_sort({Q.ligature_free(expr)}), ' ')"


def _sql_cmp(f: str) -> str:
    a, b = sql_strip(f"old_{f}"), sql_strip(f"new_{f}")
    return f"CASE WHEN {b} = '' THEN 'missing' WHEN {a} = {b} THEN 'exact' WHEN {_sql_loose(a)} = {_sql_loose(b)} THEN 'ligatures' ELSE 'diff' END AS {f}_cmp"


_COMPARED = _LINKED + f", compared AS MATERIALIZED (SELECT *, {', '.join(_sql_cmp(f) for f in FIELDS)} FROM linked)"
_STATUS = ("CASE WHEN new_stored IS NOT NULL AND old_stored <> new_stored THEN 'answer_diff' WHEN " + " OR ".join(f"{f}_cmp = 'diff'" for f in FIELDS)
           + " THEN 'text_diff' WHEN contains(new_explanation, '|') AND NOT contains(old_explanation, '|') THEN 'table_format_flag' ELSE 'ok' END")


def _compared(t: Tables):
    rows = _linked(t)
    return rows.withColumns({f"{f}_cmp": R.field_comparison(F.col(f"old_{f}"), F.col(f"new_{f}")) for f in FIELDS})


def _with_status(t: Tables):
    table = F.contains(F.col("new_explanation"), F.lit("|")) & ~F.contains(F.col("old_explanation"), F.lit("|"))
    return _compared(t).withColumn("status", R.row_status([F.col(f"{f}_cmp") for f in FIELDS], F.col("old_stored"), F.col("new_stored"), table))


@query("R1 R2", f"WITH {_COMPARED} SELECT probe_id, ref_id, {', '.join(f'{f}_cmp' for f in FIELDS)}, {_STATUS} AS status FROM compared")
def compared_fields(t: Tables):
    return _with_status(t).select("probe_id", "ref_id", *[f"{f}_cmp" for f in FIELDS], "status")


@query("R2 A14", f"WITH {_COMPARED} SELECT topic, {_STATUS} AS status, count(*) AS n FROM compared GROUP BY ALL")
def status_by_topic(t: Tables):
    return _with_status(t).groupBy("topic", "status").agg(F.count("*").alias("n"))


_COLLAPSED = lambda e: f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"
_DIFFS = _LINKED + ", diffs AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT probe_id, ref_id, topic, '{f}' AS field, {_COLLAPSED(f'old_{f}')} AS old, {_COLLAPSED(f'new_{f}')} AS new FROM linked WHERE {_COLLAPSED(f'old_{f}')} <> {_COLLAPSED(f'new_{f}')}" for f in FIELDS) + ")"


def _diffs(t: Tables):
    pairs = {f: (F.col(f"old_{f}"), F.col(f"new_{f}")) for f in FIELDS}
    return _linked(t).select("probe_id", "ref_id", "topic", F.inline(R.differing_fields(pairs)))


@query("R3", f"WITH {_DIFFS} SELECT probe_id, field, md5(old) AS old, md5(new) AS new FROM diffs")
def differing_fields(t: Tables):
    return _diffs(t).select("probe_id", "field", F.md5("old").alias("old"), F.md5("new").alias("new"))


_WHOLE = lambda tag: "concat_ws(' ', " + ", ".join(f"{tag}_{f}" for f in FIELDS[:4]) + ")"


@query("R4 R5", f"""WITH {_LINKED} SELECT probe_id, CASE WHEN {_sql_bag(_WHOLE('old'))} = {_sql_bag(_WHOLE('new'))} THEN 'clean' WHEN {_sql_loose(_WHOLE('old'))} = {_sql_loose(_WHOLE('new'))} THEN 'clean_ligatures' ELSE 'residual' END AS status,
  len(list_filter(string_split_regex(new_explanation, '\\s+'), lambda w: w <> '')) >= 0.7 * greatest(len(list_filter(string_split_regex(old_explanation, '\\s+'), lambda w: w <> '')), 1) AS long_enough FROM linked""")
def reconstructions(t: Tables):
    whole = lambda tag: F.concat_ws(" ", *[f"{tag}_{f}" for f in FIELDS[:4]])
    return _linked(t).select("probe_id", R.reconstruction_status(whole("old"), whole("new")).alias("status"),
                             R.long_enough(F.col("old_explanation"), F.col("new_explanation")).alias("long_enough"))


def _proposals(t: Tables):
    stacked = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old"), F.col(f"new_{f}").alias("new")) for f in FIELDS]))
    return _linked(t).select(F.col("probe_id").alias("id"), stacked)


_PATCHES = _LINKED + ", pp AS (" + " UNION ALL ".join(f"SELECT probe_id AS id, '{f}' AS field, old_{f} AS old, {sql_strip(f'new_{f}')} AS new FROM linked" for f in FIELDS) + f"""),
 ow AS (SELECT id, field, w, count(*) AS n FROM (SELECT id, field, unnest({Q.words('old', '[a-z0-9]{3,}')}) AS w FROM pp) GROUP BY ALL),
 nw AS (SELECT id, field, w, count(*) AS n FROM (SELECT id, field, unnest({Q.words('new', '[a-z0-9]{3,}')}) AS w FROM pp) GROUP BY ALL),
 sh AS (SELECT id, field, sum(least(ow.n, coalesce(nw.n, 0)))::DOUBLE / sum(ow.n)::DOUBLE AS overlap FROM ow LEFT JOIN nw USING (id, field, w) GROUP BY ALL),
 gated AS MATERIALIZED (SELECT pp.*, coalesce(overlap, 1.0) AS overlap, CASE WHEN new = '' THEN 'empty' WHEN new = {sql_strip('old')} THEN 'unchanged'
   WHEN (contains(old, chr(10) || '|') OR contains(old, '|---') OR contains(old, chr(10) || '-') OR contains(old, chr(10) || '1.'))
     AND NOT (contains(new, chr(10) || '|') OR contains(new, '|---') OR contains(new, chr(10) || '-')) THEN 'would_lose_format'
   WHEN starts_with({sql_strip('old')}, new) THEN 'clean_prefix' WHEN coalesce(overlap, 1.0) >= 0.85 THEN 'overlap' ELSE 'low_overlap' END AS reason FROM pp LEFT JOIN sh USING (id, field))"""


@query("R6 R12 X12", f"WITH {_PATCHES} SELECT id, field, overlap, reason, CASE WHEN reason IN ('clean_prefix', 'overlap') THEN 'patch' ELSE 'skip' END AS action FROM gated")
def gated_patches(t: Tables):
    return R.plan_gated_patches(_proposals(t)).select("id", "field", "overlap", "reason", "action")


_VERDICT = "CASE id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'unclear' WHEN 2 THEN 'option_bleed' WHEN 3 THEN 'formatting_missing' ELSE 'stem_wrong' END"


def _verdicts(t: Tables):
    """A reviewer's verdict on every differing field."""
    names = ["ok", "unclear", "option_bleed", "formatting_missing", "stem_wrong"]
    verdict = F.get(F.array(*[F.lit(n) for n in names]), (F.col("probe_id") % 5).cast("int"))
    return _diffs(t).select(F.col("probe_id").alias("id"), "field", verdict.alias("verdict"), F.col("old").alias("original"), F.col("new").alias("new_value"))


_CORR = _DIFFS + f""", v AS (SELECT probe_id AS id, field, old AS original, new AS new_value FROM diffs), corr AS MATERIALIZED (SELECT *, {_VERDICT} AS verdict FROM v WHERE new_value <> '' AND {_VERDICT} NOT IN ('ok', 'unclear', 'wrong_page'))"""


@query("R7", f"WITH {_CORR} SELECT id, field, verdict FROM corr")
def wanted_corrections(t: Tables):
    return R.wanted_corrections(_verdicts(t)).select("id", "field", "verdict")


def _bank(t: Tables):
    return t.unlabelled().select(F.col("doc_id").alias("id"), *FIELDS)


@query("R8 R12", f"""WITH {_CORR} SELECT i.doc_id AS id, {', '.join(f"md5(coalesce((SELECT max(new_value) FROM corr c WHERE c.id = i.doc_id AND c.field = '{f}'), {f})) AS {f}" for f in FIELDS)} FROM items i WHERE quality IS NULL""")
def corrected_bank(t: Tables):
    fixed = R.apply_corrections(_bank(t), R.wanted_corrections(_verdicts(t)), "id", FIELDS, "new_value")
    return fixed.select("id", *[F.md5(f).alias(f) for f in FIELDS])


@query("R8", f"WITH {_CORR} SELECT id, field, true AS verified FROM corr")
def verified_corrections(t: Tables):
    wanted = R.wanted_corrections(_verdicts(t))
    return R.verify_corrections(R.apply_corrections(_bank(t), wanted, "id", FIELDS, "new_value"), wanted, "id", FIELDS)


_W4 = lambda c: f"list_distinct({Q.words(c, '[a-z]{4,}')})"


@query("R9", f"""WITH {_CORR}, kept AS (SELECT id, field, verdict, len(list_intersect({_W4('original')}, {_W4('new_value')}))::DOUBLE / greatest(CASE WHEN verdict = 'option_bleed' THEN len({_W4('new_value')}) ELSE len({_W4('original')}) END, 1) AS kept FROM corr)
SELECT *, (verdict = 'option_bleed' AND kept < 0.8) OR (verdict = 'formatting_missing' AND kept < 0.5) AS flagged FROM kept""")
def implausible_corrections(t: Tables):
    return R.implausible_corrections(_verdicts(t))


_PATTERNS = [("%tion of%", {"lang": "xx"}), ("%und der%", {"lang": "yy", "source": "patched"}), ("%que la%", {"source": "third"})]


@query("R10", """SELECT doc_id, CASE WHEN text ILIKE '%und der%' THEN 'yy' WHEN text ILIKE '%tion of%' THEN 'xx' ELSE lang END AS lang,
  CASE WHEN text ILIKE '%que la%' THEN 'third' WHEN text ILIKE '%und der%' THEN 'patched' ELSE source END AS source FROM documents""")
def pattern_patches(t: Tables):
    return R.apply_pattern_patches(t.raw("documents"), "text", _PATTERNS).select("doc_id", "lang", "source")


@query("R11 A15", f"""WITH {_PREFIX}, s AS (SELECT p.topic, CASE WHEN x.ref_id IS NULL THEN 'no_match' WHEN {sql_strip('r.explanation')} = '' THEN 'empty'
   WHEN {Q.set_similarity('p.text', 'r.text')} < 0.40 THEN 'low_similarity' WHEN {Q.prefix_key('p.explanation', 120)} = {Q.prefix_key('r.explanation', 120)} THEN 'same' ELSE 'update' END AS status
  FROM items p LEFT JOIN prefix x ON x.probe_id = p.doc_id LEFT JOIN items r ON r.doc_id = x.ref_id WHERE p.quality IS NULL)
SELECT status, count(*) AS n FROM s GROUP BY status""")
def refresh_summary(t: Tables):
    matches = L.prefix_matches(_side(t.unlabelled(), "probe_id"), _side(t.labelled(), "ref_id"))
    probes = t.unlabelled().select(F.col("doc_id").alias("probe_id"), "text", F.col("explanation").alias("stored_text"))
    refs = t.labelled().select(F.col("doc_id").alias("ref_id"), "text", F.col("explanation").alias("fresh_text"))
    return R.plan_refresh(matches, probes, refs).groupBy("status").agg(F.count("*").alias("n"))


@query("A15", f"""WITH {_LINKED} SELECT i.topic, count(*) FILTER (l.ref_id IS NOT NULL) AS matched, count(*) FILTER (l.ref_id IS NULL) AS no_match,
  count(*) FILTER (l.ref_id IS NOT NULL AND d = 0) AS options_ok, count(*) FILTER (l.ref_id IS NOT NULL AND d > 0) AS options_wrong,
  count(*) FILTER (old_stored = new_stored) AS answer_ok, count(*) FILTER (old_stored <> new_stored) AS answer_wrong, CAST(0 AS BIGINT) AS answer_skipped
FROM items i LEFT JOIN (SELECT *, {' + '.join(f"CAST({_COLLAPSED(f'old_{f}')} <> {_COLLAPSED(f'new_{f}')} AS INT)" for f in FIELDS[1:4])} AS d FROM linked) l ON l.probe_id = i.doc_id WHERE quality IS NULL GROUP BY i.topic""")
def match_summary(t: Tables):
    options = {f: (F.col(f"old_{f}"), F.col(f"new_{f}")) for f in FIELDS[1:4]}
    linked = _linked(t).select("probe_id", "ref_id", F.size(R.differing_fields(options)).alias("option_diffs"),
                               F.col("old_stored").alias("old_answer"), F.col("new_stored").alias("new_answer"))
    rows = t.unlabelled().select(F.col("doc_id").alias("probe_id"), "topic").join(linked, "probe_id", "left")
    return R.match_summary(rows, "topic")


@query("F12", f"""WITH {_PREFIX}, s AS (SELECT {Q.set_similarity('p.text', 'r.text')} AS x FROM prefix JOIN items p ON p.doc_id = probe_id JOIN items r ON r.doc_id = ref_id)
SELECT count(*) FILTER (x >= 0.8) AS kept, count(*) FILTER (x < 0.8) AS skipped FROM s""")
def similarity_cut(t: Tables):
    p, r = _side(t.unlabelled(), "probe_id"), _side(t.labelled(), "ref_id")
    rated = L.validated_matches(L.prefix_matches(p, r), p, r, floor=0.0, length=None)
    return R.above_similarity(rated, "similarity", 0.8)[1]


@query("R13", f"""SELECT coalesce(c_custkey, user_id) AS user_id, coalesce(new_name, c_name) AS name, CASE WHEN c_custkey IS NULL THEN 'inserted' WHEN user_id IS NULL THEN 'kept' ELSE 'synced' END AS change
FROM (SELECT c_custkey, c_name FROM customer) FULL OUTER JOIN (SELECT DISTINCT user_id * 13 AS user_id, 'user ' || user_id AS new_name FROM events) ON c_custkey = user_id""")
def upserted_users(t: Tables):
    existing = t.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    incoming = t.raw("events").select((F.col("user_id") * 13).alias("user_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"))
    return R.upsert(existing, incoming, "user_id", ["name"])


@query("S6", """SELECT DISTINCT user_id * 13 AS user_id, 'user ' || user_id AS name FROM events WHERE user_id * 13 NOT IN (SELECT c_custkey FROM customer)""")
def seeded_users(t: Tables):
    existing = t.raw("customer").select(F.col("c_custkey").alias("user_id"))
    incoming = t.raw("events").select((F.col("user_id") * 13).alias("user_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"))
    return R.insert_or_ignore(existing, incoming, "user_id")


@query("T14", f"""WITH {ITEMS}, v0 AS (SELECT topic || '-' || (doc_id % 10) AS record, stored AS letter, count(*) AS votes FROM items GROUP BY ALL),
 v AS (SELECT record, letter, votes::DOUBLE / (sum(votes) OVER (PARTITION BY record))::DOUBLE AS share FROM v0 QUALIFY row_number() OVER (PARTITION BY record ORDER BY votes DESC, letter) = 1),
 r AS (SELECT doc_id, stored, letter, share, {Q.letter_patterns('explanation')} AS said, CASE doc_id % 3 WHEN 0 THEN 1.0 ELSE 0.9 END AS sim FROM items JOIN v ON record = topic || '-' || (doc_id % 10)),
 b AS (SELECT *, CASE WHEN share >= 0.8 THEN 'HIGH' WHEN share >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM r)
SELECT doc_id, CASE WHEN stored = letter THEN 'matched' WHEN said IS NULL THEN CASE WHEN share >= 0.8 AND sim >= 0.99 THEN 'MEDIUM-CACHE' ELSE 'ambiguous-' || band END
  WHEN said = letter THEN 'HIGH-CONFIRMED' WHEN said = stored THEN 'matched' ELSE 'ambiguous-' || band END AS verdict FROM b""")
def triple_confirmations(t: Tables):
    record = F.concat_ws("-", "topic", (F.col("doc_id") % 10).cast("string"))
    items = t.items().select("doc_id", record.alias("record"), "stored", S.pattern_letter(F.col("explanation")).alias("said"))
    votes = G.majority_vote(items.select("record", F.col("stored").alias("letter")), "record", "letter")
    similarity = F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(0.9)
    return items.join(votes, "record").select("doc_id", S.triple_confirmation(
        F.col("letter"), F.col("stored"), F.col("said"), F.col("votes") / F.col("total"), similarity).alias("verdict"))


@query("A18", f"""WITH {ITEMS}, u AS (SELECT doc_id, 'dangling' AS reason FROM items WHERE NOT regexp_matches({sql_strip('text')}, '[.?!:)”’"]$') UNION ALL
  SELECT doc_id, 'short' FROM items WHERE length(explanation) < 200 UNION ALL SELECT doc_id, 'letter' FROM items WHERE stored <> substr('ABC', CAST(doc_id % 3 + 1 AS INT), 1))
SELECT doc_id, array_to_string(list_sort(list_distinct(list(reason))), '|') AS reasons, count(*) AS reports FROM u GROUP BY doc_id""")
def reasons_by_item(t: Tables):
    i = t.items()
    report = lambda name, rows: rows.select("doc_id", F.lit(name).alias("reason"))
    right = F.substring(F.lit("ABC"), (F.col("doc_id") % 3 + 1).cast("int"), F.lit(1))
    return G.reasons_per_id([report("dangling", i.where(X.ends_dangling(F.col("text")))), report("short", i.where(F.length("explanation") < 200)),
                             report("letter", i.where(F.col("stored") != right))], "doc_id", "reason")


@query("A20", """SELECT source, lang, doc_id // 1000 AS slice_no, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids, count(*) AS n FROM documents GROUP BY ALL""")
def ids_by_page(t: Tables):
    rows = G.ids_per_page(t.raw("documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")
    return rows.select("source", "lang", "slice_no", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.size("ids").cast("bigint").alias("n"))


@query("U3 A14", f"""WITH {ITEMS}, a AS (SELECT doc_id, {Q.letter_patterns('explanation')} AS letter FROM items), p AS (SELECT * FROM a WHERE letter IS NOT NULL),
 s AS (SELECT doc_id, stored AS letter FROM items WHERE quality = 1)
SELECT coalesce(p.doc_id, s.doc_id) AS doc_id, coalesce(p.letter, s.letter) AS letter, p.doc_id IS NOT NULL AND s.doc_id IS NOT NULL AS confirmed, p.doc_id IS NULL AS "new" FROM p FULL OUTER JOIN s ON s.doc_id = p.doc_id""")
def merged_corrections(t: Tables):
    i = t.items()
    stated = i.select("doc_id", S.pattern_letter(F.col("explanation")).alias("letter")).where(F.col("letter").isNotNull())
    return G.first_wins(stated, i.where(F.col("quality") == 1).select("doc_id", F.col("stored").alias("letter")), "doc_id")


# ---- Ordered logs and pages ----

@query("W4", """SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' OR turn % 3 = 1 THEN substr(md5(text), 1, 6) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '') AS section FROM conversations""")
def filled_sections(t: Tables):
    heading = F.when((F.col("role") == "system") | (F.col("turn") % 3 == 1), F.substring(F.md5("text"), 1, 6))
    rows = t.turns().select("conv_id", "turn", heading.alias("heading"))
    return H.forward_fill(rows, "conv_id", "turn", "heading", "section", span=3).select("conv_id", "turn", F.coalesce("section", F.lit("")).alias("section"))


@query("W4", """WITH h AS (SELECT conv_id, turn, substr(md5(text), 1, 1) AS heading FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, heading ORDER BY turn) AS rn FROM h)
SELECT conv_id, turn, last_value(CASE WHEN rn = 1 THEN heading END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM f""")
def first_sections(t: Tables):
    rows = t.turns().select("conv_id", "turn", F.substring(F.md5("text"), 1, 1).alias("heading"))
    return H.forward_fill(H.first_headings(rows, "conv_id", "turn", "heading"), "conv_id", "turn", "heading", "section").select("conv_id", "turn", "section")


_PAGES = """pg AS (SELECT conv_id % 7 AS file, conv_id * 10 + turn AS page, 1 + (conv_id * 5 + turn * 3) % 17 AS lowest, 3 + (conv_id * 5 + turn * 3) % 17 + turn % 3 AS highest FROM conversations)"""


@query("W5", f"""WITH RECURSIVE {_PAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page) AS rn FROM pg),
 f AS (SELECT file, page, rn, highest AS top, true AS starts FROM o WHERE rn = 1
   UNION ALL SELECT o.file, o.page, o.rn, CASE WHEN o.lowest <= f.top - 3 THEN o.highest ELSE greatest(f.top, o.highest) END, o.lowest <= f.top - 3 FROM f JOIN o ON o.file = f.file AND o.rn = f.rn + 1)
SELECT file, page AS start_page FROM f WHERE starts AND rn > 1 UNION ALL SELECT DISTINCT file, -1 FROM pg""")
def section_starts(t: Tables):
    n = (F.col("conv_id") * 5 + F.col("turn") * 3) % 17
    pages = t.turns().select((F.col("conv_id") % 7).alias("file"), (F.col("conv_id") * 10 + F.col("turn")).alias("page"), (n + 1).alias("lowest"), (n + 3 + F.col("turn") % 3).alias("highest"))
    return H.section_starts(pages, "file", "page", "lowest", "highest")


@query("W10 O8 S9", """SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) AS row_no, (row_number() OVER (ORDER BY source, doc_id) - 1) // 20 AS batch_no FROM documents""")
def review_batches(t: Tables):
    return H.numbered_batches(t.raw("documents").select("doc_id", "source"), ["source", "doc_id"], 20)


@query("S9", """SELECT batch_no, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM (SELECT source, (row_number() OVER (ORDER BY source, doc_id) - 1) // 20 AS batch_no FROM documents) GROUP BY batch_no""")
def batch_manifest(t: Tables):
    from scholia.sources.writers import batch_manifest as manifest
    rows = H.numbered_batches(t.raw("documents").select("doc_id", "source"), ["source", "doc_id"], 20)
    return manifest(rows, "batch_no", "source").select("batch_no", "n", F.array_join("sources", ",").alias("sources"))


# ---- Payloads and page caches ----

@query("N1 N6", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 9 <> 0 AS parsed FROM events""")
def parsed_payloads(t: Tables):
    broken = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    rows = t.raw("events").select("event_id", "props", M.json_scores(broken).alias("scores"))
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.try_element_at("scores", F.lit("k")).isNotNull().alias("parsed"))


@query("N2 A4", f"""WITH {ATTEMPTS}, s AS (SELECT user_id, session_type, 't' || (question_id % 4) AS topic, round_even(100.0::DOUBLE * sum(CAST(is_correct AS INT)) / count(*), 1) AS pct FROM attempts GROUP BY ALL)
SELECT user_id, session_type, count(*) AS topics, CAST(sum(CAST(pct * 10 AS INTEGER)) AS BIGINT) AS total FROM s GROUP BY ALL""")
def score_payloads(t: Tables):
    """Topic scores of a session type to JSON and back again."""
    topic = F.concat(F.lit("t"), (F.col("question_id") % 4).cast("string"))
    scores = (t.attempts().groupBy("user_id", "session_type", topic.alias("topic"))
              .agg(M.percentage(F.sum(F.col("is_correct").cast("int")), F.count("*"), 1).alias("pct")))
    payload = scores.groupBy("user_id", "session_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("topic", "pct")))).alias("payload"))
    back = payload.select("user_id", "session_type", F.explode(M.json_scores(F.col("payload"))).alias("topic", "pct"))
    return back.groupBy("user_id", "session_type").agg(F.count("*").alias("topics"), F.sum(F.round(F.col("pct") * 10).cast("int")).alias("total"))


@query("N6 N2", f"""WITH {ATTEMPTS}, s AS (SELECT user_id, session_type, question_id % 4 AS slot, round_even(100.0::DOUBLE * sum(CAST(is_correct AS INT)) / count(*), 1) AS pct FROM attempts GROUP BY ALL)
SELECT user_id, session_type, slot, CAST(pct * 10 AS INTEGER) AS tenths FROM s""")
def scores_by_slot(t: Tables):
    """Scores saved under string keys, as JSON has no others, and read back under integer keys."""
    scores = (t.attempts().groupBy("user_id", "session_type", (F.col("question_id") % 4).cast("string").alias("slot"))
              .agg(M.percentage(F.sum(F.col("is_correct").cast("int")), F.count("*"), 1).alias("pct")))
    payload = scores.groupBy("user_id", "session_type").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("slot", "pct")))).alias("payload"))
    back = payload.select("user_id", "session_type", F.explode(M.integer_keys(M.json_scores(F.col("payload")))).alias("slot", "pct"))
    return back.select("user_id", "session_type", "slot", F.round(F.col("pct") * 10).cast("int").alias("tenths"))


@query("N3 F3", """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
 i AS (SELECT event_id, unnest([k, k + 1, k * 11]) AS id FROM e) SELECT event_id, count(*) FILTER (doc_id IS NOT NULL) = 3 AS restorable FROM i LEFT JOIN documents ON doc_id = id GROUP BY event_id""")
def restorable_runs(t: Tables):
    """Saved runs of both payload shapes; a run is restorable if all of its questions still exist."""
    k = F.col("question_id")
    ids = F.array(k, k + 1, k * 11)
    current = F.to_json(F.struct(F.transform(ids, lambda x: x.cast("string")).alias("question_ids")))
    older = F.to_json(F.struct(F.transform(ids, lambda x: F.struct(x.cast("string").alias("id"))).alias("diag_questions")))
    saved = t.attempts().select(F.col("attempt_id").alias("event_id"), F.when(F.col("attempt_id") % 2 == 0, current).otherwise(older).alias("payload"))
    rows = saved.select("event_id", F.explode(M.saved_question_ids(F.col("payload"))).alias("id"))
    found = rows.join(t.raw("documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(1).alias("found")), "id", "left")
    return found.groupBy("event_id").agg((F.count("*") == F.count("found")).alias("restorable"))


def _cache(t: Tables):
    """Conversations as page caches: user turns are question pages, assistant turns answer pages; sentences are the items."""
    kind = F.when(F.col("role") == "user", "questions").when(F.col("role") == "assistant", "answers").otherwise("other")
    items = F.transform(X.sentences(F.col("text")), lambda s, i: F.struct((i + 1).alias("n"), s.alias("stem")))
    return t.turns().select((F.col("conv_id") % 10).alias("file"), (F.col("conv_id") * 10 + F.col("turn")).alias("page_idx"), kind.alias("page_type"), items.alias("items"))


_CACHE = f"""cache AS (SELECT conv_id % 10 AS file, conv_id * 10 + turn AS page_idx, CASE role WHEN 'user' THEN 'questions' WHEN 'assistant' THEN 'answers' ELSE 'other' END AS page_type,
  {sql_sentences(sql_strip('text'))} AS items FROM conversations)"""


@query("S4 S5", f"WITH {_CACHE} SELECT file, page_idx, page_type, CAST(n AS INTEGER) AS n, md5(stem) AS stem FROM (SELECT file, page_idx, page_type, unnest(items) AS stem, unnest(range(1, len(items) + 1)) AS n FROM cache WHERE page_type IN ('questions', 'answers')) WHERE stem <> ''")
def page_items(t: Tables):
    from scholia.sources.readers import page_items as items
    return items(_cache(t), ["questions", "answers"]).where(F.col("stem") != "").select("file", "page_idx", "page_type", "n", F.md5("stem").alias("stem"))


@query("N4", f"WITH {_CACHE} SELECT file, bool_or(page_type IN ('questions', 'answers') AND len(items) > 2) AS valid FROM cache GROUP BY file")
def valid_caches(t: Tables):
    return _cache(t).groupBy("file").agg(F.bool_or(F.col("page_type").isin("questions", "answers") & (F.size("items") > 2)).alias("valid"))


@query("N4", f"""SELECT conv_id, bool_or((role IN ('user', 'assistant') AND len(list_filter({sql_sentences(sql_strip('text'))}, lambda s: length(s) > 90)) > 0)
  OR (role = 'system' AND conv_id % 3 = 0)) AS valid FROM conversations GROUP BY conv_id""")
def usable_caches(t: Tables):
    """One cache per conversation: long sentences are its items, some system turns its answers."""
    kind = F.when(F.col("role") == "user", "questions").when(F.col("role") == "assistant", "answers").otherwise("other")
    pages = t.turns().select("conv_id", kind.alias("page_type"), F.filter(X.sentences(F.col("text")), lambda s: F.length(s) > 90).alias("items"),
                             F.when((F.col("role") == "system") & (F.col("conv_id") % 3 == 0), "A").alias("answer"))
    return R.cache_validity(pages, "conv_id", ["questions", "answers"], "answer")


@query("N5", f"""WITH {_CACHE} SELECT file, page_idx, CASE WHEN page_type = 'other' THEN 'questions' ELSE page_type END AS page_type, CAST(CASE WHEN page_type = 'other' THEN 1 ELSE len(items) END AS INTEGER) AS n_items FROM cache""")
def merged_caches(t: Tables):
    """Pages of the type "other" were read again, twice: of the later reading, the one item carries the drifted key `qnum`, renamed to `n`."""
    again = (t.turns().where(F.col("role") == "system")
             .select((F.col("conv_id") % 10).alias("file"), (F.col("conv_id") * 10 + F.col("turn")).alias("page_idx"), F.lit("questions").alias("page_type"),
                     F.array(F.struct(F.col("turn").cast("int").alias("qnum"), "text")).alias("raw")))
    renamed = again.select("file", "page_idx", "page_type", F.transform("raw", lambda r: F.struct(r["qnum"].alias("n"), r["text"].alias("stem"))).alias("items"))
    first = renamed.withColumn("items", F.concat("items", "items"))
    readings = first.withColumn("reading", F.lit(1)).unionByName(renamed.withColumn("reading", F.lit(2)))
    return R.nested_upsert(_cache(t), readings, ["file", "page_idx"], ["reading"]).select("file", "page_idx", "page_type", F.size("items").alias("n_items"))


@query("S11", f"""WITH n AS (SELECT doc_id, {sql_sentences(sql_strip('text'))} AS s FROM documents WHERE source = 'src3')
SELECT doc_id, md5(s[1]) AS overview, CAST(p AS INTEGER) AS section_no, md5(s[CAST(p + 2 AS INT)]) AS body FROM (SELECT doc_id, s, unnest(range(0, len(s) - 1)) AS p FROM n)""")
def study_sections(t: Tables):
    """Nested study notes looked up by topic: overview first, then one row per section, its content or else its body."""
    from scholia.sources.readers import note_sections
    s = X.sentences(F.col("text"))
    notes = t.raw("documents").select("doc_id", F.col("source").alias("topic"), F.get(s, F.lit(0)).alias("overview"),
                                      F.transform(F.slice(s, 2, X.REST), lambda x, i: F.struct(
                                          F.when(i % 2 == 0, x).alias("content"), F.when(i % 2 == 1, x).alias("body"))).alias("sections"))
    return note_sections(notes, "src3").select("doc_id", F.md5("overview").alias("overview"), "section_no", F.md5("text").alias("body"))


@query("S11", f"""SELECT doc_id, CAST(p AS INTEGER) AS tip_no, md5(tips[CAST(p + 1 AS INT)]) AS tip FROM (SELECT doc_id, tips, unnest(range(0, len(tips))) AS p FROM (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN s[1:1] ELSE s[2:3] END AS tips FROM (SELECT doc_id, {sql_sentences(sql_strip('text'))} AS s FROM documents WHERE source = 'src3')))""")
def study_tips(t: Tables):
    """Exam tips of a topic's notes; every other note has only key points."""
    from scholia.sources.readers import note_tips
    s = X.sentences(F.col("text"))
    notes = t.raw("documents").select("doc_id", F.col("source").alias("topic"), F.when(F.col("doc_id") % 2 == 0, F.slice(s, 1, 1)).alias("exam_tips"),
                                      F.slice(s, 2, 2).alias("key_points"))
    return note_tips(notes, "src3").select("doc_id", "tip_no", F.md5("tip").alias("tip"))


@query("S10 M1", f"WITH {SESSIONS} SELECT session_id, total_questions, correct_answers, score_pct FROM sessions")
def session_facts(t: Tables):
    from scholia.sources.writers import session_rows
    return session_rows(t.sessions().drop("score_pct")).select("session_id", "total_questions", "correct_answers", "score_pct")


@query("S2", "SELECT doc_id, source, lang FROM documents WHERE source = 'src7'")
def bank_scan(t: Tables):
    from scholia.sources.readers import read_table
    return read_table(t.spark, f"{t.folder}/documents.parquet", ["doc_id", "source", "lang"], source="src7")


@query("M3", """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN TIMESTAMP '2024-01-20 12:00:00' WHEN event_id % 5 = 1 THEN ts - INTERVAL 2 HOUR ELSE ts END AS parsed FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def parsed_timestamps(t: Tables):
    from scholia.plans.tables import ANCHOR
    text = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    shape = (F.when(F.col("event_id") % 5 == 0, F.concat(text, F.lit("Z"))).when(F.col("event_id") % 5 == 1, F.concat(text, F.lit("+02:00")))
             .when(F.col("event_id") % 5 == 2, F.concat(text, F.lit("+00:00"))).when(F.col("event_id") % 5 == 3, text).otherwise(F.lit("soon")))
    return t.raw("events").select("event_id", M.parse_timestamp(shape, F.lit(str(ANCHOR)).cast("timestamp_ntz")).alias("parsed"))
