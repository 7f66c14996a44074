"""The provided tables bound to the roles that the operators expect.

`Tables` gives Spark DataFrames; the strings below are the same bindings as SQL common table expressions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as X
from scholia.operators.progress import outcomes_by_question
from scholia.session import spread

ANCHOR = dt.datetime(2024, 1, 20, 12, 0, 0)
ANCHOR_DAY = ANCHOR.date()
TOPICS = [f"src{i}" for i in range(20)]
# Blueprint of the bound topics: weights sum to 1, quotas to 180.
WEIGHTS = {t: f"{0.02 * (1 + i % 4):.2f}" for i, t in enumerate(TOPICS)}
QUOTAS = {t: 6 + 2 * (i % 4) for i, t in enumerate(TOPICS)}
HIDDEN_TYPES = ["error"]
CORRECT_BELOW = 35.0
# Tables with much work per row.
TEXT_TABLES = ("documents", "pages")


class Tables:
    """Lazy bindings on one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table

    def attempts(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("attempt_id"),
            "user_id",
            F.get_json_object("props", "$.k").cast("int").alias("question_id"),
            (F.col("value") < CORRECT_BELOW).alias("is_correct"),
            F.col("ts").alias("attempted_at"),
            F.floor("value").cast("int").alias("time_spent_sec"),
            F.col("event_type").alias("session_type"),
        )

    def bank(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("question_id"), F.col("source").alias("topic"), "lang", "text", "n_chars")

    def outcomes(self) -> DataFrame:
        """What counts for progress: user, topic, correct, attempted, time."""
        return outcomes_by_question(self.attempts(), self.bank())

    def sessions(self) -> DataFrame:
        day = F.to_date("attempted_at")
        return (self.attempts().groupBy("user_id", day.alias("day"), "session_type")
                .agg(F.count("*").alias("total_questions"),
                     F.sum(F.col("is_correct").cast("int")).alias("correct_answers"),
                     F.sum("time_spent_sec").alias("duration_sec"),
                     F.max("attempted_at").alias("completed_at"))
                .withColumn("session_id", F.concat_ws("-", F.col("user_id").cast("string"),
                                                      F.date_format("day", "yyyyMMdd"), "session_type"))
                .withColumn("score_pct", F.bround(100.0 * F.col("correct_answers") / F.col("total_questions"), 2)))

    def reviews(self) -> DataFrame:
        return self.attempts().select("user_id", F.col("question_id").alias("card_id"),
                                      F.col("is_correct").alias("knew"), F.col("attempted_at").alias("ts"),
                                      F.col("attempt_id").alias("seq"))

    def items(self) -> DataFrame:
        """Question items cut from documents: stem, three options, an explanation and a stored letter.

        The first four sentences are stem and options; the rest follows a lead-in that names the right option
        in one of several ways, so every kind of answer signal occurs.
        """
        docs = self.raw("documents").select("doc_id", F.col("source").alias("topic"), "text")
        labels = self.raw("labels").select("doc_id", "quality")
        right = F.element_at(F.array(F.col("option_a"), F.col("option_b"), F.col("option_c")),
                             (F.col("doc_id") % 3 + 1).cast("int"))
        letter = F.substring(F.lit("ABC"), (F.col("doc_id") % 3 + 1).cast("int"), F.lit(1))
        other = F.substring(F.lit("ABC"), ((F.col("doc_id") + 1) % 3 + 1).cast("int"), F.lit(1))
        stored = F.substring(F.lit("ABC"),
                             ((F.col("doc_id") + F.coalesce(F.col("quality"), F.lit(0))) % 3 + 1).cast("int"), F.lit(1))
        lead = (F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("The correct answer is "), letter, F.lit(". ")))
                .when(F.col("doc_id") % 7 == 1, F.concat(right, F.lit(" ")))
                .when(F.col("doc_id") % 7 == 2, F.concat(other, F.lit(" is incorrect. "), letter, F.lit(" is the best answer. ")))
                .when(F.col("doc_id") % 7 == 3, F.concat(F.lit("Not "), other, F.lit(", only "), letter, F.lit(" holds. "), right, F.lit(" ")))
                .when(F.col("doc_id") % 7 == 4, F.concat(F.lit("It does not follow. "), right, F.lit(" ")))
                .otherwise(F.lit("")))
        part = lambda i: F.coalesce(F.get("sentences", F.lit(i)), F.lit(""))
        cut = (docs.join(labels, "doc_id", "left")
               .withColumn("sentences", X.sentences(F.col("text")))
               .select("doc_id", "topic", "quality", "text", part(0).alias("stem"), part(1).alias("option_a"),
                       part(2).alias("option_b"), part(3).alias("option_c"),
                       F.array_join(F.slice("sentences", 5, X.REST), " ").alias("rest")))
        # `inline` keeps later filters on the cut fields from being pushed into, and repeated inside, the cutting.
        fields = F.struct("stem", "option_a", "option_b", "option_c", F.concat(lead, F.col("rest")).alias("explanation"), stored.alias("stored"))
        return cut.select("doc_id", "topic", "quality", "text", F.inline(F.array(fields)))

    def booklets(self) -> DataFrame:
        """Items printed on the pages of one book a topic (doc, page_no, text). An item's second half stands on the next page, before the
        next item's first half. Some items lack an option, have them out of order, or repeat a mark in the explanation."""
        n = F.col("doc_id")
        line = lambda mark, c: F.concat(F.lit(mark), c)
        option_b, option_c = line("B) ", F.col("option_b")), line("C) ", F.col("option_c"))
        lines = F.concat_ws("\n", line("Question #", F.concat(n.cast("string"), F.lit(" of 9999"))), line("Question ID: ", n.cast("string")), F.col("stem"),
                            line("A) ", F.col("option_a")), F.when(n % 13 == 0, option_c).otherwise(option_b),
                            F.when(n % 13 == 0, option_b).when(n % 11 != 0, option_c), F.lit("Explanation"),
                            F.when(n % 17 == 0, F.lit("A) is repeated here")), F.col("explanation"),
                            F.concat(F.lit("(Module "), (n % 9 + 1).cast("string"), F.lit(".2, LOS 3.a)\nfootnote")))
        cut = self.items().select(F.col("topic").alias("doc"), "doc_id", F.floor(n / 20).alias("page_no"), F.split(lines, "\n").alias("lines"))
        half = F.floor(F.size("lines") / 2).cast("int")
        parts = cut.select("doc", "doc_id", F.inline(F.array(
            F.struct(F.lit(1).alias("half"), F.col("page_no").alias("page_no"), F.array_join(F.slice("lines", F.lit(1), half), "\n").alias("text")),
            F.struct(F.lit(0).alias("half"), (F.col("page_no") + 1).alias("page_no"), F.array_join(F.slice("lines", half + 1, X.REST), "\n").alias("text")))))
        page = F.sort_array(F.collect_list(F.struct("half", "doc_id", "text")))
        return parts.groupBy("doc", "page_no").agg(F.array_join(F.transform(page, lambda p: p["text"]), "\n").alias("text"))

    def records(self) -> DataFrame:
        """Whole documents with their label, if any."""
        docs = self.raw("documents").select("doc_id", F.col("source").alias("topic"), "text")
        return docs.join(self.raw("labels").select("doc_id", "quality"), "doc_id", "left")

    def labelled(self) -> DataFrame:
        """Items with a label: the reference corpus."""
        return self.items().where(F.col("quality").isNotNull())

    def unlabelled(self) -> DataFrame:
        return self.items().where(F.col("quality").isNull())

    def turns(self) -> DataFrame:
        return self.raw("conversations")


# ---- The same bindings as SQL ----

ATTEMPTS = f"""attempts AS (
  SELECT event_id AS attempt_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS question_id,
         value < {CORRECT_BELOW} AS is_correct, ts AS attempted_at, CAST(floor(value) AS INTEGER) AS time_spent_sec,
         event_type AS session_type
  FROM events)"""

OUTCOMES = ATTEMPTS + """, outcomes AS (
  SELECT attempt_id, user_id, source AS topic, question_id, CAST(is_correct AS INTEGER) AS correct, 1 AS attempted,
         attempted_at AS ts, time_spent_sec, session_type
  FROM attempts JOIN documents ON doc_id = question_id)"""

SESSIONS = ATTEMPTS + """, sessions AS (
  SELECT *, concat_ws('-', CAST(user_id AS VARCHAR), strftime(day, '%Y%m%d'), session_type) AS session_id,
         round_even(100.0::DOUBLE * correct_answers / total_questions, 2) AS score_pct
  FROM (SELECT user_id, CAST(attempted_at AS DATE) AS day, session_type, count(*) AS total_questions,
               CAST(sum(CAST(is_correct AS INTEGER)) AS BIGINT) AS correct_answers,
               CAST(sum(time_spent_sec) AS BIGINT) AS duration_sec, max(attempted_at) AS completed_at
        FROM attempts GROUP BY ALL))"""

REVIEWS = ATTEMPTS + """, reviews AS (
  SELECT user_id, question_id AS card_id, is_correct AS knew, attempted_at AS ts, attempt_id AS seq FROM attempts)"""

PROGRESS = OUTCOMES + """, progress AS (
  SELECT user_id, topic, count(*) AS total_attempted, CAST(sum(correct) AS BIGINT) AS total_correct,
         round_even(100.0::DOUBLE * sum(correct) / count(*), 2) AS mastery_pct, max(ts) AS last_attempted
  FROM outcomes GROUP BY user_id, topic)"""

TOPIC_LIST = "(SELECT unnest([" + ", ".join(f"'{t}'" for t in TOPICS) + "]) AS topic)"
WEIGHT_ROWS = "(VALUES " + ", ".join(f"('{t}', {w}::DECIMAL(9,6))" for t, w in WEIGHTS.items()) + ") w(topic, weight)"
QUOTA_ROWS = "(VALUES " + ", ".join(f"('{t}', {q})" for t, q in QUOTAS.items()) + ") q(topic, quota)"

MASTERY = PROGRESS + f""", mastery AS (
  SELECT u.user_id, t.topic, coalesce(p.mastery_pct, 0.0) AS mastery_pct
  FROM (SELECT DISTINCT user_id FROM attempts) u CROSS JOIN {TOPIC_LIST} t
  LEFT JOIN progress p ON p.user_id = u.user_id AND p.topic = t.topic)"""


def sql_sentences(expr: str) -> str:
    """Split after . ! or ? and white space, without lookbehind."""
    return f"string_split(regexp_replace({expr}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


ITEMS = f"""items AS (
  SELECT doc_id, topic, quality, text, stem, option_a, option_b, option_c,
         CASE doc_id % 7
           WHEN 0 THEN 'The correct answer is ' || letter || '. '
           WHEN 1 THEN list_extract([option_a, option_b, option_c], CAST(doc_id % 3 + 1 AS INT)) || ' '
           WHEN 2 THEN other || ' is incorrect. ' || letter || ' is the best answer. '
           WHEN 3 THEN 'Not ' || other || ', only ' || letter || ' holds. '
                       || list_extract([option_a, option_b, option_c], CAST(doc_id % 3 + 1 AS INT)) || ' '
           WHEN 4 THEN 'It does not follow. '
                       || list_extract([option_a, option_b, option_c], CAST(doc_id % 3 + 1 AS INT)) || ' '
           ELSE '' END || rest AS explanation,
         stored
  FROM (SELECT d.doc_id, source AS topic, quality, text,
               coalesce(s[1], '') AS stem, coalesce(s[2], '') AS option_a, coalesce(s[3], '') AS option_b,
               coalesce(s[4], '') AS option_c, coalesce(array_to_string(s[5:], ' '), '') AS rest,
               substr('ABC', CAST(d.doc_id % 3 + 1 AS INT), 1) AS letter,
               substr('ABC', CAST((d.doc_id + 1) % 3 + 1 AS INT), 1) AS other,
               substr('ABC', CAST((d.doc_id + coalesce(quality, 0)) % 3 + 1 AS INT), 1) AS stored
        FROM (SELECT *, {sql_sentences(sql_strip('text'))} AS s FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""

BOOKLETS = ITEMS + """, printed AS (
  SELECT topic AS doc, doc_id, CAST(floor(doc_id / 20) AS BIGINT) AS page_no, string_split(concat_ws(chr(10), 'Question #' || doc_id || ' of 9999', 'Question ID: ' || doc_id, stem,
         'A) ' || option_a, CASE WHEN doc_id % 13 = 0 THEN 'C) ' || option_c ELSE 'B) ' || option_b END,
         CASE WHEN doc_id % 13 = 0 THEN 'B) ' || option_b WHEN doc_id % 11 <> 0 THEN 'C) ' || option_c END, 'Explanation',
         CASE WHEN doc_id % 17 = 0 THEN 'A) is repeated here' END, explanation,
         '(Module ' || (doc_id % 9 + 1) || '.2, LOS 3.a)' || chr(10) || 'footnote'), chr(10)) AS lines FROM items),
booklets AS (
  SELECT doc, page_no, string_agg(text, chr(10) ORDER BY half, doc_id) AS text FROM (
    SELECT doc, doc_id, 1 AS half, page_no, array_to_string(lines[1:len(lines) // 2], chr(10)) AS text FROM printed
    UNION ALL SELECT doc, doc_id, 0, page_no + 1, array_to_string(lines[len(lines) // 2 + 1:], chr(10)) FROM printed) GROUP BY doc, page_no)"""
