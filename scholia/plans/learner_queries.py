"""Learner analytics on the attempt log, for all users at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia import fixed_values as V
from scholia.functions import scalars as M
from scholia.operators import history as H
from scholia.operators import progress as P
from scholia.operators import sampling as S
from scholia.plans.registry import query
from scholia.plans.tables import (ANCHOR, ANCHOR_DAY, ATTEMPTS, HIDDEN_TYPES, MASTERY, OUTCOMES, PROGRESS, QUOTA_ROWS, QUOTAS,
                                  REVIEWS, SESSIONS, TOPIC_LIST, TOPICS, WEIGHT_ROWS, WEIGHTS, Tables)

def now():
    return F.lit(str(ANCHOR)).cast("timestamp_ntz")


def today():
    return F.lit(ANCHOR_DAY)


SQL_NOW = f"TIMESTAMP '{ANCHOR}'"
SQL_TODAY = f"DATE '{ANCHOR_DAY}'"
SEED = "s1"
SHELF_LOTS = 16


def _mastery(t: Tables):
    return P.mastery_by_topic(t.attempts(), P.progress(t.outcomes()), TOPICS)


@query("A6 M1", f"WITH {PROGRESS} SELECT user_id, topic, total_attempted, total_correct, mastery_pct, last_attempted FROM progress")
def progress_by_user_topic(t: Tables):
    return P.progress(t.outcomes()).select("user_id", "topic", "total_attempted", "total_correct", "mastery_pct", "last_attempted")


@query("J14", f"WITH {MASTERY} SELECT * FROM mastery")
def mastery_by_topic(t: Tables):
    return _mastery(t)


@query("A9 M2", f"""WITH {MASTERY}
SELECT *, CASE WHEN readiness >= 70 THEN 'strong' WHEN readiness >= 50 THEN 'medium' ELSE 'weak' END AS band
FROM (SELECT user_id, round_even(CAST(sum(CAST(mastery_pct AS DECIMAL(9,2)) * weight) AS DOUBLE), 1) AS readiness
      FROM mastery JOIN {WEIGHT_ROWS} USING (topic) GROUP BY user_id)""")
def readiness_by_user(t: Tables):
    return P.readiness(_mastery(t), WEIGHTS).withColumn("band", M.mastery_status(F.col("readiness")))


@query("A7", f"""WITH {PROGRESS}
SELECT user_id, CAST(sum(total_attempted) AS BIGINT) AS total_attempted, CAST(sum(total_correct) AS BIGINT) AS total_correct,
       round_even(100.0::DOUBLE * sum(total_correct) / sum(total_attempted), 1) AS accuracy_pct
FROM progress GROUP BY user_id""")
def accuracy_by_user(t: Tables):
    return P.accuracy(P.progress(t.outcomes()), ["user_id"])


@query("A8", f"""WITH {MASTERY}
SELECT user_id, count(*) FILTER (mastery_pct >= 70) AS mastered, count(*) FILTER (mastery_pct < 50) AS weak,
       count(*) FILTER (mastery_pct < 70) AS below_mark FROM mastery GROUP BY user_id""")
def mastered_and_weak_counts(t: Tables):
    return P.mastered_counts(_mastery(t))


@query("O6", f"""WITH {MASTERY}, r AS (
  SELECT *, min(mastery_pct) OVER (PARTITION BY user_id) AS m,
         CASE WHEN mastery_pct < 50 THEN 'high' WHEN mastery_pct < 70 THEN 'medium' END AS priority FROM mastery)
SELECT user_id, topic, mastery_pct, priority,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY mastery_pct, topic) AS INTEGER) AS place
FROM r WHERE priority = 'high' OR (priority = 'medium' AND m >= 50)
QUALIFY place <= 5""")
def weakest_topics(t: Tables):
    return S.weak_topics(_mastery(t), below=V.WEAK_MARK, n=5, else_below=V.PASS_MARK)


_ANSWERS = SESSIONS + """, answers AS (
  SELECT o.*, concat_ws('-', CAST(user_id AS VARCHAR), strftime(ts, '%Y%m%d'), session_type) AS session_id,
         time_spent_sec > 2 AS answered, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), session_type ORDER BY ts, attempt_id) - 1 AS position
  FROM (SELECT attempt_id, user_id, 'src' || (question_id % 20) AS topic, is_correct AS correct, attempted_at AS ts, time_spent_sec, session_type FROM attempts) o)"""


def _answers(t: Tables):
    """Answers of a session: an answer given within two seconds counts as left blank."""
    day = F.to_date("attempted_at")
    return t.attempts().select(
        "attempt_id", F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")).alias("topic"), F.col("is_correct").alias("correct"),
        "time_spent_sec", "session_type", (F.col("time_spent_sec") > 2).alias("answered"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format(day, "yyyyMMdd"), "session_type").alias("session_id"))


@query("A4", f"""WITH {_ANSWERS}
SELECT session_id, topic, CAST(sum(CAST(correct AND answered AS INT)) AS BIGINT) AS correct, count(*) AS total,
       round_even(100.0::DOUBLE * sum(CAST(correct AND answered AS INT)) / count(*), 1) AS pct
FROM answers GROUP BY ALL""")
def exam_scores_by_topic(t: Tables):
    return P.topic_scores(_answers(t), "session_id", unanswered="wrong")


@query("A4", f"""WITH {_ANSWERS}
SELECT session_id, topic, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS correct, count(*) AS total,
       round_even(100.0::DOUBLE * sum(CAST(correct AS INT)) / count(*), 1) AS pct
FROM answers WHERE answered GROUP BY ALL""")
def quiz_scores_by_topic(t: Tables):
    return P.topic_scores(_answers(t), "session_id", unanswered="skipped")


@query("A5 M5", f"""WITH {_ANSWERS}, s AS (
  SELECT session_id, count(*) AS total, CAST(sum(CAST(correct AND answered AS INT)) AS BIGINT) AS correct,
         count(*) FILTER (NOT answered) AS skipped, CAST(sum(time_spent_sec) AS BIGINT) AS duration_sec,
         max(CASE WHEN session_type = 'signup' THEN 60 ELSE 70 END) AS pass_mark
  FROM answers GROUP BY session_id)
SELECT *, score_pct >= pass_mark AS passed, round_even(score_pct - pass_mark, 1) AS points_to_mark,
       CASE WHEN duration_sec >= 3600 THEN printf('%dh %02dm %02ds', duration_sec // 3600, duration_sec % 3600 // 60, duration_sec % 60)
            ELSE printf('%dm %02ds', duration_sec // 60, duration_sec % 60) END AS duration
FROM (SELECT *, round_even(100.0::DOUBLE * correct / total, 2) AS score_pct FROM s)""")
def session_totals(t: Tables):
    mark = F.when(F.col("session_type") == "signup", V.DIAGNOSTIC_PASS_MARK).otherwise(V.PASS_MARK)
    return (P.session_totals(_answers(t), "session_id", mark).withColumn("duration", M.duration_text(F.col("duration_sec"))))


@query("A10", f"""WITH {_ANSWERS}, sized AS (SELECT *, count(*) OVER (PARTITION BY session_id) // 2 AS h FROM answers)
SELECT session_id, max(h) AS half, count(*) FILTER (correct AND position < h) AS first_correct,
       count(*) FILTER (correct AND position >= h) AS second_correct,
       CASE WHEN max(h) = 0 THEN 0.0 ELSE round_even(100.0::DOUBLE * count(*) FILTER (correct AND position < h) / max(h), 1) END AS first_pct,
       CASE WHEN max(h) = 0 THEN 0.0 ELSE round_even(100.0::DOUBLE * count(*) FILTER (correct AND position >= h) / max(h), 1) END AS second_pct
FROM sized GROUP BY session_id""")
def half_scores(t: Tables):
    """Positions follow the attempt number, which grows with time; sizes come from a grouped count."""
    from scholia.operators.linkage import position_in_group
    rows = _answers(t).select("session_id", "attempt_id", "correct")
    sizes = rows.groupBy("session_id").agg(F.count("*").alias("size"))
    placed = position_in_group(rows, "session_id", "attempt_id", "place").join(sizes, "session_id")
    return P.half_scores(placed.withColumn("position", F.col("place") - 1), "session_id", "position", F.col("size"))


@query("A1", """SELECT CASE WHEN grouping(source) = 1 THEN 'All' ELSE coalesce(nullif(source, ''), 'Unknown') END AS source, count(*) AS n
FROM documents GROUP BY ROLLUP (source)""")
def bank_size_by_source(t: Tables):
    return P.count_by(t.raw("documents"), F.col("source"), "source", total_label="All")


@query("A2 J13", f"""WITH {SESSIONS}
SELECT c_custkey AS user_id, c_name AS name, coalesce(n, 0) AS session_count, last_active
FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, max(completed_at) AS last_active FROM sessions
                         WHERE session_type NOT IN ('error') GROUP BY user_id) s ON s.user_id = c_custkey""")
def user_activity(t: Tables):
    users = t.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return P.user_activity(users, t.sessions(), HIDDEN_TYPES)


@query("A3", f"""WITH {SESSIONS}
SELECT count(*) AS users, count(*) FILTER (c_acctbal > 0) AS diagnosed, count(*) FILTER (s.user_id IS NOT NULL) AS active_users
FROM customer LEFT JOIN (SELECT DISTINCT user_id FROM sessions WHERE session_type NOT IN ('error')) s ON s.user_id = c_custkey""")
def platform_totals(t: Tables):
    users = t.raw("customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return P.platform_totals(P.user_activity(users, t.sessions(), HIDDEN_TYPES), F.col("c_acctbal") > 0)


@query("W1", f"""WITH {SESSIONS}
SELECT user_id, session_type, session_id, completed_at, total_questions, score_pct FROM sessions
QUALIFY row_number() OVER (PARTITION BY user_id, session_type ORDER BY completed_at DESC, session_id DESC) = 1""")
def latest_state_by_type(t: Tables):
    rows = t.sessions().select("user_id", "session_type", "session_id", "completed_at", "total_questions", "score_pct")
    return H.latest_per_key(rows, ["user_id", "session_type"], ["completed_at", "session_id"])


@query("W2 M4", f"""WITH RECURSIVE {SESSIONS}, d AS (SELECT DISTINCT user_id, day FROM sessions),
  walk AS (SELECT user_id, day, 1 AS n FROM d WHERE day = {SQL_TODAY}
           UNION ALL SELECT d.user_id, d.day, n + 1 FROM walk JOIN d ON d.user_id = walk.user_id AND d.day = walk.day - 1)
SELECT u.user_id, CAST(coalesce(max(n), 0) AS BIGINT) AS streak FROM (SELECT DISTINCT user_id FROM d) u LEFT JOIN walk w ON w.user_id = u.user_id GROUP BY u.user_id""")
def active_day_streak(t: Tables):
    return H.streak(t.sessions(), today())


_BOXES = REVIEWS + """, ordered AS (
  SELECT *, row_number() OVER w AS rn, sum(CAST(NOT knew AS INT)) OVER w AS island FROM reviews
  WINDOW w AS (PARTITION BY user_id, card_id ORDER BY ts, seq)), runs AS (
  SELECT user_id, card_id, island, count(*) FILTER (knew) AS run, max(ts) AS upto FROM ordered GROUP BY ALL), boxes AS (
  SELECT user_id, card_id, CAST(least(1 + run, 5) AS INTEGER) AS box, times_correct, times_wrong, updated_at,
         updated_at + INTERVAL 1 DAY * (CASE least(1 + run, 5) WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 7 ELSE 14 END) AS next_review_at
  FROM (SELECT user_id, card_id, arg_max(run, island) AS run FROM runs GROUP BY ALL)
  JOIN (SELECT user_id, card_id, count(*) FILTER (knew) AS times_correct, count(*) FILTER (NOT knew) AS times_wrong,
               max(ts) AS updated_at FROM reviews GROUP BY ALL) USING (user_id, card_id))"""


@query("W3 M6", f"WITH {_BOXES} SELECT * FROM boxes")
def review_boxes(t: Tables):
    return H.review_boxes(t.reviews())


_STATUS = _BOXES + f""", status AS (
  SELECT c.user_id, c.card_id, box, next_review_at,
         CASE WHEN box IS NOT NULL THEN (epoch_us({SQL_NOW}) - epoch_us(next_review_at)) // 1000000 END AS overdue_sec,
         CASE WHEN box IS NULL THEN 'new' WHEN box = 1 OR next_review_at <= {SQL_NOW} THEN 'due' ELSE 'future' END AS status
  FROM (SELECT u.user_id, k.card_id FROM (SELECT DISTINCT user_id, question_id % 7 AS slot FROM attempts) u
        JOIN (SELECT DISTINCT question_id AS card_id FROM attempts) k ON k.card_id % 7 = u.slot) c
  LEFT JOIN boxes b ON b.user_id = c.user_id AND b.card_id = c.card_id)"""


def _status(t: Tables):
    """Each user's deck: the cards of every shelf (card number modulo 7) that the user has touched. All answers count as reviews."""
    touched = t.attempts().select("user_id", F.col("question_id").alias("card_id"), (F.col("question_id") % 7).alias("shelf"))
    cards = touched.select("card_id", "shelf").distinct()
    # Seven shelves are few join keys, so each shelf is dealt out by user; its cards go to every lot.
    lot = F.pmod(F.xxhash64("user_id"), F.lit(SHELF_LOTS)).cast("int")
    shelves = touched.select("user_id", "shelf").distinct().withColumn("lot", lot)
    dealt = cards.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(SHELF_LOTS - 1))))
    decks = shelves.join(dealt, ["shelf", "lot"]).select("user_id", "card_id")
    return S.card_status(decks, H.review_boxes(t.reviews()), now())


@query("J15", f"WITH {_STATUS} SELECT user_id, card_id, coalesce(box, 0) AS box, next_review_at, status FROM status")
def card_status(t: Tables):
    return _status(t).drop("overdue_sec").fillna(0, ["box"])


@query("A11", f"""WITH {_STATUS}
SELECT user_id, count(*) FILTER (box = 1) AS box_1, count(*) FILTER (box = 2) AS box_2, count(*) FILTER (box = 3) AS box_3,
       count(*) FILTER (box = 4) AS box_4, count(*) FILTER (box = 5) AS box_5, count(*) FILTER (status = 'due') AS due,
       count(*) FILTER (status = 'new') AS "new", count(*) FILTER (box = 5) AS mastered FROM status GROUP BY user_id""")
def box_distribution(t: Tables):
    return S.box_counts(_status(t))


@query("O5", f"""WITH {_STATUS}
SELECT user_id, card_id, status, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE status WHEN 'due' THEN 0 ELSE 1 END, box NULLS LAST,
         overdue_sec DESC NULLS LAST, md5('{SEED}:' || user_id || ':' || card_id), card_id) AS INTEGER) AS place
FROM status WHERE status <> 'future'""")
def review_queue(t: Tables):
    return S.review_order(_status(t), SEED).select("user_id", "card_id", "status", "place")


@query("W6", f"""WITH {SESSIONS}
SELECT user_id, session_id, completed_at, score_pct, CAST(row_number() OVER (PARTITION BY user_id ORDER BY completed_at DESC, session_id DESC) AS INTEGER) AS rank
FROM sessions WHERE session_type NOT IN ('error') QUALIFY rank <= 30""")
def score_trend(t: Tables):
    rows = P.visible_sessions(t.sessions(), HIDDEN_TYPES).select("user_id", "session_id", "completed_at", "score_pct")
    return H.newest_rows(rows, "user_id", [F.col("completed_at").desc(), F.col("session_id").desc()], 30)


@query("F4", f"""WITH {SESSIONS} SELECT session_id, user_id, session_type, completed_at, score_pct FROM sessions WHERE session_type NOT IN ('error')""")
def visible_sessions(t: Tables):
    return (P.visible_sessions(t.sessions(), HIDDEN_TYPES).select("session_id", "user_id", "session_type", "completed_at", "score_pct"))


@query("W7", f"""WITH {ATTEMPTS}
SELECT user_id, question_id, attempted_at, attempt_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY attempted_at DESC, attempt_id DESC) AS INTEGER) AS rank
FROM attempts WHERE NOT is_correct QUALIFY rank <= 400""")
def latest_wrong_attempts(t: Tables):
    return H.latest_wrong(t.attempts(), 400)


@query("W11 M2 M4", f"""WITH {SESSIONS}, last AS (
  SELECT * FROM sessions WHERE session_type NOT IN ('error') AND day <= {SQL_TODAY}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY completed_at DESC, session_id DESC) = 1)
SELECT user_id, session_type, score_pct, CAST({SQL_TODAY} - day AS INTEGER) AS days_ago,
       CASE {SQL_TODAY} - day WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE CAST({SQL_TODAY} - day AS VARCHAR) || 'd ago' END AS age,
       CASE WHEN score_pct >= 70 THEN 'strong' WHEN score_pct >= 50 THEN 'medium' ELSE 'weak' END AS band FROM last""")
def last_session(t: Tables):
    rows = (P.visible_sessions(t.sessions(), HIDDEN_TYPES).where(F.col("day") <= today())
            .select("user_id", "session_type", "score_pct", "day", "completed_at", "session_id"))
    days = F.datediff(today(), F.col("day"))
    return (H.latest_per_key(rows, ["user_id"], ["completed_at", "session_id"])
            .select("user_id", "session_type", "score_pct", days.alias("days_ago"), M.age_label(days).alias("age"),
                    M.mastery_status(F.col("score_pct")).alias("band")))


@query("M4 M2", f"""SELECT o_orderkey AS plan_id, CAST(CAST(o_orderdate AS DATE) - DATE '1995-06-17' AS INTEGER) AS days_left,
       CASE WHEN CAST(o_orderdate AS DATE) - DATE '1995-06-17' < 14 THEN 'urgent' WHEN CAST(o_orderdate AS DATE) - DATE '1995-06-17' < 45 THEN 'soon' ELSE 'far' END AS status
FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1995-06-17'""")
def exam_countdown(t: Tables):
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-06-17").cast("date"))
    return (t.raw("orders").where(F.col("o_orderdate") >= F.lit("1995-06-18").cast("timestamp_ntz"))
            .select(F.col("o_orderkey").alias("plan_id"), days.alias("days_left"), M.countdown_status(days).alias("status")))


# ---- Sampling ----

@query("O1 F1", f"""SELECT doc_id AS question_id, source AS topic FROM documents WHERE lang = 'en'
ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT 50""")
def random_questions(t: Tables):
    from scholia.operators.filters import matching
    return S.random_rows(matching(t.bank(), topic="All", lang="EN"), "question_id", 50, SEED).select("question_id", "topic")


@query("O2", f"""SELECT doc_id AS question_id, source AS topic, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id), doc_id) AS INTEGER) AS pick
FROM documents QUALIFY pick <= 3""")
def diagnostic_sample(t: Tables):
    return S.rows_per_group(t.bank().select("question_id", "topic"), "topic", "question_id", 3, SEED)


@query("O2", f"""SELECT doc_id AS question_id, source AS topic, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('quiz:' || doc_id), doc_id) AS INTEGER) AS pick
FROM documents QUALIFY pick <= 20""")
def mixed_quiz_pool(t: Tables):
    return S.rows_per_group(t.bank().select("question_id", "topic"), "topic", "question_id", S.mixed_quiz_size(30), "quiz")


_WRONG = """, wrong AS (SELECT DISTINCT user_id, question_id FROM (SELECT user_id, question_id FROM attempts WHERE NOT is_correct
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY attempted_at DESC, attempt_id DESC) <= @))"""


@query("O3 J3", f"""WITH {MASTERY}{_WRONG.replace('@', '400')},
  pool AS (SELECT doc_id AS question_id, source AS topic FROM documents ORDER BY md5('pool:' || doc_id), doc_id LIMIT 200),
  tickets AS (SELECT m.user_id, p.question_id, p.topic, w.question_id IS NOT NULL AS was_wrong,
    CAST((CASE WHEN mastery_pct < 30 THEN 5 WHEN mastery_pct < 50 THEN 3 WHEN mastery_pct < 70 THEN 2 ELSE 1 END)
      * (CASE WHEN w.question_id IS NULL THEN 1 ELSE 2 END) AS INTEGER) AS tickets
    FROM mastery m JOIN pool p ON p.topic = m.topic LEFT JOIN wrong w ON w.user_id = m.user_id AND w.question_id = p.question_id)
SELECT user_id, question_id, topic, tickets, was_wrong, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ticket, question_id) AS INTEGER) AS pick
FROM (SELECT *, list_min(list_transform(range(1, tickets + 1), lambda i: md5('{SEED}:' || user_id || ':' || question_id || ':' || i))) AS ticket FROM tickets)
QUALIFY pick <= 20""")
def weighted_sample(t: Tables):
    pool = S.random_rows(t.bank().select("question_id", "topic"), "question_id", S.pool_size(20, one_topic=False), "pool")
    return S.weighted_sample(pool, _mastery(t), H.latest_wrong(t.attempts(), 400), 20, SEED)


_BLUEPRINT = f"""{ATTEMPTS}{_WRONG.replace('@', '500')},
  pool AS (SELECT doc_id AS question_id, source AS topic, quota FROM documents JOIN {QUOTA_ROWS} ON q.topic = source
           QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('pool:' || doc_id), doc_id) <= greatest(4 * quota, 40)),
  picked AS (SELECT u.user_id, p.topic, p.question_id, w.question_id IS NOT NULL AS was_wrong, quota,
      CAST(row_number() OVER (PARTITION BY u.user_id, p.topic ORDER BY w.question_id IS NOT NULL DESC, md5('{SEED}:' || u.user_id || ':' || p.question_id), p.question_id) AS INTEGER) AS pick
    FROM (SELECT DISTINCT user_id FROM attempts) u CROSS JOIN pool p LEFT JOIN wrong w ON w.user_id = u.user_id AND w.question_id = p.question_id
    QUALIFY pick <= quota)"""


def _blueprint(t: Tables):
    pool = S.blueprint_pool(t.bank().select("question_id", "topic"), QUOTAS, "pool")
    return S.blueprint_sample(t.attempts(), pool, H.latest_wrong(t.attempts(), 500), QUOTAS, SEED)


@query("O4", f"WITH {_BLUEPRINT} SELECT user_id, topic, pick, question_id, was_wrong FROM picked")
def blueprint_sample(t: Tables):
    return _blueprint(t)


@query("O4", f"""WITH {_BLUEPRINT}, g AS (SELECT user_id, topic, count(*) AS got FROM picked GROUP BY ALL)
SELECT u.user_id, q.topic, coalesce(got, 0) AS got, quota, quota - coalesce(got, 0) AS missing
FROM (SELECT DISTINCT user_id FROM attempts) u CROSS JOIN {QUOTA_ROWS} LEFT JOIN g ON g.user_id = u.user_id AND g.topic = q.topic""")
def blueprint_shortage(t: Tables):
    return S.blueprint_shortage(t.attempts(), _blueprint(t), QUOTAS)
