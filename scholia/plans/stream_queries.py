"""The events table replayed as a stream; results must equal the batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia import fixed_values as V
from scholia.plans.learner_queries import _BOXES
from scholia.plans.registry import query
from scholia.plans.tables import ATTEMPTS, CORRECT_BELOW, PROGRESS, Tables
from scholia.streaming import keyed as K
from scholia.streaming import sinks


def _attempt_stream(t: Tables) -> DataFrame:
    schema = t.raw("events").schema
    events = t.spark.readStream.schema(schema).parquet(f"{t.folder}/events*.parquet")
    return events.select(F.col("event_id").alias("attempt_id"), "user_id", F.get_json_object("props", "$.k").cast("int").alias("question_id"),
                         (F.col("value") < CORRECT_BELOW).alias("is_correct"), F.col("ts").alias("attempted_at"),
                         F.floor("value").cast("int").alias("time_spent_sec"), F.col("event_type").alias("session_type"))


def _run(t: Tables, stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    folder = sinks.working_folder(t.spark)
    sinks.write_changes(stream, folder, mode).awaitTermination()
    return sinks.read_latest(t.spark, folder, keys)


@query("ST1", f"WITH {PROGRESS} SELECT user_id, topic, total_attempted, total_correct, mastery_pct, last_attempted FROM progress")
def streamed_progress(t: Tables):
    topics = t.bank().select("question_id", "topic")
    outcomes = _attempt_stream(t).join(topics, "question_id").select(
        "user_id", "topic", F.col("is_correct").cast("int").alias("correct"), F.lit(1).alias("attempted"), F.col("attempted_at").alias("ts"))
    return (_run(t, K.progress_stream(outcomes), ["user_id", "topic"])
            .select("user_id", "topic", "total_attempted", "total_correct", "mastery_pct", "last_attempted"))


@query("ST2", f"WITH {_BOXES} SELECT user_id, card_id, box, times_correct, times_wrong, last_seq FROM boxes JOIN (SELECT user_id, card_id, arg_max(seq, (ts, seq)) AS last_seq FROM reviews GROUP BY ALL) USING (user_id, card_id)")
def streamed_boxes(t: Tables):
    reviews = _attempt_stream(t).select("user_id", F.col("question_id").alias("card_id"), F.col("is_correct").alias("knew"),
                                        F.col("attempted_at").alias("ts"), F.col("attempt_id").alias("seq"))
    return _run(t, K.review_box_stream(reviews, (T.LongType(), T.IntegerType())), ["user_id", "card_id"])


@query("ST3", f"""WITH {ATTEMPTS} SELECT user_id, session_type, attempt_id, attempted_at FROM attempts
QUALIFY row_number() OVER (PARTITION BY user_id, session_type ORDER BY attempted_at DESC, attempt_id DESC) = 1""")
def streamed_states(t: Tables):
    states = _attempt_stream(t).select("user_id", "session_type", "attempt_id", "attempted_at")
    return _run(t, K.latest_state_stream(states, ["user_id", "session_type"], ["attempted_at", "attempt_id"]), ["user_id", "session_type"])


_TIMED = ATTEMPTS + """, d AS (SELECT *, CAST(attempted_at AS DATE) AS day FROM attempts), timed AS (
  SELECT concat_ws('-', CAST(user_id AS VARCHAR), strftime(day, '%Y%m%d')) AS session_id, min(attempted_at) OVER w AS started_at, 2 * count(*) OVER w AS size,
         attempted_at AS ts, is_correct AS correct FROM d WINDOW w AS (PARTITION BY user_id, day))"""


@query("ST4 A5", f"""WITH {_TIMED}, c AS (SELECT session_id, CAST(max(size) AS BIGINT) AS size, count(*) FILTER (ok) AS answered, count(*) FILTER (ok AND correct) AS correct
  FROM (SELECT *, ts <= started_at + to_seconds(size * {V.SECONDS_PER_QUESTION}) AS ok FROM timed) GROUP BY session_id)
SELECT *, size - answered AS blank, round_even(100.0::DOUBLE * correct / size, 2) AS score_pct FROM c""")
def closed_sessions(t: Tables):
    """Daily sessions with twice as many questions as answers; what comes after the time budget is not counted."""
    a = t.attempts().withColumn("day", F.to_date("attempted_at"))
    facts = a.groupBy("user_id", "day").agg(F.min("attempted_at").alias("started_at"), (2 * F.count("*")).alias("size"))
    answers = a.join(facts, ["user_id", "day"]).select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("day", "yyyyMMdd")).alias("session_id"), "started_at", "size",
        F.col("attempted_at").alias("ts"), F.col("is_correct").alias("correct"))
    return K.closed_sessions(answers, F.col("size") * V.SECONDS_PER_QUESTION)


_KINDS = {"signup": "mock_partial", "purchase": "mock_full"}
_LATENESS_HOURS = 1
_TYPED = ATTEMPTS + """, d AS (SELECT *, CAST(attempted_at AS DATE) AS day FROM attempts), typed AS (
  SELECT concat_ws('-', CAST(user_id AS VARCHAR), strftime(day, '%Y%m%d'), session_type) AS session_id, min(attempted_at) OVER w AS started_at, 2 * count(*) OVER w AS size,
         CASE session_type WHEN 'signup' THEN 67 * 60 WHEN 'purchase' THEN 135 * 60 ELSE 2 * count(*) OVER w * 90 END AS budget, attempted_at AS ts, is_correct AS correct
  FROM d WINDOW w AS (PARTITION BY user_id, day, session_type))"""


@query("ST4", f"""WITH {_TYPED} SELECT session_id, CAST(max(size) AS BIGINT) AS size, count(*) FILTER (ts <= started_at + to_seconds(budget)) AS answered,
 count(*) FILTER (correct AND ts <= started_at + to_seconds(budget)) AS correct FROM typed GROUP BY session_id
HAVING max(started_at + to_seconds(budget)) < (SELECT max(ts) FROM typed) - INTERVAL {_LATENESS_HOURS} HOUR""")
def streamed_closed_sessions(t: Tables):
    """Sessions of a user, day and type that have reached their deadline when the replayed events end; later answers aren't counted."""
    a = t.attempts().withColumn("day", F.to_date("attempted_at"))
    facts = a.groupBy("user_id", "day", "session_type").agg(F.min("attempted_at").alias("started_at"), (2 * F.count("*")).alias("size"))
    answers = (_attempt_stream(t).withColumn("day", F.to_date("attempted_at")).join(facts, ["user_id", "day", "session_type"])
               .withColumn("kind", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _KINDS.items() for x in kv]), F.col("session_type")), F.lit("quiz")))
               .select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("day", "yyyyMMdd"), "session_type").alias("session_id"),
                       F.col("started_at").cast("timestamp").alias("started_at"), "size", "kind", F.col("attempted_at").cast("timestamp").alias("ts"),
                       F.col("is_correct").alias("correct")))
    closed = K.closed_session_stream(answers, f"{_LATENESS_HOURS} hours", K.session_budget(F.col("kind"), F.col("size")))
    return _run(t, closed, ["session_id"], "append")
