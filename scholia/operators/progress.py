"""Progress, mastery, readiness, sessions and users: grouped aggregates over outcomes and sessions.

All groupings combine on the map side, so a hot user or topic costs one partial row per input partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia import fixed_values as V
from scholia.functions.scalars import percentage


def outcomes_by_question(attempts: DataFrame, topics: DataFrame) -> DataFrame:
    """Outcomes (user_id, topic, correct, attempted, ts) of an attempt log, one row per user and question.

    The log is reduced before it meets the bank, so the join moves a row per user and question, however often it was asked.
    """
    totals = attempts.groupBy("user_id", "question_id").agg(
        F.sum(F.col("is_correct").cast("int")).alias("correct"), F.count("*").alias("attempted"), F.max("attempted_at").alias("ts"))
    return totals.join(topics.select("question_id", "topic"), "question_id").select("user_id", "topic", "correct", "attempted", "ts")


def progress(outcomes: DataFrame, by: list[str] = ["user_id", "topic"]) -> DataFrame:
    """Attempted, correct, mastery and last activity per key, from rows (keys, correct, attempted, ts)."""
    return (outcomes.groupBy(*by)
            .agg(F.sum("attempted").cast("bigint").alias("total_attempted"),
                 F.sum("correct").cast("bigint").alias("total_correct"),
                 F.max("ts").alias("last_attempted"))
            .withColumn("mastery_pct", percentage(F.col("total_correct"), F.col("total_attempted"), 2)))


def mastery_by_topic(users: DataFrame, progress_rows: DataFrame, topics: list[str]) -> DataFrame:
    """One row per user and known topic, 0 where never attempted; unknown topics are left out.

    The topic catalogue is exploded from a literal array, so no join is needed to build the frame.
    """
    frame = users.select("user_id").distinct().select(
        "user_id", F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"))
    return (frame.join(progress_rows.select("user_id", "topic", "mastery_pct"), ["user_id", "topic"], "left")
            .select("user_id", "topic", F.coalesce("mastery_pct", F.lit(0.0)).alias("mastery_pct")))


def readiness(mastery: DataFrame, weights: dict[str, str | float], digits: int = 1) -> DataFrame:
    """Weighted mastery per user. The sum runs on decimals, so it does not depend on the order of the rows."""
    pairs = [F.lit(x) for topic, w in weights.items() for x in (topic, str(w))]
    weight = F.try_element_at(F.create_map(*pairs), F.col("topic")).cast("decimal(9,6)")
    product = F.col("mastery_pct").cast("decimal(9,2)") * F.coalesce(weight, F.lit("0").cast("decimal(9,6)"))
    return mastery.groupBy("user_id").agg(F.bround(F.sum(product).cast("double"), digits).alias("readiness"))


def accuracy(progress_rows: DataFrame, by: list[str]) -> DataFrame:
    return (progress_rows.groupBy(*by)
            .agg(F.sum("total_attempted").alias("total_attempted"), F.sum("total_correct").alias("total_correct"))
            .withColumn("accuracy_pct", percentage(F.col("total_correct"), F.col("total_attempted"), 1)))


def mastered_counts(mastery: DataFrame, mastered_at: float = V.PASS_MARK, weak_below: float = V.WEAK_MARK) -> DataFrame:
    return mastery.groupBy("user_id").agg(
        F.count_if(F.col("mastery_pct") >= mastered_at).alias("mastered"),
        F.count_if(F.col("mastery_pct") < weak_below).alias("weak"),
        F.count_if(F.col("mastery_pct") < mastered_at).alias("below_mark"))


def topic_scores(answers: DataFrame, session: str, unanswered: str = "wrong") -> DataFrame:
    """Correct, total and percentage per session and topic.

    `answers` holds (session, topic, correct, answered). Exams count unanswered rows as wrong, quizzes skip them.
    """
    rows = answers if unanswered == "wrong" else answers.where("answered")
    right = (F.col("correct") & F.col("answered")).cast("int")
    return (rows.groupBy(session, "topic").agg(F.sum(right).alias("correct"), F.count("*").alias("total"))
            .withColumn("pct", percentage(F.col("correct"), F.col("total"), 1)))


def session_totals(answers: DataFrame, session: str, pass_mark: Column, digits: int = 2) -> DataFrame:
    """Score, skipped, duration, pass flag and distance to the pass mark per session."""
    right = (F.col("correct") & F.col("answered")).cast("int")
    return (answers.groupBy(session)
            .agg(F.count("*").alias("total"), F.sum(right).alias("correct"),
                 F.count_if(~F.col("answered")).alias("skipped"), F.sum("time_spent_sec").alias("duration_sec"),
                 F.max(pass_mark).alias("pass_mark"))
            .withColumn("score_pct", percentage(F.col("correct"), F.col("total"), digits))
            .withColumn("passed", F.col("score_pct") >= F.col("pass_mark"))
            .withColumn("points_to_mark", F.bround(F.col("score_pct") - F.col("pass_mark"), 1)))


def half_scores(answers: DataFrame, session: str, position: str, size: Column) -> DataFrame:
    """Score of the first and the second half of a session, by question position from 0; both over size // 2."""
    half = F.floor(size / 2)
    return (answers.groupBy(session)
            .agg(F.max(half).alias("half"),
                 F.count_if(F.col("correct") & (F.col(position) < half)).alias("first_correct"),
                 F.count_if(F.col("correct") & (F.col(position) >= half)).alias("second_correct"))
            .withColumn("first_pct", percentage(F.col("first_correct"), F.col("half"), 1))
            .withColumn("second_pct", percentage(F.col("second_correct"), F.col("half"), 1)))


def count_by(df: DataFrame, key: Column, name: str, total_label: str | None = None) -> DataFrame:
    """Rows per value (null and '' are "Unknown"), with a totals row when `total_label` is given."""
    labelled = df.select(F.coalesce(F.nullif(key, F.lit("")), F.lit("Unknown")).alias(name))
    if total_label is None:
        return labelled.groupBy(name).agg(F.count("*").alias("n"))
    return (labelled.rollup(name).agg(F.count("*").alias("n"), F.grouping(name).alias("is_total"))
            .select(F.when(F.col("is_total") == 1, F.lit(total_label)).otherwise(F.col(name)).alias(name), "n"))


def visible_sessions(sessions: DataFrame, hidden: list[str] = V.STATE_SESSION_TYPES) -> DataFrame:
    return sessions.where(~F.col("session_type").isin(hidden))


def user_activity(users: DataFrame, sessions: DataFrame, hidden: list[str] = V.STATE_SESSION_TYPES) -> DataFrame:
    """All users with their session count and last activity; sessions are aggregated before the join."""
    stats = (visible_sessions(sessions, hidden).groupBy("user_id")
             .agg(F.count("*").alias("session_count"), F.max("completed_at").alias("last_active")))
    return users.join(stats, "user_id", "left").withColumn("session_count", F.coalesce("session_count", F.lit(0)))


def platform_totals(activity: DataFrame, diagnosed: Column) -> DataFrame:
    return activity.agg(F.count("*").alias("users"), F.count_if(diagnosed).alias("diagnosed"),
                        F.count_if(F.col("session_count") > 0).alias("active_users"))


def letter_shares(df: DataFrame, letter: str) -> DataFrame:
    """Rows per answer letter with the whole-number percentage. The window runs over the few grouped letters."""
    from pyspark.sql import Window
    counts = df.groupBy(letter).agg(F.count("*").alias("n"))
    everything = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", F.floor(100 * F.col("n") / everything).cast("int"))
