"""Schemas of the stored tables and stage files."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    """'name type, ...' with the few simple types used here; works without a session."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
             "timestamp": T.TimestampType(), "date": T.DateType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (part.split() for part in ddl.split(","))])


QUESTIONS = _struct("id string, topic string, subtopic string, difficulty string, question_en string, option_a string, option_b string, "
                    "option_c string, correct_answer string, explanation_en string, explanation_fr string, source string")
FLASHCARDS = _struct("id string, topic string, concept_en string, definition_en string, definition_fr string, example_en string, formula string")
USERS = _struct("id string, email string, first_name string, target_exam_date date, created_at timestamp, diagnostic_done boolean, diagnostic_score double")
ATTEMPTS = _struct("id string, user_id string, question_id string, selected_answer string, is_correct boolean, time_spent_sec int, "
                   "session_type string, attempted_at timestamp")
SESSIONS = _struct("id string, user_id string, session_type string, topic string, total_questions int, correct_answers int, score_pct double, "
                   "duration_sec int, domain_scores_json string, completed_at timestamp")
PROGRESS = _struct("id string, user_id string, topic string, total_attempted int, total_correct int, mastery_pct double, last_attempted timestamp")
CARD_STATES = _struct("id string, user_id string, card_id string, box int, next_review_at timestamp, times_correct int, times_wrong int, updated_at timestamp")
VERDICTS = _struct("id string, verdict string, field string, new_value string, evidence string")
ITEM = _struct("n int, qnum int, stem string, A string, B string, C string, correct string, expl string")
