"""Numbers, times and JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole rounded half to even; 0 where the whole is 0 or null.

    Multiplying first keeps exact ties exact (1/32 is 3.125 on the nose), so rounding does not depend on the engine.
    """
    share = (F.lit(100.0) * part) / F.nullif(whole, F.lit(0))
    return F.coalesce(F.bround(share, digits), F.lit(0.0))


def band(value: Column, bounds: list[tuple[float, str]], below: str) -> Column:
    """Label of the first bound that `value` reaches; bounds are given from high to low."""
    chain = F
    for bound, label in bounds:
        chain = chain.when(value >= bound, F.lit(label))
    return chain.otherwise(F.lit(below))


def mastery_status(pct: Column) -> Column:
    return band(pct, [(70, "strong"), (50, "medium")], "weak")


def countdown_status(days: Column) -> Column:
    return F.when(days < 14, "urgent").when(days < 45, "soon").otherwise("far")


def parse_timestamp(text: Column, fallback: Column | None = None) -> Column:
    """ISO text with `Z`, an offset or no zone (then UTC) to an NTZ timestamp in UTC; null or `fallback` if malformed."""
    zoned = F.regexp_replace(text, "Z$", "+00:00")
    has_offset = zoned.rlike("[+-]\\d{2}:\\d{2}$")
    utc = F.when(has_offset, zoned).otherwise(F.concat(zoned, F.lit("+00:00")))
    parsed = F.to_utc_timestamp(F.try_to_timestamp(utc), F.current_timezone()).cast("timestamp_ntz")
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of an NTZ timestamp read as UTC, whatever the session zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def calendar_day(ts: Column) -> Column:
    return F.to_date(ts)


def age_label(days: Column) -> Column:
    return (F.when(days == 0, "today").when(days == 1, "yesterday")
            .otherwise(F.concat(days.cast("string"), F.lit("d ago"))))


def duration_text(seconds: Column) -> Column:
    """`1h 02m 03s`, or `2m 03s` below an hour."""
    h = F.floor(seconds / 3600).cast("int")
    m = F.floor((seconds % 3600) / 60).cast("int")
    s = (seconds % 60).cast("int")
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s)).otherwise(F.format_string("%dm %02ds", m, s))


def add_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days)


def json_scores(payload: Column) -> Column:
    """JSON object of topic -> score as a map; null where it does not parse."""
    return F.from_json(payload, T.MapType(T.StringType(), T.DoubleType()), {"mode": "PERMISSIVE"})


def integer_keys(mapping: Column) -> Column:
    return F.transform_keys(mapping, lambda k, v: k.cast("int"))


PAYLOAD_SCHEMA = T.StructType([
    T.StructField("diag_idx", T.IntegerType()),
    T.StructField("question_ids", T.ArrayType(T.StringType())),
    T.StructField("diag_questions", T.ArrayType(T.StructType([T.StructField("id", T.StringType())]))),
])


def saved_question_ids(payload: Column) -> Column:
    """Ids of a saved run: the current shape lists ids, the older one embeds whole questions."""
    parsed = F.from_json(payload, PAYLOAD_SCHEMA)
    embedded = F.transform(parsed["diag_questions"], lambda q: q["id"])
    ids = F.coalesce(parsed["question_ids"], embedded)
    return F.when(F.size(ids) > 0, ids)
