"""The attempt stream: progress, review boxes, resumable state and session deadlines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholia import fixed_values as V
from scholia.functions.scalars import add_days, percentage
from scholia.operators.progress import progress

# A state holds all keys of one lot, so that a task is called once for each lot and not once for each key.
LOTS = 4096


def _by_lot(rows: DataFrame, *keys: str, lots: int):
    return rows.withColumn("lot", F.pmod(F.xxhash64(*keys), F.lit(lots)).cast("int")).groupBy("lot")


def _lists(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in fields])


def progress_stream(outcomes: DataFrame) -> DataFrame:
    """Running progress per (user, topic); the same aggregate as in batch, for update mode."""
    return progress(outcomes)


def latest_state_stream(states: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running newest row per key, for update mode."""
    rest = [c for c in states.columns if c not in keys]
    return (states.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
            .select(*keys, *[F.col("row")[c].alias(c) for c in rest]))


def review_box_stream(reviews: DataFrame, key_types: tuple[T.DataType, T.DataType], top: int = max(V.BOX_DAYS), lots: int = LOTS) -> DataFrame:
    """Box, counters and last review per (user_id, card_id) from (user_id, card_id, knew, ts, seq), one row per touched card.

    Answers of a micro-batch count in (ts, seq) order, after those of earlier batches. Only a card's newest top - 1 answers can
    matter for its box, so each input partition is first cut down to those and the counters; a card that holds much of a
    micro-batch does not gather in one task. Cards are kept in `lots` states by a hash of their key; a stream that goes on from a
    checkpoint must keep that number. Reviews without user or card count nowhere, as in batch.
    """
    keys, tail = ["user_id", "card_id"], top - 1
    thin = T.StructType([T.StructField("user_id", key_types[0]), T.StructField("card_id", key_types[1]), T.StructField("knew", T.BooleanType()),
                         reviews.schema["ts"], T.StructField("seq", T.LongType()), T.StructField("right", T.LongType()), T.StructField("wrong", T.LongType())])
    out = T.StructType([*thin.fields[:2], T.StructField("box", T.IntegerType()), T.StructField("times_correct", T.LongType()),
                        T.StructField("times_wrong", T.LongType()), T.StructField("last_seq", T.LongType())])

    state_type = _lists([*zip(keys, key_types), ("box", T.IntegerType()), ("right", T.LongType()), ("wrong", T.LongType())])

    def newest(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in chunks:
            if rows.empty:
                continue
            rows = rows.sort_values(["ts", "seq"])
            right = rows["knew"].astype("int64")
            groups = [rows["user_id"], rows["card_id"]]
            back = rows.groupby(keys).cumcount(ascending=False)
            rows = rows.assign(right=right.groupby(groups).transform("sum"), size=right.groupby(groups).transform("size"))
            # The counters travel on a card's newest row.
            rows = rows.assign(wrong=(rows["size"] - rows["right"]).where(back == 0, 0), right=rows["right"].where(back == 0, 0))
            yield rows.loc[back < tail, thin.names]

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cards = {}
        if state.exists:
            users, numbers, *counts = state.get
            cards = dict(zip(zip(users, numbers), zip(*counts)))
        rows = pd.concat(list(chunks)).sort_values(["ts", "seq"])
        touched: dict[tuple, list] = {}
        columns = [rows[c].tolist() for c in ("knew", "seq", "right", "wrong")]
        for card, knew, seq, right, wrong in zip(zip(*(rows[k].tolist() for k in keys)), *columns):
            seen = touched.setdefault(card, [[], 0, 0, seq])
            seen[0].append(knew)
            seen[1:] = seen[1] + right, seen[2] + wrong, seq
        out_rows = []
        for card, (answers, new_right, new_wrong, last) in touched.items():
            box, right, wrong = cards.get(card, (1, 0, 0))
            for knew in answers[-tail:]:
                box = min(box + 1, top) if knew else 1
            cards[card] = box, right + new_right, wrong + new_wrong
            out_rows.append((*card, *cards[card], last))
        state.update(tuple(map(list, zip(*((*card, *counts) for card, counts in cards.items())))))
        yield pd.DataFrame(out_rows, columns=out.names)

    return (_by_lot(reviews.select(*keys, "knew", "ts", "seq").dropna(subset=keys).mapInPandas(newest, thin), *keys, lots=lots)
            .applyInPandasWithState(fold, out, state_type, "update", GroupStateTimeout.NoTimeout))


def due_dates(boxes: DataFrame, updated_at: Column, days: dict[int, int] = V.BOX_DAYS) -> DataFrame:
    wait = F.element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), F.col("box"))
    return boxes.withColumn("next_review_at", add_days(updated_at, wait))


def closed_sessions(answers: DataFrame, budget_sec: Column) -> DataFrame:
    """Batch form of the deadline: answers up to start + budget count, all other questions of the session are wrong.

    Takes (session_id, started_at, size, ts, correct); the budget may use `size`.
    """
    in_time = F.col("ts") <= F.col("started_at") + F.make_dt_interval(secs=budget_sec)
    return (answers.groupBy("session_id").agg(F.max("size").alias("size"), F.count_if(in_time).alias("answered"),
                                              F.count_if(in_time & F.col("correct")).alias("correct"))
            .withColumn("blank", F.col("size") - F.col("answered"))
            .withColumn("score_pct", percentage(F.col("correct"), F.col("size"), 2)))


DEADLINE_STATE = _lists([("session_id", T.StringType()), ("size", T.LongType()), ("answered", T.LongType()), ("correct", T.LongType()),
                         ("deadline", T.LongType()), ("forget", T.LongType())])
CLOSED = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("size", T.LongType()), T.StructField("answered", T.LongType()),
                       T.StructField("correct", T.LongType())])


def session_budget(session_type: Column, size: Column, fixed: dict[str, int] = V.SESSION_BUDGETS, per_question: int = V.SECONDS_PER_QUESTION) -> Column:
    """Seconds that a session may take: those of its type, or so many a question."""
    named = F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv]) if fixed else F.create_map().cast("map<string,int>")
    return F.coalesce(F.try_element_at(named, session_type), size * per_question).cast("long")


def closed_session_stream(answers: DataFrame, lateness: str, budget_sec: Column | None = None, retention: str = "1 day",
                          lots: int = LOTS) -> DataFrame:
    """Emit a session once, when the watermark passes its deadline, start + `budget_sec` (90 seconds a question, unless given).
    A session first seen behind its deadline is emitted at once. Answers after the close don't count: a closed session is remembered
    for `retention` of event time. `lateness` is how far answers may lag behind the newest one. Sessions are kept in `lots` states by a
    hash of their id; a stream that goes on from a checkpoint must keep that number.

    Takes (session_id, started_at, size, ts, correct), times as TIMESTAMP in a session whose time zone is UTC.
    """

    keep = int(pd.Timedelta(retention).total_seconds() * 1000)

    def milliseconds(times: pd.Series) -> list[int]:
        utc = times.dt.tz_convert("UTC").dt.tz_localize(None) if times.dt.tz is not None else times
        return (utc.to_numpy().astype("datetime64[us]").astype("int64") // 1000).tolist()

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        # size, answered, correct, deadline (-1: closed), when to forget a closed one
        sessions = {}
        if state.exists:
            ids, *facts = state.get
            sessions = {s: list(some) for s, some in zip(ids, zip(*facts))}
        if not state.hasTimedOut:
            rows = pd.concat(list(chunks))
            ends = rows["started_at"] + pd.to_timedelta(rows["budget_sec"], unit="s")
            timely = rows["ts"] <= ends
            right = timely & (rows["correct"] == True)  # noqa: E712 (null is wrong)
            touched = set()
            for s, size, end, timely_one, right_one in zip(rows["session_id"].tolist(), rows["size"].tolist(), milliseconds(ends), timely.tolist(), right.tolist()):
                held = sessions.setdefault(s, [0, 0, 0, 0, 0])
                if held[3] < 0:
                    held[4] = now + keep
                    continue
                if s not in touched:
                    touched.add(s)
                    held[0], held[3] = int(size), end
                held[1] += timely_one
                held[2] += right_one
        out_rows = []
        for s, held in sessions.items():
            if 0 <= held[3] < now:
                out_rows.append((s, *held[:3]))
                held[3:] = -1, now + keep
        sessions = {s: held for s, held in sessions.items() if held[3] >= 0 or held[4] > now}
        if sessions:
            state.update(tuple(map(list, zip(*((s, *held) for s, held in sessions.items())))))
            state.setTimeoutTimestamp(max(now, min(held[4] if held[3] < 0 else held[3] for held in sessions.values())) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out_rows, columns=CLOSED.names)

    budget = F.col("size") * V.SECONDS_PER_QUESTION if budget_sec is None else budget_sec
    return (_by_lot(answers.withColumn("budget_sec", budget.cast("long")).withWatermark("ts", lateness), "session_id", lots=lots)
            .applyInPandasWithState(fold, CLOSED, DEADLINE_STATE, "append", GroupStateTimeout.EventTimeTimeout))
