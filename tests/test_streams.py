"""Streams against their batch forms, over several micro-batches, and the file readers and writers."""

import datetime as dt
import json
import random
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.operators import history as H
from scholia.operators import progress as P
from scholia.sources import readers, schemas, writers
from scholia.streaming import keyed as K
from scholia.streaming import sinks

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, card_id int, topic string, knew boolean, ts timestamp_ntz, seq long"


def log_folder(spark, files=3, n=300):
    rng, folder = random.Random(1), tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = [(rng.randrange(4), rng.randrange(6), rng.choice("xy"), rng.random() < 0.7, T0 + dt.timedelta(minutes=i), i) for i in range(n)]
    size = n // files
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return folder


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")


def run(spark, folder, stream, keys):
    sinks.write_changes(stream, folder + "/out").awaitTermination()
    return sinks.read_latest(spark, folder + "/out", keys)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_progress_stream_equals_batch(spark):
    folder = log_folder(spark)
    as_outcomes = lambda d: d.select("user_id", "topic", F.col("knew").cast("int").alias("correct"), F.lit(1).alias("attempted"), "ts")
    got = run(spark, folder, K.progress_stream(as_outcomes(stream_of(spark, folder))), ["user_id", "topic"])
    want = P.progress(as_outcomes(spark.read.parquet(folder + "/log")))
    cols = ["user_id", "topic", "total_attempted", "total_correct", "mastery_pct", "last_attempted"]
    assert rows(got, *cols) == rows(want, *cols)
    sinks.compact(spark, folder + "/out", ["user_id", "topic"], folder + "/snapshot")
    assert rows(spark.read.parquet(folder + "/snapshot"), *cols) == rows(want, *cols)


def test_box_stream_equals_batch(spark):
    folder = log_folder(spark)
    pick = ["user_id", "card_id", "knew", "ts", "seq"]
    got = run(spark, folder, K.review_box_stream(stream_of(spark, folder).select(*pick), (T.LongType(), T.IntegerType())), ["user_id", "card_id"])
    want = H.review_boxes(spark.read.parquet(folder + "/log"))
    cols = ["user_id", "card_id", "box", "times_correct", "times_wrong"]
    assert rows(got, *cols) == rows(want, *cols)


def test_latest_state_stream_equals_batch(spark):
    folder = log_folder(spark)
    got = run(spark, folder, K.latest_state_stream(stream_of(spark, folder).select("user_id", "topic", "seq", "ts"), ["user_id", "topic"], ["ts", "seq"]), ["user_id", "topic"])
    want = H.latest_per_key(spark.read.parquet(folder + "/log").select("user_id", "topic", "seq", "ts"), ["user_id", "topic"], ["ts", "seq"])
    assert rows(got, "user_id", "topic", "seq") == rows(want, "user_id", "topic", "seq")


def test_deadline_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    data = [("s", T0, 2, at(1), True), ("s", T0, 2, at(2), False), ("s", T0, 2, at(4), True), ("t", at(5), 4, at(6), True)]
    schema = "session_id string, started_at timestamp, size long, ts timestamp, correct boolean"
    # Later rows move the watermark past the deadlines, file by file.
    after = [("s", T0, 2, at(501), True)]  # an answer for a session that is closed
    for part in (data[:2], data[2:], [("late", at(500), 1, at(500), True)], after, [("later", at(900), 1, at(900), True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder + "/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/log")
    sinks.write_changes(K.closed_session_stream(stream, lateness="0 seconds"), folder + "/out", mode="append").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(folder + "/out/rows").select("session_id", "size", "answered", "correct").collect())
    batch = K.closed_sessions(spark.createDataFrame(data, schema), F.col("size") * 90)
    want = {tuple(r) for r in batch.select("session_id", "size", "answered", "correct").collect()}
    assert want == {("s", 2, 2, 1), ("t", 4, 1, 1)}
    assert [g for g in got if g[0] in ("s", "t")] == sorted(want)


def test_deadline_stream_by_type_over_many_batches(spark):
    """Every session is emitted once with the batch form's counts: budgets by type, answers after the close, a session that is first seen
    behind its deadline."""
    rng, folder = random.Random(3), tempfile.mkdtemp(prefix="run-", dir="/tmp")
    kinds, data = ["quiz", "mock_partial", "mock_full"], []
    for s in range(60):
        kind, size, start = kinds[s % 3], rng.randrange(1, 30), T0 + dt.timedelta(minutes=20 * s)
        for _ in range(rng.randrange(1, 12)):
            data.append((f"s{s}", kind, start, size, start + dt.timedelta(minutes=rng.randrange(0, 200)), rng.random() < 0.5))
    data.append(("after", "quiz", T0, 2, T0 + dt.timedelta(minutes=700), True))
    data.sort(key=lambda r: r[4])
    data.append(("end", "quiz", T0 + dt.timedelta(days=3), 1, T0 + dt.timedelta(days=3), True))
    schema = "session_id string, kind string, started_at timestamp, size long, ts timestamp, correct boolean"
    for i in range(0, len(data), 60):
        spark.createDataFrame(data[i:i + 60], schema).coalesce(1).write.mode("append").parquet(folder + "/log")
    budget = K.session_budget(F.col("kind"), F.col("size"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder + "/log")
    sinks.write_changes(K.closed_session_stream(stream, "10 minutes", budget, retention="2 days"), folder + "/out", mode="append").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(folder + "/out/rows").select("session_id", "size", "answered", "correct").collect())
    want = K.closed_sessions(spark.createDataFrame(data, schema), budget).where("session_id <> 'end'")
    assert got == sorted(tuple(r) for r in want.select("session_id", "size", "answered", "correct").collect())


def test_dump_with_byte_order_mark_and_drift(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(folder + "/dump.json", "w", encoding="utf-8-sig") as f:
        json.dump([{"id": "1", "source": "x", "topic": "t"}, {"id": "2", "source": "y"}], f)
    got = readers.read_dump(spark, folder + "/dump.json", schemas.QUESTIONS, source="x").select("id", "topic").collect()
    assert [tuple(r) for r in got] == [("1", "t")]
    with open(folder + "/cache_1.json", "w") as f:
        json.dump([{"page_idx": 0, "page_type": "questions", "topic": "t", "items": [{"n": 1, "stem": "a"}, {"qnum": 2, "stem": "b", "correct": "A"}]},
                   {"page_idx": 1, "page_type": "other", "items": []}], f)
    cache = readers.read_page_cache(spark, folder + "/cache_*.json")
    items = readers.page_items(cache)
    assert rows(items, "page_idx", "n", "stem") == [(0, 1, "a"), (0, 2, "b")]
    assert [r.file.endswith("cache_1.json") for r in items.collect()] == [True, True]
    assert rows(readers.flat_items(items, answered=True), "n") == [(2,)]


def test_writers(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = H.numbered_batches(spark.range(0, 45).select(F.col("id"), (F.col("id") % 2).cast("string").alias("source")), ["source", "id"], 20)
    writers.write_batches(df, folder + "/batches")
    back = spark.read.json(folder + "/batches")
    assert back.groupBy("batch_no").count().orderBy("batch_no").collect() == [(0, 20), (1, 20), (2, 5)]
    writers.write_report(df, folder + "/report")
    assert spark.read.json(folder + "/report").count() == 45
    writers.append_rows(df, folder + "/facts")
    writers.append_rows(df, folder + "/facts")
    assert spark.read.parquet(folder + "/facts").count() == 90
    path = writers.write_snapshot(df, folder, "1")
    assert spark.read.parquet(path).count() == 45


def test_last_update_of_a_page_counts(spark):
    from scholia.operators import repair as R
    pages = spark.createDataFrame([(1, "other", [0]), (2, "questions", [5]), (3, None, None)], "p int, page_type string, items array<int>")
    updates = spark.createDataFrame([(1, 1, "questions", [1]), (1, 3, "answers", [3]), (1, 2, "other", [2]), (3, 1, "a", [1]), (3, 1, "b", [0]), (9, 1, "x", [1])],
                                    "p int, reading int, page_type string, items array<int>")
    got = R.nested_upsert(pages, updates, ["p"], ["reading"]).select("p", "page_type", "items").collect()
    assert sorted(map(tuple, got)) == [(1, "answers", [3]), (2, "questions", [5]), (3, "b", [0])]


def test_states_are_kept_by_lot(spark):
    """Many cards and sessions share a state, whatever the number of lots; reviews without a card count nowhere."""
    folder = log_folder(spark)
    pick = ["user_id", "card_id", "knew", "ts", "seq"]
    source = lambda d: d.select(*pick).withColumn("card_id", F.when(F.col("card_id") > 0, F.col("card_id")))
    for lots in (1, 3):
        out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        got = run(spark, out, K.review_box_stream(source(stream_of(spark, folder)), (T.LongType(), T.IntegerType()), lots=lots), ["user_id", "card_id"])
        want = H.review_boxes(source(spark.read.parquet(folder + "/log")))
        as_set = lambda d: {tuple(r) for r in d.select("user_id", "card_id", "box", "times_correct", "times_wrong").collect()}
        assert as_set(got) == as_set(want) and got.count() == 20
    at = lambda m: T0 + dt.timedelta(minutes=m)
    schema = "session_id string, started_at timestamp, size long, ts timestamp, correct boolean"
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for part in ([("a", T0, 1, at(1), True), ("b", T0, 40, at(1), None)], [("a", T0, 1, at(50), True), ("b", T0, 40, at(50), True)], [("c", at(900), 1, at(900), True)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(out + "/log")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(out + "/log")
    sinks.write_changes(K.closed_session_stream(stream, "0 seconds", lots=1), out + "/out", mode="append").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out + "/out/rows").select("session_id", "size", "answered", "correct").collect())
    assert got == [("a", 1, 1, 1), ("b", 40, 2, 1)]
