"""Learner operators: edge rows and invariants."""

import datetime as dt

from pyspark.sql import functions as F

from scholia.functions import scalars as M
from scholia.operators import history as H
from scholia.operators import progress as P
from scholia.operators import repair as R
from scholia.operators import sampling as S

T0 = dt.datetime(2024, 1, 10, 9, 0, 0)


def test_zero_attempts_give_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 3), (1, 32)], "c int, t int").select(M.percentage(F.col("c"), F.col("t"), 2).alias("p"))
    assert [r.p for r in df.collect()] == [0.0, 33.33, 3.12]


def test_unattempted_topic_is_zero(spark):
    users = spark.createDataFrame([("u",)], "user_id string")
    rows = spark.createDataFrame([("u", "x", 80.0), ("u", "unknown", 10.0)], "user_id string, topic string, mastery_pct double")
    got = {r.topic: r.mastery_pct for r in P.mastery_by_topic(users, rows, ["x", "y"]).collect()}
    assert got == {"x": 80.0, "y": 0.0}


def test_streak_needs_the_anchor_day(spark):
    day = lambda n: T0 - dt.timedelta(days=n)
    rows = [("today", day(0)), ("today", day(1)), ("today", day(3)), ("yesterday", day(1)), ("yesterday", day(2)), ("later", day(-1))]
    df = spark.createDataFrame(rows, "user_id string, completed_at timestamp")
    got = {r.user_id: r.streak for r in H.streak(df, F.lit(T0.date())).collect()}
    assert got == {"today": 2, "yesterday": 0, "later": 0}


def test_box_fold(spark):
    runs = {"fresh_wrong": [0], "two": [1, 1], "top": [1] * 7, "reset": [1, 1, 1, 0, 1], "long": [0, 1, 1, 1, 1, 1]}
    rows = [("u", card, bool(k), T0 + dt.timedelta(minutes=i), i) for card, ks in runs.items() for i, k in enumerate(ks)]
    df = spark.createDataFrame(rows, "user_id string, card_id string, knew boolean, ts timestamp_ntz, seq int")
    got = {r.card_id: (r.box, r.times_correct, r.times_wrong, (r.next_review_at - r.updated_at).days) for r in H.review_boxes(df).collect()}
    days = {1: 0, 2: 1, 3: 3, 4: 7, 5: 14}
    for card, ks in runs.items():
        box = 1
        for k in ks:
            box = min(box + 1, 5) if k else 1
        assert got[card] == (box, sum(ks), len(ks) - sum(ks), days[box])


def test_forward_fill_across_spans(spark):
    rows = [("f", i, "h" + str(i) if i in (2, 7) else None) for i in range(12)]
    df = spark.createDataFrame(rows, "f string, p int, h string")
    got = [r.s for r in H.forward_fill(df, "f", "p", "h", "s", span=3).orderBy("p").collect()]
    assert got == [None, None] + ["h2"] * 5 + ["h7"] * 5


def test_section_starts(spark):
    import random
    rng = random.Random(4)
    pages = [(f, i, n, n + rng.randint(0, 4)) for f in "ab" for i in range(60) for n in [rng.randint(1, 14)]]
    df = spark.createDataFrame(pages, "file string, page int, lowest int, highest int")
    want = {("a", -1), ("b", -1)}
    for f in "ab":
        top = 0
        for _, page, lowest, highest in (p for p in pages if p[0] == f):
            if top and lowest <= top - 3:
                want.add((f, page))
                top = highest
            top = max(top, highest)
    for span in (1000, 7):
        assert {tuple(r) for r in H.section_starts(df, "file", "page", "lowest", "highest", span=span).collect()} == want


def test_numbered_batches_is_a_global_order(spark):
    df = spark.range(0, 1000).select((F.col("id") % 3).alias("g"), (999 - F.col("id")).alias("k"))
    rows = H.numbered_batches(df, ["g", "k"], 20, partitions=5).orderBy("g", "k").collect()
    assert [r.row_no for r in rows] == list(range(1, 1001))
    assert [r.batch_no for r in rows] == [i // 20 for i in range(1000)]


def test_weighted_sample_has_no_repeats(spark):
    pool = spark.range(0, 15).select(F.col("id").alias("question_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("topic"))
    mastery = spark.createDataFrame([("u", "x", 10.0), ("u", "y", 90.0), ("v", "x", 0.0), ("v", "y", 60.0)], "user_id string, topic string, mastery_pct double")
    wrong = spark.createDataFrame([("u", 3), ("u", 3)], "user_id string, question_id long")
    rows = S.weighted_sample(pool, mastery, wrong, 20, "s").collect()
    for u in "uv":
        ids = [r.question_id for r in rows if r.user_id == u]
        assert len(ids) == len(set(ids)) == 15
    assert {r.tickets for r in rows if r.user_id == "u"} == {5, 1, 2}


def test_timestamps(spark):
    fallback = F.lit(T0).cast("timestamp_ntz")
    cases = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05", "soon", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", M.parse_timestamp(F.col("t"), fallback).alias("x"))
    assert [r.x for r in df.orderBy("i").collect()] == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 1, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5), T0, T0]


def test_patch_gates_and_idempotence(spark):
    old = "one two three four five six seven eight nine ten"
    rows = [("1", "a", old, ""), ("2", "a", old, old + " "), ("3", "a", "x\n| a |", "x a"), ("4", "a", old, "one two three"), ("5", "a", old, old + " more"),
            ("6", "a", old, "entirely different words"), ("7", "a", None, "new text")]
    df = spark.createDataFrame(rows, "id string, field string, old string, new string")
    plan = {r.id: (r.action, r.reason, r.new) for r in R.plan_gated_patches(df).collect()}
    assert {k: v[1] for k, v in plan.items()} == {"1": "empty", "2": "unchanged", "3": "would_lose_format", "4": "clean_prefix", "5": "overlap", "6": "low_overlap", "7": "overlap"}
    after = [(i, f, plan[i][2] if plan[i][0] == "patch" else o, n) for i, f, o, n in rows]
    again = R.plan_gated_patches(spark.createDataFrame(after, "id string, field string, old string, new string"))
    assert {r.id for r in again.where("action = 'patch'").collect()} == set()


def test_applied_corrections_leave_no_difference(spark):
    bank = spark.createDataFrame([("1", "a", "b"), ("2", "c", None)], "id string, f string, g string")
    fixes = spark.createDataFrame([("1", "f", "A"), ("2", "g", "D"), ("9", "f", "Z")], "id string, field string, new_value string")
    after = R.apply_corrections(bank, fixes, "id", ["f", "g"], "new_value")
    assert {tuple(r) for r in after.collect()} == {("1", "A", "b"), ("2", "c", "D")}
    checked = {(r.id, r.field): r.verified for r in R.verify_corrections(after, fixes, "id", ["f", "g"]).collect()}
    assert checked == {("1", "f"): True, ("2", "g"): True, ("9", "f"): False}


def test_due_status(spark):
    cards = spark.createDataFrame([("u", c) for c in "abcd"], "user_id string, card_id string")
    states = spark.createDataFrame([("u", "a", 1, T0 + dt.timedelta(days=3)), ("u", "b", 2, T0), ("u", "c", 3, T0 + dt.timedelta(days=1))],
                                   "user_id string, card_id string, box int, next_review_at timestamp_ntz")
    got = {r.card_id: r.status for r in S.card_status(cards, states, F.lit(T0).cast("timestamp_ntz")).collect()}
    assert got == {"a": "due", "b": "due", "c": "future", "d": "new"}


def test_weighted_sample_against_a_loop(spark):
    import hashlib

    pool = [(i, "xyz"[i % 3] if i % 7 else None) for i in range(40)]
    mastery = [("u", "x", 10.0), ("u", "y", 60.0), ("v", "z", None), ("v", "other", 5.0), ("w", None, 5.0)]
    wrong = [("u", 3), ("u", 3), ("u", 99), ("v", 2), ("n", 1), ("u", None)]
    got = S.weighted_sample(spark.createDataFrame(pool, "question_id int, topic string"),
                            spark.createDataFrame(mastery, "user_id string, topic string, mastery_pct double"),
                            spark.createDataFrame(wrong, "user_id string, question_id int"), 9, "s").collect()
    want = []
    for user in "uvw":
        drawn = []
        for q, topic in pool:
            level = [m for u, t, m in mastery if u == user and t is not None and t == topic]
            if level:
                was = (user, q) in wrong
                times = (5 if level[0] is not None and level[0] < 30 else 2 if level[0] is not None and level[0] < 70 else 1) * (1 + was)
                ticket = min(hashlib.md5(f"s:{user}:{q}:{i + 1}".encode()).hexdigest() for i in range(times))
                drawn.append((ticket, q, topic, times, was))
        want += [(user, i + 1, *d[1:]) for i, d in enumerate(sorted(drawn)[:9])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_samples_from_empty_tables(spark):
    pool = spark.createDataFrame([], "question_id int, topic string")
    mastery = spark.createDataFrame([("u", "x", 1.0)], "user_id string, topic string, mastery_pct double")
    wrong = spark.createDataFrame([], "user_id string, question_id int")
    assert S.weighted_sample(pool, mastery, wrong, 3, "s").count() == 0
    assert S.weighted_sample(pool, mastery.limit(0), wrong, 3, "s").count() == 0
    assert S.blueprint_sample(mastery, pool, wrong, {"x": 2}, "s").count() == 0


def test_samples_shuffle_no_row_for_each_user_and_question(spark):
    """Only rows that are drawn come out of a user's row, after the last exchange."""
    pool = spark.range(300).select(F.col("id").alias("question_id"), F.lit("x").alias("topic"))
    users = spark.range(2000).select(F.col("id").alias("user_id"), F.lit("x").alias("topic"), F.lit(50.0).alias("mastery_pct"))
    wrong = spark.range(2000).select(F.col("id").alias("user_id"), F.lit(5).cast("long").alias("question_id"))
    for sample in (S.weighted_sample(pool, users, wrong, 10, "s"), S.blueprint_sample(users, pool, wrong, {"x": 10}, "s")):
        plan = sample._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
        assert sample.count() == 20000


def test_cards_of_hidden_sessions_stay_new(spark):
    now = F.lit(T0).cast("timestamp")
    cards = spark.createDataFrame([("u", 1), ("u", 2), ("u", 3)], "user_id string, card_id int")
    states = spark.createDataFrame([("u", 1, 1, T0 + dt.timedelta(days=2)), ("u", 2, 3, T0 + dt.timedelta(days=2))],
                                   "user_id string, card_id int, box int, next_review_at timestamp")
    got = {r.card_id: r.status for r in S.review_order(S.card_status(cards, states, now), "s").collect()}
    assert got == {1: "due", 3: "new"}


def test_decks_hold_whole_shelves_and_all_reviews(spark):
    """Cards of a touched shelf that the user hasn't met are new; answers in hidden sessions are reviews like others."""
    import tempfile

    from scholia.plans import REGISTRY
    from scholia.plans.tables import Tables

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    events = [(1, 1, "error", 1.0, 3), (2, 1, "quiz", 1.0, 4), (3, 2, "quiz", 50.0, 10), (4, 2, "quiz", 1.0, 18)]
    spark.createDataFrame([(i, T0, u, kind, v, '{"k": %d}' % k) for i, u, kind, v, k in events],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    t = Tables(spark, folder)
    status = sorted((r.user_id, r.card_id, r.box, r.status) for r in REGISTRY["card_status"].build(t).collect())
    assert status == [(1, 3, 2, "due"), (1, 4, 2, "due"), (1, 10, 0, "new"), (1, 18, 0, "new"),
                      (2, 3, 0, "new"), (2, 4, 0, "new"), (2, 10, 1, "due"), (2, 18, 2, "due")]
    assert {r.user_id: (r.due, r["new"]) for r in REGISTRY["box_distribution"].build(t).collect()} == {1: (2, 2), 2: (2, 2)}
    assert REGISTRY["review_queue"].build(t).count() == 8
