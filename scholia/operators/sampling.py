"""Reproducible sampling and ordering: random order is the order of md5(seed:...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia import fixed_values as V
from scholia.session import spread


def random_key(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]))


def random_rows(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    return df.orderBy(random_key(seed, F.col(key)), key).limit(n)


def rows_per_group(df: DataFrame, group: str, key: str, n: Column | int, seed: str) -> DataFrame:
    """`n` random rows of each group. A constant n is limited per partition before the shuffle."""
    order = Window.partitionBy(group).orderBy(random_key(seed, F.col(key)), key)
    return df.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def mixed_quiz_size(n: int, topics: int = 10) -> int:
    return max(min(n // topics * 4, 60), 20)


def draw_count(mastery: Column, wrong: Column) -> Column:
    """Tickets of a question in the weighted draw: more for weak topics, doubled if answered wrong before."""
    chain = F
    for below, tickets in V.DRAW_BANDS:
        chain = chain.when(mastery < below, F.lit(tickets))
    return chain.otherwise(F.lit(1)) * F.when(wrong, V.WRONG_FACTOR).otherwise(1)


def smallest_ticket(seed: str, user: Column, item: Column, tickets: Column) -> Column:
    """Smallest of `tickets` random keys. Ordering by it equals shuffling an item's copies and keeping the first."""
    keys = F.transform(F.sequence(F.lit(1), tickets), lambda i: random_key(seed, user, item, i))
    return F.array_min(keys)


def earlier_mistakes(wrong: DataFrame, pool: DataFrame) -> DataFrame:
    """(user_id, missed): each user's wrong questions that are in the pool, so a list is no longer than the pool."""
    ids = pool.select("question_id").distinct()
    return (wrong.select("user_id", "question_id").join(F.broadcast(ids), "question_id", "left_semi")
            .groupBy("user_id").agg(F.collect_set("question_id").alias("missed")))


def weighted_sample(pool: DataFrame, mastery: DataFrame, wrong: DataFrame, n: int, seed: str) -> DataFrame:
    """n questions per user without repeats, likelier from weak topics and from earlier mistakes.

    `pool` is (question_id, topic), drawn beforehand and so of bounded size; `mastery` has a row per user and topic, 0 where
    unseen; `wrong` is (user_id, question_id). Rows without topic take no part.

    A user is one row that draws from the pool by itself (the pool is a scalar subquery), so no row for each user and question is
    ever made and only the mastery and the mistakes are shuffled.
    """
    levels = (mastery.where(F.col("topic").isNotNull()).groupBy("user_id")
              .agg(F.map_from_entries(F.collect_list(F.struct("topic", "mastery_pct"))).alias("levels")))
    whole = pool.agg(F.collect_list(F.struct("question_id", "topic")).alias("pool")).scalar()
    users = spread(levels.join(earlier_mistakes(wrong, pool), "user_id", "left")).withColumn("pool", whole)

    def drawn(q):
        was_wrong = F.coalesce(F.array_contains("missed", q["question_id"]), F.lit(False))
        tickets = draw_count(F.try_element_at("levels", q["topic"]), was_wrong)
        ticket = smallest_ticket(seed, F.col("user_id"), q["question_id"], tickets)
        return F.struct(ticket.alias("ticket"), q["question_id"].alias("question_id"), q["topic"].alias("topic"),
                        tickets.alias("tickets"), was_wrong.alias("was_wrong"))

    own = F.filter("pool", lambda q: F.coalesce(F.map_contains_key("levels", q["topic"]), F.lit(False)))
    picks = F.slice(F.array_sort(F.transform(own, drawn)), 1, n)
    return (users.select("user_id", F.posexplode(picks).alias("at", "q"))
            .select("user_id", (F.col("at") + 1).alias("pick"), "q.question_id", "q.topic", "q.tickets", "q.was_wrong"))


def pool_size(n: int, one_topic: bool) -> int:
    return max(n * 5, 100) if one_topic else min(n * 10, 700)


def quota_column(quotas: dict[str, int], topic: str = "topic") -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(topic))


def blueprint_pool(bank: DataFrame, quotas: dict[str, int], seed: str) -> DataFrame:
    """Per topic, max(4 * quota, 40) random questions to choose from."""
    widest = max(max(q * 4, 40) for q in quotas.values())
    quota = quota_column(quotas)
    return (rows_per_group(bank.where(quota.isNotNull()), "topic", "question_id", widest, seed)
            .where(F.col("pick") <= F.greatest(quota * 4, F.lit(40))).select("question_id", "topic"))


def blueprint_sample(users: DataFrame, pool: DataFrame, wrong: DataFrame, quotas: dict[str, int], seed: str) -> DataFrame:
    """A test per user with the given number of questions per topic, earlier mistakes first, random inside each class.

    Each user and topic is one row that picks from the topic's pool by itself; nothing is shuffled but users and their mistakes.
    """
    lists = pool.where(F.col("topic").isin(*quotas)).groupBy("topic").agg(F.collect_list("question_id").alias("ids"))
    takers = spread(users.select("user_id").distinct().join(earlier_mistakes(wrong, pool), "user_id", "left"))
    frame = (takers.withColumn("topic", F.explode(F.array(*[F.lit(t) for t in quotas])))
             .join(F.broadcast(lists), "topic"))  # a row per topic, bounded by the quotas

    def ranked(q):
        was_wrong = F.coalesce(F.array_contains("missed", q), F.lit(False))
        return F.struct((~was_wrong).alias("late"), random_key(seed, F.col("user_id"), q).alias("at"), q.alias("question_id"))

    picks = F.slice(F.array_sort(F.transform("ids", ranked)), F.lit(1), quota_column(quotas))
    return (frame.select("user_id", "topic", F.posexplode(picks).alias("at", "q"))
            .select("user_id", "topic", (F.col("at") + 1).alias("pick"), "q.question_id", (~F.col("q.late")).alias("was_wrong")))


def blueprint_shortage(users: DataFrame, sample: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Questions missing per user and topic, also for topics that gave none and for users without any question."""
    frame = users.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(t) for t in quotas])).alias("topic"))
    got = sample.groupBy("user_id", "topic").agg(F.count("*").alias("got"))
    return (frame.join(got, ["user_id", "topic"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
            .withColumn("quota", quota_column(quotas)).withColumn("missing", F.col("quota") - F.col("got")))


def review_queue(cards: DataFrame, states: DataFrame, now: Column, seed: str) -> DataFrame:
    """Cards per user in review order: due ones by box and delay, then new ones at random; future ones are left out.

    `cards` is (user_id, card_id); `states` holds box and next_review_at, with a missing time read as `now`.
    """
    return review_order(card_status(cards, states, now), seed)


def review_order(status: DataFrame, seed: str) -> DataFrame:
    """The same for cards whose status is known."""
    rows = status.where(F.col("status") != "future")
    order = Window.partitionBy("user_id").orderBy(
        F.when(F.col("status") == "due", 0).otherwise(1), F.col("box").asc_nulls_last(), F.col("overdue_sec").desc_nulls_last(),
        random_key(seed, F.col("user_id"), F.col("card_id")), "card_id")
    return rows.withColumn("place", F.row_number().over(order))


def card_status(cards: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """New, due or future per card: box 1 is always due, others once their review time has come."""
    due_at = F.coalesce(F.col("next_review_at"), now)
    joined = cards.join(states.select("user_id", "card_id", "box", "next_review_at"), ["user_id", "card_id"], "left")
    return (joined.withColumn("overdue_sec", F.when(F.col("box").isNotNull(), F.timestamp_diff("SECOND", due_at, now)))
            .withColumn("status", F.when(F.col("box").isNull(), "new")
                        .when((F.col("box") == 1) | (due_at <= now), "due").otherwise("future")))


def box_counts(status: DataFrame, boxes: int = 5) -> DataFrame:
    """Cards per box with zeros, and due, new and mastered counts per user, in one aggregate."""
    return status.groupBy("user_id").agg(
        *[F.count_if(F.col("box") == b).alias(f"box_{b}") for b in range(1, boxes + 1)],
        F.count_if(F.col("status") == "due").alias("due"), F.count_if(F.col("status") == "new").alias("new"),
        F.count_if(F.col("box") == boxes).alias("mastered"))


def weak_topics(mastery: DataFrame, below: float, n: int, else_below: float | None = None) -> DataFrame:
    """The n weakest topics under a mark per user; users without any fall back to the next band if one is given."""
    order = Window.partitionBy("user_id").orderBy("mastery_pct", "topic")
    level = F.when(F.col("mastery_pct") < below, F.lit("high"))
    if else_below is not None:
        level = level.when(F.col("mastery_pct") < else_below, F.lit("medium"))
    ranked = mastery.withColumn("priority", level).where(F.col("priority").isNotNull())
    ranked = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    weakest = F.min("mastery_pct").over(Window.partitionBy("user_id"))
    # A user with a topic under the first mark shows only such topics.
    return ranked.withColumn("_min", weakest).where((F.col("priority") == "high") | (F.col("_min") >= below)).drop("_min")
