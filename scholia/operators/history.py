"""Ordered operators over logs: latest rows, streaks, review boxes, fills, restarts, trends, batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia import fixed_values as V
from scholia.functions.scalars import add_days
from scholia.session import stage_table


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key. `max_by` combines on the map side, so a hot key moves one row per partition."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def newest_rows(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """Newest n rows per key with their rank; Spark limits each partition's groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def latest_wrong(attempts: DataFrame, n: int = 400) -> DataFrame:
    """Latest n wrong attempts per user; a question answered right later stays in, repeated ones count each time."""
    order = [F.col("attempted_at").desc(), F.col("attempt_id").desc()]
    wrong = attempts.where(~F.col("is_correct")).select("user_id", "question_id", "attempted_at", "attempt_id")
    return newest_rows(wrong, "user_id", order, n)


def streak(sessions: DataFrame, anchor: Column, user: str = "user_id", ts: str = "completed_at") -> DataFrame:
    """Length of the run of active days that ends on the anchor day; 0 without activity on that day.

    Days are made distinct first, so the window sees at most one row per user and calendar day.
    """
    days = sessions.select(user, F.to_date(ts).alias("day")).distinct()
    back = Window.partitionBy(user).orderBy(F.col("day").desc())
    run = days.where(F.col("day") <= anchor).withColumn("rn", F.row_number().over(back))
    hits = (run.where(F.datediff(anchor, F.col("day")) == F.col("rn") - 1)
            .groupBy(user).agg(F.count("*").alias("streak")))
    return days.select(user).distinct().join(hits, user, "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def review_boxes(reviews: DataFrame, days: dict[int, int] = V.BOX_DAYS) -> DataFrame:
    """Box, next review and counters per (user, card) from (user_id, card_id, knew, ts, seq).

    A wrong answer resets to box 1 and a new card starts there, so box = min(1 + trailing run of right answers, top):
    only the newest top - 1 answers matter. They come through a group-limited window, the counters through a partial
    aggregate; neither collects the history of a card.
    """
    keys, top = ["user_id", "card_id"], max(days)
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("seq").desc())
    tail = (reviews.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= top - 1)
            .groupBy(*keys)
            .agg(F.min(F.when(~F.col("knew"), F.col("rn"))).alias("first_wrong"), F.count("*").alias("seen")))
    run = F.coalesce(F.col("first_wrong") - 1, F.col("seen"))
    totals = reviews.groupBy(*keys).agg(F.count_if("knew").alias("times_correct"),
                                        F.count_if(~F.col("knew")).alias("times_wrong"), F.max("ts").alias("updated_at"))
    wait = F.element_at(F.create_map(*[F.lit(x) for kv in days.items() for x in kv]), F.col("box"))
    return (tail.join(totals, keys)
            .withColumn("box", F.least(run + 1, F.lit(top)).cast("int"))
            .withColumn("next_review_at", add_days(F.col("updated_at"), wait))
            .select(*keys, "box", "next_review_at", "times_correct", "times_wrong", "updated_at"))


def forward_fill(df: DataFrame, group: str, position: str, value: str, out: str, span: int = 10000) -> DataFrame:
    """Last non-null `value` at or before each row of its group, by integer position.

    Groups are cut into spans of positions, each filled in its own task; the last value of every span is carried into the
    later ones through a small per-span table. A group that holds most of the rows spreads over many tasks.
    """
    cut = df.withColumn("_span", F.floor(F.col(position) / span))
    inside = Window.partitionBy(group, "_span").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carry = (cut.groupBy(group, "_span").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias("_end"))
             .withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).select(group, "_span", "_carry"))
    filled = F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry"))
    return cut.join(carry, [group, "_span"]).withColumn(out, filled).drop("_span", "_carry")


def first_headings(df: DataFrame, group: str, position: str, heading: str) -> DataFrame:
    """Null out every heading that occurred earlier in its group, so a repeat does not reopen a section."""
    first = (df.where(F.col(heading).isNotNull()).groupBy(group, heading).agg(F.min(position).alias(position))
             .select(group, position, F.lit(True).alias("_first")))
    return (df.join(first, [group, position], "left")
            .withColumn(heading, F.when(F.col("_first"), F.col(heading))).drop("_first"))


def section_starts(pages: DataFrame, file: str, page: str, lowest: str, highest: str, drop: int = 3, span: int = 10000) -> DataFrame:
    """First pages of the sections of each file (-1 for the first section): a new one starts where the page's lowest number
    is at most the running maximum - `drop`.

    The maximum restarts with each section, so this is a fold in page order. Files are cut into spans of pages. A span's effect
    depends on the incoming maximum only up to its first restart, so each span is summed up as a short table (incoming maximum
    -> outgoing maximum); those tables are chained per file, and the spans are folded again with their true start.
    """
    rows = pages.select(F.col(file).alias("file"), F.col(page).cast("bigint").alias("page"), F.col(lowest).cast("bigint").alias("low"),
                        F.col(highest).cast("bigint").alias("high")).withColumn("span_no", F.floor(F.col("page") / span))
    file_type = rows.schema["file"].dataType

    def fold(lows, highs, top: int, begin: int = 0) -> tuple[int, list[int]]:
        starts = []
        for i in range(begin, len(lows)):
            if top and lows[i] <= top - drop:
                starts.append(i)
                top = highs[i]
            else:
                top = max(top, highs[i])
        return top, starts

    def summarise(key: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("page")
        lows, highs = chunk["low"].tolist(), chunk["high"].tolist()
        # From which incoming maximum on does the span first restart at page i? Only record lows before the own first restart matter.
        table, top, record = [], 0, None
        for i, low in enumerate(lows):
            own = bool(top) and low <= top - drop
            if record is None or low < record or own:
                out, _ = fold(lows, highs, highs[i], i + 1)
                table.append((*key, 0 if own else low + drop, out, False))
                record = low
            if own:
                break
            top = max(top, highs[i])
        else:
            table.append((*key, 0, top, True))
        return pd.DataFrame(table, columns=["file", "span_no", "from_top", "out_top", "keeps"])

    def chain(key: tuple, spans: pd.DataFrame) -> pd.DataFrame:
        top, out = 0, []
        for number, table in spans.sort_values("span_no").groupby("span_no", sort=True):
            out.append((key[0], number, top))
            # The first restart is the earliest page whose bound the incoming maximum reaches: rows come in page order.
            hit = next(r for r in table.sort_values("from_top", ascending=False, kind="stable").itertuples() if top >= max(r.from_top, 1) or r.from_top == 0)
            top = max(top, hit.out_top) if hit.keeps else hit.out_top
        return pd.DataFrame(out, columns=["file", "span_no", "in_top"])

    def locate(key: tuple, chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("page")
        _, starts = fold(chunk["low"].tolist(), chunk["high"].tolist(), int(chunk["in_top"].iloc[0]))
        return pd.DataFrame({"file": [key[0]] * len(starts), "start_page": chunk["page"].iloc[starts].tolist()})

    fields = lambda *names: T.StructType([T.StructField("file", file_type), *[T.StructField(n, T.LongType()) for n in names]])
    summary = rows.groupBy("file", "span_no").applyInPandas(
        summarise, T.StructType([*fields("span_no", "from_top", "out_top").fields, T.StructField("keeps", T.BooleanType())]))
    incoming = summary.groupBy("file").applyInPandas(chain, fields("span_no", "in_top"))
    found = rows.join(incoming, ["file", "span_no"]).groupBy("file", "span_no").applyInPandas(locate, fields("start_page"))
    first = rows.select("file").distinct().withColumn("start_page", F.lit(-1).cast("bigint"))
    return first.unionByName(found).withColumnRenamed("file", file)


def numbered_batches(df: DataFrame, order: list[str], size: int, partitions: int | None = None) -> DataFrame:
    """Global row number and fixed-size batch number in the given order.

    Rows are range-partitioned, numbered inside each partition and shifted by the sizes of the partitions before; only
    those sizes pass through a single task. The ranged rows are written once so that numbering and sizes see one layout.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage_table(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (ranged.join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn("row_no", F.row_number().over(inside) + F.col("_offset"))
            .withColumn("batch_no", F.floor((F.col("row_no") - 1) / size))
            .drop("_part", "_offset"))
