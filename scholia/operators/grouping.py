"""Grouped reports: first copies, votes, histograms, collected reasons and page slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia import fixed_values as V


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key in the given order. `min_by` combines on the map side, so copies never gather in one task."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("row"))
            .select(*keys, *[F.col("row")[c].alias(c) for c in rest]))


def majority_vote(votes: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key with its share and band; the smallest value wins a tie. One aggregate over the counts."""
    counts = votes.groupBy(key, value).agg(F.count("*").alias("votes"))
    winner = (counts.groupBy(key).agg(F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), F.col(value).isNull(), value)).alias("_top"),
                                      F.sum("votes").alias("total"))
              .select(key, F.col("_top")[value].alias(value), "_top.votes", "total"))
    share = F.col("votes") / F.col("total")
    return (winner.withColumn("agreement", F.bround(share, 4))
            .withColumn("confidence", F.when(share >= 0.8, "HIGH").when(share >= 0.5, "MEDIUM").otherwise("LOW")))


def confidence_histogram(flags: DataFrame, confidence: str, buckets: list[tuple[float, float]] = V.CONFIDENCE_BUCKETS,
                         thresholds: list[float] = V.CONFIDENCE_THRESHOLDS) -> DataFrame:
    """Rows per half-open bucket and at or above each threshold: one aggregate, unpivoted into (kind, bound, n)."""
    tests = [("bucket", low, (F.col(confidence) >= low) & (F.col(confidence) < high)) for low, high in buckets]
    tests += [("at_least", t, F.col(confidence) >= t) for t in thresholds]
    one = flags.agg(*[F.count_if(test).alias(f"_{i}") for i, (_, _, test) in enumerate(tests)])
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(bound).alias("bound"), F.col(f"_{i}").alias("n"))
                     for i, (kind, bound, _) in enumerate(tests)])
    return one.select(F.inline(rows))


def reasons_per_id(reports: list[DataFrame], key: str, reason: str) -> DataFrame:
    """Distinct reasons per record over several report tables, as one '|'-joined text; there are only few kinds of reason."""
    stacked = reports[0].select(key, reason)
    for other in reports[1:]:
        stacked = stacked.unionByName(other.select(key, reason))
    return (stacked.groupBy(key, reason).agg(F.count("*").alias("n"))
            .groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(reason)), "|").alias("reasons"), F.sum("n").alias("reports")))


def ids_per_page(df: DataFrame, keys: list[str], key_id: str, slice_rows: int = 1000) -> DataFrame:
    """Ids to handle together, one list per page. A page's ids are cut into slices of an id range, so no list grows without bound."""
    sliced = df.withColumn("slice_no", F.floor(F.col(key_id) / slice_rows))
    return (sliced.groupBy(*keys, "slice_no")
            .agg(F.array_sort(F.collect_list(key_id)).alias("ids")))


def first_wins(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Union of two correction sets, the primary one first; `confirmed` marks ids that both hold."""
    marked = primary.withColumn("_rank", F.lit(0)).unionByName(secondary.withColumn("_rank", F.lit(1)))
    rest = [c for c in primary.columns if c != key]
    return (marked.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("_rank")).alias("row"), F.min("_rank").alias("_low"), F.max("_rank").alias("_high"))
            .select(key, *[F.col("row")[c].alias(c) for c in rest], (F.col("_low") != F.col("_high")).alias("confirmed"),
                    (F.col("_low") == 1).alias("new")))


def rank_flags(flags: DataFrame, score: Column, key: str, n: int) -> DataFrame:
    return flags.withColumn("rank_score", score).orderBy(F.col("rank_score").desc(), key).limit(n)


def pass_summary(rows: DataFrame, by: str, shortest: int = 15) -> DataFrame:
    """Per group: explanations too short to judge, those without a signal, and agreeing and differing letters of each pass.

    Takes (by, explanation, letter, pass_no, stored).
    """
    short = F.length(F.regexp_replace(F.coalesce("explanation", F.lit("")), "^\\s+|\\s+$", "")) < shortest
    same = F.coalesce(F.col("letter") == F.upper(F.trim("stored")), F.lit(False))
    of_pass = lambda n: ~short & F.col("letter").isNotNull() & (F.col("pass_no") == n)
    return rows.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(short).alias("no_explanation"), F.count_if(~short & F.col("letter").isNull()).alias("no_signal"),
        *[F.count_if(of_pass(n) & (same if ok else ~same)).alias(f"p{n}_{'ok' if ok else 'wrong'}") for n in (1, 2, 3, 4) for ok in (True, False)])
