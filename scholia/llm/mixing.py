"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time from 0 to 1. Its integral is the source's cumulative demand for tokens. A
document stands at some cumulative supply within its source; where demand meets it, inverted, is its training position. The mix is the
documents range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import stage

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
# Schedule of a source by its weight: the rate at the start against the mean rate; at the end 2 minus it. The first kind fades out, the
# last one fades in, and all integrate to 1.
RAMPS = (1.5, 1.0, 0.5)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` runs: blanks squeezed to one, then what separates words."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "), "  +", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """`source`, `source_size`, `weight`, `target` from one row per source (`source`, `source_size`).

    The total is shared by weight; a target stops at `most` times its source's size and the excess is shared again. In order of the
    stop per weight, a source is stopped exactly when its fair share of what those before it leave is beyond its stop.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("kind", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = F.array(*(F.lit(w) for w in weights))
    weighted = (ranked.withColumn("kind", (F.col("kind") % len(weights)).cast("int")).withColumn("weight", F.get(listed, F.col("kind")))
                .withColumn("stop", F.lit(most) * F.col("source_size")))
    by_stop = Window.partitionBy().orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    after = by_stop.rowsBetween(0, Window.unboundedFollowing)
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    return (weighted.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0)))
            .withColumn("weight_left", F.sum("weight").over(after))
            .withColumn("stopped", F.col("stop") * F.col("weight_left") < F.col("left") * F.col("weight"))
            .withColumn("open_left", F.min(F.when(~F.col("stopped"), F.struct(F.col("stop") / F.col("weight"), "left", "weight_left")))
                        .over(everything))
            .select("source", "source_size", "kind", "weight",
                    F.when(F.col("stopped"), F.col("stop").cast("double"))
                    .otherwise(F.col("open_left.left").cast("double") * F.col("weight") / F.col("open_left.weight_left")).alias("target")))


def invert_ramp(demand: Column, start: Column) -> Column:
    """Time at which the integral of `start + (2 - 2 start) t` over time reaches `demand` (0 to 1)."""
    bend = 1 - start
    root = F.sqrt(F.greatest(F.lit(0.0), start * start + 4 * bend * demand))
    return F.least(F.lit(1.0), 2 * demand / F.greatest(start + root, F.lit(1e-12)))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: `doc_id`, `source`, `size`, `source_size`, `target`, `taken`, `epochs`, `positions`.

    A source's documents stand in the order of the MD5 of their id. Its target is so many whole rounds over them and the documents
    up to the remaining words; the one at the edge is taken in part. `taken` sums to the rounded target of each source, at most 3
    times the size per document. `positions` holds, for each round it is taken in, where the demand reaches it; null without any.
    Null and empty texts have size 0 and are taken 0 words; a null source is a source of its own, the last; rows that repeat stand one
    after another; a source without words has target 0; an empty table gives an empty result. Other columns are ignored.
    """
    return mixture_of_sizes(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                        word_count(F.col(text_col)).alias("size")))


def mixture_of_sizes(sized: DataFrame, *keep: str) -> DataFrame:
    """The mixture of units of known size (`doc_id`, `source`, `size`), with the columns `keep`, which also order rows that repeat."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = stage(sized.withColumn("rank", order))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stage(targets(sizes))
    bucket = F.substring("rank", 1, 3)
    parts = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    starts = stage(starts.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    within = (Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size", *keep)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (rows.withColumn("bucket", bucket).withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .join(starts.withColumnRenamed("source", "of").withColumnRenamed("bucket", "at"),
                    F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))))
    wanted = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(F.lit(0))
    supply = F.col("start") + F.col("inner")
    mixed = (placed.withColumn("wanted", wanted).withColumn("full", full).withColumn("supply", supply)
             .withColumn("rest", F.col("wanted") - F.col("full") * F.col("source_size"))
             .withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("supply"))))
             .withColumn("taken", (F.col("full") * F.col("size") + F.col("part")).cast("long")))
    ramp = F.get(F.array(*(F.lit(r) for r in RAMPS)), F.col("kind"))
    rounds = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    mixed = mixed.withColumn("epochs", rounds).withColumn("ramp", ramp)
    places = F.transform(F.sequence(F.lit(0), F.col("epochs") - 1), lambda e: invert_ramp(
        F.least(F.lit(1.0), (F.col("supply") + e * F.col("source_size")) / F.col("wanted")), F.col("ramp")))
    return (mixed.withColumn("positions", F.when(F.col("epochs") > 0, places))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "epochs", "positions", *keep))


def curriculum(docs: DataFrame) -> DataFrame:
    """The documents as they are trained on: each as often as at least half of it is taken, range-sorted by position.

    Every row is a unit of its own, as in `mixture`, also where ids repeat or are null. Rows without words, and those of which less than
    half is taken, are not in the result; a null source is a source of its own; an empty table gives an empty result. Other columns are
    kept, whatever their names.
    """
    rows = stage(docs.select(*(F.col(c).alias(f"d_{c}") for c in docs.columns), F.monotonically_increasing_id().alias("row")))
    units = rows.select(F.col("d_doc_id").alias("doc_id"), F.col("d_source").alias("source"), word_count(F.col("d_text")).alias("size"),
                        F.col("row").alias("unit"))
    mixed = mixture_of_sizes(units, "unit")
    whole = F.round(F.col("taken") / F.col("size")).cast("int")
    times = stage(mixed.where("size > 0").select("unit", F.explode(F.slice("positions", F.lit(1), whole)).alias("at")))
    return (rows.join(times, F.col("row") == F.col("unit")).orderBy("at", "unit")
            .select(*(F.col(f"d_{c}").alias(c) for c in docs.columns)))
