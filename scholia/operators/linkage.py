"""Record linkage: prefix keys, word bags, n-grams, containment and positional pairing.

Everything runs as equi-joins on exploded keys. Copies are folded before any pairing (one representative, the smallest id,
stands for all rows with the same content), and keys that many reference rows share are spread over slices, so neither a
group of copies nor a frequent word gathers in one task. No candidate is dropped for being frequent.
"""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia import fixed_values as V
from scholia.functions import similarity as Sim
from scholia.functions import text as X
from scholia.session import stage_table

SLICE_ROWS = 100_000
HOT_KEYS = 1_000
SLICE_ELEMENTS = 4_000_000


def fold_copies(df: DataFrame, id_name: str, content: list[str], out: str) -> DataFrame:
    """One row per distinct content with its smallest id and the number of copies; combines on the map side."""
    return df.groupBy(*content).agg(F.min(id_name).alias(out), F.count("*").alias(f"{out}_copies"))


def hot_counts(counts: DataFrame, keys: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The most frequent keys of (keys, n) with more than `slice_rows` rows; at most `HOT_KEYS`, so they can be broadcast. A key that is
    not among them has at most 1/`HOT_KEYS` of all rows, or `slice_rows`."""
    return counts.where(F.col("n") > slice_rows).orderBy(F.col("n").desc(), *keys).limit(HOT_KEYS).select(*keys, "n")


def with_counts(rows: DataFrame, counts: DataFrame, keys: list[str], row_id: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Left join of rows with the count n of their key. Hot keys get theirs from a broadcast, and their rows are dealt out by `row_id`."""
    hot = F.broadcast(hot_counts(counts, keys, slice_rows).withColumnRenamed("n", "_hot"))
    lot = F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(row_id), F.lit(HOT_KEYS)).cast("int") + 1)
    return (rows.join(hot, keys, "left").withColumn("_lot", lot).join(counts.select(*keys, "n", F.lit(0).alias("_lot")), [*keys, "_lot"], "left")
            .withColumn("n", F.coalesce("_hot", "n")).drop("_hot", "_lot"))


def sliced_join(probes: DataFrame, refs: DataFrame, keys: list[str], ref_id: str, ref_counts: DataFrame, slice_rows: int = SLICE_ROWS,
                probe_id: str | None = None, probe_counts: DataFrame | None = None) -> DataFrame:
    """Inner equi-join on `keys` in which every hot key is cut into slices of about `slice_rows` rows, on the side of the references and,
    with `probe_counts`, of the probes too.

    Both counts hold (keys, n). Rows of a hot key go to one slice of their own side by their id and to all slices of the other.
    Which keys are hot is broadcast to both sides, so no row is moved by a hot key alone.
    """
    def slices(df: DataFrame, counts: DataFrame | None, name: str) -> DataFrame:
        if counts is None:
            return df.withColumn(name, F.lit(1))
        cut = hot_counts(counts, keys, slice_rows).select(*keys, F.ceil(F.col("n") / slice_rows).cast("int").alias(name))
        return df.join(F.broadcast(cut), keys, "left").withColumn(name, F.coalesce(name, F.lit(1)))

    def dealt(df: DataFrame, own: str, own_id: str | None, other: str) -> DataFrame:
        rows = slices(slices(df, ref_counts, "_refs"), probe_counts, "_probes")
        at = F.pmod(F.xxhash64(own_id), F.col(own)).cast("int") if own_id else F.lit(0)
        return (rows.withColumn(f"{own}_at", at).withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .drop("_refs", "_probes"))

    left = dealt(probes, "_probes", probe_id if probe_counts is not None else None, "_refs")
    return left.join(dealt(refs, "_refs", ref_id, "_probes"), [*keys, "_refs_at", "_probes_at"]).drop("_refs_at", "_probes_at")


def bag_documents(df: DataFrame, id_name: str, words: str, repeats: bool = True) -> DataFrame:
    """(part, id, elements, sig, and the column `share` where there is one): the bag of each row, made from that row alone. Without `repeats`,
    plain distinct words. `sig` is a digest."""
    elements = X.multiset(F.col(words)) if repeats else F.sort_array(F.array_distinct(words))
    kept = [c for c in ("share",) if c in df.columns]
    # `inline` keeps the filter and the digest from making the bag anew.
    bags = df.select("part", id_name, *kept, F.inline(F.array(F.struct(elements.alias("elements"))))).where(F.size("elements") > 0)
    return bags.withColumn("sig", F.md5(F.array_join("elements", " ")))


def fold_bags(docs: DataFrame, id_name: str, side: str) -> DataFrame:
    """One row per distinct bag of a part: digest, smallest id, copies, elements and size, prefixed with `side`."""
    return (docs.groupBy("part", F.col("sig").alias(f"{side}_sig"))
            .agg(F.min(id_name).alias(f"{side}_rep"), F.count("*").alias(f"{side}_copies"), F.any_value("elements").alias(f"{side}_elements"),
                 *[F.min(c).alias(f"{side}_{c}") for c in ("share",) if c in docs.columns])
            .withColumn(f"{side}_size", F.size(f"{side}_elements")))


def dealt_blocks(probes: DataFrame, refs: DataFrame, p_weights: DataFrame, r_weights: DataFrame, on: list[str], probe_id: str, ref_id: str,
                 slice_rows: int, slice_weight: int, rounds: bool = False) -> tuple[DataFrame, DataFrame, list[str]] | list[tuple]:
    """Both sides cut into blocks (`on`, p_at, r_at) in which every probe meets every reference of its `on` once.

    A side of a group is cut by its ids into slices of about `slice_rows` rows and of the sum `slice_weight`, and each of its rows goes to
    all slices of the other side. So rows are repeated as often as the other side has slices, and no block is large. The weights hold
    (`on`, weight), a row for each row of their side. With `rounds` the blocks come as a list: one slice of the references of each group at a
    time, so that a probe is in a round once, and what a round shuffles grows with the rows and not with their square.
    """
    def cuts(d: DataFrame, name: str) -> DataFrame:
        full = F.greatest(F.ceil(F.count("*") / slice_rows), F.ceil(F.sum("weight") / slice_weight))
        return d.groupBy(*on).agg(full.cast("int").alias(name)).where(F.col(name) > 1)  # at most one row for each slice that is full

    p_cuts, r_cuts = cuts(p_weights, "p_cut"), cuts(r_weights, "r_cut")
    if rounds:
        p_cuts, r_cuts = stage_table(p_cuts), stage_table(r_cuts)  # read in each round

    def dealt(d: DataFrame, own: str, own_id: str, other: str) -> DataFrame:
        cut = d.join(F.broadcast(p_cuts), on, "left").join(F.broadcast(r_cuts), on, "left").fillna(1, ["p_cut", "r_cut"])
        return (cut.withColumn(f"{own}_at", F.pmod(F.xxhash64(own_id), F.col(f"{own}_cut")).cast("int"))
                .withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(f"{other}_cut") - 1))).drop("p_cut", "r_cut"))

    block = [*on, "p_at", "r_at"]
    left, right = dealt(probes, "p", probe_id, "r"), dealt(refs, "r", ref_id, "p")
    if not rounds:
        return left, right, block
    return [(left.where(F.col("r_at") == i), right.where(F.col("r_at") == i), block) for i in range(r_cuts.agg(F.max("r_cut")).first()[0] or 1)]


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return whole.flatten().to_numpy(), np.append(0, np.cumsum(sizes))


def overlapping_rows(probes: pa.ChunkedArray, p_needed: np.ndarray, refs: pa.ChunkedArray, r_needed: np.ndarray) -> tuple[np.ndarray, ...]:
    """(probe row, reference row, shared) of all rows whose sets of hashes share as many as both rows need, at least one.

    Rare elements come first in a probe. A pair that shares `needed` elements shares k of them within the first (size - needed + k), so the
    most frequent ones are not looked up; k is a tenth of `needed`. What a probe shares with the references that it meets so often is
    counted in full: by its other elements, or by theirs if those are fewer.
    """
    (p_all, p_from), (r_all, r_from) = _lists(probes), _lists(refs)
    none = np.zeros(0, np.int64)
    if not len(p_all) or not len(r_all):
        return none, none, none
    known, r_all = np.unique(r_all, return_inverse=True)
    order = np.argsort(r_all, kind="stable")
    held = np.searchsorted(r_from, order, side="right").astype(np.int32) - 1  # the references of each element, element by element
    held_from = np.append(0, np.cumsum(np.bincount(r_all, minlength=len(known))))
    del order
    holders = lambda some: np.bincount(np.concatenate([held[held_from[e]:held_from[e + 1]] for e in some]), minlength=len(r_from) - 1)
    marked = np.zeros(len(known), bool)
    found = []
    for row in range(len(p_from) - 1):
        own = p_all[p_from[row]:p_from[row + 1]]
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        at = at[known[at] == own]
        needed = max(int(p_needed[row]), 1)
        if len(at) < needed:
            continue
        meets = -(-needed // 10)
        often = held_from[at + 1] - held_from[at]
        by_rarity, cut = np.argsort(often, kind="stable"), len(at) - needed + meets
        met = holders(at[by_rarity[:cut]])
        likely = np.flatnonzero(met >= meets)
        likely = likely[(r_from[likely + 1] - r_from[likely] >= needed) & (r_needed[likely] <= len(at))]
        if not len(likely):
            continue
        sizes = r_from[likely + 1] - r_from[likely]
        rest = by_rarity[cut:]
        if often[rest].sum() <= 4 * sizes.sum():
            shared = (met + holders(at[rest]) if len(rest) else met)[likely]
        else:
            marked[at] = True
            begin = np.cumsum(sizes) - sizes
            shared = np.add.reduceat(marked[r_all[np.arange(int(sizes.sum())) + np.repeat(r_from[likely] - begin, sizes)]], begin, dtype=np.int64)
            marked[at] = False
        good = shared >= np.maximum(r_needed[likely], needed)
        if good.any():
            found.append((np.full(int(good.sum()), row), likely[good], shared[good]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (none, none, none)


def overlap_pairs(probes: DataFrame, refs: DataFrame, min_share: float | None, of_larger: bool = False, repeats: bool = True,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """All (probe, reference representative) pairs of a part whose bags overlap by at least `min_share`; without it, by at least the
    probe's own column `share` (of probes with one bag, the smallest).

    Takes (part, probe_id, words) and (part, ref_id, words); gives part, probe_id, ref_id, ref_id_copies, score. The score is
    the overlap over the probe's size, or over the larger side with `of_larger`.

    Folded bags meet in blocks of bounded size (`dealt_blocks`), and a task counts what they share in arrays: a row is made for a pair that
    reaches the share only. The blocks are worked off in rounds, whose pairs are staged (but for the last), so that shuffles take room for
    one round. No pair above the share is lost. Words are compared by 64-bit hashes. With `of_larger` bags meet those only whose sizes allow
    the share.
    """
    hashed = lambda d, id_name: bag_documents(d, id_name, "words", repeats).withColumn("elements", F.transform("elements", lambda e: F.xxhash64(e)))
    # Bags are dear to make, and read for the sizes of the blocks, the pairs and the members.
    p_docs, r_docs = (stage_table(hashed(d, c), compression="zstd") for d, c in ((probes, "probe_id"), (refs, "ref_id")))
    share = {"p": F.col("p_share") if min_share is None else F.lit(min_share), "r": F.lit(min_share)}
    needs = lambda side: F.greatest(F.ceil(share[side] * F.col(f"{side}_size") - 1e-9), F.lit(1)).cast("int")
    p = fold_bags(p_docs, "probe_id", "p").select("part", "p_sig", "p_size", needs("p").alias("p_needed"), share["p"].alias("p_least"), "p_elements")
    r = fold_bags(r_docs, "ref_id", "r").select("part", "r_sig", "r_rep", "r_copies", "r_size",
                                                (needs("r") if of_larger else F.lit(1)).alias("r_needed"), "r_elements")
    p, r = stage_table(p, compression="zstd"), stage_table(r, compression="zstd")  # read in each round
    on, p_bands, r_bands = ["part"], lambda d, size: d, lambda d, size: d
    if of_larger and 0 < min_share < 1:
        # Sizes that differ by a factor of 1 / min_share at most are in one band or in neighbouring ones.
        band = lambda size: F.floor(F.log(F.col(size).cast("double")) / -math.log(min_share) + 1e-9).cast("int")
        p_bands = lambda d, size: d.withColumn("band", F.explode(F.sequence(band(size) - 1, band(size) + 1)))
        r_bands = lambda d, size: d.withColumn("band", band(size))
        on = ["part", "band"]
    weights = lambda d, side: d.select("part", F.col(f"{side}_size").alias("weight"))
    met_in = dealt_blocks(p_bands(p, "p_size"), r_bands(r, "r_size"), p_bands(weights(p, "p"), "weight"), r_bands(weights(r, "r"), "weight"),
                          on, "p_sig", "r_sig", slice_rows, SLICE_ELEMENTS, rounds=True)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        row, at, shared = overlapping_rows(left.column("p_elements"), left.column("p_needed").to_numpy(),
                                           right.column("r_elements"), right.column("r_needed").to_numpy())
        p_at, r_at = pa.array(row, pa.int64()), pa.array(at, pa.int64())
        return pa.table({**{c: left.column(c).take(p_at) for c in ("part", "p_sig", "p_size", "p_least")},
                         "ref_id": right.column("r_rep").take(r_at), "ref_id_copies": right.column("r_copies").take(r_at),
                         "r_size": right.column("r_size").take(r_at), "shared": pa.array(shared, pa.int64())})

    out = T.StructType([T.StructField("part", p.schema["part"].dataType), T.StructField("p_sig", T.StringType()), T.StructField("p_size", T.IntegerType()),
                        T.StructField("p_least", T.DoubleType()), T.StructField("ref_id", r.schema["r_rep"].dataType),
                        T.StructField("ref_id_copies", T.LongType()), T.StructField("r_size", T.IntegerType()), T.StructField("shared", T.LongType())])
    whole = F.greatest("p_size", "r_size") if of_larger else F.col("p_size")
    scored = None
    for i, (left, right, block) in enumerate(met_in, start=1):
        pairs = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(met, out)
        some = (pairs.withColumn("score", F.col("shared") / whole).where(F.col("score") >= F.col("p_least"))
                .select("part", "p_sig", "ref_id", "ref_id_copies", "score"))
        if i < len(met_in):
            some = stage_table(some)  # the last round is left to the caller
        scored = some if scored is None else scored.unionByName(some)
    members = p_docs.select("part", "probe_id", F.col("sig").alias("p_sig"))
    return scored.join(members, ["part", "p_sig"]).select("part", "probe_id", "ref_id", "ref_id_copies", "score")


def best_match(pairs: DataFrame, keys: list[str] = ["part", "probe_id"]) -> DataFrame:
    """Best reference per probe, the smaller id on a tie, with the runner-up's score (its own score if it has copies)."""
    ranked = F.sort_array(F.collect_list("_ranked"))
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "ref_id")
    two = (pairs.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= 2)
           .withColumn("_ranked", F.struct("_rn", "ref_id", "score", "ref_id_copies")))
    first = lambda name: F.get("_top", F.lit(0))[name]
    return (two.groupBy(*keys).agg(ranked.alias("_top"))
            .select(*keys, first("ref_id").alias("ref_id"), first("score").alias("score"),
                    F.when(first("ref_id_copies") > 1, first("score")).otherwise(
                        F.coalesce(F.get("_top", F.lit(1))["score"], F.lit(0.0))).alias("second")))


def bag_matches(probes: DataFrame, refs: DataFrame, accept: float = 0.5) -> DataFrame:
    """Best word-bag match of every probe within its part: score = covered share of the probe's words, or no_match."""
    best = best_match(overlap_pairs(probes, refs, accept))
    return (probes.select("part", "probe_id").join(best, ["part", "probe_id"], "left")
            .withColumn("status", F.when(F.col("ref_id").isNull(), "no_match").otherwise("matched")))


def retry_matches(first: DataFrame, probes: DataFrame, refs: DataFrame, accept: float = 0.5) -> DataFrame:
    """Search the probes without a match again in all parts at once."""
    first = stage_table(first)  # read for the probes to retry and for the result
    left = first.where(F.col("status") == "no_match").select("probe_id")
    everywhere = lambda d: d.withColumn("part", F.lit("*"))
    again = bag_matches(everywhere(probes.join(left, "probe_id", "left_semi")), everywhere(refs), accept)
    found = first.where(F.col("status") != "no_match").withColumn("round", F.lit(1))
    return found.unionByName(again.withColumn("round", F.lit(2)).withColumn("part", F.col("part").cast(first.schema["part"].dataType)))


def _options(df: DataFrame, id_name: str, side: str) -> DataFrame:
    """(part, id, a, b, c with the side's mark, and their letter counts)."""
    bare = df.select("part", id_name, *[F.lower(X.strip(X.blank_if_null(F.col(o)))).alias(f"{side}_{o}") for o in "abc"])
    return bare.withColumns({f"{side}_{o}_counts": Sim.letter_counts(F.col(f"{side}_{o}")) for o in "abc"})


def _options_agree(pairs: DataFrame, floor: float) -> DataFrame:
    """The pairs whose three options all have a ratio of at least `floor`. Letter counts refuse most others before any ratio, and each
    pair of option sets is rated once."""
    possible, likely = F.lit(True), F.lit(True)
    for o in "abc":
        possible &= Sim.ratio_possible(F.col(f"p_{o}"), F.col(f"r_{o}"), floor)
        likely &= Sim.ratio_reachable(F.col(f"p_{o}"), F.col(f"r_{o}"), F.col(f"p_{o}_counts"), F.col(f"r_{o}_counts"), floor)
    pairs = pairs.where(possible & likely)
    texts = [f"{s}_{o}" for o in "abc" for s in "pr"]
    once = pairs.select(*texts).distinct()
    rated = once.withColumns({f"x_{o}": Sim.sequence_ratio(F.col(f"p_{o}"), F.col(f"r_{o}")) for o in "abc"})
    return pairs.join(rated.where(F.least("x_a", "x_b", "x_c") >= floor).select(*texts), texts, "left_semi")


def likely_options(probes: pa.Table, refs: pa.Table, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(probe row, reference row) of the pairs whose three options may all have a ratio of `floor`, by lengths and letters, and that share a
    word. Takes `lengths` (three), `letters` (counts of the three options, one after the other) and `words` (hashes, not empty)."""
    matrix = lambda t, c: _lists(t.column(c))[0].reshape(t.num_rows, -1).astype(np.int64)
    if not probes.num_rows or not refs.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p_lengths, r_lengths, p_letters, r_letters = (matrix(t, c) for c in ("lengths", "letters") for t in (probes, refs))
    (p_words, p_from), (r_words, r_from) = _lists(probes.column("words")), _lists(refs.column("words"))
    known, r_words = np.unique(r_words, return_inverse=True)
    marked = np.zeros(len(known), bool)
    rows, found = [], []
    for row in range(probes.num_rows):
        both = r_lengths + p_lengths[row]
        at = np.flatnonzero(np.all((both == 0) | (2.0 * np.minimum(r_lengths, p_lengths[row]) / np.maximum(both, 1) >= floor), axis=1))
        if len(at):
            shared = np.minimum(r_letters[at], p_letters[row]).reshape(len(at), 3, -1).sum(axis=2)
            at = at[np.all(2.0 * shared >= (floor - 1e-9) * both[at], axis=1)]
        if not len(at):
            continue
        own = p_words[p_from[row]:p_from[row + 1]]
        place = np.searchsorted(known, own)
        place[place == len(known)] = 0
        place = place[known[place] == own]
        marked[place] = True
        sizes = r_from[at + 1] - r_from[at]
        begin = np.cumsum(sizes) - sizes
        at = at[np.logical_or.reduceat(marked[r_words[np.arange(int(sizes.sum())) + np.repeat(r_from[at] - begin, sizes)]], begin)]
        marked[place] = False
        rows.append(np.full(len(at), row))
        found.append(at)
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def option_neighbours(probes: DataFrame, refs: DataFrame, floor: float, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(part, probe_id, ref_id) whose three options all look alike and whose words have one in common.

    Texts with a ratio of `floor` differ in length by a factor of (2 - floor) / floor at most, so the options' lengths together fall into the
    same or the next band on that scale. Within a band, probes and references meet in blocks (`dealt_blocks`); a task compares lengths,
    letter counts and words in arrays and gives the pairs that are worth rating.
    """
    step = math.log((2 - floor) / floor)
    p, r = _options(probes, "probe_id", "p"), _options(refs, "ref_id", "r")

    def keyed(d: DataFrame, source: DataFrame, id_name: str, side: str) -> DataFrame:
        whole = sum((F.length(f"{side}_{o}") for o in "abc"), F.lit(0))
        # Empty options are like empty ones only, so their band lies apart.
        band = F.when(whole == 0, -9).otherwise(F.floor(F.log(whole.cast("double")) / step + 1e-9)).cast("int")
        words = source.select("part", id_name, F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)).alias("words")).where(F.size("words") > 0)
        return d.select("part", id_name, band.alias("band"), F.array(*[F.length(f"{side}_{o}") for o in "abc"]).alias("lengths"),
                        F.concat(*[f"{side}_{o}_counts" for o in "abc"]).alias("letters")).join(words, ["part", id_name])

    around = F.when(F.col("band") == -9, F.array("band")).otherwise(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    # Options and words are dear to cut, and read for the sizes of the blocks too.
    p_rows, r_rows = stage_table(keyed(p, probes, "probe_id", "p")), stage_table(keyed(r, refs, "ref_id", "r"))
    p_rows = p_rows.withColumn("band", F.explode(around))
    weights = lambda d: d.select("part", "band", (F.size("words") + F.size("letters")).alias("weight"))
    p_dealt, r_dealt, block = dealt_blocks(p_rows, r_rows, weights(p_rows), weights(r_rows), ["part", "band"], "probe_id", "ref_id", slice_rows,
                                           SLICE_ELEMENTS)

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        row, at = likely_options(left, right, floor)
        row = pa.array(row, pa.int64())
        return pa.table({"part": left.column("part").take(row), "probe_id": left.column("probe_id").take(row),
                         "ref_id": right.column("ref_id").take(pa.array(at, pa.int64()))})

    out = T.StructType([p_rows.schema["part"], p_rows.schema["probe_id"], r_rows.schema["ref_id"]])
    pairs = p_dealt.groupBy(*block).cogroup(r_dealt.groupBy(*block)).applyInArrow(met, out)
    rows = pairs.join(p, ["part", "probe_id"]).join(r, ["part", "ref_id"])
    # Words are compared by hashes, so a shared one is made sure of by the score that the caller needs anyway.
    return _options_agree(rows, floor).select("part", "probe_id", "ref_id")


GATE_SHARE = 0.45


def gated_matches(probes: DataFrame, refs: DataFrame, ratio_floor: float = 0.8, near_top: float = 0.9, alone: float = 0.85,
                  min_words: int = 3) -> DataFrame:
    """Among candidates within 90 % of the top word score, the first whose three options all look alike; else the top one alone
    from 0.85 on, marked low confidence.

    Takes (part, id, words, a, b, c) on both sides. Probes with a word score of 0.5 or more have all their candidates among the pairs
    that share 45 % of the words. For the others, references with like options are found by an index on words and option lengths;
    only probes that have some need to know their top score, and it is searched from the score of their best such reference on.
    """
    long_enough = probes.where(F.size("words") >= min_words)
    first = stage_table(overlap_pairs(long_enough, refs, GATE_SHARE))  # read for the candidates and for the probes that have none
    tops = first.groupBy("part", "probe_id").agg(F.max("score").alias("top")).where(F.col("top") >= GATE_SHARE / near_top)
    close = first.join(tops, ["part", "probe_id"]).where(F.col("score") >= near_top * F.col("top")).select("part", "probe_id", "ref_id", "score")
    # Copies share their words, not necessarily their options, so all members of a representative are compared.
    bags = bag_documents(refs, "ref_id", "words").select("part", "sig", "ref_id")
    members = (bags.groupBy("part", "sig").agg(F.min("ref_id").alias("rep")).join(bags, ["part", "sig"])
               .select("part", F.col("rep").alias("ref_id"), F.col("ref_id").alias("member_id")))
    rows = (close.join(members, ["part", "ref_id"]).drop("ref_id").withColumnRenamed("member_id", "ref_id")
            .join(_options(probes, "probe_id", "p"), ["part", "probe_id"]).join(_options(refs, "ref_id", "r"), ["part", "ref_id"]))
    agreeing = _options_agree(rows, ratio_floor).select("part", "probe_id", "ref_id", "score")

    rest = long_enough.join(tops, ["part", "probe_id"], "left_anti")
    words = lambda d, id_name, side: bag_documents(d, id_name, "words").select("part", id_name, F.col("elements").alias(side))
    alike = (option_neighbours(rest, refs, ratio_floor).join(words(rest, "probe_id", "p"), ["part", "probe_id"])
             .join(words(refs, "ref_id", "r"), ["part", "ref_id"])
             .select("part", "probe_id", "ref_id", (F.size(F.array_intersect("p", "r")) / F.size("p")).alias("score")).where(F.col("score") > 0))
    alike = stage_table(alike)  # few rows that took a search; read for the shares and for the result
    shares = alike.groupBy("part", "probe_id").agg(F.max("score").alias("share"))
    searched = overlap_pairs(rest.join(shares, ["part", "probe_id"]).select("part", "probe_id", "words", "share"), refs, None)
    higher = searched.groupBy("part", "probe_id").agg(F.max("score").alias("top"))
    late = alike.join(higher, ["part", "probe_id"]).where(F.col("score") >= near_top * F.col("top")).drop("top")

    best = lambda d, name: d.groupBy("part", "probe_id").agg(F.min_by(F.struct("ref_id", "score"), F.struct(-F.col("score"), "ref_id")).alias(name))
    out = (probes.select("part", "probe_id").join(best(agreeing.unionByName(late), "gate"), ["part", "probe_id"], "left")
           .join(best(close, "top"), ["part", "probe_id"], "left"))
    low = F.col("gate").isNull() & (F.col("top.score") >= alone)
    return out.select("part", "probe_id", F.coalesce("gate.ref_id", F.when(low, F.col("top.ref_id"))).alias("ref_id"),
                      F.coalesce("gate.score", F.when(low, F.col("top.score")), F.lit(0.0)).alias("score"),
                      F.when(F.col("gate").isNotNull(), "matched").when(low, "low_confidence").otherwise("no_match").alias("status"))


def ngrams(words: Column, n: int = 4) -> Column:
    """Distinct n-word sequences; none for shorter texts."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(
        F.array().cast("array<string>"))


def gram_candidates(probes: DataFrame, refs: DataFrame, n: int = 4, top: int | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Pairs of folded texts that share a word n-gram, with the number of shared ones; optionally the `top` per probe.

    Takes (probe_id, text) and (ref_id, text) and compares their alphanumeric forms.
    """
    form = lambda d: d.withColumn("form", X.alnum_form(F.col("text")))
    grams = lambda d, rep: d.withColumn("_words", F.split("form", " ")).select(rep, "form", f"{rep}_copies", F.explode(ngrams(F.col("_words"), n)).alias("gram"))
    p = fold_copies(form(probes), "probe_id", ["form"], "p_rep")
    r = fold_copies(form(refs), "ref_id", ["form"], "r_rep")
    p_grams, r_grams = grams(p, "p_rep").select("p_rep", "gram"), grams(r, "r_rep").select("r_rep", "gram")
    counts = r_grams.groupBy("gram").agg(F.count("*").alias("n"))
    shared = (sliced_join(p_grams, r_grams, ["gram"], "r_rep", counts, slice_rows, "p_rep", p_grams.groupBy("gram").agg(F.count("*").alias("n")))
              .groupBy("p_rep", "r_rep").agg(F.count("*").alias("shared")))
    if top is not None:
        order = Window.partitionBy("p_rep").orderBy(F.col("shared").desc(), "r_rep")
        shared = shared.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= top).drop("_rn")
    return shared.join(with_form(p, "p"), "p_rep").join(with_form(r, "r", "r_rep_copies"), "r_rep")


def with_form(reps: DataFrame, side: str, *more: str) -> DataFrame:
    """Folded texts of one side: `rep`, `form`, and the form's letter counts, counted once a form before it is paired."""
    return reps.select(f"{side}_rep", F.col("form").alias(f"{side}_form"), Sim.letter_counts(F.col("form")).alias(f"{side}_counts"), *more)


def reachable(pairs: DataFrame, floor: float) -> DataFrame:
    """The pairs whose lengths and letters allow a ratio of `floor`; only these are worth rating."""
    return pairs.where(Sim.ratio_reachable(F.col("p_form"), F.col("r_form"), F.col("p_counts"), F.col("r_counts"), floor))


def common_letters(places: dict[str, int], length: int, text: str) -> int:
    """Length of the longest common subsequence of `text` and a text of `length` letters, of which `places` has the bits where each letter
    stands. The bits of a whole row of the usual table are kept in one number."""
    every = (1 << length) - 1
    open_ = every
    for letter in text:
        met = open_ & places.get(letter, 0)
        open_ = ((open_ + met) | (open_ - met)) & every
    return length - open_.bit_count()


def best_two_ratios(pairs: DataFrame, floor: float) -> DataFrame:
    """(p_rep, r_rep, r_rep_copies, score) of pairs that hold the best two sequence ratios of each probe, and some others.

    Takes candidate pairs with forms and letter counts; those whose lengths or letters do not allow a ratio of `floor` are left out. The
    pairs of a probe are read from the highest possible ratio down: a pair is rated only if its letters, and then its longest common
    subsequence, allow at least the second best ratio so far, so none of the best two, nor of those equal to them, is
    passed over. (Matching blocks come in the same order in both texts, so they make a common subsequence.) Few bytes stand for much work
    here, so the pairs are spread over as many tasks as the session shuffles into, whatever their size.
    """
    letters = pairs.where(Sim.ratio_possible(F.col("p_form"), F.col("r_form"), floor))
    bound = Sim.ratio_bound(F.col("p_form"), F.col("r_form"), F.col("p_counts"), F.col("r_counts"))
    # `inline` keeps the filter and the sort from reckoning the bound anew.
    likely = letters.select("p_rep", "r_rep", "r_rep_copies", "p_form", "r_form",
                            F.inline(F.array(F.struct(bound.alias("bound"))))).where(F.col("bound") >= floor - 1e-9)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = likely.repartition(tasks, "p_rep").sortWithinPartitions("p_rep", F.col("bound").desc(), "r_rep")

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, first, second = None, 0.0, 0.0
        for batch in batches:
            rows, found = [], []
            columns = (batch.column(c).to_pylist() for c in ("p_rep", "bound", "p_form", "r_form"))
            for row, (rep, most, a, b) in enumerate(zip(*columns)):
                if probe != rep:
                    probe, first, second = rep, 0.0, 0.0
                    places: dict[str, int] = {}
                    for i, letter in enumerate(a):
                        places[letter] = places.get(letter, 0) | 1 << i
                least = (second - 1e-9) * (len(a) + len(b)) / 2
                if most < second - 1e-9 or (second and common_letters(places, len(a), b) < least):
                    continue
                score = difflib.SequenceMatcher(None, a, b).ratio()
                first, second = max(first, score), max(second, min(first, score))
                rows.append(row)
                found.append(score)
            kept = batch.select(["p_rep", "r_rep", "r_rep_copies"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.float64())], [*kept.schema.names, "score"])

    out = T.StructType([*[likely.schema[c] for c in ("p_rep", "r_rep", "r_rep_copies")], T.StructField("score", T.DoubleType())])
    return dealt.mapInArrow(rated, out)


def gram_matches(probes: DataFrame, refs: DataFrame, threshold: float = 0.78, margin: float = 0.05, top: int | None = None) -> DataFrame:
    """Best text per probe by sequence ratio among n-gram candidates; ambiguous if the runner-up is closer than `margin`.

    By default every candidate is rated; `top=30` keeps only those with the most shared n-grams.
    """
    # Texts may be dear to make, and are read for the folds, the grams, the forms and the result; a form is its own form.
    probes, refs = (stage_table(d.select(c, X.alnum_form(F.col("text")).alias("text"))) for d, c in ((probes, "probe_id"), (refs, "ref_id")))
    rated = best_two_ratios(gram_candidates(probes, refs, top=top), threshold - margin)
    best = best_match(rated.select(F.lit(0).alias("part"), F.col("p_rep").alias("probe_id"), F.col("r_rep").alias("ref_id"),
                                   F.col("r_rep_copies").alias("ref_id_copies"), "score")).drop("part")
    form = probes.withColumn("form", X.alnum_form(F.col("text")))
    reps = fold_copies(form, "probe_id", ["form"], "p_rep").drop("p_rep_copies")
    all_probes = form.join(reps, "form").select("probe_id", "p_rep")
    best = best.withColumnRenamed("probe_id", "p_rep")
    joined = all_probes.join(best, "p_rep", "left").drop("p_rep")
    status = (F.when(F.coalesce("score", F.lit(0.0)) < threshold, "no_match")
              .when(F.col("score") - F.col("second") < margin, "ambiguous").otherwise("matched"))
    return joined.withColumn("status", status)


def fuzzy_matches(probes: DataFrame, refs: DataFrame, threshold: float = 0.82, margin: float = 0.05, shortest: int = 20) -> DataFrame:
    """Equal 60-character openings count as 1.0; others need one opening of 20 characters within the other's first 80 and a
    sequence ratio over 150 characters. The best one stands unless the second is closer than `margin`.

    The opening gate is an equi-join on the 61 windows of the first 80 characters.
    """
    form = lambda d: d.withColumn("form", F.substring(X.alnum_form(F.col("text")), 1, 150))
    p = fold_copies(form(probes).where(F.length("form") >= shortest), "probe_id", ["form"], "p_rep")
    r = fold_copies(form(refs).where(F.col("form") != ""), "ref_id", ["form"], "r_rep")
    head, windows = F.substring("form", 1, 20), F.array_distinct(F.regexp_extract_all(F.substring("form", 1, 80), F.lit("(?=(.{20}))"), F.lit(1)))
    keyed = lambda d, rep, key: d.select(rep, key.alias("key"))
    counts = lambda d: d.groupBy("key").agg(F.count("*").alias("n"))
    lengths = range(math.ceil(threshold * 20 / (2 - threshold)), 20)  # shorter references cannot reach the ratio with 20 characters
    runs = lambda n: F.regexp_extract_all(F.substring("form", 1, 80), F.lit("(?=(.{%d}))" % n), F.lit(1))
    short_windows = F.when(F.length("form") <= math.ceil(20 * (2 - threshold) / threshold), F.flatten(F.array(*[runs(n) for n in lengths])))
    p_open = keyed(p, "p_rep", F.explode(F.array_distinct(F.concat(windows, F.coalesce(short_windows, F.array().cast("array<string>"))))))
    r_open, r_head = keyed(r, "r_rep", F.explode(windows)), keyed(r, "r_rep", head)
    meet = lambda a, b: sliced_join(a, b, ["key"], "r_rep", counts(b), SLICE_ROWS, "p_rep", counts(a)).select("p_rep", "r_rep")
    gated = meet(keyed(p, "p_rep", head), r_open).union(meet(p_open, r_head))
    pairs = gated.distinct().join(with_form(p, "p"), "p_rep").join(with_form(r, "r", "r_rep_copies"), "r_rep")
    same = F.substring("p_form", 1, 60) == F.substring("r_form", 1, 60)
    equal = pairs.where(same).withColumn("score", F.lit(1.0))
    rated = (reachable(pairs.where(~same), threshold)
             .withColumn("score", Sim.sequence_ratio(F.col("p_form"), F.col("r_form"))).where(F.col("score") >= threshold))
    both = equal.unionByName(rated).select(F.lit(0).alias("part"), F.col("p_rep").alias("probe_id"), F.col("r_rep").alias("ref_id"),
                                           F.col("r_rep_copies").alias("ref_id_copies"), "score")
    best = best_match(both).drop("part").withColumnRenamed("probe_id", "p_rep")
    members = form(probes).join(p.select("form", "p_rep"), "form", "left").select("probe_id", "p_rep")
    return (members.join(best, "p_rep", "left").drop("p_rep")
            .withColumn("status", F.when(F.col("ref_id").isNull(), "no_match")
                        .when((F.col("second") > 0) & (F.col("score") - F.col("second") < margin), "ambiguous")
                        .otherwise("matched")))


def prefix_matches(probes: DataFrame, refs: DataFrame, tiers: list[int] = V.PREFIX_TIERS) -> DataFrame:
    """Reference row with the same text opening: longest tier first; among several, the most similar options, then the smallest id.

    Takes (probe_id, text, a, b, c) and (ref_id, text, a, b, c). Each probe first meets one pre-aggregated row per key, which
    settles its tier and, for keys with one reference, the match. Only the rest is compared option by option, on folded copies.

    A text is cut to its keys once, whatever the tiers and however often the rows are read: all tiers are openings of the longest key, and
    the folded references and the probes that have a key in common with some are staged.
    """
    options = [F.col(o) for o in "abc"]
    keys = X.let(X.prefix_key(F.col("text"), max(tiers)),
                 lambda longest: F.array(*[F.struct(F.lit(n).alias("tier"), F.substring(longest, 1, n).alias("key")) for n in tiers]))
    word_sets = F.concat_ws("|", *[F.array_join(F.sort_array(F.array_distinct(X.words(o, "[a-z]+"))), " ") for o in options])
    explode = lambda d, id_name: d.select(id_name, word_sets.alias("_sets"), keys.alias("_keys")).select(id_name, "_sets", F.inline("_keys"))
    r_folded = stage_table(explode(refs, "ref_id").groupBy("tier", "key", "_sets").agg(F.min("ref_id").alias("ref_id")))
    r_keys = r_folded.groupBy("tier", "key").agg(F.count("*").alias("variants"), F.min("ref_id").alias("only"))
    hits = stage_table(explode(probes, "probe_id").join(r_keys, ["tier", "key"]).groupBy("probe_id", "_sets")
                       .agg(F.max_by(F.struct("tier", "key", "variants", "only"), F.col("tier")).alias("hit")).select("probe_id", "_sets", "hit.*"))
    single = hits.where(F.col("variants") == 1).select("probe_id", "tier", F.col("only").alias("ref_id"))
    many = hits.where(F.col("variants") > 1).select("probe_id", "tier", "key", F.col("_sets").alias("p_sets"))
    cases = many.select("tier", "key", "p_sets").distinct()
    chosen = most_similar_options(cases, r_folded.join(cases.select("tier", "key").distinct(), ["tier", "key"], "left_semi"))
    return single.unionByName(many.join(chosen, ["tier", "key", "p_sets"]).select("probe_id", "tier", "ref_id"))


def most_similar_options(cases: DataFrame, lists: DataFrame, slice_rows: int = 8192) -> DataFrame:
    """(tier, key, p_sets, ref_id): for each option set of the probes the reference under the same key whose options are most similar,
    the smallest id among equals.

    Takes cases (tier, key, p_sets) and references (tier, key, _sets, ref_id); a set holds three sorted word lists. The similarity is
    the mean over the options of shared words by the larger list.

    Cases and references of a key meet in blocks of about `slice_rows` rows a side. No row is made for a pair: a task counts the words
    that a case shares with the references of its block in arrays, and gives one row a case. So what is shuffled grows with the rows, and
    for a key of more rows than a slice holds with rows times slices.
    """
    on = ["tier", "key"]
    counted = lambda d, name: d.groupBy(*on).agg(F.ceil(F.count("*") / slice_rows).cast("int").alias(name)).where(F.col(name) > 1)
    p_cuts, r_cuts = counted(cases, "p_cut"), counted(lists, "r_cut")  # at most one row for each slice that is full

    def dealt(d: DataFrame, own: str, own_id: str, other: str) -> DataFrame:
        cut = d.join(F.broadcast(p_cuts), on, "left").join(F.broadcast(r_cuts), on, "left").fillna(1, ["p_cut", "r_cut"])
        return (cut.withColumn(f"{own}_at", F.pmod(F.xxhash64(own_id), F.col(f"{own}_cut")).cast("int"))
                .withColumn(f"{other}_at", F.explode(F.sequence(F.lit(0), F.col(f"{other}_cut") - 1))).drop("p_cut", "r_cut"))

    fields = [cases.schema["tier"], cases.schema["key"], cases.schema["p_sets"], lists.schema["ref_id"]]
    out = T.StructType([*fields, T.StructField("rate", T.DoubleType())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("ref_id")  # the first of the best has the smallest id
        found = most_similar_rows(left.column("p_sets").to_pylist(), right.column("_sets").to_pylist() if left.num_rows else [])
        left = left.slice(0, len(found))
        at, rates = [i for i, _ in found], [rate for _, rate in found]
        return pa.table({"tier": left.column("tier"), "key": left.column("key"), "p_sets": left.column("p_sets"),
                         "ref_id": right.column("ref_id").take(pa.array(at, pa.int64())), "rate": pa.array(rates, pa.float64())})

    block = [*on, "p_at", "r_at"]
    met = (dealt(cases, "p", "p_sets", "r").groupBy(*block).cogroup(dealt(lists, "r", "ref_id", "p").groupBy(*block)).applyInArrow(best, out))
    return met.groupBy(*on, "p_sets").agg(F.min_by("ref_id", F.struct(-F.col("rate"), "ref_id")).alias("ref_id"))


def most_similar_rows(probes: list[str], refs: list[str]) -> list[tuple[int, float]]:
    """For each of `probes` the first of the most similar `refs` and their similarity; nothing without references."""
    if not refs:
        return []
    lists = lambda sets: [part.split(" ") if part else [] for part in sets.split("|")]
    places: list[dict[str, list[int]]] = [{}, {}, {}]
    sizes = np.zeros((3, len(refs)))
    for row, sets in enumerate(refs):
        for i, words in enumerate(lists(sets)):
            sizes[i, row] = len(words)
            for w in words:
                places[i].setdefault(w, []).append(row)
    held = [{w: np.array(rows, dtype=np.int32) for w, rows in some.items()} for some in places]
    found = []
    for sets in probes:
        rate = np.zeros(len(refs))
        for i, words in enumerate(lists(sets)):
            if met := [held[i][w] for w in words if w in held[i]]:
                rate += np.bincount(np.concatenate(met), minlength=len(refs)) / np.maximum(sizes[i], len(words))
        rate /= 3.0
        at = int(rate.argmax())
        found.append((at, float(rate[at])))
    return found


def validated_matches(matches: DataFrame, probes: DataFrame, refs: DataFrame, floor: float = 0.40, length: int | None = 120) -> DataFrame:
    """Keep prefix matches whose texts (or their openings) share at least `floor` of their words."""
    key = (lambda c: X.prefix_key(c, length)) if length else (lambda c: c)
    rows = (matches.join(probes.select("probe_id", F.col("text").alias("p_text")), "probe_id")
            .join(refs.select("ref_id", F.col("text").alias("r_text")), "ref_id"))
    rated = rows.withColumn("similarity", Sim.word_set_similarity(key(F.col("p_text")), key(F.col("r_text")))).drop("p_text", "r_text")
    return rated.select("probe_id", "ref_id", "tier", F.inline(F.array(F.struct("similarity")))).where(F.col("similarity") >= floor)


def similar_fallback(probes: DataFrame, refs: DataFrame, above: float = 0.70) -> DataFrame:
    """For probes without a key hit: the first reference (smallest id) whose distinct words agree by more than `above`."""
    as_bag = lambda d, id_name: d.select(F.lit(0).alias("part"), id_name, X.words(F.col("text"), "[a-z]+").alias("words"))
    pairs = overlap_pairs(as_bag(probes, "probe_id"), as_bag(refs, "ref_id"), above, of_larger=True, repeats=False)
    return pairs.where(F.col("score") > above).groupBy("probe_id").agg(F.min("ref_id").alias("ref_id"))


def containment_pairs(needles: DataFrame, texts: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(part, needle_id, text_id) for every needle that occurs in a text of its part.

    Takes (part, needle_id, needle) and (part, text_id, text). A word inside the needle is a whole word of the text as well,
    so each needle is looked up by its rarest inner word and then verified. Needles without one are looked up by their
    rarest run of three characters; shorter needles are refused by `needle` being null.
    """
    word = "[\\p{L}\\p{N}]+"
    all_words = lambda c: F.regexp_extract_all(c, F.lit(word), F.lit(0))
    inner = lambda ws: F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 2, F.lit(0)))
    triples = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(.{3}))"), F.lit(1)))
    n = needles.where(F.length("needle") >= 3).withColumn("_inner", F.array_distinct(inner(all_words(F.col("needle")))))
    n_texts = texts.select("part", "text_id", "text")

    def look_up(some: DataFrame, anchors: Column, text_keys: Column) -> DataFrame:
        n_keys = some.select("part", "needle_id", F.explode(anchors).alias("key"))
        # Only keys that some needle has are counted.
        t_keys = (n_texts.select("part", "text_id", F.explode(text_keys).alias("key"))
                  .join(n_keys.select("part", "key").distinct(), ["part", "key"], "left_semi"))
        counts = t_keys.groupBy("part", "key").agg(F.count("*").alias("n"))
        # A key that no text has settles the needle: it occurs nowhere.
        rated = n_keys.join(counts, ["part", "key"], "left").groupBy("part", "needle_id").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("rare"))
        rare = rated.where(F.col("rare.n") > 0).select("part", "needle_id", "rare.key", "rare.n")
        return sliced_join(rare.drop("n"), t_keys, ["part", "key"], "text_id", counts, slice_rows).select("part", "needle_id", "text_id")

    by_word = look_up(n.where(F.size("_inner") > 0), F.col("_inner"), F.array_distinct(all_words(F.col("text"))))
    by_triple = look_up(n.where(F.size("_inner") == 0), triples(F.col("needle")), triples(F.col("text")))
    return (by_word.unionByName(by_triple).join(n.select("part", "needle_id", "needle"), ["part", "needle_id"])
            .join(n_texts, ["part", "text_id"]).where(F.contains(F.col("text"), F.col("needle"))).select("part", "needle_id", "text_id"))


def locate_pages(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Page of each record within its document: before and after text (tier 1), after (2), opening (3), before (4); lowest page first.

    Takes (part, record_id, before, after, opening), already normalised, and (part, page_no, text).
    """
    kinds = {"before": 10, "after": 10, "opening": 20}
    probes = records.select("part", "record_id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.when(F.length(k) >= least, F.col(k)).alias("needle")) for k, least in kinds.items()])).alias("p"))
    needles = probes.select("part", F.concat_ws("\u0001", F.col("record_id").cast("string"), "p.kind").alias("needle_id"),
                            F.col("p.needle").alias("needle")).where(F.col("needle").isNotNull())
    texts = pages.select("part", F.col("page_no").alias("text_id"), "text")
    hits = containment_pairs(needles, texts).withColumn("_parts", F.split("needle_id", "\u0001"))
    on = lambda kind: F.max((F.get("_parts", F.lit(1)) == kind).cast("int")) == 1
    pages_hit = hits.groupBy("part", F.get("_parts", F.lit(0)).alias("record_key"), F.col("text_id").alias("page_no")).agg(
        on("before").alias("b"), on("after").alias("a"), on("opening").alias("o"))
    after_len = records.select("part", F.col("record_id").cast("string").alias("record_key"), "record_id", F.length("after").alias("_n"))
    tier = F.when(F.col("b") & F.col("a"), 1).when(F.col("a") & (F.col("_n") >= 15), 2).when(F.col("o"), 3).when(F.col("b"), 4)
    found = (pages_hit.join(after_len, ["part", "record_key"]).withColumn("tier", tier).where(F.col("tier").isNotNull())
             .groupBy("part", "record_id").agg(F.min(F.struct("tier", "page_no")).alias("at")))
    return found.select("part", "record_id", "at.tier", "at.page_no")


def holding_pages(words: list[str], texts: list[str]) -> dict[str, np.ndarray]:
    """For each word which of the texts contain it, also inside a longer word. Words hold no blank and texts are split at blanks, so a word
    is looked for in the texts' distinct tokens only, written one after the other: where its rarest run of three characters stands."""
    numbers: dict[str, int] = {}
    tokens = [list({t for t in text.split(" ") if t}) for text in texts]
    token = np.array([numbers.setdefault(t, len(numbers)) for some in tokens for t in some], dtype=np.int64)
    page = np.repeat(np.arange(len(texts)), [len(some) for some in tokens])
    held = page[np.argsort(token, kind="stable")]  # the pages of each token, token by token
    held_from = np.append(0, np.cumsum(np.bincount(token, minlength=len(numbers))))
    letters = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    written = letters("".join(f"{t} " for t in numbers) + "  ")  # a run can begin at every letter
    begin = np.cumsum([0, *[len(t) + 1 for t in numbers]])[:-1]
    run = lambda c: c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    runs = run(written)
    order = np.argsort(runs, kind="stable")
    runs = runs[order]
    out = {}
    for w in words:
        own = letters(w)
        if len(own) < 3:
            at = np.flatnonzero(written == own[0])
            at = at if len(own) < 2 else at[written[at + 1] == own[1]]
        else:
            from_, to = (np.searchsorted(runs, run(own), side) for side in ("left", "right"))
            rarest = int(np.argmin(to - from_))
            at = order[from_[rarest]:to[rarest]] - rarest
            at = at[(at >= 0) & (at + len(own) <= len(written))]
            for i, letter in enumerate(own.tolist()):
                at = at[written[at + i] == letter]
        hosts = np.unique(np.searchsorted(begin, at, side="right") - 1)
        sizes = held_from[hosts + 1] - held_from[hosts]
        there = np.zeros(len(texts), bool)
        there[held[np.arange(int(sizes.sum())) + np.repeat(held_from[hosts] - (np.cumsum(sizes) - sizes), sizes)]] = True
        out[w] = there
    return out


def locate_by_words(records: DataFrame, pages: DataFrame, opening: int = 50, words: int = 8, hits: int = 6, fallback_words: int = 4,
                    fallback_hits: int = 3, slice_rows: int = 4096) -> DataFrame:
    """Page of each record by its first words: part, record_id, tier, page_no.

    Takes (part, record_id, text) and (part, page_no, text). The words are those of the first `opening` characters; tier 1 are pages
    that contain at least `hits` of the first `words` of them (all, if there are fewer), tier 2 those that contain `fallback_hits` of
    the first `fallback_words`. A word may lie inside a longer one and counts as often as it is written. The lowest tier stands,
    then the lowest page; records without words or page give no row.

    Distinct openings and pages meet in blocks of bounded size (`dealt_blocks`). A task looks the words up in its pages and gives one row
    for each opening that has a page there; no row is made for a word of a page or for a pair of an opening and a page.
    """
    flat = lambda c: X.collapse(F.lower(X.blank_if_null(c)))
    listed = F.filter(F.split(F.substring(flat(F.col("text")), 1, opening), " "), lambda w: w != "")
    cases = (records.where(F.col("part").isNotNull()).select("part", "record_id", F.slice(listed, 1, words).alias("words"))
             .where(F.size("words") > 0).withColumn("case", F.array_join("words", " ")))
    distinct = cases.select("part", "case").distinct()
    there = pages.where(F.col("part").isNotNull() & F.col("page_no").isNotNull())
    texts = there.select("part", "page_no", flat(F.col("text")).alias("text"))
    weights = lambda d, c: d.select("part", F.length(c).alias("weight"))
    p, r, block = dealt_blocks(distinct, texts, weights(distinct, "case"), weights(there, "text"), ["part"], "case", "page_no", slice_rows,
                               2 * SLICE_ELEMENTS)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("page_no")  # the first page of a tier is the lowest
        found = []
        if left.num_rows and right.num_rows:
            openings = [case.split(" ") for case in left.column("case").to_pylist()]
            holding = holding_pages(sorted({w for some in openings for w in some}), right.column("text").to_pylist())
            for row, some in enumerate(openings):
                counts = np.cumsum([holding[w] for w in some], axis=0)
                first = counts[-1] >= min(hits, len(some))
                second = counts[min(fallback_words, len(some)) - 1] >= fallback_hits
                for tier, pages_of in ((1, first), (2, second)):
                    if pages_of.any():
                        found.append((row, tier, int(pages_of.argmax())))
                        break
        row, tier, at = (pa.array([f[i] for f in found], pa.int32()) for i in range(3))
        return pa.table({"part": left.column("part").take(row), "case": left.column("case").take(row), "tier": tier,
                         "page_no": right.column("page_no").take(at)})

    out = T.StructType([distinct.schema["part"], T.StructField("case", T.StringType()), T.StructField("tier", T.IntegerType()), texts.schema["page_no"]])
    met = p.groupBy(*block).cogroup(r.groupBy(*block)).applyInArrow(best, out)
    placed = met.groupBy("part", "case").agg(F.min(F.struct("tier", "page_no")).alias("at"))
    return cases.join(placed, ["part", "case"]).select("part", "record_id", "at.tier", "at.page_no")


def resolve_by_key(left: DataFrame, right: DataFrame, left_text: str, right_text: str, left_pattern: str, right_pattern: str) -> DataFrame:
    """Join on a key that each side's text holds, such as a document number."""
    keyed = lambda d, c, p: d.withColumn("doc_key", F.nullif(F.regexp_extract(c, p, 1), F.lit(""))).where(F.col("doc_key").isNotNull())
    return keyed(left, left_text, left_pattern).join(keyed(right, right_text, right_pattern), "doc_key")


def pair_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers for questions on (file, topic, number); failing that on (file, number) if that number has one answer only.

    Several answers for one (file, topic, number) count as their smallest; answers are reduced before both joins.
    """
    exact = answers.groupBy("file", "topic", "number").agg(F.min("answer").alias("exact_answer"))
    alone = (answers.groupBy("file", "number").agg(F.count("*").alias("_n"), F.min("answer").alias("only_answer"))
             .where(F.col("_n") == 1).drop("_n"))
    return (questions.join(exact, ["file", "topic", "number"], "left").join(alone, ["file", "number"], "left")
            .withColumn("answer", F.coalesce("exact_answer", "only_answer"))
            .withColumn("how", F.when(F.col("exact_answer").isNotNull(), "topic").when(F.col("only_answer").isNotNull(), "number"))
            .drop("exact_answer", "only_answer"))


def position_in_group(df: DataFrame, group: str, order: str, out: str, span: int = 10000) -> DataFrame:
    """Row number of each row in its group by an integer order; groups are numbered span by span and shifted, not in one task."""
    cut = df.withColumn("_span", F.floor(F.col(order) / span))
    before = Window.partitionBy(group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (cut.groupBy(group, "_span").agg(F.count("*").alias("_n"))
             .withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(group, "_span").orderBy(order)
    return (cut.join(ahead, [group, "_span"]).withColumn(out, F.row_number().over(inside) + F.col("_ahead")).drop("_span", "_ahead"))


def align_by_position(left: DataFrame, right: DataFrame, group: str, order: str) -> DataFrame:
    """Pair the i-th row of one side with the i-th of the other, in groups with equally many rows on both sides."""
    sizes = lambda d, name: d.groupBy(group).agg(F.count("*").alias(name))
    level = sizes(left, "_l").join(sizes(right, "_r"), group).where(F.col("_l") == F.col("_r")).select(group)
    numbered = lambda d: position_in_group(d, group, order, "place").drop(order)
    return numbered(left).join(level, group).join(numbered(right), [group, "place"])


def known_corrections(records: DataFrame, text: str, stored: str, patterns: list[tuple[str, str, str]], key: str) -> DataFrame:
    """Corrections from (pattern, stored letter, right letter): the first record per pattern, if its stored letter is as expected."""
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("expected"), F.lit(c).alias("right_letter")) for p, s, c in patterns])
    low = F.lower(F.col(text))
    hits = records.select(key, stored, F.explode(F.filter(rows, lambda r: F.contains(low, F.lower(r["pattern"])))).alias("p"))
    first = hits.groupBy("p").agg(F.min_by(F.struct(key, stored), F.col(key)).alias("row"))
    return first.where(F.col(f"row.{stored}") == F.col("p.expected")).select(f"row.{key}", "p.pattern", "p.expected", "p.right_letter")
