"""Comparison, gated patches, corrections and refreshes. `plan_*` functions only report; `apply_*` build the new snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import similarity as Sim
from scholia.functions import text as X
from scholia.session import stage_table

KEEP_VERDICTS = ["ok", "unclear", "wrong_page"]


def field_comparison(old: Column, new: Column) -> Column:
    """exact / ligatures (equal but for lost ligatures) / diff / missing (no reference text)."""
    a, b = X.strip(X.blank_if_null(old)), X.strip(X.blank_if_null(new))
    bag = lambda c: Sim.word_count_text(X.ligature_free_words(c))
    return F.when(b == "", "missing").when(a == b, "exact").when(bag(a) == bag(b), "ligatures").otherwise("diff")


def row_status(comparisons: list[Column], old_answer: Column, new_answer: Column, table_flag: Column) -> Column:
    answer = new_answer.isNotNull() & ~old_answer.eqNullSafe(new_answer)
    text = reduce(lambda x, y: x | y, [c == "diff" for c in comparisons])
    return F.when(answer, "answer_diff").when(text, "text_diff").when(table_flag, "table_format_flag").otherwise("ok")


def differing_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Array of (field, old, new) for the fields that differ after white space is collapsed."""
    rows = [F.struct(F.lit(name).alias("field"), X.collapse(X.blank_if_null(old)).alias("old"), X.collapse(X.blank_if_null(new)).alias("new"))
            for name, (old, new) in pairs.items()]
    return F.filter(F.array(*rows), lambda r: r["old"] != r["new"])


def reconstruction_status(old: Column, new: Column) -> Column:
    """clean if both records hold the same words, clean_ligatures if they do without ligature letters, else residual."""
    bag, loose = (lambda c: Sim.word_count_text(X.bag_words(c))), (lambda c: Sim.word_count_text(X.ligature_free_words(c)))
    return F.when(bag(old) == bag(new), "clean").when(loose(old) == loose(new), "clean_ligatures").otherwise("residual")


def long_enough(old: Column, new: Column, share: float = 0.7) -> Column:
    """Whether a changed replacement keeps at least `share` of the old number of words."""
    count = lambda c: F.size(F.filter(F.split(X.blank_if_null(c), "\\s+"), lambda w: w != ""))
    return count(new) >= share * F.greatest(count(old), F.lit(1))


def contained_shares(df: DataFrame, probe: str, ref: str, out: str, empty: float = 1.0) -> DataFrame:
    """Share of the probe's word bag inside the reference's, from each row alone and for texts of any length: both bags are sets of
    numbered words, which meet by hashing."""
    bags = F.struct(X.multiset(X.bag_words(F.col(probe))).alias("p"), X.multiset(X.bag_words(F.col(ref))).alias("r"))
    share = X.let(bags, lambda b: F.when(F.size(b["p"]) == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(b["p"], b["r"])) / F.size(b["p"])))
    # `inline` keeps later conditions on the share from making the bags anew.
    return df.select("*", F.inline(F.array(F.struct(share.alias(out)))))


def plan_gated_patches(fields: DataFrame, floor: float = 0.85) -> DataFrame:
    """Decide per (id, field, old, new): skip empty or unchanged texts, never trade formatting for plain text, accept a clean
    prefix or a word overlap of at least `floor`."""
    old, new = X.blank_if_null(F.col("old")), X.strip(X.blank_if_null(F.col("new")))
    shaped = X.has_table(old) | X.has_list(old, numbered=True)
    rated = contained_shares(fields, "old", "new", "overlap")
    reason = (F.when(new == "", "empty").when(new == X.strip(old), "unchanged")
              .when(shaped & ~(X.has_table(new) | X.has_list(new)), "would_lose_format")
              .when(X.strip(old).startswith(new), "clean_prefix")
              .when(F.col("overlap") >= floor, "overlap").otherwise("low_overlap"))
    return (rated.select("id", "field", "old", new.alias("new"), "overlap", reason.alias("reason"))
            .withColumn("action", F.when(F.col("reason").isin("clean_prefix", "overlap"), "patch").otherwise("skip")))


def wanted_corrections(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict").isNotNull() & ~F.col("verdict").isin(KEEP_VERDICTS) & (X.blank_if_null(F.col("new_value")) != ""))


def plan_corrections(bank: DataFrame, corrections: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, before, after, found) per correction; nothing is changed."""
    before = reduce(lambda chain, f: chain.when(F.col("field") == f, F.col(f)), fields, F)
    rows = corrections.join(bank.select(key, *fields, F.lit(True).alias("found")), key, "left")
    return rows.select(key, "field", before.alias("before"), F.col("new_value").alias("after"), F.coalesce("found", F.lit(False)).alias("found"))


def apply_corrections(bank: DataFrame, corrections: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """New snapshot of the bank: corrected fields replaced, all else kept. Of several corrections of a field, the last by `order` wins."""
    value = F.col("new_value")
    pick = lambda f: F.max_by(F.when(F.col("field") == f, value), F.when(F.col("field") == f, F.col(order)))
    wide = corrections.groupBy(key).agg(*[pick(f).alias(f"_new_{f}") for f in fields])
    return (bank.join(wide, key, "left").withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).drop(*[f"_new_{f}" for f in fields]))


def verify_corrections(snapshot: DataFrame, corrections: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Read every corrected field back: verified if it holds the new value."""
    planned = plan_corrections(snapshot, corrections, key, fields)
    return planned.select(key, "field", F.coalesce(F.col("before") == F.col("after"), F.lit(False)).alias("verified"))


def implausible_corrections(corrections: DataFrame) -> DataFrame:
    """Flag option_bleed fixes with under 80 % of their words in the original, and formatting fixes that keep under 50 % of its words.

    Takes (id, field, verdict, original, new_value).
    """
    words = lambda c: F.array_distinct(X.words(c, "[a-z]{4,}"))
    sides = F.struct(words(F.col("original")).alias("o"), words(F.col("new_value")).alias("n"))
    shared = lambda s: F.size(F.array_intersect(s["o"], s["n"]))
    kept = X.let(sides, lambda s: F.when(F.col("verdict") == "option_bleed", shared(s) / F.greatest(F.size(s["n"]), F.lit(1)))
                 .otherwise(shared(s) / F.greatest(F.size(s["o"]), F.lit(1))))
    rows = wanted_corrections(corrections).select("id", "field", "verdict", F.inline(F.array(F.struct(kept.alias("kept")))))
    return rows.withColumn("flagged", ((F.col("verdict") == "option_bleed") & (F.col("kept") < 0.8))
                           | ((F.col("verdict") == "formatting_missing") & (F.col("kept") < 0.5)))


def apply_pattern_patches(bank: DataFrame, text: str, patches: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """Set fields of the records whose text matches a case-blind LIKE pattern; later patches win. Applying twice changes nothing more
    as long as the patched fields are not the matched one."""
    targets = sorted({f for _, values in patches for f in values})

    def patched(field: str) -> Column:
        chain = F
        for pattern, values in reversed(patches):
            if field in values:
                chain = chain.when(F.col(text).ilike(pattern), F.lit(values[field]))
        return chain.otherwise(F.col(field))

    return bank.withColumns({f: patched(f) for f in targets})


def plan_refresh(matches: DataFrame, probes: DataFrame, refs: DataFrame, length: int = 120, floor: float = 0.40) -> DataFrame:
    """What linked reference texts mean for a stored column: no_match / empty / low_similarity / same / update.

    Takes matches (probe_id, ref_id), probes (probe_id, text, stored_text) and refs (ref_id, text, fresh_text).
    """
    rows = (probes.select("probe_id", F.col("text").alias("p_text"), "stored_text").join(matches.select("probe_id", "ref_id"), "probe_id", "left")
            .join(refs.select("ref_id", F.col("text").alias("r_text"), "fresh_text"), "ref_id", "left"))
    same = X.prefix_key(F.col("stored_text"), length) == X.prefix_key(F.col("fresh_text"), length)
    status = (F.when(F.col("ref_id").isNull(), "no_match").when(X.strip(X.blank_if_null(F.col("fresh_text"))) == "", "empty")
              .when(Sim.word_set_similarity(F.col("p_text"), F.col("r_text")) < floor, "low_similarity").when(same, "same").otherwise("update"))
    return rows.select("probe_id", "ref_id", "fresh_text", F.inline(F.array(F.struct(status.alias("status")))))


def match_summary(pairs: DataFrame, by: str) -> DataFrame:
    """Matched, unmatched, option and answer agreement per source, in one aggregate.

    Takes (by, ref_id, option_diffs, old_answer, new_answer).
    """
    hit = F.col("ref_id").isNotNull()
    answer = hit & F.col("new_answer").isNotNull()
    same = F.col("old_answer").eqNullSafe(F.col("new_answer"))
    return pairs.groupBy(by).agg(
        F.count_if(hit).alias("matched"), F.count_if(~hit).alias("no_match"),
        F.count_if(hit & (F.col("option_diffs") == 0)).alias("options_ok"), F.count_if(hit & (F.col("option_diffs") > 0)).alias("options_wrong"),
        F.count_if(answer & same).alias("answer_ok"), F.count_if(answer & ~same).alias("answer_wrong"),
        F.count_if(hit & F.col("new_answer").isNull()).alias("answer_skipped"))


def above_similarity(rows: DataFrame, score: str, floor: float) -> tuple[DataFrame, DataFrame]:
    """Rows at or above the floor, and one row counting kept and skipped."""
    keep = F.coalesce(F.col(score) >= floor, F.lit(False))
    return rows.where(keep), rows.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("skipped"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, synced: list[str]) -> DataFrame:
    """Snapshot after an upsert on a natural key: new keys are added, `synced` columns follow the incoming rows,
    of several for one key the one that sorts last by them."""
    new = (incoming.groupBy(key).agg(F.max(F.struct(*synced)).alias("_new"))
           .select(key, *[F.col(f"_new.{c}").alias(f"_in_{c}") for c in synced], F.lit(True).alias("_seen")))
    rows = existing.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    return (rows.withColumns({c: F.coalesce(f"_in_{c}", c) for c in synced})
            .withColumn("change", F.when(F.col("_old").isNull(), "inserted").when(F.col("_seen").isNull(), "kept").otherwise("synced"))
            .drop(*[f"_in_{c}" for c in synced], "_old", "_seen"))


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is new, one per key; appending them seeds a table without touching what is there."""
    from scholia.operators.grouping import keep_first
    fresh = incoming.join(existing.select(key), key, "left_anti")
    order = next((c for c in fresh.columns if c != key), None)
    return keep_first(fresh, [key], order).select(*incoming.columns) if order else fresh.distinct()


def nested_upsert(pages: DataFrame, updates: DataFrame, keys: list[str], order: list[str] = []) -> DataFrame:
    """Replace type and items of the pages that have an update; pages without one stay, updates without a page are ignored.

    Of several updates of one page the last by `order` counts, and among equal ones the greatest by type and items.
    """
    last = F.max(F.struct(*order, F.col("page_type").alias("_type"), F.col("items").alias("_items"))).alias("_new")
    new = updates.groupBy(*keys).agg(last).select(*keys, "_new._type", "_new._items")
    return (pages.join(new, keys, "left").withColumns({"page_type": F.coalesce("_type", "page_type"), "items": F.coalesce("_items", "items")})
            .drop("_type", "_items"))


def cache_validity(pages: DataFrame, key: str, types: list[str], answer: str) -> DataFrame:
    """Whether a cache holds anything: a page of the wanted types with an item, or a row with an answer."""
    items = F.col("page_type").isin(types) & (F.size("items") > 0)
    return pages.groupBy(key).agg(F.bool_or(F.coalesce(items, F.lit(False)) | F.col(answer).isNotNull()).alias("valid"))
