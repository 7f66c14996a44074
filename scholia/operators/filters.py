"""Row filters and record checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia import fixed_values as V
from scholia.functions import text as X



def matching(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters; None and "All" mean no filter, other values compare in lower case."""
    for name, value in wanted.items():
        if value is not None and value != "All":
            df = df.where(F.col(name) == value.lower())
    return df


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def in_given_order(wanted: DataFrame, df: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Rows for the wanted keys with their positions; keys without a row drop out. `wanted` is (key, position)."""
    return wanted.join(df, key).orderBy(position)


def pick_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of a caller's id list, in list order; an id that is listed again keeps its first place."""
    places = {i: pos for pos, i in reversed(list(enumerate(ids)))}
    wanted = df.sparkSession.createDataFrame([(i, pos) for i, pos in places.items()], T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("pos", T.LongType())]))
    return in_given_order(wanted, df, key)


def _name_only(options: list[Column], pattern: str) -> Column:
    """All given options are bare names, and at least one is given."""
    filled = F.filter(F.array(*[X.strip(X.blank_if_null(o)) for o in options]), lambda o: o != "")
    return (F.size(filled) > 0) & F.forall(filled, lambda o: o.rlike("(?i)" + pattern))


def is_incomplete(stem: Column, options: list[Column]) -> Column:
    """An exhibit is announced but no table is there, or the options are bare names of things a table would describe."""
    announced = stem.rlike("(?i)" + V.EXHIBIT_MENTION) & ~stem.contains("|")
    return announced | (_name_only(options, V.NAME_ONLY_OPTION) & stem.rlike("(?i)" + V.DATA_WORD))


def is_truly_incomplete(stem: Column, options: list[Column]) -> Column:
    """Stricter: the text ends on the exhibit reference or resumes with a colon, or all options are bare names."""
    text = X.strip(stem)
    after = X.strip(F.regexp_extract(text, "(?is)" + V.EXHIBIT_MENTION + "(.*)$", 1))
    announced = text.rlike("(?i)" + V.EXHIBIT_MENTION)
    ends = text.rlike("(?i)" + V.EXHIBIT_NOUN + "[:.]?\\s*$")
    cut = announced & (after.startswith(":") | (after == ""))
    return ~text.contains("|") & (ends | _name_only(options, V.NAME_ONLY_OPTION) | cut)


def is_truly_missing(stem: Column, options: list[Column]) -> Column:
    """The exhibit reference runs straight into the question, or all options are bare names."""
    return ~stem.contains("|") & (stem.rlike("(?i)" + V.EXHIBIT_NOUN + V.EXHIBIT_FLOW)
                                  | _name_only(options, V.NAME_ONLY_OPTION_WIDE))


def completeness(stem: Column, explanation: Column, shortest: int = 50) -> Column:
    """ok / table / explanation / both: what a record lacks."""
    table = stem.rlike("(?i)" + V.EXHIBIT_FLOW_WIDE) & ~stem.contains("|")
    short = F.length(X.strip(X.blank_if_null(explanation))) < shortest
    return F.when(table & short, "both").when(table, "table").when(short, "explanation").otherwise("ok")


def reject_reason(stem: Column, options: list[Column], stored: Column, explanation: Column, min_stem: int = 10,
                  min_option: int = 2, min_explanation: int = 15) -> Column:
    """First reason to refuse a record, or null if it is valid."""
    short_option = reduce(lambda a, b: a | b, [F.length(X.strip(X.blank_if_null(o))) < min_option for o in options])
    return (F.when(~F.coalesce(stored, F.lit("")).isin("A", "B", "C"), "letter")
            .when(F.length(X.strip(X.blank_if_null(stem))) < min_stem, "stem")
            .when(short_option, "option")
            .when(F.length(X.strip(X.blank_if_null(explanation))) < min_explanation, "explanation"))


def login_reject_reason(name: Column, suffix: Column) -> Column:
    """Why a login name and its two-letter suffix are refused, or null."""
    return (F.when(F.length(name) < 3, "too short").when(F.length(name) > 30, "too long")
            .when(~name.rlike("^[A-Za-z0-9_À-ÿ]+$"), "characters")
            .when(F.length(suffix) != 2, "suffix length")
            .when(~suffix.rlike("^[A-Za-zÀ-ÿ]{2}$"), "suffix characters"))


def login_key(name: Column, suffix: Column) -> Column:
    return F.concat(F.lower(name), F.lower(suffix))


def has_all_phrases(text: Column, phrases: list[str]) -> Column:
    low = F.lower(X.blank_if_null(text))
    return F.forall(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(low, p))


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """First listed phrase inside the text, or null. The list is compiled into the plan."""
    low = F.lower(X.blank_if_null(text))
    hits = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low, F.lower(p)))
    return F.get(hits, F.lit(0))
