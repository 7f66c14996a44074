"""Complete items from paged text: an ordered state machine over marked lines whose state is carried over pages.

A line can be a header, an option mark, the mark of the explanation, or plain. Plain lines change nothing, so a page is cut at its marked
lines only. What a stretch of pieces does to the state is a function of the states, written as a string: its i-th character is the state
that state i becomes. Functions compose by `translate`, so stretches are summed up in two levels of spans, the state before each stretch
is found from the spans' summaries, and no task walks through a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia import fixed_values as V
from scholia.functions import text as X
from scholia.session import stage_table

# 0 before any header, 1 stem, 2 to 4 options, 5 explanation, 6 options out of order (left at the next header only).
STATES = "0123456"
STEPS = {"header": "1111111", "A": "0223456", "B": "0133456", "C": "0164456", "explanation": "0155556"}
STRETCH = 256  # pieces of a stretch
SPAN = 1000  # page numbers of a span; spans of as many spans come above


def _after(state: Column, kind: Column) -> Column:
    """Each character of `state` moved on by a piece of `kind`."""
    steps = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])
    return F.call_function("translate", state, F.lit(STATES), F.coalesce(steps[kind], F.lit(STATES)))


def pieces(text: Column, marks: dict[str, str] = V.ITEM_MARKS) -> Column:
    """The text cut before each marked line: an array of (kind, text); `kind` is null for what precedes the first mark."""
    # Few texts have either of the two characters, and finding that out is cheap.
    marked = F.when(F.contains(text, F.lit("\u0001")), F.translate(text, "\u0001", "")).otherwise(X.blank_if_null(text))
    lines = X.let(marked, lambda t: F.when(F.contains(t, F.lit("\r")), F.regexp_replace(t, "\r\n?", "\n")).otherwise(t))
    cut = F.split(F.regexp_replace(lines, f"(?md)^(?=(?:{'|'.join(marks.values())}))", "\u0001"), "\u0001")
    kind = lambda p: F.coalesce(*[F.when(p.rlike(f"(?md)\\A(?:{m})"), F.lit(k)) for k, m in marks.items()])
    # A text that starts with a mark has nothing before it.
    held = X.let(cut, lambda c: F.when((F.size(c) > 1) & (F.get(c, F.lit(0)) == ""), F.slice(c, 2, X.REST)).otherwise(c))
    return F.transform(held, lambda p: F.struct(kind(p).alias("kind"), p.alias("text")))


def _sum_up(units: DataFrame, doc: str, span: Column, order: list[str]) -> DataFrame:
    """(doc, span, members): the stretches or spans of each span, in order, with `move` and `opened` of them all together."""
    members = F.sort_array(F.collect_list(F.struct(*order, "move", "opened")))
    return (units.groupBy(doc, span.alias("span")).agg(members.alias("members"))
            .withColumn("move", F.aggregate("members", F.lit(STATES), lambda m, u: F.call_function("translate", m, F.lit(STATES), u["move"])))
            .withColumn("opened", F.try_element_at(F.filter(F.transform("members", lambda u: u["opened"]), lambda o: o.isNotNull()), F.lit(-1))))


def _spread(spans: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """(doc, order, state, open) before each member, from `state` and `open` before its span."""
    opened = spans.schema["open"].dataType
    kept = F.struct(F.col("state").alias("state"), F.col("open").alias("open"),
                    F.array().cast(f"array<struct<{', '.join(f'{c}:{spans.schema["members"].dataType.elementType[c].dataType.simpleString()}' for c in order)},"
                                   f"state:string,open:{opened.simpleString()}>>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        here = F.struct(*[u[c].alias(c) for c in order], acc["state"].alias("state"), acc["open"].alias("open"))
        return F.struct(F.call_function("translate", acc["state"], F.lit(STATES), u["move"]).alias("state"),
                        F.coalesce(u["opened"], acc["open"]).alias("open"), F.concat(acc["out"], F.array(here)).alias("out"))

    return spans.select(doc, F.inline(F.aggregate("members", kept, step)["out"]))


def carried(units: DataFrame, doc: str, page: str = "page_no", part: str = "stretch") -> DataFrame:
    """State and open header before each stretch, from (doc, page, part, move, opened)."""
    low = _sum_up(units, doc, F.floor(F.col(page) / SPAN), [page, part])
    high = _sum_up(low, doc, F.floor(F.col("span") / SPAN), ["span"])
    top = _sum_up(high, doc, F.lit(0), ["span"])
    place = units.schema["opened"].dataType
    start = top.withColumns({"state": F.lit(STATES[0]), "open": F.lit(None).cast(place)})
    for spans in (high, low):
        before = _spread(start, doc, ["span"])
        start = spans.drop("move", "opened").join(before, [doc, "span"])
    return _spread(start, doc, [page, part])


def extract_items(pages: DataFrame, doc: str = "doc", marks: dict[str, str] = V.ITEM_MARKS, trailing: str = V.TRAILING_REFERENCE,
                  min_stem: int = 10, min_option: int = 2) -> DataFrame:
    """Items of each document: doc, number, stem, option_a to option_c, explanation, first_page, last_page.

    Takes (doc, page_no, text). Pages are read in order and an item may go over many; pages that share a number are read in the
    order of their text, and rows without document or number are left out. Only the first mark of each kind counts, in the order A, B,
    C, explanation; later ones are plain text. Items without a stem of `min_stem` and options of `min_option` characters are dropped,
    a missing explanation is empty, and what follows the trailing reference is cut off.
    """
    whole = (pages.where(F.col(doc).isNotNull() & F.col("page_no").isNotNull()).groupBy(doc, "page_no")
             .agg(F.array_join(F.sort_array(F.collect_list(X.blank_if_null(F.col("text")))), "\n").alias("text")))
    cut = whole.withColumn("pieces", pieces(F.col("text"), marks)).select(
        doc, "page_no", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("pieces"), F.lit(STRETCH)),
                                                 lambda i: F.slice("pieces", i, STRETCH))).alias("stretch", "pieces"))
    headers = F.filter(F.transform("pieces", lambda p, i: F.when(p["kind"] == "header", F.struct(F.col("page_no"), F.col("stretch"), i.alias("at")))),
                       lambda h: h.isNotNull())
    move = F.aggregate("pieces", F.lit(STATES), lambda m, p: _after(m, p["kind"]))
    # Read for the spans, at each of their levels, and for the pieces; so the text is cut once.
    cut = stage_table(cut.withColumns({"move": move, "opened": F.try_element_at(headers, F.lit(-1))}))
    units = cut.select(doc, "page_no", "stretch", "move", "opened")
    place = units.schema["opened"].dataType.simpleString()
    known = cut.drop("move", "opened").join(carried(units, doc), [doc, "page_no", "stretch"])

    first = F.struct(F.col("state").alias("state"), F.col("open").alias("open"), F.lit(0).alias("at"),
                     F.array().cast(f"array<struct<open:{place},state:string,at:int,text:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        state = _after(acc["state"], p["kind"])
        is_header = F.coalesce(p["kind"] == "header", F.lit(False))
        opened = F.when(is_header, F.struct(F.col("page_no"), F.col("stretch"), acc["at"].alias("at"))).otherwise(acc["open"])
        # A mark that moves the state is dropped from the text, any other is part of it.
        moved = p["kind"].isNotNull() & (is_header | (state != acc["state"]))
        text = F.when(moved & ~is_header, F.regexp_replace(p["text"], f"(?md)\\A(?:{'|'.join(m for k, m in marks.items() if k != 'header')})", "")).otherwise(p["text"])
        here = F.struct(opened.alias("open"), state.alias("state"), acc["at"].alias("at"), text.alias("text"))
        return F.struct(state.alias("state"), opened.alias("open"), (acc["at"] + 1).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    rows = (known.select(doc, "page_no", "stretch", F.inline(F.aggregate("pieces", first, step)["out"]))
            .where(F.col("open").isNotNull()))
    items = rows.groupBy(doc, "open").agg(F.sort_array(F.collect_list(F.struct("page_no", "stretch", "at", "state", "text"))).alias("parts"))
    of = lambda state: F.array_join(F.transform(F.filter("parts", lambda p: p["state"] == state), lambda p: p["text"]), "\n")
    head = of("1")
    body = F.regexp_replace(head, f"(?md)\\A(?:{marks['header']})[^\n]*\n?", "")
    fields = {"stem": X.tidy_lines(F.regexp_replace(body, f"(?md)^{V.ITEM_ID_LINE}\n?", "")),
              **{f"option_{o}": X.tidy_lines(of(s)) for o, s in zip("abc", "234")},
              "explanation": X.tidy_lines(F.get(F.split(of("5"), trailing, 2), F.lit(0)))}
    found = items.select(
        doc, F.regexp_extract(head, "#(\\d+)", 1).cast("long").alias("number"), *[c.alias(n) for n, c in fields.items()],
        F.get("parts", F.lit(0))["page_no"].alias("first_page"), F.element_at("parts", -1)["page_no"].alias("last_page"))
    enough = F.length("stem") >= min_stem
    for o in "abc":
        enough &= F.length(f"option_{o}") >= min_option
    return found.where(enough)
