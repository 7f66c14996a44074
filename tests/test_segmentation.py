"""Item extraction against a plain walk over lines, with short stretches and spans so that state is carried over all of them."""

import random
import re

import pytest

from scholia.operators import segmentation as Seg

MARKS = [("header", r"[ \t]*Question\s+#\d+\s+of\s+\d+"), ("A", r"[ \t]*A\)(?=\s|$)"), ("B", r"[ \t]*B\)(?=\s|$)"), ("C", r"[ \t]*C\)(?=\s|$)"),
         ("explanation", r"[ \t]*(?i:explanation)[ \t]*$")]


def tidy(lines):
    return re.sub("  +", " ", re.sub(r"\s*\n\s*", " ", "\n".join(lines).replace("\xad", "")).strip())


def plain_items(pages):
    books = {}
    for doc, no, text in pages:
        if doc is not None and no is not None:
            books.setdefault(doc, {}).setdefault(no, []).append(text or "")
    out = []
    for doc, by_no in books.items():
        item, state = None, None
        items = []
        for no in sorted(by_no):
            for line in re.sub("\r\n?", "\n", "\n".join(sorted(by_no[no]))).split("\n"):
                kind = next((k for k, p in MARKS if re.match(p, line)), None)
                rest = re.sub("^(?:" + "|".join(p for k, p in MARKS if k != "header") + ")", "", line)
                if kind == "header":
                    item, state = {"n": int(re.search(r"#(\d+)", line)[1]), "parts": {k: [] for k in ("stem", "A", "B", "C", "explanation")}, "first": no}, "stem"
                    items.append(item)
                    item["last"] = no
                    continue
                if item is None:
                    continue
                item["last"] = no
                moves = {("stem", "A"): "A", ("A", "B"): "B", ("B", "C"): "C", ("A", "C"): "broken",
                         **{(s, "explanation"): "explanation" for s in "ABC"}}
                if (state, kind) in moves:
                    state, line = moves[state, kind], rest
                if state != "broken":
                    item["parts"][state].append(line)
        for item in items:
            p = item["parts"]
            stem = [x for x in p["stem"] if not re.match(r"[ \t]*Question\s+ID:\s*\d+", x)]
            row = (doc, item["n"], tidy(stem), tidy(p["A"]), tidy(p["B"]), tidy(p["C"]), tidy(re.split(r"\(Module\s+\d+", "\n".join(p["explanation"]))[0].split("\n")),
                   item["first"], item["last"])
            if len(row[2]) >= 10 and min(map(len, row[3:6])) >= 2:
                out.append(row)
    return sorted(out)


def book(seed):
    pick = random.Random(seed)
    lines = []
    for n in range(40):
        some = ["A) alpha beta", "B) gamma", " C) delta\xad  x", "Explanation", "EXPLANATION  ", "A)", "B) again", "C) again", "plain words here", "", "  more of it",
                "Question ID: 77", "(Module 3.1, LOS 2.b)", "not A) marked", "A)x is no mark"]
        if pick.random() < .7:
            lines += [f"Question #{n} of 40", "Question ID: 123", "What is the right answer to this", pick.choice(["", "and that"]), "A) first one", *[""] * pick.randint(0, 3),
                      "B) second", "C) third", "of them", "Explanation", "Because", "of this (Module 3.1, LOS 2.b)", "page foot"][:pick.choice([13, 13, 13, 8, 5])]
        lines += [pick.choice(some) for _ in range(pick.randint(0, 4))]
    pages, no = [], pick.randint(-3, 5)
    while lines:
        size = pick.choice([1, 1, 2, 5, 30])
        pages.append((no, pick.choice(["\n", "\r\n"]).join(lines[:size])))
        lines, no = lines[size:], no + pick.choice([1, 1, 1, 7])
    return pages


@pytest.mark.parametrize("stretch,span", [(256, 1000), (3, 2)])
def test_items_of_whole_books(spark, monkeypatch, stretch, span):
    monkeypatch.setattr(Seg, "STRETCH", stretch)
    monkeypatch.setattr(Seg, "SPAN", span)
    pages = [(f"book{s}", no, text) for s in range(4) for no, text in book(s)]
    pages += [("one", 1, "\n".join(t for _, t in book(9))), ("two", 1, "b"), ("two", 1, "Question #1 of 2\nA long enough stem\nA) aa\nB) bb\nC) cc"), ("none", 3, "A) x"),
              ("null", 1, None), (None, 1, "Question #1 of 2"), ("null", None, "Question #1 of 2")]
    got = Seg.extract_items(spark.createDataFrame(pages, "doc string, page_no long, text string").repartition(5)).collect()
    want = plain_items(pages)
    assert len(want) > 30 and any(r[7] != r[8] for r in want)
    assert sorted(map(tuple, got)) == want


def test_no_pages(spark):
    assert Seg.extract_items(spark.createDataFrame([], "doc string, page_no long, text string")).count() == 0


def test_pages_are_cut_once(spark):
    """The spans, on each of their levels, and the pieces read the same cut pages instead of cutting them again."""
    pages = spark.createDataFrame([("d", 1, "Question #1 of 2\nWhat is it?\r\nA) this")], "doc string, page_no long, text string")
    plan = Seg.extract_items(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
