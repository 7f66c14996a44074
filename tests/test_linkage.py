"""Linkage against brute force on small fixtures, with copies, ties and frequent words."""

import difflib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from scholia.functions import similarity as Sim
from scholia.functions import text as X
from scholia.operators import linkage as L

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa the the the of of and".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpora(seed=3, n_probes=25, n_refs=40):
    rng = random.Random(seed)
    refs = {i: sentence(rng, rng.randint(3, 14)) for i in range(n_refs)}
    refs[n_refs] = refs[0]  # a copy
    probes = {}
    for i in range(n_probes):
        base = refs[rng.randrange(n_refs)].split()
        if rng.random() < 0.6:
            base[rng.randrange(len(base))] = rng.choice(WORDS)
        probes[i] = " ".join(base) if rng.random() < 0.8 else sentence(rng, 6)
    probes[n_probes] = probes[0]
    return probes, refs


def bag(text):
    return Counter(re.findall(r"[a-z0-9]{3,}", text.lower()))


def score(p, r):
    total = sum(p.values())
    return sum((p & r).values()) / total if total else 0.0


def frames(spark, probes, refs):
    p = spark.createDataFrame([(0, i, t) for i, t in probes.items()], "part int, probe_id int, text string")
    r = spark.createDataFrame([(0, i, t) for i, t in refs.items()], "part int, ref_id int, text string")
    return p, r


def test_bag_matches(spark):
    probes, refs = corpora()
    p, r = frames(spark, probes, refs)
    words = X.bag_words(F.col("text")).alias("words")
    got = {x.probe_id: (x.ref_id, x.score) for x in L.bag_matches(p.select("part", "probe_id", words), r.select("part", "ref_id", words)).collect()}
    for i, text in probes.items():
        best = max(((score(bag(text), bag(t)), -j) for j, t in refs.items()))
        want = (-best[1], best[0]) if best[0] >= 0.5 else (None, None)
        assert got[i] == want


def test_sliced_join_equals_plain(spark):
    probes, refs = corpora(5)
    p, r = frames(spark, probes, refs)
    words = X.bag_words(F.col("text")).alias("words")
    args = (p.select("part", "probe_id", words), r.select("part", "ref_id", words), 0.3)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(L.overlap_pairs(*args)) == rows(L.overlap_pairs(*args, slice_rows=2))


def test_overlap_of_larger(spark):
    probes, refs = corpora(7)
    p, r = frames(spark, probes, refs)
    words = X.words(F.col("text"), "[a-z]+").alias("words")
    pairs = L.overlap_pairs(p.select("part", "probe_id", words), r.select("part", "ref_id", words), 0.6, of_larger=True, repeats=False)
    got = {(x.probe_id, x.ref_id): x.score for x in pairs.collect()}
    sets = {j: frozenset(t.split()) for j, t in refs.items()}
    lowest = {s: min(j for j in sets if sets[j] == s) for s in sets.values()}
    want = {}
    for i, text in probes.items():
        a = set(text.split())
        for s, j in lowest.items():
            x = len(a & s) / max(len(a), len(s))
            if x >= 0.6:
                want[(i, j)] = x
    assert got == want


def form(t):
    return re.sub(r" +", " ", re.sub(r"[^a-z0-9 ]", " ", t.lower())).strip()


def grams(t):
    w = form(t).split()
    return {" ".join(w[i:i + 4]) for i in range(len(w) - 3)}


def test_gram_matches(spark):
    probes, refs = corpora(11)
    p, r = frames(spark, probes, refs)
    got = {x.probe_id: (x.status, x.ref_id if x.status == "matched" else None) for x in L.gram_matches(p, r).collect()}
    for i, text in probes.items():
        rated = sorted(((difflib.SequenceMatcher(None, form(text), form(t)).ratio(), -j) for j, t in refs.items() if grams(text) & grams(t)), reverse=True)
        best = rated[0][0] if rated else 0.0
        second = rated[1][0] if len(rated) > 1 else 0.0
        if best < 0.78:
            want = ("no_match", None)
        else:
            want = ("ambiguous", None) if best - second < 0.05 else ("matched", -rated[0][1])
        assert got[i] == want, i


def test_fuzzy_matches(spark):
    rng = random.Random(2)
    refs = {i: sentence(rng, rng.randint(2, 20)) for i in range(30)}
    refs[30] = "accrued interest"  # shorter than the opening window
    probes = {i: refs[i] + (" tail" if i % 2 else "") for i in range(20)}
    probes[20], probes[21], probes[22] = "xx " + refs[3], "short", "accrued interest etc"
    p, r = frames(spark, probes, refs)
    got = {x.probe_id: (x.status, x.ref_id if x.status == "matched" else None) for x in L.fuzzy_matches(p, r).collect()}
    for i, text in probes.items():
        a, hits = form(text), []
        for j, t in refs.items():
            b = form(t)
            if len(a) < 20 or not b:
                continue
            if a[:60] == b[:60]:
                hits.append((1.0, -j))
            elif a[:20] in b[:80] or b[:20] in a[:80]:
                x = difflib.SequenceMatcher(None, a[:150], b[:150]).ratio()
                if x >= 0.82:
                    hits.append((x, -j))
        hits.sort(reverse=True)
        if not hits:
            want = ("no_match", None)
        elif len(hits) > 1 and hits[0][0] - hits[1][0] < 0.05:
            want = ("ambiguous", None)
        else:
            want = ("matched", -hits[0][1])
        assert got[i] == want, (i, text)


def test_gated_matches(spark):
    rng = random.Random(8)
    refs = {i: [sentence(rng, 8), *(sentence(rng, 4) for _ in range(3))] for i in range(15)}
    refs[15] = refs[2][:]  # same words, options swapped
    refs[15][1], refs[15][2] = refs[15][2], refs[15][1]
    probes = {i: refs[i][:] for i in range(8)}
    probes[1][1] += " x"
    probes[3][2] = "unlike anything else here"
    probes[8] = ["of", "a", "b", "c"]
    probes[9] = [sentence(rng, 9), "kappa", "iota", "eta"]
    row = lambda i, v: (0, i, " ".join(v), *v[1:])
    p = spark.createDataFrame([row(i, v) for i, v in probes.items()], "part int, probe_id int, text string, a string, b string, c string")
    r = spark.createDataFrame([row(i, v) for i, v in refs.items()], "part int, ref_id int, text string, a string, b string, c string")
    words = lambda d: d.withColumn("words", X.bag_words(F.col("text")))
    got = {x.probe_id: (x.status, x.ref_id) for x in L.gated_matches(words(p), words(r)).collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio()
    for i, v in probes.items():
        b = bag(" ".join(v))
        want = ("no_match", None)
        if sum(b.values()) >= 3:
            rated = sorted(((score(b, bag(" ".join(t))), -j) for j, t in refs.items()), reverse=True)
            top = rated[0][0]
            near = [-j for s, j in rated if s > 0 and s >= 0.9 * top]
            good = [j for j in near if min(ratio(v[k], refs[j][k]) for k in (1, 2, 3)) >= 0.8]
            if good:
                want = ("matched", good[0])
            elif top >= 0.85:
                want = ("low_confidence", near[0])
        assert got[i] == want, i


def test_containment_pairs(spark):
    texts = {1: "the cat sat on the mat", 2: "a catalogue of mats", 3: "nothing"}
    needles = {1: "cat sat on", 2: "cat", 3: "mats", 4: "at on the", 5: "zzz qqq www", 6: "no"}
    n = spark.createDataFrame([(0, i, t) for i, t in needles.items()], "part int, needle_id int, needle string")
    t = spark.createDataFrame([(0, i, x) for i, x in texts.items()], "part int, text_id int, text string")
    got = {(x.needle_id, x.text_id) for x in L.containment_pairs(n, t).collect()}
    assert got == {(i, j) for i, a in needles.items() for j, b in texts.items() if a in b and len(a) >= 3}
    assert got == {(x.needle_id, x.text_id) for x in L.containment_pairs(n, t, slice_rows=1).collect()}


def test_prefix_matches_prefer_similar_options(spark):
    text = "w" * 130
    p = spark.createDataFrame([(1, text, "red apple", "b", "c"), (2, "other", "x", "y", "z")], "probe_id int, text string, a string, b string, c string")
    r = spark.createDataFrame([(1, text, "green pear", "b", "c"), (2, text, "red apple", "b", "c"), (3, "w" * 70 + "v", "red apple", "b", "c")],
                              "ref_id int, text string, a string, b string, c string")
    assert [tuple(x) for x in L.prefix_matches(p, r).select("probe_id", "tier", "ref_id").collect()] == [(1, 120, 2)]


def test_prefix_matches_find_the_most_similar_options_of_many(spark):
    rng = random.Random(21)
    opening = ["w" * 130, "v" * 130]
    pick = lambda: sentence(rng, rng.randint(0, 5))
    refs = [(i, rng.choice(opening), pick(), pick(), pick()) for i in range(60)] + [(60 + i, "u" * 130, "", "", "") for i in range(3)]
    probes = [(i, rng.choice(opening), *(rng.choice(refs)[2:] if rng.random() < .4 else (pick(), pick(), pick()))) for i in range(50)]
    probes += [(50, "u" * 130, "alpha", "", ""), (51, opening[0], "", "", ""), (52, opening[1], "zzz", "", "qqq")]
    p = spark.createDataFrame(probes, "probe_id int, text string, a string, b string, c string")
    r = spark.createDataFrame(refs, "ref_id int, text string, a string, b string, c string")
    def rate(x, y):
        total = 0.0
        for a, b in zip(x[2:], y[2:]):
            a, b = set(a.split()), set(b.split())
            total += len(a & b) / max(len(a), len(b)) if a and b else 0.0
        return total / 3.0
    got = {x.probe_id: x.ref_id for x in L.prefix_matches(p, r).collect()}
    want = {x[0]: min(((-rate(x, y), y[0]) for y in refs if y[1] == x[1]))[1] for x in probes}
    assert got == want


def test_sequence_ratio(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("same", "same"), ("x" * 250 + "abc", "abc" + "x" * 250)]
    got = [x.r for x in spark.createDataFrame(pairs, "a string, b string").select(Sim.sequence_ratio("a", "b").alias("r")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_alignment_skips_unequal_groups(spark):
    l = spark.createDataFrame([("g", 1, "q1"), ("g", 5, "q2"), ("h", 1, "q3")], "g string, o int, q string")
    r = spark.createDataFrame([("g", 2, "a1"), ("g", 9, "a2"), ("h", 1, "a3"), ("h", 2, "a4")], "g string, o int, a string")
    got = {(x.g, x.q, x.a) for x in L.align_by_position(l, r, "g", "o").collect()}
    assert got == {("g", "q1", "a1"), ("g", "q2", "a2")}


def test_word_hits_equal_every_record_against_every_page(spark):
    pick = random.Random(5)
    voc = ["a", "of", "in", "inner", "winner", "beta", "alpha", "alphabet", "bet", "gamma", "del", "delta", "é", "zeta", "x1", "()"]
    pages = [(p, n, None if pick.random() < .03 else "  ".join(pick.choice(voc) for _ in range(pick.randint(0, 14))).title()) for p in "ab" for n in range(60)]
    records = [(p, i, None if i == 7 else " ".join(pick.choice(voc) for _ in range(pick.randint(0, 11))) + "\n" * (i % 2)) for p in "ab" for i in range(50)]
    records.append(("a", 99, records[3][2]))
    got = L.locate_by_words(spark.createDataFrame(records, "part string, record_id long, text string").repartition(3),
                            spark.createDataFrame(pages, "part string, page_no long, text string").repartition(3), slice_rows=7).collect()
    flat = lambda t: " ".join((t or "").lower().split())
    want = set()
    for part, i, text in records:
        words = flat(text)[:50].split()[:8]
        best = None
        for p, n, page in pages:
            if p != part or not words:
                continue
            hits = lambda ws: sum(w in flat(page) for w in ws)
            tier = 1 if hits(words) >= min(6, len(words)) else 2 if hits(words[:4]) >= 3 else None
            if tier and (best is None or (tier, n) < best):
                best = (tier, n)
        if best:
            want.add((part, i, *best))
    assert {tuple(r) for r in got} == want and {r[2] for r in want} == {1, 2}


def test_multiset(spark):
    rng = random.Random(4)
    bags = [[rng.choice(["a", "aa", "b", "ab", "b#2"[:1], "the"]) for _ in range(rng.randint(0, 30))] for _ in range(40)] + [["x"] * 20_000, []]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(bags)], "i int, words array<string>").select("i", X.multiset(F.col("words")).alias("e")).collect()
    for i, e in got:
        want = [w if k == 1 else f"{w}#{k}" for w, n in Counter(bags[i]).items() for k in range(1, n + 1)]
        assert e == sorted(want)


def test_a_word_of_every_row_is_cut_on_both_sides(spark):
    """With one word in all rows, slices of few rows give the pairs of a plain join, and each probe its own least share."""
    rng = random.Random(6)
    texts = [" ".join(["common", "common"] + [rng.choice(WORDS) for _ in range(rng.randint(0, 5))]) for _ in range(60)]
    shares = [rng.choice([0.2, 0.5, 0.9]) for _ in range(30)]
    p = spark.createDataFrame([(0, i, texts[i].split(), shares[i]) for i in range(30)], "part int, probe_id int, words array<string>, share double")
    r = spark.createDataFrame([(0, i, texts[i].split()) for i in range(30, 60)], "part int, ref_id int, words array<string>")
    bags = [Counter(t.split()) for t in texts]
    reps = {frozenset(bags[i].items()): i for i in range(59, 29, -1)}
    least = {}
    for i in range(30):
        key = frozenset(bags[i].items())
        least[key] = min(least.get(key, 1), shares[i])
    want = {(i, j) for i in range(30) for j in reps.values() if score(bags[i], bags[j]) >= least[frozenset(bags[i].items())]}
    for rows in (3, 100):
        got = L.overlap_pairs(p, r, None, slice_rows=rows).collect()
        assert {(x.probe_id, x.ref_id) for x in got} == want
        assert all(x.score == score(bags[x.probe_id], bags[x.ref_id]) for x in got)


def test_option_neighbours_lose_no_pair(spark):
    rng = random.Random(12)
    def near(t):
        t = list(t)
        for _ in range(rng.randrange(0, 4)):
            t.insert(rng.randint(0, len(t)), rng.choice(["", "x", "é "]))
            if t and rng.random() < .5:
                t.pop(rng.randrange(len(t)))
        return "".join(t)
    base = [[sentence(rng, rng.randint(1, 4)), rng.choice(["", "a", "ab"]), sentence(rng, 2)] for _ in range(12)]
    side = lambda n: [(0, i, rng.sample(WORDS, 3), *(near(o) if o else o for o in rng.choice(base))) for i in range(n)]
    ps, rs = side(40), side(50)
    schema = "part int, {}_id int, words array<string>, a string, b string, c string"
    got = L.option_neighbours(spark.createDataFrame(ps, schema.format("probe")), spark.createDataFrame(rs, schema.format("ref")), 0.8, slice_rows=5).collect()
    ratio = lambda x, y: difflib.SequenceMatcher(None, x.lower().strip(), y.lower().strip()).ratio()
    want = {(p[1], r[1]) for p in ps for r in rs if set(p[2]) & set(r[2]) and min(ratio(p[k], r[k]) for k in (3, 4, 5)) >= 0.8}
    assert {(x.probe_id, x.ref_id) for x in got} == want and len(want) > 20


def test_letters_never_refuse_a_reachable_ratio(spark):
    rng = random.Random(1)
    pairs = [(sentence(rng, rng.randint(0, 8)), sentence(rng, rng.randint(0, 8))) for _ in range(60)]
    pairs += [(a, a.replace("a", "é", 1)) for a, _ in pairs]
    d = spark.createDataFrame(pairs, "a string, b string")
    counts = [Sim.letter_counts(F.col(c)) for c in "ab"]
    for floor in (0.3, 0.6, 0.8, 1.0):
        got = d.select(Sim.ratio_reachable(F.col("a"), F.col("b"), *counts, floor).alias("ok")).collect()
        assert all(x.ok or difflib.SequenceMatcher(None, a, b).ratio() < floor for x, (a, b) in zip(got, pairs))


def test_option_search_in_blocks_makes_no_row_for_a_pair(spark):
    """Slices of any size give the brute-force result, and what leaves the exchange before the search grows with rows, not with pairs."""
    rng = random.Random(5)
    some = lambda: "|".join(" ".join(sorted({rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 5))})) for _ in range(3))
    lists = [(120, "k", s, i) for i, s in enumerate(sorted({some() for _ in range(90)}, key=hash))] + [(60, "k", "a||", 7), (60, "k", "|b|", 3)]
    cases = [(120, "k", s) for s in {some() for _ in range(70)}] + [(60, "k", "||c"), (60, "k", "a||"), (80, "no references", "a||")]

    def rate(p, r):
        total = 0.0
        for a, b in zip(p.split("|"), r.split("|")):
            a, b = set(a.split()), set(b.split())
            total += len(a & b) / max(len(a), len(b)) if a and b else 0.0
        return total / 3.0

    want = {(t, k, p): min(((-rate(p, s), i) for t2, k2, s, i in lists if (t2, k2) == (t, k)), default=(0, None))[1] for t, k, p in cases}
    want = {c: i for c, i in want.items() if i is not None}
    p, r = spark.createDataFrame(cases, "tier int, key string, p_sets string"), spark.createDataFrame(lists, "tier int, key string, _sets string, ref_id long")
    for size in (8192, 7):
        got = L.most_similar_options(p, r, slice_rows=size)
        assert {(x.tier, x.key, x.p_sets): x.ref_id for x in got.collect()} == want
    plan = L.most_similar_options(p, r)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "rate" in plan


def test_overlap_pairs_make_rows_for_real_pairs_only(spark):
    """One frequent word in every text made a candidate row for each pair; the blocks make none, and lose no pair. Long bags are cut as well."""
    rng = random.Random(12)
    words = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 25))] + ["the", "the"] for _ in range(300)]
    words[7], words[8] = ["the"], []
    ps = [(i % 2, i, words[i] if i % 3 else words[i + 1] + ["the"]) for i in range(299)]
    rs = [(i % 2, i, words[i]) for i in range(300)]
    schema = "part int, {}_id int, words array<string>"
    p, r = spark.createDataFrame(ps, schema.format("probe")), spark.createDataFrame(rs, schema.format("ref"))
    for larger in (False, True):
        want, first = {}, {}
        for part, j, w in rs:
            first.setdefault((part, tuple(sorted(w))), j)
        for part, i, w in ps:
            for (other, bag_), j in first.items():
                a, b = Counter(w), Counter(bag_)
                size = max(a.total(), b.total()) if larger else a.total()
                if part == other and size and b and (a & b).total() / size >= 0.5:
                    want[i, j] = (a & b).total() / size
        got = L.overlap_pairs(p, r, 0.5, of_larger=larger, slice_rows=40)
        assert {(x.probe_id, x.ref_id): x.score for x in got.collect()} == want
        assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()  # pairs are met inside tasks


def test_option_neighbours_make_no_row_for_a_shared_word(spark):
    """Options of one length and one common word made a row for each pair; only pairs that may be alike leave the tasks."""
    texts = ["".join(chr(97 + (7 * i + k * k) % 26) for k in range(12)) for i in range(26)]
    side = lambda name: spark.createDataFrame([(0, i, ["the", f"w{i}"], t, t, t) for i, t in enumerate(texts)],
                                              f"part int, {name}_id int, words array<string>, a string, b string, c string")
    found = L.option_neighbours(side("probe"), side("ref"), 0.8, slice_rows=6)
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    assert {(x.probe_id, x.ref_id) for x in found.collect()} == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts) if ratio(x, y) >= 0.8}
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_prefix_matches_cut_each_text_once(spark):
    """Every text used to be cut to keys anew for each use of its rows, and once a tier: many passes over a large table."""
    cuts = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda t: cuts.add(1) or t, "string").asNondeterministic()
    text = "one opening " * 12
    rows = [(i, text, f"red {i % 5}", f"blue {'x' * (i % 3)}", "c") for i in range(40)] + [(40, "another " * 20, "a", "b", "c")]
    d = lambda name: spark.createDataFrame(rows, f"{name} int, text string, a string, b string, c string").withColumn("text", counted("text"))
    found = L.prefix_matches(d("probe_id"), d("ref_id")).collect()
    assert len(found) == 41 and cuts.value == 82


def test_keys_and_ends_of_odd_texts(spark):
    """A key cut from the opening is that of the whole text, and no blank is lost before a line separator that `$` takes for the end."""
    odd = ["", " \n\t ", "| a |\n" * 90 + "Late START  of it " * 9, " " * 700 + "deep " * 50, "A" * 118 + "ΟΔΟΣ" + "'" * 400 + "x", "short",
           "İstanbul " * 40, "b " * 200, "| open", "x\n|" + "y" * 600, "tail  ", None]
    d = spark.createDataFrame([(t,) for t in odd], "t string")
    whole = F.substring(F.trim(F.regexp_replace(F.lower(X.without_tables(F.col("t"))), "\\s+", " ")), 1, 120)
    for x in d.select("t", X.prefix_key(F.col("t"), 120).alias("key"), whole.alias("want"), X.strip(F.col("t")).alias("bare")).collect():
        assert x.key == x.want
        assert x.bare == (None if x.t is None else x.t.strip(" \t\n\v\f\r"))


def test_word_search_makes_no_row_for_a_word_of_a_page(spark):
    """Tokens of all pages used to be shuffled as rows, and each opening met each page that holds one of its words as a row with the text."""
    pages = spark.createDataFrame([(0, i, f"all of them w{i} hold these few words") for i in range(50)], "part int, page_no long, text string")
    records = spark.createDataFrame([(0, i, f"hold these few words w{i}") for i in range(60)], "part int, record_id long, text string")
    found = L.locate_by_words(records, pages, slice_rows=20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") <= 2 and "FlatMapCoGroupsInArrow" in plan  # the deal of both sides over the blocks
    assert {r.record_id: (r.tier, r.page_no) for r in found.collect()} == {i: (1, i if i < 50 else 0) if i < 50 else (2, 0) for i in range(60)}


def test_holding_pages_are_those_that_contain_the_word():
    rng = random.Random(3)
    texts = ["", "  ", "é", "\U0001f600a aa aaa", *[" ".join("".join(rng.choice("abé()") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(80)]]
    words = ["a", "ab", "é", "(a", "abé", "aaaa", "zzz", "\U0001f600", *{"".join(rng.choice("abé()") for _ in range(rng.randint(1, 6))) for _ in range(100)}]
    got = L.holding_pages(words, texts)
    assert {w: [w in t for t in texts] for w in words} == {w: x.tolist() for w, x in got.items()}
    assert not L.holding_pages(["a", "abc"], ["", " "])["a"].any()


def test_only_ratios_that_can_be_among_the_best_two_are_rated(spark, tmp_path):
    """Every candidate used to be rated, by as few tasks as its bytes fill. The best two, with ties, are those of rating all."""
    rng = random.Random(8)
    base = "the quick brown fox jumps over the lazy dog near a river bank"
    mutate = lambda: "".join(rng.choice("abcdef ") if rng.random() < rng.choice((0.02, 0.1, 0.2)) else c for c in base)
    ps, rs = [(i, mutate()) for i in range(6)], [(i, mutate()) for i in range(150)] + [(150 + i, base) for i in range(2)]
    p = L.with_form(spark.createDataFrame(ps, "p_rep int, form string"), "p")
    r = L.with_form(spark.createDataFrame([(i, t, 1) for i, t in rs], "r_rep int, form string, r_rep_copies long"), "r", "r_rep_copies")
    rated = L.best_two_ratios(p.crossJoin(r), 0.3)
    got = rated.collect()
    assert len(got) < len(ps) * len(rs) / 2 and "MapInArrow" in rated._jdf.queryExecution().optimizedPlan().toString()
    for i, a in ps:
        want = sorted((-difflib.SequenceMatcher(None, a, b).ratio(), j) for j, b in rs)
        have = sorted((-x.score, x.r_rep) for x in got if x.p_rep == i)
        assert have[:2] == want[:2]
