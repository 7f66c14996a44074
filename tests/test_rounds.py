"""Word bags meet in rounds, one slice of the references at a time, and what a round shuffles is removed."""

from pathlib import Path

from scholia import session
from scholia.operators import linkage as L


def _bags(spark, rows, name):
    return spark.createDataFrame(rows, f"part int, {name} long, words array<string>")


def test_rounds_give_every_pair_once(spark):
    words = [f"w{i}" for i in range(12)]
    own = lambda i: [words[(i * k) % 12] for k in (1, 2, 3, 5)] + [words[i % 12]]
    p, r = [(i % 2, i, own(i)) for i in range(30)], [(i % 2, 100 + i, own(i)) for i in range(40)]
    for kinds in ({"of_larger": False}, {"of_larger": True, "repeats": False}):
        rows = lambda n: {tuple(x) for x in L.overlap_pairs(_bags(spark, p, "probe_id"), _bags(spark, r, "ref_id"), 0.5, slice_rows=n, **kinds).collect()}
        assert rows(2) == rows(100_000) and rows(2)


def test_blocks_of_a_round_hold_each_probe_once(spark):
    p = spark.createDataFrame([(0, i) for i in range(20)], "part int, p_sig long")
    r = spark.createDataFrame([(0, i) for i in range(50)], "part int, r_sig long")
    one = lambda d: d.selectExpr("part", "1 AS weight")
    rounds = L.dealt_blocks(p, r, one(p), one(r), ["part"], "p_sig", "r_sig", 10, 10**6, rounds=True)
    assert len(rounds) == 5
    met = [x for left, right, on in rounds for x in left.join(right, on).select("p_sig", "r_sig").collect()]
    assert len(met) == len(set(met)) == 1000
    assert all(left.count() == 20 for left, _, _ in rounds)


def test_stage_tables_remove_their_shuffles_and_keep_the_setting(spark, tmp_path):
    before = spark.conf.get(session.CLEAN_UP, None)
    staged = session.stage_table(spark.range(1000).repartition(7), compression="zstd")
    assert staged.count() == 1000 and spark.conf.get(session.CLEAN_UP, None) == before
    assert all("zstd" in f for f in map(lambda f: Path(f).name, staged.inputFiles()))
