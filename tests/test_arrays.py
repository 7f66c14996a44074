"""JSON arrays read in splits against the reader of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.sources import readers
from scholia.sources.arrays import array_records, effect

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("more", T.StructType([T.StructField("list", T.ArrayType(T.StringType()))]))])


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2500", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def records(n, seed=1):
    pick = random.Random(seed)
    odd = ["}", "{", "]", "[", '"', "\\", "\\\\", ",", "\n", "},{", '"}', "é", "word", " "]
    text = lambda most: "".join(pick.choices(odd, k=pick.randrange(most)))
    return [{"id": i, "text": text(4000 if i % 17 == 0 else 30), "more": {"list": [text(5) for _ in range(i % 3)]}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_splits_lose_nothing(spark, small_splits, tmp_path, indent):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(records(150, ord(name)), indent=indent).encode())
    got = readers.read_dump(spark, str(tmp_path), SCHEMA)
    whole = spark.read.schema(SCHEMA).json(str(tmp_path), multiLine=True)
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 20
    assert got.where(F.col("_corrupt_record").isNotNull()).count() == 0
    key = lambda r: (r.id, r.text)
    assert sorted(got.drop("_corrupt_record").collect(), key=key) == sorted(whole.collect(), key=key)


def test_raw_letters_outside_of_ascii(spark, small_splits, tmp_path):
    rows = [{"id": i, "text": "ü}" * i} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    got = readers.read_dump(spark, str(tmp_path), SCHEMA).select("id", "text").collect()
    assert sorted(map(tuple, got)) == [(r["id"], r["text"]) for r in rows]


@pytest.mark.parametrize("text, want", [
    ("[]", []), ("", []), (" [ \n ] \n", []), ('[{}]', [(None, False)]), ('[{"id": 1}, {"id": 2}]\n', [(1, False), (2, False)]),
    ('[{"id": 1}, {"id": 2,, }, {"id": 3}]', [(1, False), (3, False), (None, True)]),
    ('[{"id": 1}, {"id": 2', [(1, False), (None, True)]), ('[{"id": 1}, {"text": "open}, {]', [(1, False), (None, True)]),
    ('[{"id": 1}, 5, {"id": 2}, {"id": 3}]', [(1, False), (3, False), (None, True)]),
])
def test_defects_and_empty_files(spark, tmp_path, text, want):
    (tmp_path / "a.json").write_text(text)
    got = readers.read_dump(spark, str(tmp_path), SCHEMA).collect()
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.id, r._corrupt_record is not None) for r in got), key=order) == want


def test_bulk_is_not_shuffled(spark, small_splits, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(records(100)))
    plan = array_records(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_effect():
    assert effect('{"a": "x', 0) == (1, 1)
    assert effect('y", "b": [1]', 1) == (0, -1)
    assert effect('a\\\\", {', 1) == (0, 0)
    assert effect('a\\"', 1) == (1, 0)
