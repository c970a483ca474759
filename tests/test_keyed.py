"""Upserts against a plain dictionary, and writes that fail."""

import random

import pytest
from pyspark.sql import functions as F

from riskweave.sources import keyed

KIND = "a int, b string, at int, value string"


def table(spark, path):
    return sorted((tuple(r) for r in keyed.read(spark, path).select("a", "b", "at", "value").collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_upserts_leave_the_latest_of_every_identity(spark, tmp_path, seed):
    rng, path, want = random.Random(seed), str(tmp_path / "t"), {}
    for n in range(3):
        rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), rng.randint(0, 5), f"{n}-{i}") for i in range(12)]
        rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
        for r in rows:
            if r[:2] not in want or (r[2], n) >= (want[r[:2]][0], want[r[:2]][2]):
                want[r[:2]] = (r[2], r[3], n)
        keyed.upsert(spark.createDataFrame(rows, KIND).repartition(2), path, ["a", "b"], ["at"], buckets=4)
        assert table(spark, path) == sorted(((*k, v[0], v[1]) for k, v in want.items()), key=str)


def test_only_touched_buckets_are_rewritten_and_a_failed_write_leaves_the_old(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(i, "x", 1, "old") for i in range(40)]
    keyed.upsert(spark.createDataFrame(rows, KIND), str(path), ["a", "b"], ["at"], buckets=8)
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    keyed.upsert(spark.createDataFrame([(7, "x", 2, "new")], KIND), str(path), ["a", "b"], ["at"], buckets=8)
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert len(set(before.items()) & set(after.items())) == len(before) - 1
    have = table(spark, str(path))
    broken = spark.createDataFrame([(3, "x", 9, "bad")], KIND).withColumn("value", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        keyed.upsert(broken, str(path), ["a", "b"], ["at"], buckets=8)
    assert table(spark, str(path)) == have and (7, "x", 2, "new") in have and len(have) == 40
    keyed.upsert(spark.createDataFrame([], KIND), str(path), ["a", "b"], ["at"], buckets=8)
    assert table(spark, str(path)) == have
