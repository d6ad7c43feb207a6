import random

import pytest
from pyspark.sql import functions as F

from cairn.operators.skewed import Measure, heavy_hashes, key_statistics, salted_aggregate

ALL = [Measure("n", "rows"), Measure("c", "count", "v"), Measure("s", "sum", "v"), Measure("lo", "min", "v"), Measure("hi", "max", "v"), Measure("m", "mean", "v")]


def brute(data):
    out = []
    for k in sorted({k for k, _ in data if k is not None}):
        mine = [v for key, v in data if key == k]
        real = [v for v in mine if v is not None]
        out.append((k, len(mine), len(real), sum(real) if real else None, min(real, default=None), max(real, default=None), sum(real) / len(real) if real else None))
    return out


@pytest.mark.parametrize("share,salts", [(0.5, 1), (0.05, 7), (0.0001, 64), (1e-7, 5), (1.0, 3)])
def test_same_as_plain_sums(spark, rows, share, salts):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 1, rng.randint(2, 90), None]), rng.choice([None, rng.randint(-5, 5)])) for _ in range(2000)] + [(500, None)]
    df = spark.createDataFrame(data, "k int, v long")
    assert rows(salted_aggregate(df, ["k"], ALL, heavy_share=share, salts=salts)) == brute(data)


def test_heavy_keys_are_found(spark):
    """The sketch names every key of the share asked for, and no key far below it."""
    df = spark.createDataFrame([(1,)] * 60 + [(2,)] * 30 + [(i,) for i in range(10, 20)], "k int")
    wanted = [r[0] for r in spark.createDataFrame([(1,), (2,)], "k int").select(F.xxhash64("k")).collect()]
    assert heavy_hashes(df, F.xxhash64("k"), 0.3) == sorted(wanted)
    many = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    assert len(heavy_hashes(many, F.xxhash64("k"), 0.005)) == 1
    assert heavy_hashes(many.limit(0), F.xxhash64("k"), 0.005) == []


def test_two_kinds_and_clashing_names(spark, rows):
    df = spark.createDataFrame([(1, 9, 2.0, 0, "a"), (1, None, None, 1, "b"), (None, 9, 4.0, 2, None)], "u int, i int, key_id double, row_id long, salt string")
    found = key_statistics(df, {"user": "u", "item": "i"}, [Measure("n", "rows"), Measure("m", "mean", "key_id")], ["row_id"])
    assert rows(found) == [("item", 9, 2, 3.0), ("user", 1, 2, 2.0)]
    assert rows(key_statistics(df.limit(0), {"user": "u", "item": "i"}, [Measure("n", "rows")])) == []


def test_equal_rows_and_bad_arguments(spark, rows):
    df = spark.createDataFrame([(1, 1)] * 100, "k int, v int")
    assert rows(salted_aggregate(df, ["k"], [Measure("n", "rows"), Measure("s", "sum", "v")])) == [(1, 100, 100)]
    with pytest.raises(ValueError):
        Measure("x", "median", "v")
    with pytest.raises(ValueError):
        Measure("x", "sum")
    with pytest.raises(ValueError):
        salted_aggregate(df, ["k"], [Measure("n", "rows")], heavy_share=0)
