import random

import pytest

from cairn.operators.sessions import sessionize


def brute(data, gap):
    out = []
    for u in sorted({u for u, t in data if u is not None}):
        times = sorted(t for v, t in data if v == u and t is not None and t > 0)
        run = []
        for t in times:
            if run and t - run[-1] > gap:
                out.append((u, run[0], run[-1], run[-1] - run[0], len(run)))
                run = []
            run.append(t)
        if run:
            out.append((u, run[0], run[-1], run[-1] - run[0], len(run)))
    return sorted(out)


@pytest.mark.parametrize("gap,width", [(1800, 86_400), (10, 25), (10, 10), (10, 3), (0, 7)])
def test_against_brute_force(spark, rows, gap, width):
    """Slices far narrower than sessions give the same sessions; so do ties and repeated rows."""
    rng = random.Random(gap + width)
    data = [(rng.choice([1, 2, 3, None]), rng.choice([None, 0, -1, rng.randint(1, 400), rng.randint(1, 60_000)])) for _ in range(600)]
    data += data[:50]
    df = spark.createDataFrame(data, "user_idx int, ts long")
    assert rows(sessionize(df, "user_idx", "ts", gap, width)) == brute(data, gap)


def test_gap_itself_belongs(spark, rows):
    df = spark.createDataFrame([(1, 100), (1, 1900), (1, 3701)], "u int, ts long")
    assert rows(sessionize(df, "u", "ts")) == [(1, 100, 1900, 1800, 2), (1, 3701, 3701, 0, 1)]


def test_empty_and_clashing_columns(spark, rows):
    kind = "user_idx int, ts long, u string, t int, k int, n int, starts boolean"
    assert rows(sessionize(spark.createDataFrame([], kind), "user_idx", "ts")) == []
    df = spark.createDataFrame([(5, 10, None, 1, None, 7, True), (5, 10, "x", None, 3, 7, None)], kind)
    assert rows(sessionize(df, "user_idx", "ts")) == [(5, 10, 10, 0, 2)]


def test_sizes_are_checked(spark):
    with pytest.raises(ValueError):
        sessionize(spark.createDataFrame([], "u int, ts long"), "u", "ts", gap=-1)
