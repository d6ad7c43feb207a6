import random

import pytest

from cairn.llm.topn import _cuts, read_best, skipping, top_n


def brute(data, n):
    groups = {}
    for m, u, i, s in data:
        if i is not None and s is not None and s == s and abs(s) != float("inf"):
            items = groups.setdefault((m, u), {})
            items[i] = max(items.get(i, s), s)
    return sorted(((m, u, i, s, r) for (m, u), items in groups.items() for r, (i, s) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n], 1)), key=str)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    found = [(rng.choice("ab"), rng.choice([1, 1, 1, 1, rng.randint(2, 60), None]), rng.choice([None, rng.randint(1, 400), rng.randint(1, 400)]), rng.choice([*odd, *[round(rng.random(), 2) for _ in range(16)]])) for _ in range(6000)]
    return found + found[:500]


@pytest.mark.parametrize("n,size", [(1, 8192), (5, 16), (20, 100), (1000, 33)])
def test_against_brute_force(spark, data, n, size):
    """Small row groups, ties, nulls in every column, repeated rows and items."""
    df = spark.createDataFrame(data, "model string, user_idx int, item_idx int, score double")
    found = sorted((tuple(r) for r in top_n(df, ["model", "user_idx"], "item_idx", "score", n, size).collect()), key=str)
    assert found == brute(data, n)


def test_row_groups_are_skipped(spark):
    """Of a group of a million rows nearly all row groups stay unread, and most of another's; small groups are read."""
    rows = spark.range(1_000_000).selectExpr("1 AS g", "CAST(id AS INT) AS i", "CAST(hash(id) AS DOUBLE) AS s")
    rows = rows.union(spark.range(60_000).selectExpr("2", "CAST(id AS INT)", "CAST(id AS DOUBLE)")).union(spark.range(900).selectExpr("CAST(3 + id AS INT)", "7", "0.5D"))
    found = skipping(rows, ["g"], "i", "s", 20).first()
    assert found["rows_read"] + found["rows_skipped"] == 1_060_900 and found["skipped"] > 9 * found["read"]


def test_row_groups_end_where_large_groups_do():
    import pyarrow as pa

    g = pa.array(["a"] * 3 + ["b"] * 2 + ["c"] * 11 + ["d"] * 4 + ["e"])
    assert _cuts(g, 5) == [5, 10, 15, 16, 21]
    assert _cuts(g, 4) == [3, 5, 9, 13, 16, 20, 21] and _cuts(g, 100) == [21] and _cuts(g[:0], 4) == []


def test_the_clustered_copy_is_removed(spark, data):
    from pathlib import Path

    from cairn.session import shared_dir

    df = spark.createDataFrame(data[:500], "model string, user_idx int, item_idx int, score double")
    base = Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    assert top_n(df, ["model"], "item_idx", "score", 2).count() == 4
    assert not list(base.glob("cairn-groups-*"))


def test_a_file_of_many_batches(spark, tmp_path):
    """Rows come to the writer in batches of any size; a large group's row groups hold no other."""
    import pyarrow.parquet as pq

    from cairn.llm.topn import cluster

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rows = spark.range(3000).selectExpr("CAST(CASE WHEN id % 3 = 0 THEN 5 ELSE id % 100 END AS INT) AS g", "CAST(id AS INT) AS i", "CAST(hash(id) AS DOUBLE) AS s")
        files = [r["uri"] for r in cluster(rows, ["g"], "i", "s", f"file:{tmp_path}/t", 50).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    total = 0
    for uri in files:
        file = pq.ParquetFile(uri.removeprefix("file:"))
        total += file.metadata.num_rows
        for r in range(file.num_row_groups):
            groups = file.read_row_group(r)["g"].to_pylist()
            assert len(groups) <= 50 and (len(set(groups)) == 1 or '{"g0":5}' not in groups)
        assert read_best(uri, 3).rows.groupby("g").size().max() <= 3
    assert total == 3000


def test_ties_across_row_groups(spark):
    """All scores equal: nothing may be skipped, the smallest items win."""
    df = spark.createDataFrame([(1, i, 1.0) for i in range(20_000, 0, -1)], "g int, i int, s double")
    assert sorted(r["i"] for r in top_n(df, ["g"], "i", "s", 20, 512).collect()) == list(range(1, 21))


def test_empty_and_clashing(spark):
    kind = "g int, item int, score double, rank int, at long"
    assert top_n(spark.createDataFrame([], kind), ["g"], "item", "score", 3).collect() == []
    df = spark.createDataFrame([(None, 4, 1.0, 9, 9), (None, 4, 2.0, 9, 9)], kind)
    assert [tuple(r) for r in top_n(df, ["g"], "item", "score", 3).collect()] == [(None, 4, 2.0, 1)]
    with pytest.raises(ValueError):
        top_n(df, ["g"], "item", "score", 0)
