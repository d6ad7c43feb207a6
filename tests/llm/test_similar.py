import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm.similar import _contenders, fit, neighbours, similar_pairs


def make(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, 16))
    v = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, 16))
    v[:copies] = v[0]
    return v * rng.uniform(0.3, 5, (n, 1))


def brute(v, k, least):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    out = set()
    for a in range(len(v)):
        order = [b for b in sorted(range(len(v)), key=lambda b: (-s[a, b], b)) if b != a][:k]
        out |= {(min(a, b), max(a, b)) for b in order if s[a, b] >= least}
    return out


@pytest.mark.parametrize("least,block,coarse", [(0.8, 8192, 4096), (0.8, 40, 4096), (0.8, 8192, 4), (-1.0, 8192, 4096)])
def test_recall_and_exact_scores(spark, least, block, coarse):
    """Against brute force; blocks smaller than a cell change nothing but the layout; cells may be of several codebooks."""
    v = make(600, 1)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item int, vec array<float>")
    found = neighbours(df, "item", "vec", 5, least, words=64, block=block, coarse_words=coarse)
    got, want = {tuple(r) for r in similar_pairs(found).collect()}, brute(v, 5, least)
    assert len(got & want) >= (0.99 if least > 0 else 0.9) * len(want)
    if least > 0:
        assert len(got - want) <= 0.01 * len(want)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(r["similarity"] == pytest.approx(float(u[r["item"]] @ u[r["neighbour"]]), abs=1e-6) for r in found.limit(200).collect())


def test_many_copies(spark):
    """A third of all vectors are equal: one cell holds them, and each has the smallest others as neighbours."""
    v = make(300, 3, copies=100)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item int, vec array<double>")
    found = neighbours(df, "item", "vec", 3, 0.9, words=32, block=64).where("item = 50").orderBy("rank").collect()
    assert [r["similarity"] for r in found] == [pytest.approx(1.0)] * 3 and [r["neighbour"] for r in found] == [0, 1, 2]


def test_two_thousand_copies_and_scaled_copies(spark):
    """Exact copies and scaled ones of another vector, amid others: every list is that of brute force."""
    rng = np.random.default_rng(6)
    v = make(600, 9)
    v = np.concatenate([v, np.tile(v[3], (2000, 1)), v[5] * rng.uniform(0.01, 90, (2000, 1))])[rng.permutation(4600)]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item int, vec array<double>")
    got, want = {tuple(r) for r in similar_pairs(neighbours(df, "item", "vec", 3, 0.8, words=64)).collect()}, brute(v, 3, 0.8)
    assert got == want


def test_copies_beyond_the_candidates(spark):
    """Far more copies than are reranked: each, and each item near them, has the smallest ids; the rest is as by brute force."""
    v = make(300, 3, copies=100)[np.random.default_rng(4).permutation(300)]
    v[7] = make(300, 3, copies=100)[0] + 0.02
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item int, vec array<double>")
    for block in (64, 8192):
        found = neighbours(df, "item", "vec", 3, 0.8, words=32, block=block)
        assert {tuple(r) for r in similar_pairs(found).collect()} == brute(v, 3, 0.8)
        assert found.groupBy("item", "rank").count().where("count > 1").count() == 0
    same = neighbours(df.where("item < 6").withColumn("vec", F.expr("transform(vec, x -> 1.5D)")), "item", "vec", 2, 0.8)
    assert {tuple(r) for r in similar_pairs(same).collect()} == {(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (0, 4), (1, 4), (0, 5), (1, 5)}


def test_candidates_within_the_margin_all_go_on():
    """Forty codes with one score, and one just below whose error leaves it a chance: none is given up."""
    dot = np.array([[0.9] * 40 + [0.88, 0.2, -np.inf]], dtype=np.float32)
    kept = _contenders(dot, np.zeros(43), np.array([0.01] * 40 + [0.05, 0.01, 0.5]), 5, 32)
    assert kept[0, :41].all() and not kept[0, 41:].any()


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [2.0, 0.1], 3), (3, None, 4), (4, [0.0, 0.0], 5), (5, [nan, 1.0], 6), (6, [inf, 1.0], 7), (None, [1.0, 1.0], 8), (7, [None, 1.0], 9)]
    df = spark.createDataFrame(data, "item int, v array<float>, cell int")
    assert [tuple(r) for r in similar_pairs(neighbours(df, "item", "v", 5, 0.8)).collect()] == [(1, 2)]
    assert neighbours(df.limit(0), "item", "v").collect() == [] and neighbours(df.limit(1), "item", "v").collect() == []
    with pytest.raises(ValueError):
        neighbours(df, "item", "v", k=0)


def test_beam_search_lowers_the_error():
    x = make(400, 5).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = fit(x, 8, 4, 32)
    deep = fit(x, 40, 4, 32, coarse_words=8)
    assert len(deep.coarse) == 2 and deep.cells(x, 16).max() < 49 and all(len(set(r)) == 16 for r in deep.cells(x, 16))
    narrow, wide = (np.linalg.norm(x - q.encode(x, b)[1], axis=1).mean() for b in (1, 8))
    codes, sums = q.encode(x, 8)
    assert wide <= narrow < 1 and codes.shape == (400, 4)
    assert np.allclose(sum(q.books[level][codes[:, level]] for level in range(4)), sums, atol=1e-4)
