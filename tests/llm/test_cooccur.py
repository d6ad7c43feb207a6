import math
import random
from itertools import combinations

import pytest

from cairn.llm import cooccur
from cairn.llm.cooccur import pairs
from cairn.llm.queries import QUERIES, SIGNIFICANT


def brute(data, support, lift):
    baskets, out = {}, []
    for u, i in data:
        if u is not None and i is not None:
            baskets.setdefault(u, set()).add(i)
    n, ones, twos = len(baskets), {}, {}
    for items in baskets.values():
        for i in items:
            ones[i] = ones.get(i, 0) + 1
        for p in combinations(sorted(items), 2):
            twos[p] = twos.get(p, 0) + 1
    for (a, b), c in twos.items():
        if c >= support and c * n / (ones[a] * ones[b]) >= lift:
            out.append((a, b, c, ones[a], ones[b], n))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    data = [(rng.choice([None, 1, 1, rng.randint(2, 60)]), rng.choice([None, rng.randint(1, 8), rng.randint(1, 90)])) for _ in range(3000)]
    return data + data[:300]


@pytest.mark.parametrize("support,lift,block,buffer", [(1, 0.0, 512, 4_000_000), (3, 0.0, 7, 4_000_000), (2, 1.2, 2, 50), (4, 1.5, 20, 100)])
def test_against_brute_force(spark, monkeypatch, support, lift, block, buffer):
    """One basket holds a third of the rows; small blocks cut it, small buffers flush many stripes."""
    monkeypatch.setattr(cooccur, "BUFFER", buffer)
    data = rows_of(block)
    df = spark.createDataFrame(data, "u int, i int")
    found = pairs(df, "u", "i", support, lift, block=block)
    assert sorted(tuple(r)[:6] for r in found.collect()) == brute(data, support, lift)


def test_significance(spark):
    data = [(u, i) for u in range(40) for i in ((1, 2) if u < 10 else (3,))]
    (r,) = pairs(spark.createDataFrame(data, "u int, i int"), "u", "i", min_llr=10.83).collect()
    assert (r["item_a"], r["item_b"], r["n_ab"], r["lift"]) == (1, 2, 10, 4.0)
    assert r["llr"] == pytest.approx(2 * (10 * math.log(4) + 30 * math.log(40 / 30)))


def test_rarer_than_chance_is_negative(spark):
    data = [(u, i) for u in range(20) for i in ((1, 2) if u == 0 else (1,) if u < 10 else (2,))]
    (r,) = pairs(spark.createDataFrame(data, "u int, i int"), "u", "i").collect()
    assert r["lift"] < 1 and r["llr"] < 0


def test_empty_clashing_and_text_items(spark):
    assert pairs(spark.createDataFrame([], "u int, i int"), "u", "i").collect() == []
    df = spark.createDataFrame([(1, "x", 5, 5), (1, "y", None, 5), (1, "x", 5, 5), (None, "y", 1, 1)], "x int, i string, n int, c int")
    assert [tuple(r)[:6] for r in pairs(df, "x", "i").collect()] == [("x", "y", 1, 1, 1, 1)]
    with pytest.raises(ValueError):
        pairs(df, "x", "i", min_support=0)


def test_pairs_query_returns_counts_and_significance(spark):
    """All significant pairs at sf0.01 with their counts, as counted one by one."""
    path = "/root/testdata/sf0.01"
    rows = {(r[0], r[1]) for r in spark.read.parquet(f"{path}/train.parquet").select("user_idx", "item_idx").dropna().collect()}
    users = {}
    for u, i in rows:
        users.setdefault(i, set()).add(u)
    n, want = len({u for u, _ in rows}), {}
    frequent = sorted(i for i in users if len(users[i]) >= 12)
    for at, a in enumerate(frequent):
        for b in frequent[at + 1 :]:
            ab, na, nb = len(users[a] & users[b]), len(users[a]), len(users[b])
            cells = ((ab, na, nb), (na - ab, na, n - nb), (nb - ab, n - na, nb), (n - na - nb + ab, n - na, n - nb))
            llr = 2 * sum(k * math.log(k * n / (r * c)) for k, r, c in cells if k)
            if ab >= 12 and ab * n >= na * nb and llr >= SIGNIFICANT:
                want[a, b] = (ab, na, nb, pytest.approx(ab * n / (na * nb)), pytest.approx(llr))
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["lift"], r["llr"]) for r in QUERIES["p5_pairs"](spark, path).collect()}
    assert want and got == want
