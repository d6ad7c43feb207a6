import random

import numpy as np
import pytest

from cairn.llm import leaks
from cairn.llm.leaks import Walk, edits, find_leaks, leaked_shares, plan

VOCABULARY = [f"w{i}" for i in range(300)] + ["Straße", "É", "12"]


def make(seed, max_edits=0):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=rng.choice([5, 13, 40])))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        words = rng.choices(VOCABULARY, k=rng.choice([0, 3, 60, 200]))
        if d % 3 == 0:
            source = rng.choice(items[:25])[1].split()
            n = rng.randint(10, 20)
            at = rng.randint(0, max(0, len(source) - n))
            part = source[at : at + n]
            for _ in range(rng.randint(0, max_edits)):
                part[rng.randrange(len(part))] = "other"
            words[len(words) // 2 : len(words) // 2] = [w.upper() + rng.choice(["", ",", " -"]) for w in part]
        docs.append((d, " ".join(words)))
    return docs + [(500, None), (501, "")] + docs[:5], items


def brute(docs, items, size):
    out = set()
    for i, text in items:
        w = leaks.words(text or "")
        grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        for d, t in docs:
            v = leaks.words(t or "")
            if any(tuple(v[k : k + size]) in grams for k in range(len(v) - size + 1)):
                out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [leaks.BROADCAST_BYTES, 0])
def test_exact_windows_both_ways(spark, broadcast):
    docs, items = make(1)
    found = find_leaks(spark.createDataFrame(docs, "id int, text string"), "id", "text", spark.createDataFrame(items, "item int, text string"), "item", "text", broadcast_bytes=broadcast)
    assert sorted((r["id"], r["item"]) for r in found.collect()) == brute(docs, items, 13) != []


@pytest.mark.parametrize("broadcast", [leaks.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("most", [1, 2])
def test_near_windows_reach_the_recall(spark, broadcast, most):
    """Every pair within so many edits is known by brute force; a recall of 0.99 is asked for; the few pairs here allow for one miss."""
    docs, items = make(2, most)
    want = set()
    for d, t in docs:
        v = leaks.words(t or "")
        for i, text in items:
            w = leaks.words(text or "")
            if any(edits(v[a : a + 13], w[b : b + 13], most) <= most for a in range(len(v) - 12) for b in range(len(w) - 12)):
                want.add((d, i))
    found = find_leaks(spark.createDataFrame(docs, "id int, text string"), "id", "text", spark.createDataFrame(items, "item int, text string"), "item", "text", max_edits=most, recall=0.99, broadcast_bytes=broadcast)
    got = {(r["id"], r["item"]) for r in found.collect()}
    assert got <= want and len(got) >= len(want) - 1 and set(brute(docs, items, 13)) <= got


def test_edits():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
        return row[-1]

    rng = random.Random(3)
    for _ in range(500):
        a, b = (rng.choices("abc", k=rng.randint(0, 9)) for _ in range(2))
        for most in (0, 1, 3, 10):
            assert edits(a, b, most) == min(plain(a, b), most + 1)
    a, b = (np.array([rng.choices(range(3), k=9) for _ in range(300)], dtype=np.uint64) for _ in range(2))
    for most in (0, 2, 4):
        assert list(leaks.edits_of_many(a, b, most)) == [min(plain(list(x), list(y)), most + 1) for x, y in zip(a, b)]


def test_windows_without_a_shared_run_are_passed_over():
    """Exactly those windows go on that hold one of the items' runs; equal windows always do."""
    rng = np.random.default_rng(1)
    item, text = rng.integers(0, 2**63, 20, dtype=np.uint64), rng.integers(0, 2**63, 60, dtype=np.uint64)
    text[30:34] = item[3:7]
    bitmap = np.zeros(1 << 22, dtype=np.uint8)
    leaks._mark(bitmap, leaks._places(leaks.runs(item, 4), 25))
    where = np.arange(48)
    assert list(np.flatnonzero(leaks.promising(text, where, 13, 4, bitmap, 25))) == list(range(21, 31))
    assert leaks.run_length(13, 2) == 4 and leaks.run_length(13, 0) == 13


def test_equal_windows_share_keys_anywhere():
    rng = np.random.default_rng(0)
    window = rng.integers(0, 2**63, 13, dtype=np.uint64)
    text = np.concatenate([rng.integers(0, 2**63, 50, dtype=np.uint64), window, rng.integers(0, 2**63, 9, dtype=np.uint64), window])
    for walk in plan(13, 2, 0.9):
        a, b = walk.keys(text, np.array([50, 72]))
        assert a == b
    assert len(plan(13, 0, 0.99)) == 1 and len(plan(13, 1, 0.9)) <= len(plan(13, 1, 0.99))
    assert isinstance(plan(13, 1, 0.9)[0], Walk)


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    text = " ".join(f"x{i}" for i in range(5000))
    index = type("B", (), {"value": leaks.Index(plan(13, 0, 0.99), [7], [[f"x{i}" for i in range(990, 1010)]], 0)})
    import pandas as pd

    found = pd.concat(leaks._scan(index, most_words=1000)(iter([pd.DataFrame({"doc": [1], "text": [text]})])))
    assert set(map(tuple, found.itertuples(index=False))) == {(1, 7, 0)}


def test_edge_cases(spark):
    docs, items = "doc int, text string, item int, edits int", "item int, text string, doc int"
    empty = find_leaks(spark.createDataFrame([], docs), "doc", "text", spark.createDataFrame([], items), "item", "text")
    assert empty.collect() == []
    same = " ".join(f"a{i}" for i in range(13))
    d = spark.createDataFrame([(1, same, 3, 3), (None, same, 3, 3), (1, same, 4, 4)], docs)
    i = spark.createDataFrame([(3, same.upper(), 1), (3, same, 1), (None, same, 1), (4, "short", 1)], items)
    found = find_leaks(d, "doc", "text", i, "item", "text")
    assert [tuple(r) for r in found.collect()] == [(1, 3, 0)]
    assert sorted(tuple(r) for r in leaked_shares(found, i.where("item IS NOT NULL"), "item").collect()) == [(3, 1), (4, 0)]
    with pytest.raises(ValueError):
        find_leaks(d, "doc", "text", i, "item", "text", window_words=1)
