import random

import pytest

from cairn.llm.packing import VOCABULARY, _tokenizer, pack, pack_texts


def test_windows_hold_and_follow_the_mixture():
    rng = random.Random(1)
    sources = rng.choices(["a", "b", "c"], weights=[6, 3, 1], k=3000)
    sizes = [rng.randint(1, 700) for _ in sources]
    total = {s: sum(n for n, t in zip(sizes, sources) if t == s) for s in "abc"}
    shares = {s: v / sum(sizes) for s, v in total.items()}
    at = pack(sizes, sources, 2048, shares, {})
    fill, mix = {}, {}
    for (w, start), n, s in zip(at, sizes, sources):
        fill.setdefault(w, []).append((start, n))
        mix.setdefault(w, dict.fromkeys("abc", 0))[s] += n
    for parts in fill.values():
        end = 0
        for start, n in sorted(parts):
            assert start == end
            end += n
        assert end <= 2048
    assert sum(sizes) / (len(fill) * 2048) > 0.99
    # summed over windows, no source is ever far from its share
    so_far = dict.fromkeys("abc", 0.0)
    for w in range(len(fill) * 3 // 4):
        for s in "abc":
            so_far[s] += mix[w][s] - shares[s] * 2048
        assert max(map(abs, so_far.values())) < 2 * 2048


def test_owed_sources_come_first():
    at = pack([10] * 8, ["a"] * 4 + ["b"] * 4, 20, {"a": 0.5, "b": 0.5}, {"b": 40.0, "a": -40.0})
    assert [w for w, _ in at[4:]] == [0, 0, 1, 1]


def texts(seed, n=200):
    rng = random.Random(seed)
    data = [(i, rng.choice(["x", "y", None]), " ".join(rng.choices(["alpha", "beta", "gamma", "δ", "12"], k=rng.choice([1, 30, 900])))) for i in range(n)]
    return data + [(900, "x", None), (901, "y", ""), (902, "x", "word " * 9000), data[0]]


@pytest.mark.parametrize("per_part", [20_000, 30])
def test_every_text_is_laid_once(spark, per_part):
    data = texts(3)
    df = spark.createDataFrame(data, "id int, source string, text string")
    found = pack_texts(df, "id", "text", "source", 256, texts_per_part=per_part).collect()
    encode, want, got, windows = _tokenizer(VOCABULARY).encode_ordinary, {}, {}, {}
    for i, _, t in data:
        if t:
            want[i] = want.get(i, 0) + len(encode(t))
    for r in found:
        got[r["id"]] = got.get(r["id"], 0) + r["n_tokens"]
        windows.setdefault((r["part"], r["window"]), []).append((r["start"], r["n_tokens"]))
        assert r["piece"] == 0 or want[r["id"]] > 256
    assert got == want
    for parts in windows.values():
        ends = [0]
        for start, n in sorted(parts):
            assert start == ends[-1]
            ends.append(start + n)
        assert ends[-1] <= 256


def test_edge_cases(spark):
    df = spark.createDataFrame([], "id int, source string, text string, n int, part int")
    assert pack_texts(df, "id", "text", "source").collect() == []
    df = spark.createDataFrame([(None, None, "a b", 1, 1)], df.schema)
    (r,) = pack_texts(df, "id", "text", "source", shares={"other": 1.0}).collect()
    assert (r["id"], r["source"], r["window"], r["start"]) == (None, "", 0, 0)
    with pytest.raises(ValueError):
        pack_texts(df, "id", "text", "source", capacity=0)


def test_faults_and_report(spark):
    """No fault in what was laid; each kind of fault is counted; the mixture's distance by hand."""
    from cairn.llm.packing import count_tokens, packing_faults, packing_report

    df = spark.createDataFrame(texts(3), "id int, source string, text string")
    laid, counted = pack_texts(df, "id", "text", "source", 256), count_tokens(df, "id", "text", "source")
    good = packing_faults(laid, counted, "id", 256).first()
    assert (good["n_overfull"], good["n_apart"], good["n_divided"], good["n_lost"]) == (0, 0, 0, 0) and good["n_texts"] == 201
    assert packing_report(laid, "source", 256).first()["fill"] > 0.98
    kind = "id int, source string, piece int, n_tokens long, part int, window int, start int"
    bad = spark.createDataFrame([(1, "x", 0, 6, 0, 0, 0), (1, "x", 1, 2, 0, 0, 8), (2, "y", 0, 4, 0, 1, 1)], kind)
    want = spark.createDataFrame([(1, "x", 0, 8), (2, "y", 0, 5)], "id int, source string, h long, n long")
    assert tuple(packing_faults(bad, want, "id", 9).first()) == (2, 1, 2, 1, 1)
    even = spark.createDataFrame([(1, "x", 0, 6, 0, 0, 0), (2, "y", 0, 2, 0, 0, 6), (3, "y", 0, 8, 0, 1, 0)], kind)
    found = packing_report(even, "source", 8).first()
    assert (found["windows"], found["fill"]) == (2, 1.0) and found["mean_distance"] == pytest.approx(0.375)


def test_parts_stay_small_without_ids(spark):
    """Rows without an id, and rows alike in all, are dealt to parts as evenly as others."""
    df = spark.createDataFrame([(None, "x", "alpha beta")] * 400, "id int, source string, text string")
    sizes = [r["count"] for r in pack_texts(df, "id", "text", "source", 256, texts_per_part=50).groupBy("part").count().collect()]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) < 100
