"""Operators of the recommendation pipeline on small cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.config import PrepareConfig, RerankWeights, TrainConfig, fingerprint
from cairn.operators import candidates, profiles, quality, rerank, retrieval, scoring, split, training, validation
from cairn.operators.encode import dense_ids, number_rows, require_known
from cairn.operators.kcore import k_core


@pytest.mark.parametrize("one_task", [0, 4, 1000])
def test_k_core_rounds(spark, rows, one_task):
    """Dropping item 9 leaves user 3 one row short, which drops them in the next round; by rounds of the cluster, of one task, or of both."""
    data = [(1, 7), (1, 8), (2, 7), (2, 8), (3, 8), (3, 9)]
    core, kept = k_core(spark.createDataFrame(data, "user int, item int"), 2, one_task=one_task)
    assert rows(core) == data[:4] and kept == [5, 4, 4]
    with pytest.raises(ValueError, match="empty core"):
        k_core(spark.createDataFrame(data, "user int, item int"), 5, one_task=one_task)
    with pytest.raises(ValueError, match="empty core"):
        k_core(spark.createDataFrame([], "user int, item int"), 1, one_task=one_task)
    whole, kept = k_core(spark.createDataFrame(data, "user int, item int"), 1, one_task=one_task)
    assert rows(whole) == data and kept == [6]
    odd, kept = k_core(spark.createDataFrame([*data, (None, 7), (None, 7), (1, None)], "user int, item int"), 2, one_task=one_task)
    assert rows(odd) == data[:4] and kept == [5, 4, 4]


def test_k_core_counts_rows(spark):
    assert k_core(spark.createDataFrame([(1, 7)] * 3, "user int, item int"), 3)[0].count() == 3


@pytest.mark.parametrize("n,want", [(3, (1, 1, 1)), (4, (2, 1, 1)), (9, (7, 1, 1)), (10, (8, 1, 1)), (15, (12, 1, 2)), (29, (23, 2, 4))])
def test_split_sizes(spark, n, want):
    df = spark.createDataFrame([(1, i, 5) for i in range(n)], "user int, item int, ts long")
    found = split.chronological_split(df, ["ts", "item"]).collect()
    assert tuple(sum(r["split"] == s for r in found) for s in ("train", "val", "test")) == want
    assert [r["item"] for r in sorted(found, key=lambda r: r["pos"])] == list(range(n))


def test_split_needs_three_rows(spark):
    with pytest.raises(ValueError):
        split.chronological_split(spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "user int, item int, ts long"), ["ts"])


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_numbers_do_not_depend_on_partitions(spark, rows, parts):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int").repartition(parts)
    assert rows(number_rows(df, "x")) == [(i, i) for i in range(101)]
    assert rows(dense_ids(spark.createDataFrame([(5,), (3,), (5,), (None,)], "x int"), "x", "id")) == [(3, 0), (5, 1)]


def test_reference_check(spark):
    known = spark.createDataFrame([(1,)], "item int")
    require_known(known, known, "item")
    with pytest.raises(ValueError, match="item 2"):
        require_known(spark.createDataFrame([(2,)], "item int"), known, "item")


def test_genres_and_profiles(spark, rows):
    items = spark.createDataFrame([(1, "b|a|b"), (2, None), (3, "")], "item int, genres string")
    mine = profiles.item_genres(items)
    none = "(no genres listed)"
    assert rows(mine) == [(1, "a"), (1, "b"), (2, none), (3, none)]
    train = spark.createDataFrame([(9, 1), (9, 1), (9, 2)], "user int, item int")
    assert rows(profiles.user_profiles(train, profiles.item_shares(mine))) == [(9, none, pytest.approx(1 / 3)), (9, "a", pytest.approx(1 / 3)), (9, "b", pytest.approx(1 / 3))]
    assert rows(profiles.multi_hot(mine, profiles.vocabulary(mine)))[0] == (1, [0.0, 1.0, 1.0])


def test_candidates(spark):
    items = spark.createDataFrame([(i * 10,) for i in range(30)], "item int")
    seen = spark.createDataFrame([(1, i * 10) for i in range(20)] + [(2, 0)], "user int, item int")
    users = seen.select("user").distinct().withColumn("split", F.explode(F.array(F.lit("val"), F.lit("test"))))
    draw = lambda n, users=users: candidates.negatives(users, seen, items, n, {"val": 3, "test": 4}).collect()
    found = draw(10)
    mine = [r["item"] for r in found if r["user"] == 1 and r["split"] == "val"]
    assert sorted(mine) == [i * 10 for i in range(20, 30)] and len(found) == 40
    assert sorted(map(tuple, found)) == sorted(map(tuple, draw(10, users.repartition(3))))
    two = {s: [r["item"] for r in sorted(found, key=lambda r: r["pos"]) if r["user"] == 2 and r["split"] == s] for s in ("val", "test")}
    assert two["val"] != two["test"] and all(len(set(x)) == 10 and 0 not in x for x in two.values())
    with pytest.raises(ValueError, match="unseen"):
        draw(11)


@pytest.mark.parametrize("block", [2, 100])
def test_candidate_scores_both_ways(spark, rows, block):
    """One broadcast block and the joins give the same; a bias counts; users and items without a vector drop out."""
    items = spark.createDataFrame([(i, [float(i), 1.0], 0.5 if i else None) for i in range(3)], "item int, vec array<double>, bias double")
    users = spark.createDataFrame([(1, [2.0, -1.0])], "user int, vec array<double>")
    cands = spark.createDataFrame([("test", 1, 2), ("val", 1, 2), ("test", 1, 0), ("test", 1, 9), ("test", 5, 1)], "split string, user int, item int")
    found = scoring.candidate_scores(cands, users, items, digits=3, block=block)
    assert rows(found) == [("test", 1, 0, -1.0), ("test", 1, 2, 3.5), ("val", 1, 2, 3.5)]


def test_ranks_are_pessimistic(spark, rows):
    data = [("test", 1, True, 0.5), ("test", 1, False, 0.5), ("test", 1, False, 0.7), ("test", 1, False, 0.1), ("test", 2, True, 1.0), ("test", 2, False, 0.0)]
    ranks = scoring.positive_ranks(spark.createDataFrame(data, "split string, user int, is_positive boolean, score double"))
    assert rows(ranks) == [("test", 1, 3), ("test", 2, 1)]
    found = scoring.ranking_metrics(ranks, [1, 3]).first()
    assert (found["hr_1"], found["hr_3"]) == (0.5, 1.0)
    assert found["ndcg_3"] == pytest.approx((1 + 0.5) / 2) and found["mrr_3"] == pytest.approx((1 + 1 / 3) / 2)
    with pytest.raises(ValueError):
        scoring.require_finite(spark.createDataFrame([([1.0, float("nan")],)], "vec array<double>"))


@pytest.mark.parametrize("block", [3, 1000])
def test_retrieval_in_blocks(spark, rows, block):
    """Any block size gives the same; ties go to the smaller item; seen items stay out; k must be below n."""
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(12, 4)), 1)
    items = spark.createDataFrame([(i, [float(x) for x in r], 0.0) for i, r in enumerate(v)], "item int, vec array<double>, bias double")
    queries = spark.createDataFrame([(7, [1.0, 0.0, 0.0, 0.0], [0, 1, 2])], "query int, vec array<double>, seen array<int>")
    want = sorted(range(3, 12), key=lambda i: (-v[i, 0], i))[:5]
    assert [r[2] for r in rows(retrieval.top_k(queries, items, 5, block=block))] == want
    with pytest.raises(ValueError):
        retrieval.top_k(queries, items, 12)
    near = retrieval.item_neighbours(items, 3)
    assert near.where("item = neighbor").count() == 0 and near.count() == 36


def test_blocks_equal_expressions(spark):
    """The matrix products of blocks and the expression on arrays give the same scores."""
    from cairn.functions.vectors import dot
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, [float(x) for x in r], 0.0) for i, r in enumerate(rng.normal(size=(9, 5)))], "item int, vec array<double>, bias double")
    queries = items.select(F.col("item").alias("query"), F.col("vec"), F.array("item").alias("seen"))
    found = {(r["query"], r["item"]): r["score"] for r in retrieval.top_k(queries, items, 8).collect()}
    pairs = queries.select("query", F.col("vec").alias("u")).join(items, F.col("query") != F.col("item")).select("query", "item", dot(F.col("u"), F.col("vec")).alias("s"))
    assert found == {(r["query"], r["item"]): pytest.approx(r["s"], abs=1e-6) for r in pairs.collect()}


def test_few_unseen_items_give_fewer_rows(spark):
    items = spark.createDataFrame([(i, [1.0]) for i in range(4)], "item int, vec array<double>")
    users = spark.createDataFrame([(1, [1.0])], "user int, vec array<double>")
    train = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "user int, item int")
    assert retrieval.recommend(users, items, train, 3).count() == 1


def test_calibration_bounds(spark, rows):
    profile = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.5), (2, "b", 0.5)], "user int, genre string, p double")
    mix = spark.createDataFrame([(1, "b", 1.0), (2, "a", 0.5), (2, "b", 0.5)], "user int, genre string, q double")
    found = dict(rows(quality.calibration(profile, mix)))
    assert found[1] == pytest.approx(0, abs=1e-9) and found[2] == pytest.approx(1)


def test_diversity_by_sums_equals_pairs(spark, rows):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(6, 3))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = [1 - unit[i] @ unit[j] for i in range(6) for j in range(i + 1, 6)]
    lists = spark.createDataFrame([(1, i, i + 1) for i in range(6)] + [(2, 0, 1)], "user int, item int, rank int")
    features = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "item int, vec array<double>")
    assert rows(quality.diversity(lists, features)) == [(1, pytest.approx(np.mean(pairs))), (2, None)]


def test_greedy_choice():
    """All relevance: in order of score, ties by rank. All diversity: the opposite of the first comes second."""
    unit = np.array([[1.0, 0], [1, 0], [-1, 0]])
    shares, profile = np.eye(3), np.ones(3) / 3
    by_score = rerank.choose(np.array([1.0, 1.0, 0.0]), profile, shares, unit, 2, RerankWeights(1, 0, 0), None)
    assert [i for i, _ in by_score] == [0, 1]
    apart = rerank.choose(np.array([1.0, 0.9, 0.0]), profile, shares, unit, 2, RerankWeights(0, 0, 1), None)
    assert [i for i, _ in apart] == [0, 2] and apart[1][1] == 1.0
    with pytest.raises(ValueError):
        RerankWeights(0.5, 0.5, 0.5)
    with pytest.raises(ValueError):
        RerankWeights(1.5, -0.5, 0)


def test_greedy_needs_enough_candidates(spark):
    lists = spark.createDataFrame([(1, 1, 5, 0.3)], "user int, rank int, item int, score double")
    features = spark.createDataFrame([(5, [1.0])], "item int, vec array<double>")
    shares = spark.createDataFrame([(5, "a", 1.0)], "item int, genre string, share double")
    mine = spark.createDataFrame([(1, "a", 1.0)], "user int, genre string, p double")
    with pytest.raises(ValueError):
        rerank.greedy_rerank(lists, mine, shares, features, 2)
    assert rerank.greedy_rerank(lists, mine, shares, features, 1).first()["objective"] == pytest.approx(0.15)


def test_gradients_match_differences():
    rng = np.random.default_rng(4)
    args = [rng.normal(size=(5, 3)) for _ in range(3)] + [rng.normal(size=5) for _ in range(2)]
    loss, *grads = training.mf_loss(*args, 0.1)
    for x, g in zip(args, grads):
        at = (1,) * x.ndim
        x[at] += 1e-6
        up = training.mf_loss(*args, 0.1)[0]
        x[at] -= 1e-6
        assert g[at] == pytest.approx((up - loss) / 1e-6, abs=1e-5)
    tower = training.Tower.new(4, 6, 3, rng)
    x, dy = rng.normal(size=(5, 4)), rng.normal(size=(5, 3))
    y, kept = tower.forward(x)
    parts, dx = tower.backward(y, kept, dy)
    assert np.allclose(np.linalg.norm(y, axis=1), 1)
    for p, g in [*zip(tower.parts(), parts), (x, dx)]:
        at = (0,) * p.ndim
        p[at] += 1e-6
        up = (tower.forward(x)[0] * dy).sum()
        p[at] -= 1e-6
        assert g[at] == pytest.approx((up - (y * dy).sum()) / 1e-6, abs=1e-4)


def test_unseen_items_are_drawn_evenly():
    """User 0 has all but 4, user 1 only 2, user 2 nothing: every unseen item comes, as often as any other."""
    unseen = training.Unseen(np.array([0, 0, 0, 0, 1, 1]), np.array([0, 1, 2, 3, 2, 2]), 3, 5)
    rng = np.random.default_rng(1)
    assert list(unseen.left()) == [1, 4, 5]
    assert set(unseen.draw(np.zeros(50, dtype=int), rng)) == {4}
    for user, want in ((1, {0, 1, 3, 4}), (2, set(range(5)))):
        drawn = unseen.draw(np.full(4000, user), rng)
        items, counts = np.unique(drawn, return_counts=True)
        assert set(items) == want and counts.min() > 0.8 * 4000 / len(want)


@pytest.mark.parametrize("block_rows,item_block", [(1_000_000, 1000), (40, 1000), (1_000_000, 15)])
def test_training_learns(spark, block_rows, item_block):
    """Two groups of users with items of their own; with users spread over blocks, and with items in several blocks."""
    rng = np.random.default_rng(0)
    data = [(u, int(i) + 20 * (u % 2)) for u in range(20) for i in rng.choice(20, 12, replace=False)] + [(0, i) for i in (0, 1, 2)] * 5
    config = TrainConfig(dim=8, epochs=3, batch_size=64, steps_per_epoch=300, blocks=2)
    catalogue = spark.range(40).select(F.col("id").cast("int").alias("item"))
    model = training.train(spark.createDataFrame(data, "user int, item int"), catalogue, config, block_rows=block_rows, item_block=item_block)
    users, items = model.vectors("users").collect(), sorted(model.vectors("items").collect())
    assert model.losses[-1] < model.losses[0] < 0.75 and len(users) == 20 and len(items) == 40
    vec, bias = np.array([r["vec"] for r in items]), np.array([r["bias"] for r in items])
    scores = {r["id"]: vec @ np.array(r["vec"]) + bias for r in users}
    assert np.mean([s[20 * (u % 2) :][:20].mean() > s.mean() for u, s in scores.items()]) > 0.9


def test_a_stratum_keeps_pieces_not_rows(spark, monkeypatch):
    """What a stratum keeps are some pieces of state, though each user and item has one row in the model."""
    kept, settle = [], training.settle
    monkeypatch.setattr(training, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    data = spark.range(12_000).select((F.col("id") % 6000).cast("int").alias("user"), (F.col("id") * 7 % 5000).cast("int").alias("item"))
    config = TrainConfig(dim=2, batch_size=64, steps_per_epoch=16, blocks=2)
    model = training.train(data, spark.range(5000).select(F.col("id").cast("int").alias("item")), config, item_block=3000)
    assert kept[-1].count() < 50
    for rows, n in ((model.users, 6000), (model.items, 5000)):
        assert rows.count() == rows.select("id").distinct().count() == rows.where(F.size("x") == 9).count() == n


def test_a_step_of_the_towers(monkeypatch):
    """Positives and negatives pass together and all weights step at once, as if each had by itself."""
    rng = np.random.default_rng(5)
    config = TrainConfig("two-tower", dim=3, hidden=6)
    parts = [x for _ in range(2) for x in training.Tower.new(5, 6, 3, rng).parts()]
    shapes, count = [x.shape for x in parts], sum(x.size for x in parts)
    flat = np.concatenate([*(x.ravel() for x in parts), rng.normal(size=count) / 9, rng.random(count) / 9])
    towers, old = training.Towers.of(flat, shapes, 4, config), flat.copy()
    users, items = (training.Rows(np.hstack([rng.normal(size=(7, 4)), np.zeros((7, 8))]), 3, 4, 0.01) for _ in range(2))
    profile, hot, (u, p, n) = rng.random((7, 2)), rng.random((7, 2)), rng.integers(0, 7, (3, 20))
    inputs = [np.hstack([x[ids, :3], f[ids]]) for x, f, ids in ((users.state.copy(), profile, u), (items.state.copy(), hot, p), (items.state.copy(), hot, n))]
    mine, theirs = training.Tower(*parts[:4]), training.Tower(*parts[4:])
    (yu, ku), (yp, kp), (yn, kn) = (t.forward(x) for t, x in zip((mine, theirs, theirs), inputs))
    loss, du, dp, dn = training.tower_loss(yu, yp, yn)
    grads = mine.backward(yu, ku, du)[0] + [a + b for a, b in zip(theirs.backward(yp, kp, dp)[0], theirs.backward(yn, kn, dn)[0])]
    want = []
    for x, m, v, g in zip(parts, *(training.unpack(y, shapes) for y in np.split(old, 3)[1:]), grads):
        x, adam = x.copy(), training.LazyAdam(m.copy(), v.copy(), 4, config.learning_rate, config.weight_decay)
        adam.step(x, slice(None), g)
        want.append(x.ravel())
    steps, step = [], training.LazyAdam.step
    monkeypatch.setattr(training.LazyAdam, "step", lambda *a: steps.append(1) or step(*a))
    assert training._tower_steps(users, items, (towers, profile, hot), u, p, n, config) == pytest.approx(loss)
    assert np.allclose(towers.flat()[:count], np.concatenate(want)) and len(steps) == 3 and np.array_equal(flat, old)


def test_pieces_are_averaged_by_touches():
    """Rows of several units by how often each was touched; a row none touched stays as it was."""
    sent = [(np.array([1.0, 5.0, 7.0]), np.array([1, 2, 0])), (np.array([4.0, 3.0, 7.0]), np.array([2, 0, 0]))]
    batches = [training._batch([("item", 0, 3, np.arange(3), x, w)], training._PIECE) for x, w in sent]
    (found,) = training._merged(iter(batches))
    assert np.allclose(np.frombuffer(found["x"][0].as_py()), [3.0, 5.0, 7.0]) and found["piece"][0].as_py() == 3


def test_first_state_is_normal_and_of_the_id_alone():
    config = TrainConfig(dim=16)
    first = training.fresh(1, np.arange(5000), config)
    assert np.array_equal(first[[7, 4000]], training.fresh(1, np.array([7, 4000]), config)) and not first[:, 16:].any()
    assert abs(first[:, :16].mean()) < 0.001 and first[:, :16].std() == pytest.approx(0.05, rel=0.02)
    assert abs(np.corrcoef(first[:, :16].T) - np.eye(16)).max() < 0.06 and not np.isin(first[:, 0], training.fresh(2, np.arange(5000), config)[:, 0]).any()


def test_a_user_of_all_items_stops_training(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3)], "user int, item int")
    with pytest.raises(Exception, match="seen every item"):
        training.train(rows, rows.select("item"), TrainConfig(dim=2, batch_size=4, blocks=1))
    with pytest.raises(ValueError, match="no training rows"):
        training.train(rows.limit(0), rows.select("item"), TrainConfig())


def test_a_saved_model_gives_the_same_vectors(spark, rows, tmp_path):
    data = spark.createDataFrame([(u, i) for u in range(6) for i in range(u % 3, 8, 2)], "user int, item int")
    profiles = spark.createDataFrame([(u, [u / 6, 1 - u / 6]) for u in range(6)], "user int, profile array<double>")
    hot = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "item int, hot array<float>")
    config = TrainConfig("two-tower", dim=4, hidden=6, batch_size=8, blocks=2)
    model = training.train(data, hot.select("item"), config, profiles, hot)
    model.save(str(tmp_path / "m"))
    features = hot.select(F.col("item").cast("long").alias("id"), F.col("hot").cast("array<double>").alias("features"))
    again = training.Model.load(spark, str(tmp_path / "m"), config)
    assert rows(model.vectors("items", features)) == rows(again.vectors("items", features))
    assert all(np.linalg.norm(r["vec"]) == pytest.approx(1) for r in again.vectors("items", features).collect()) and again.items.count() == 9


def test_settings():
    for bad in ({"model": "als"}, {"steps_per_epoch": 0}, {"epochs": 0}):
        with pytest.raises(ValueError):
            TrainConfig(**bad)
    with pytest.raises(ValueError):
        PrepareConfig(max_rows=0)
    assert fingerprint(PrepareConfig(seed=1)) != fingerprint(PrepareConfig(seed=2))
    assert [PrepareConfig(seed=5).negative_seed(s) for s in ("val", "test", "train")] == [6, 7, 36]


def test_report_finds_violations(spark):
    lists = spark.createDataFrame([(1, 1, 5, 0.1), (1, 2, 5, 0.9)], "user int, rank int, item int, score double")
    found = {r["check"]: r["ok"] for r in validation.report(validation.list_checks("x", lists, "score", 2)).collect()}
    assert found == {"x_unique": False, "x_length": True, "x_sorted": False}
    with pytest.raises(ValueError, match="x_sorted"):
        validation.require_ok(validation.report(validation.list_checks("x", lists, "score", 2)))


def test_metric_terms(spark):
    from cairn.functions.metrics import gain, hit, reciprocal
    from pyspark.sql import functions as F

    row = spark.range(3, 4).select(hit(F.col("id"), 2), hit(F.col("id"), 3), gain(F.col("id"), 3), reciprocal(F.col("id"), 3)).first()
    assert tuple(row) == (0.0, 1.0, pytest.approx(1 / math.log2(4)), pytest.approx(1 / 3))


def test_neighbour_lists_are_as_long_as_the_references(spark):
    from cairn.plans.reference import QUERIES

    found = QUERIES["item_neighbors"](spark, "/root/testdata/sf0.001").groupBy("item").count()
    assert {r["count"] for r in found.collect()} == {200}
