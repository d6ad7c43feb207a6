"""The whole pipeline on a small data set of CSV files, and the file sources."""

import io
import random
import zipfile

import numpy as np
import pytest

from cairn.config import PrepareConfig, TrainConfig
from cairn.operators import validation
from cairn.plans import pipeline
from cairn.sources import files


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("raw"), random.Random(3)
    with open(folder / "movies.csv", "w") as f:
        f.write("movieId,title,genres\n")
        f.writelines(f'{i * 3},"Film ""{i}"", part {i % 3}",{"" if i == 7 else "|".join(rng.sample("ABCD", 2))}\n' for i in range(1, 31))
    with open(folder / "ratings.csv", "w") as f:
        f.write("userId,movieId,rating,timestamp\n")
        for u in range(1, 13):
            f.writelines(f"{u * 5},{i * 3},{rng.randint(1, 5)},{rng.randint(1, 99)}\n" for i in rng.sample(range(1, 31), 12))
    return str(folder)


def test_run_all(spark, raw, tmp_path):
    out = str(tmp_path)
    config = PrepareConfig(2, 5, 7)
    models = [TrainConfig("mf", dim=4, batch_size=16, blocks=2), TrainConfig("two-tower", dim=4, hidden=8, batch_size=16, blocks=2)]
    report = pipeline.run_all(spark, raw, out, config, models, top=6, keep=3, near=3)
    checks = {r["check"]: r["ok"] for r in report.collect()}
    assert all(checks.values()) and {"train_count_matches_stats", "two-tower_users_unit_length", "two-tower_neighbours_sorted"} <= set(checks)
    stats = files.load_json(f"{out}/stats.json")
    assert (stats["n_users"], stats["n_raw"]) == (12, 144) and stats["n_interactions"] == stats["n_train"] + stats["n_val"] + stats["n_test"]
    quality = files.load_json(f"{out}/mf_quality.json")
    assert 0 <= quality["calibration_mean"] <= 1 and quality["relevance"] == 0.7
    sample = spark.read.csv(f"{out}/mf_sample_recommendations", header=True, escape='"')
    assert sample.columns == ["user_idx", "userId", "rank", "item_idx", "movieId", "title", "genres", "rerank_score"] and sample.count() == 36
    assert "Film \"" in sample.first()["title"]
    (wrong,) = validation.stats_checks(spark.read.parquet(f"{out}/split"), stats | {"n_val": stats["n_val"] + 1})[1:2]
    assert wrong.first()["violations"] == 1
    assert spark.read.parquet(f"{out}/all_seen").count() == spark.read.parquet(f"{out}/train_seen").count() == 12
    again = pipeline.prepare(spark, raw, out, config)
    assert again["candidates"].count() == 12 * 2 * 6


def test_unknown_item_stops_the_run(spark, raw, tmp_path):
    bad = tmp_path / "raw"
    bad.mkdir()
    (bad / "movies.csv").write_text("movieId,title,genres\n1,A,x\n")
    (bad / "ratings.csv").write_text("userId,movieId,rating,timestamp\n1,2,3.0,4\n")
    with pytest.raises(ValueError, match="not in the catalogue"):
        pipeline.prepare(spark, str(bad), str(tmp_path / "out"), PrepareConfig(1, 1, 1))


def test_cache_follows_settings(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    one = lambda: spark.createDataFrame([(1,)], "x int")
    two = lambda: spark.createDataFrame([(2,)], "x int")
    assert rows(files.cached(spark, path, "a", one)) == [(1,)]
    assert rows(files.cached(spark, path, "a", two)) == [(1,)]
    assert rows(files.cached(spark, path, "b", two)) == [(2,)]
    assert rows(files.cached(spark, path, "b", one, force=True)) == [(1,)]


def test_new_ratings_are_not_met_by_old_tables(spark, raw, tmp_path):
    """Same settings, other ratings: every stage is made again."""
    import shutil

    other = shutil.copytree(raw, tmp_path / "raw")
    first = pipeline.prepare(spark, str(other), str(tmp_path / "out"), PrepareConfig(2, 5, 7))["split"].count()
    with open(other / "ratings.csv", "a") as f:
        f.write("5,3,4.0,999\n")
    assert pipeline.prepare(spark, str(other), str(tmp_path / "out"), PrepareConfig(2, 5, 7))["split"].count() == first + 1


def test_short_lists_of_users_with_few_items_left_are_legal(spark):
    lists = spark.createDataFrame([(1, 1, 5, 0.1), (2, 1, 5, 0.1)], "user int, rank int, item int, score double")
    left = lambda n: spark.createDataFrame([(1, 1), (2, n)], "user int, n int")
    assert [validation.list_checks("x", lists, "score", 2, open_items=left(n))[1].first()["violations"] for n in (1, 2)] == [0, 1]
    none = lists.where("user = 1")
    assert validation.list_checks("x", none, "score", 2, open_items=left(1))[1].first()["violations"] == 1


def test_grouping_and_shapes(spark):
    split = spark.createDataFrame([(1, 5, 0, "train"), (1, 6, 1, "val"), (1, 7, 2, "test")], "user int, item int, pos int, split string")
    profiles, genres = spark.createDataFrame([(1, "a", 1.0)], "user int, genre string, p double"), spark.createDataFrame([(5, "a"), (6, "a"), (7, "a")], "item int, genre string")
    cands = spark.createDataFrame([("val", 1, 6), ("val", 1, 9), ("test", 1, 7), ("test", 1, 9)], "split string, user int, item int")
    bad = lambda checks: [c.first()["check"] for c in checks if c.first()["violations"]]
    assert bad(validation.grouping_checks(split) + validation.shape_checks(split, profiles, genres, cands, 1)) == []
    assert bad(validation.grouping_checks(split.where("pos <> 1"))) == ["grouped_by_user"]
    assert bad(validation.shape_checks(split, profiles.limit(0), genres.limit(2), cands.limit(3), 1)) == ["profiles_shape", "genres_shape", "candidates_shape"]


def test_files(spark, tmp_path, rows):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "hello")
    assert (files.extract(str(tmp_path / "a.zip"), str(tmp_path / "out")) / "d/x.txt").read_text() == "hello"
    copy = files.fetch((tmp_path / "a.zip").as_uri(), str(tmp_path / "got/a.zip"))
    assert copy.read_bytes() == (tmp_path / "a.zip").read_bytes()
    copy.write_bytes(b"kept")
    assert files.fetch((tmp_path / "a.zip").as_uri(), str(copy)).read_bytes() == b"kept"
    damaged = (tmp_path / "a.zip").read_bytes().replace(b"hello", b"hellO", 1)
    (tmp_path / "b.zip").write_bytes(damaged)
    with pytest.raises(RuntimeError):
        files.extract(str(tmp_path / "b.zip"), str(tmp_path / "out2"))
    assert files.file_hashes(spark, str(tmp_path / "out/d/x.txt")).first()["sha256"].startswith("2cf24dba5fb0a30e")
    np.savez(tmp_path / "m.npz", ids=np.arange(3, dtype=np.int32), vec=np.ones((3, 2), dtype=np.float32))
    assert rows(files.read_arrays(spark, str(tmp_path / "m.npz"), ["ids", "vec"])) == [(i, [1.0, 1.0]) for i in range(3)]
    np.save(tmp_path / "m.npy", np.array([True, False]))
    assert rows(files.read_arrays(spark, str(tmp_path / "m.npy"))) == [(False,), (True,)]
    df = spark.createDataFrame([("train", 1, 5, 0), ("test", 1, 6, 1)], "split string, user int, item int, pos int")
    files.write_split(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'test'").count() == 1
    assert files.ragged(df).first()["items"] == [5, 6]
    made = files.write_arrays(spark.range(10).selectExpr("CAST(id AS INT) AS ids", "array(CAST(id AS FLOAT), 0.5F) AS vec").repartition(3), f"file:{tmp_path}/n")
    assert len(made) == 3 and rows(files.read_arrays(spark, str(tmp_path / "n"), ["vec", "ids"])) == [([float(i), 0.5], i) for i in range(10)]
    assert files.read_arrays(spark, str(tmp_path / "n"), ["ids"]).columns == ["ids"]
    lines = spark.range(50).selectExpr("id AS userId", "id AS movieId", "1.0F AS rating", "id AS timestamp")
    lines.repartitionByRange(4, "userId").sortWithinPartitions("userId").write.option("header", True).csv(str(tmp_path / "c"))
    assert [r[0] for r in rows(files.read_ratings(spark, str(tmp_path / "c"), 17))] == list(range(17))
    files.save_json(str(tmp_path / "j/x.json"), {"b": "é", "a": 1})
    assert (tmp_path / "j/x.json").read_text(encoding="utf-8") == '{\n  "a": 1,\n  "b": "é"\n}\n'
    assert io.BytesIO(b"") and files.load_json(str(tmp_path / "j/x.json")) == {"a": 1, "b": "é"}
