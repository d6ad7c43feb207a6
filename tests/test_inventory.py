"""What the quality queries hand to training, on a small train table and catalogue."""

import random

import pytest

from cairn.config import NO_GENRES
from cairn.operators import profiles
from cairn.plans import inventory

NAMES = ["Spy", "Sport", "Space Opera", "Sea Epic", "Slow Western", "Family, Young", "Farmhouse Gothic", "Stop-Motion/Puppet"]


class Handed(Exception):
    pass


@pytest.fixture
def handed(spark, tmp_path, monkeypatch):
    """The tables that a kind of model is fitted to, and the genres meant for each item."""
    rng, want, movies, train = random.Random(11), {}, [], []
    for item in range(40):
        values = rng.sample(NAMES, rng.randint(1, 3)) if item > 3 else []
        want[item] = set(values) or {NO_GENRES}
        for joint in rng.sample(["|", ", ", ";", " / ", "\t"], 2 if item % 5 == 0 else 1):
            movies.append((len(movies), item, joint.join(f'"{v}"' if "," in v or "/" in v else v for v in values) or rng.choice([None, "", " "])))
        if item > 30:  # another listing names one more
            more = rng.choice(NAMES)
            movies.append((len(movies), item, f'"{more}"'))
            want[item].add(more)
    movies = [m for m in movies if m[1] != 3] + [(900 + n, None, f"{n}|Elsewhere") for n in range(3)]
    movies += [(910 + item, item, NO_GENRES) for item in (2, 32)]
    for user in range(40):
        train += [(user, (user + step) % 40, 1000 + user * 7 + step) for step in range(8)]
    spark.createDataFrame(movies, "catalog_pos int, item_idx int, genres string").write.parquet(f"{tmp_path}/movies.parquet")
    spark.createDataFrame(train, "user_idx int, item_idx int, ts long").write.parquet(f"{tmp_path}/train.parquet")
    found = {}

    def fit(data, config, **options):
        found.update(data)
        raise Handed

    monkeypatch.setattr(inventory, "fit", fit)

    def run(name):
        with pytest.raises(Handed):
            inventory.QUERIES[name](spark, str(tmp_path))
        return found, want

    return run


def test_towers_take_whole_genres(handed):
    """Every value of an item's listings in full, not its beginning, and of all listings; in no notation two values stay one."""
    data, want = handed("train_two_tower_quality")
    found = [(r["item"], r["genre"]) for r in data["item_genre"].collect()]
    assert len(found) == len(set(found)) and set(found) == {(i, g) for i, gs in want.items() for g in gs}
    assert [r["genre"] for r in profiles.vocabulary(data["item_genre"]).orderBy("genre_idx").collect()] == sorted([*NAMES, NO_GENRES])
    sums = data["profiles"].groupBy("user").agg({"p": "sum"}).collect()
    assert len(sums) == 40 and all(r[1] == pytest.approx(1) for r in sums)


def test_factors_take_no_genres(handed):
    data, _ = handed("train_mf_quality")
    assert set(data) == {"split", "catalogue"}
