"""Invariants over the tables of a run, as one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _none(df: DataFrame, name: str) -> DataFrame:
    """The check holds if ``df`` has no row; counts the rows against it."""
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def split_checks(split: DataFrame, minimum: int) -> list[DataFrame]:
    users = split.select("user").distinct()
    times = split.groupBy("user").agg(
        *(f(F.when(F.col("split") == s, F.col("ts"))).alias(f"{n}_{s}") for s in ("train", "val", "test") for n, f in (("lo", F.min), ("hi", F.max)))
    )
    checks = [_none(users.join(split.where(F.col("split") == s).select("user"), "user", "left_anti"), f"{s}_all_users_present") for s in ("train", "val", "test")]
    checks.append(_none(times.where("hi_train > lo_val"), "train_before_val"))
    checks.append(_none(times.where("hi_val > lo_test"), "val_before_test"))
    for key in ("item", "user"):
        checks.append(_none(split.groupBy(key).count().where(F.col("count") < minimum), f"minimum_{key}_interactions"))
    return checks


def stats_checks(split: DataFrame, stats: dict) -> list[DataFrame]:
    """The rows of each split are as many as the statistics say."""
    counts = split.agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")))
    return [_none(counts.where(F.col(s) != F.lit(stats[f"n_{s}"])), f"{s}_count_matches_stats") for s in ("train", "val", "test")]


def profile_checks(profiles: DataFrame, tolerance: float = 1e-5) -> list[DataFrame]:
    sums = profiles.groupBy("user").agg(F.sum("p").alias("s"))
    return [_none(sums.where(F.abs(F.col("s") - 1) > tolerance), "profiles_sum_to_one")]


def candidate_checks(candidates: DataFrame, latest: DataFrame, history: DataFrame) -> list[DataFrame]:
    negative = candidates.where(~F.col("is_positive"))
    positive = candidates.where("is_positive")
    return [
        _none(positive.join(latest, ["split", "user", "item"], "left_anti"), "positive_is_latest"),
        _none(negative.join(history.select("user", "item").distinct(), ["user", "item"], "left_semi"), "negatives_unseen"),
        _none(candidates.groupBy("split", "user", "item").count().where("count > 1"), "candidates_unique"),
    ]


def grouping_checks(split: DataFrame) -> list[DataFrame]:
    """A user's rows are one run of positions from 0, each once, and every split is one run of them, in order."""
    users = split.groupBy("user").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("d"))
    ends = split.groupBy("user").agg(*(f(F.when(F.col("split") == s, F.col("pos"))).alias(f"{n}_{s}") for s in ("train", "val", "test") for n, f in (("lo", F.min), ("hi", F.max))))
    return [
        _none(users.where("lo <> 0 OR hi <> n - 1 OR d <> n"), "grouped_by_user"),
        _none(ends.where("hi_train + 1 <> lo_val OR hi_val + 1 <> lo_test"), "splits_follow_each_other"),
    ]


def shape_checks(split: DataFrame, profiles: DataFrame, genres: DataFrame, candidates: DataFrame, negatives: int) -> list[DataFrame]:
    """Profiles cover all users, genres all items, and each user's candidates in val and test are one more than the negatives."""
    users, items = split.select("user").distinct(), split.select("item").distinct()
    sizes = users.withColumn("split", F.explode(F.array(F.lit("val"), F.lit("test"))))
    sizes = sizes.join(candidates.groupBy("split", "user").agg(F.count(F.lit(1)).alias("n")), ["split", "user"], "full")
    return [
        _none(users.join(profiles, "user", "left_anti").unionByName(profiles.select("user").distinct().join(users, "user", "left_anti")), "profiles_shape"),
        _none(items.join(genres, "item", "left_anti").unionByName(genres.select("item").distinct().join(items, "item", "left_anti")), "genres_shape"),
        _none(sizes.where(F.coalesce("n", F.lit(0)) != negatives + 1), "candidates_shape"),
    ]


def list_checks(name: str, lists: DataFrame, score: str, k: int, key: str = "user", item: str = "item", open_items: DataFrame | None = None) -> list[DataFrame]:
    """Lists are unique, as long as they should be, and sorted: a row's score is at most the one's before.

    A list should have ``k`` rows, or as many as ``open_items`` (key, n) leaves where that is fewer; then a key without a list
    is a fault as well. Neighbouring ranks meet in an equi-join on rank + 1, which needs no window.
    """
    before = lists.select(key, (F.col("rank") + 1).alias("rank"), F.col(score).alias("before"))
    sizes = lists.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    if open_items is not None:
        sizes = sizes.join(open_items.select(key, "n"), key, "full").withColumn("count", F.coalesce("count", F.lit(0)))
        sizes = sizes.withColumn("k", F.least(F.lit(k), F.coalesce("n", F.lit(0))))
    return [
        _none(lists.groupBy(key, item).count().where("count > 1"), f"{name}_unique"),
        _none(sizes.where(F.col("count") != (F.lit(k) if open_items is None else F.col("k"))), f"{name}_length"),
        _none(lists.join(before, [key, "rank"]).where(F.col(score) > F.col("before")), f"{name}_sorted"),
    ]


def unseen_counts(users: DataFrame, train: DataFrame, items: DataFrame) -> DataFrame:
    """(user, n): how many of the items a user does not have in training."""
    known = items.select("item").distinct()
    seen = train.join(known, "item", "left_semi").groupBy("user").agg(F.count_distinct("item").alias("seen"))
    return users.select("user").distinct().join(seen, "user", "left").select("user", (F.lit(known.count()) - F.coalesce("seen", F.lit(0))).alias("n"))


def containment_check(name: str, part: DataFrame, whole: DataFrame) -> DataFrame:
    return _none(part.join(whole, ["user", "item"], "left_anti"), name)


def unseen_check(name: str, lists: DataFrame, train: DataFrame) -> DataFrame:
    return _none(lists.join(train.select("user", "item").distinct(), ["user", "item"], "left_semi"), name)


def self_check(neighbours: DataFrame) -> DataFrame:
    return _none(neighbours.where("item = neighbor"), "neighbours_exclude_self")


def embedding_checks(name: str, vectors: DataFrame, dim: int, unit: bool) -> list[DataFrame]:
    from cairn.functions.vectors import finite, norm

    checks = [_none(vectors.where((F.size("vec") != dim) | ~finite(F.col("vec"))), f"{name}_finite")]
    return checks + ([_none(vectors.where(F.abs(norm(F.col("vec")) - 1) > 1e-4), f"{name}_unit_length")] if unit else [])


def report(checks: list[DataFrame]) -> DataFrame:
    """(check, violations, ok)."""
    found = checks[0]
    for c in checks[1:]:
        found = found.unionByName(c)
    return found.select("check", "violations", (F.col("violations") == 0).alias("ok"))


def require_ok(found: DataFrame) -> None:
    bad = [r["check"] for r in found.where(~F.col("ok")).collect()]
    if bad:
        raise ValueError("validation failed: " + ", ".join(sorted(bad)))
