"""Chronological positions and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.encode import number_rows


def positions(df: DataFrame, order: Sequence[str], user: str = "user") -> DataFrame:
    """``df`` with pos, from 0 in the user's order, and n, the user's rows. ``order`` must be a total order.

    All rows are numbered by (user, order); a position is a row's number less the user's first. A user with a
    third of all rows is sorted in many tasks, and none ever holds it whole.
    """
    rows = number_rows(df, user, *order, name="__no")
    users = rows.groupBy(user).agg(F.min("__no").alias("__first"), F.count(F.lit(1)).cast("int").alias("n"))
    return rows.join(users, user).withColumn("pos", (F.col("__no") - F.col("__first")).cast("int")).drop("__no", "__first")


def chronological_split(df: DataFrame, order: Sequence[str], user: str = "user", check: bool = True) -> DataFrame:
    """``positions`` with split: the first 80 % of a user's rows are train, the next 10 % val, the rest test.

    Every split holds a row of every user: an empty val takes one from test if that has more than one,
    else from train. Users with fewer than three rows raise an error.
    """
    if check and df.groupBy(user).agg(F.count(F.lit(1)).alias("n")).where("n < 3").limit(1).count():
        raise ValueError("every user needs three rows or more")
    rows = positions(df, order, user)
    sized = rows.withColumns({"t": F.expr("n * 8 div 10"), "v": F.expr("n div 10")}).withColumn("e", F.expr("n - t - v"))
    train = F.expr("t - IF(v = 0 AND e <= 1, 1, 0)")
    return sized.withColumn("cut", train).withColumn(
        "split", F.when(F.col("pos") < F.col("cut"), "train").when(F.col("pos") < F.col("cut") + F.greatest("v", F.lit(1)), "val").otherwise("test")
    ).drop("t", "v", "e", "cut", "n")


def latest(df: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """(split, user, item): the last row of each split of each user."""
    return df.groupBy("split", user).agg(F.max_by(item, "pos").alias(item))


def dataset_stats(raw: DataFrame, core: DataFrame, split: DataFrame, minimum: int, negatives: int, seed: int) -> DataFrame:
    """One row of counts and ratios over the whole data set."""
    found = split.agg(
        F.count(F.lit(1)).alias("n_interactions"),
        F.count_distinct("user").alias("n_users"),
        F.count_distinct("item").alias("n_items"),
        *(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    for s in ("train", "val", "test"):
        found = found.withColumn(f"ratio_{s}", F.round(F.col(f"n_{s}") / F.col("n_interactions"), 6))
    per_user = core.groupBy("user").count().agg(F.min("count").alias("min_user_rows"))
    per_item = core.groupBy("item").count().agg(F.min("count").alias("min_item_rows"))
    fixed = {"n_raw": raw.count(), "min_interactions": minimum, "negatives": negatives, "seed": seed}
    fixed |= {c: df.first()[0] for c, df in (("min_user_rows", per_user), ("min_item_rows", per_item))}
    return found.withColumns({c: F.lit(v).cast("long") for c, v in fixed.items()})
