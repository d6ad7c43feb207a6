"""Calibration and diversity of recommended lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.metrics import kl_term
from cairn.functions.vectors import normalised
from cairn.session import settle


def list_mix(lists: DataFrame, shares: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """(user, genre, q): the mean of the genre shares of a list's items."""
    sizes = lists.groupBy(user).agg(F.count(F.lit(1)).alias("size"))
    mass = lists.join(shares, item).groupBy(user, "genre").agg(F.sum("share").alias("w"))
    return mass.join(sizes, user).select(user, "genre", (F.col("w") / F.col("size")).alias("q"))


def calibration(profiles: DataFrame, mix: DataFrame, user: str = "user") -> DataFrame:
    """(user, calibration): 1 less the Jensen-Shannon divergence in bits; 1 is the same mix, 0 no genre in common.

    Genres on one side only count as well: both sides are united and summed, not joined. Both are normalised.
    """
    both = profiles.select(user, "genre", "p", F.lit(0.0).alias("q")).unionByName(mix.select(user, "genre", F.lit(0.0).alias("p"), "q"))
    both = both.groupBy(user, "genre").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    whole = W.partitionBy(user)
    both = both.select(user, *((F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1e-12))).alias(c) for c in "pq"))
    m = (F.col("p") + F.col("q")) / 2
    found = both.groupBy(user).agg((1 - (F.sum(kl_term(F.col("p"), m)) + F.sum(kl_term(F.col("q"), m))) / 2 / F.ln(F.lit(2.0))).alias("calibration"))
    return found


def diversity(lists: DataFrame, features: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """(user, ild): the mean of 1 - cosine over the pairs of a list; null for a list of one item.

    From the length of the sum of unit vectors, so that no pair becomes a row. ``features``: (item, vec).
    """
    unit = features.select(item, normalised(F.col("vec")).alias("v"))
    rows = lists.join(unit, item).select(user, F.posexplode("v").alias("d", "x"))
    sums = rows.groupBy(user, "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count(F.lit(1)).alias("n"))
    found = sums.groupBy(user).agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2.0
    return found.select(user, F.when(F.col("n") > 1, 1 - (F.col("all") - F.col("own")) / 2 / F.greatest(pairs, F.lit(1.0))).alias("ild"))


def list_quality(lists: DataFrame, profiles: DataFrame, shares: DataFrame, features: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """One row: mean and population deviation of calibration and diversity. Lists are settled, as three parts use them."""
    lists = settle(lists)
    found = calibration(profiles, list_mix(lists, shares, user, item), user).join(diversity(lists, features, user, item), user)
    return found.agg(
        F.avg("calibration").alias("calibration_mean"),
        F.stddev_pop("calibration").alias("calibration_std"),
        F.avg("ild").alias("ild_mean"),
        F.stddev_pop("ild").alias("ild_std"),
    )
