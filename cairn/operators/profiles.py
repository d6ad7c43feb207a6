"""Genres of items and genre profiles of users, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.config import NO_GENRES


def item_genres(items: DataFrame, item: str = "item", genres: str = "genres") -> DataFrame:
    """(item, genre), each once. Null and empty fields are a genre of their own."""
    field = F.coalesce(F.nullif(F.col(genres), F.lit("")), F.lit(NO_GENRES))
    return items.select(item, F.explode(F.array_distinct(F.split(field, r"\|"))).alias("genre"))


def vocabulary(of_items: DataFrame) -> DataFrame:
    """(genre_idx, genre) in alphabetical order. As long as there are genres, which is few."""
    return of_items.select("genre").distinct().withColumn("genre_idx", F.row_number().over(W.orderBy("genre")) - 1).select("genre_idx", "genre")


def multi_hot(of_items: DataFrame, vocab: DataFrame, item: str = "item") -> DataFrame:
    """(item, hot): an array of 0 and 1 as long as the vocabulary."""
    names = [r["genre"] for r in vocab.orderBy("genre_idx").collect()]
    mine = of_items.groupBy(item).agg(F.collect_set("genre").alias("gs"))
    return mine.select(item, F.transform(F.lit(names), lambda g: F.array_contains("gs", g).cast("float")).alias("hot"))


def item_shares(of_items: DataFrame, item: str = "item") -> DataFrame:
    """(item, genre, share): an item's mass in equal parts."""
    return of_items.withColumn("share", 1.0 / F.count(F.lit(1)).over(W.partitionBy(item)))


def user_profiles(train: DataFrame, shares: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """(user, genre, p): the genre mass of the user's training rows, repeated ones repeatedly, summing to 1.

    Rows are counted per (user, item) before the genres multiply them.
    """
    times = train.groupBy(user, item).agg(F.count(F.lit(1)).alias("times"))
    mass = times.join(shares, item).groupBy(user, "genre").agg(F.sum(F.col("times") * F.col("share")).alias("w"))
    return mass.select(user, "genre", (F.col("w") / F.greatest(F.sum("w").over(W.partitionBy(user)), F.lit(1e-12))).alias("p"))
