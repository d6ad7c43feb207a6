"""Candidates for sampled evaluation: a positive, and negatives drawn from the unseen items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators.encode import dense_ids
from cairn.session import settle


def negatives(users: DataFrame, seen: DataFrame, items: DataFrame, n: int, seeds: dict[str, int], user: str = "user", item: str = "item") -> DataFrame:
    """(split, user, pos from 1, item): for each (split, user) the first ``n`` distinct unseen items of an endless sequence of draws.

    Draw j of a user is the item whose dense rank is the first 60 bits of md5(seed:user:j) modulo the number of
    items, the seed being that of the split. Users are never paired with all items: each makes as many draws as should
    do by the share of items they have seen, all splits at once; only who is left short draws again, more often.
    Raises if a user has fewer than ``n`` unseen items.
    """
    ranked = settle(dense_ids(items, item, "rank"))
    total = ranked.count()
    have = settle(seen.select(user, item).distinct().join(ranked, item).select(user, "rank"))
    todo = users.join(have.groupBy(user).agg(F.count(F.lit(1)).alias("c")), user, "left")
    todo = settle(todo.select("split", user, (total - F.coalesce("c", F.lit(0))).alias("unseen")))
    least = todo.agg(F.min("unseen")).first()[0]
    if least is not None and least < n:
        raise ValueError(f"a user has fewer than {n} unseen items")
    seed = F.create_map(*(F.lit(x) for s, v in seeds.items() for x in (s, str(v))))[F.col("split")]
    done, factor = None, 2
    while True:
        # n distinct ones of u unseen among t items take about t * ln(u / (u - n + 1)) draws: as many, and again as many
        left = F.greatest(F.col("unseen") - n + 1, F.lit(1))
        draws = F.ceil(factor * total * F.ln((F.col("unseen") + 1) / left)).cast("int") + 16
        drawn = todo.select("split", user, F.explode(F.sequence(F.lit(0), draws)).alias("j"))
        bits = F.substring(F.md5(F.concat_ws(":", seed, F.col(user).cast("string"), F.col("j").cast("string"))), 1, 15)
        drawn = drawn.select("split", user, "j", (F.conv(bits, 16, 10).cast("long") % total).cast("int").alias("rank"))
        drawn = drawn.groupBy(user, "rank", "split").agg(F.min("j").alias("j")).join(have, [user, "rank"], "left_anti")
        drawn = drawn.withColumn("pos", F.row_number().over(W.partitionBy("split", user).orderBy("j"))).where(F.col("pos") <= n)
        drawn = settle(drawn.join(ranked, "rank").select("split", user, "pos", item))
        full = drawn.where(F.col("pos") == n).select("split", user)
        found = drawn if done is None else drawn.join(full, ["split", user], "left_semi")
        todo = settle(todo.join(full, ["split", user], "left_anti"))
        short = todo.limit(1).count()
        if short and done is None:
            found = drawn.join(full, ["split", user], "left_semi")
        done = found if done is None else done.unionByName(found)
        if not short:
            return done
        factor *= 4


def eval_candidates(positives: DataFrame, history: DataFrame, items: DataFrame, n: int, seeds: dict[str, int], user: str = "user", item: str = "item") -> DataFrame:
    """(split, user, cand_pos, item, is_positive): position 0 is the positive. Negatives avoid all of the history."""
    positives = positives.where(F.col("split").isin(list(seeds))).select("split", user, item)
    drawn = negatives(positives.select("split", user), history, items, n, seeds, user, item)
    found = positives.select("split", user, F.lit(0).alias("cand_pos"), item).unionByName(drawn.withColumnRenamed("pos", "cand_pos"))
    return found.withColumn("is_positive", F.col("cand_pos") == 0)
