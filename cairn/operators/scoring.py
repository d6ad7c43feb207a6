"""Scores of candidates, ranks of positives, ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.metrics import gain, hit, reciprocal
from cairn.functions.vectors import dot, finite
from cairn.operators.retrieval import BLOCK

CUTOFFS = (10, 20, 100)


def mean_vectors(train: DataFrame, vectors: DataFrame, dim: int, user: str = "user", item: str = "item") -> DataFrame:
    """(user, vec): the mean of the vectors of the user's training rows. Sums are partial before the shuffle."""
    rows = train.join(vectors, item)
    means = rows.groupBy(user).agg(*(F.avg(F.col("vec")[i]).alias(f"d{i}") for i in range(dim)))
    return means.select(user, F.array(*(F.col(f"d{i}") for i in range(dim))).alias("vec"))


def _dots(vectors):
    """Scores of each row's candidates, which come by id, against the one broadcast block of items; NaN for unknown ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, bias = vectors.value
        for batch in batches:
            if not len(batch):
                continue
            sizes = batch["items"].map(len).to_numpy()
            asked = np.concatenate(batch["items"].to_list())
            at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
            u = np.stack(batch["u"]).astype(np.float64)
            score = np.einsum("ij,ij->i", np.repeat(u, sizes, axis=0), matrix[at]) + bias[at]
            score[ids[at] != asked] = np.nan
            ends = np.cumsum(sizes)[:-1]
            yield batch[["user"]].assign(items=np.split(asked, ends), scores=np.split(score, ends))

    return run


def candidate_scores(candidates: DataFrame, users: DataFrame, items: DataFrame, digits: int | None = None, user: str = "user", item: str = "item", block: int = BLOCK) -> DataFrame:
    """``candidates`` with score: the inner product of the vectors, plus the item's bias where it has one.

    Candidates of users or items without a vector are left out. Where the items fit one block, it is broadcast, and
    a user's vector meets the ids of their candidates in one row: no vector is copied for a candidate. With more
    items, candidates are joined with both vectors.
    """
    bias = F.coalesce(F.col("bias").cast("double"), F.lit(0.0)) if "bias" in items.columns else F.lit(0.0)
    theirs = items.select(F.col(item).alias("i"), F.col("vec").cast("array<double>").alias("v"), bias.alias("b"))
    first = theirs.limit(block + 1).toPandas()
    if len(first) <= block:
        if not len(first):
            return candidates.withColumn("score", F.lit(None).cast("double")).limit(0)
        first = first.sort_values("i")
        vectors = users.sparkSession.sparkContext.broadcast((first["i"].to_numpy(), np.stack(first["v"]).astype(np.float64), first["b"].to_numpy(dtype=np.float64)))
        asked = candidates.groupBy(F.col(user).alias("user")).agg(F.collect_set(item).alias("items"))  # at most the block
        asked = asked.join(users.select(F.col(user).alias("user"), F.col("vec").alias("u")), "user")
        kinds = {c: candidates.schema[n].dataType.simpleString() for c, n in (("user", user), ("items", item))}
        found = asked.mapInPandas(_dots(vectors), f"user {kinds['user']}, items array<{kinds['items']}>, scores array<double>")
        found = found.select(F.col("user").alias(user), F.explode(F.arrays_zip("items", "scores")).alias("p")).select(user, F.col("p.items").alias(item), F.col("p.scores").alias("score"))
        rows = candidates.join(found.where("score IS NOT NULL AND NOT isnan(score)"), [user, item]).select(*candidates.columns, "score")
    else:
        rows = candidates.join(theirs.withColumnRenamed("i", item), item).join(users.select(user, F.col("vec").alias("u")), user)
        rows = rows.select(*candidates.columns, (dot(F.col("u"), F.col("v")) + F.col("b")).alias("score"))
    return rows.withColumn("score", F.round("score", digits)) if digits is not None else rows


def require_finite(vectors: DataFrame) -> None:
    """NaN counts as the greatest number here, which would rank it first: scores must be finite."""
    if vectors.where(~finite(F.col("vec"))).limit(1).count():
        raise ValueError("a vector holds a number that is not finite")


def positive_ranks(scored: DataFrame, user: str = "user") -> DataFrame:
    """(split, user, rank): 1 plus the negatives that score as high as the positive, or higher."""
    best = scored.groupBy("split", user).agg(
        F.max(F.when(F.col("is_positive"), F.col("score"))).alias("own"), F.collect_list(F.when(~F.col("is_positive"), F.col("score"))).alias("others")
    )
    rank = 1 + F.size(F.filter("others", lambda s: s >= F.col("own")))
    return best.select("split", user, rank.alias("rank"))


def ranking_metrics(ranks: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """(split, n_users, hr@k, ndcg@k, mrr@k as hr_k, ...)."""
    terms = [F.avg(f(F.col("rank"), k)).alias(f"{name}_{k}") for k in cutoffs for name, f in (("hr", hit), ("ndcg", gain), ("mrr", reciprocal))]
    return ranks.groupBy("split").agg(F.count(F.lit(1)).alias("n_users"), *terms)
