"""Greedy reranking for relevance, calibration and diversity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.config import RerankWeights
from cairn.functions.metrics import EPS
from cairn.functions.vectors import min_max
from cairn.session import settle


def min_max_relevance(lists: DataFrame, user: str = "user") -> DataFrame:
    """``lists`` with relevance: the score scaled to 0..1 within each user's list, all 0 where it is flat."""
    w = W.partitionBy(user)
    return lists.withColumn("relevance", min_max(F.col("score"), F.min("score").over(w), F.max("score").over(w)))


def _divergence(p: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where(p > 0, p * np.log((p + EPS) / (m + EPS)), 0.0).sum(axis=-1)


def choose(relevance: np.ndarray, profile: np.ndarray, shares: np.ndarray, unit: np.ndarray, k: int, weights: RerankWeights, digits: int | None) -> list[tuple[int, float]]:
    """The k choices in turn as (candidate, objective). Candidates are in order of rank, which decides ties.

    At each step a candidate counts with its relevance, the calibration of the list with it, and its mean
    distance to the list so far, of which there is none at the first step.
    """
    left, chosen = np.ones(len(relevance), dtype=bool), []
    genres, vectors = np.zeros(shares.shape[1]), np.zeros(unit.shape[1])
    for step in range(k):
        mix = (genres + shares) / (step + 1)
        m = (profile + mix) / 2
        calibrated = 1 - (_divergence(profile[None, :], m) + _divergence(mix, m)) / 2 / np.log(2)
        apart = np.clip((1 - unit @ vectors / step) / 2, 0, 1) if step else np.zeros(len(relevance))
        value = weights.relevance * relevance + weights.calibration * calibrated + weights.diversity * apart
        if digits is not None:
            value = np.round(value, digits)
        best = int(np.argmax(np.where(left, value, -np.inf)))
        chosen.append((best, float(value[best])))
        left[best] = False
        genres += shares[best]
        vectors += unit[best]
    return chosen


def _greedy(k: int, weights: RerankWeights, digits: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for user, profile, cands in zip(batch["user"], batch["profile"], batch["cands"]):
                cands = sorted(cands, key=lambda c: c["rank"])
                names = {g: i for i, g in enumerate(sorted({p["genre"] for p in profile} | {s["genre"] for c in cands for s in c["shares"]}))}
                mine, shares = np.zeros(len(names)), np.zeros((len(cands), len(names)))
                for p in profile:
                    mine[names[p["genre"]]] = p["p"]
                for i, c in enumerate(cands):
                    for s in c["shares"]:
                        shares[i, names[s["genre"]]] = s["share"]
                unit = np.stack([np.asarray(c["vec"], dtype=np.float64) for c in cands])
                unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
                score = np.array([c["score"] for c in cands])
                relevance = (score - score.min()) / max(score.max() - score.min(), 1e-8)
                for r, (at, value) in enumerate(choose(relevance, mine, shares, unit, k, weights, digits), 1):
                    rows.append((user, r, cands[at]["item"], value))
            yield pd.DataFrame(rows, columns=["user", "rank", "item", "objective"])

    return run


def greedy_rerank(
    lists: DataFrame, profiles: DataFrame, shares: DataFrame, features: DataFrame, k: int, weights: RerankWeights | None = None, digits: int | None = 9
) -> DataFrame:
    """(user, rank, item, objective): the k best of each list (user, rank, item, score), chosen one after another.

    Raises if a list has fewer than k candidates, for which lists are settled first. A list is as long as retrieval made it, and travels as one row.
    """
    weights, lists = weights or RerankWeights(), settle(lists)
    short = lists.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k).limit(1).count()
    if short:
        raise ValueError(f"a list has fewer than {k} candidates")
    by_item = shares.groupBy("item").agg(F.collect_list(F.struct("genre", "share")).alias("shares"))
    no_shares = F.array().cast("array<struct<genre:string,share:double>>")
    rows = lists.join(by_item, "item", "left").join(features.select("item", "vec"), "item").withColumn("shares", F.coalesce("shares", no_shares))
    rows = rows.groupBy("user").agg(F.collect_list(F.struct("rank", "item", "score", "shares", "vec")).alias("cands"))
    mine = profiles.groupBy("user").agg(F.collect_list(F.struct("genre", "p")).alias("profile"))
    rows = rows.join(mine, "user", "left").select("user", "cands", F.coalesce("profile", F.array().cast("array<struct<genre:string,p:double>>")).alias("profile"))
    return rows.mapInPandas(_greedy(k, weights, digits), "user int, rank int, item int, objective double")


def sample_report(lists: DataFrame, users: DataFrame, items: DataFrame, n_users: int = 100) -> DataFrame:
    """The lists of the first ``n_users`` users, with the raw ids, titles and genres, in order."""
    rows = lists.where(F.col("user_idx") < n_users).join(users, "user_idx").join(items, "item_idx")
    return rows.select("user_idx", "userId", "rank", "item_idx", "movieId", "title", "genres", "rerank_score").orderBy("user_idx", "rank")
