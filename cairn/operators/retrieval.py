"""Exact Top-K by inner product: matrix products of blocks, never pairs as rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.vectors import normalised
from cairn.session import settle

#: Items or queries in one block; of 64 numbers each it is 32 MB. No more than one block is ever broadcast.
BLOCK = 65_536
QUERIES = 512


def _top(scores: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray) -> list[tuple[int, float]]:
    """The best k of one row; equal scores in order of the id."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        bound = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= bound]
    at = at[np.lexsort((ids[at], -scores[at]))][:k]
    return [(int(ids[i]), float(scores[i])) for i in at]


@dataclass
class Block:
    """Items in order of their ids, with their vectors and biases."""

    ids: np.ndarray
    matrix: np.ndarray
    bias: np.ndarray

    @staticmethod
    def of(rows: pd.DataFrame) -> Block:
        rows = rows.sort_values("item")
        return Block(rows["item"].to_numpy(), np.stack(rows["vec"]).astype(np.float64), rows["bias"].to_numpy(dtype=np.float64))

    def search(self, batch: pd.DataFrame, k: int, digits: int) -> Iterator[pd.DataFrame]:
        """The best k of this block for each query."""
        for lo in range(0, len(batch), QUERIES):
            part = batch.iloc[lo : lo + QUERIES]
            scores = np.round(np.stack(part["vec"]) @ self.matrix.T + self.bias, digits)
            rows = []
            for q, seen, line in zip(part["query"], part["seen"], scores):
                allowed = np.ones(len(self.ids), dtype=bool)
                at = np.searchsorted(self.ids, seen := np.asarray(seen))
                at = np.minimum(at, len(self.ids) - 1)
                allowed[at[self.ids[at] == seen]] = False
                rows += [(q, i, s) for i, s in _top(line, self.ids, k, allowed)]
            yield pd.DataFrame(rows, columns=["query", "item", "score"])


def _search(block, k: int, digits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from block.value.search(batch, k, digits)

    return run


def _search_unit(k: int, digits: int):
    def run(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found = list(Block.of(items).search(queries, k, digits)) if len(queries) and len(items) else []
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"query": [], "item": [], "score": []})

    return run


def top_k(queries: DataFrame, items: DataFrame, k: int, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(query, rank, item, score). ``queries``: (query, vec, seen), items in ``seen`` are left out; ``items``: (item, vec, bias).

    Items that fit one block are broadcast, and queries pass by once without a shuffle. More are cut into blocks,
    queries as well; each pair of blocks is a unit of work of its own, and nothing passes through the driver.
    Every unit gives its best k, and the best k of those remain. A query with fewer than k unseen items has fewer
    rows. k must be below the number of items.
    """
    spark = queries.sparkSession
    first = items.select("item", "vec", "bias").limit(block + 1).toPandas()
    n = len(first) if len(first) <= block else items.count()
    if k < 1 or k >= n:
        raise ValueError(f"k must be from 1 to below the number of items, {n}")
    found_as = f"query {queries.schema['query'].dataType.simpleString()}, item {items.schema['item'].dataType.simpleString()}, score double"
    if n <= block:
        found = queries.mapInPandas(_search(spark.sparkContext.broadcast(Block.of(first)), k, digits), found_as)
    else:
        queries = settle(queries)
        sides = {"b": -(-n // block), "c": -(-queries.count() // block)}
        cuts = {c: F.sequence(F.lit(0), F.lit(max(m, 1) - 1)) for c, m in sides.items()}
        asked = queries.withColumn("c", F.pmod(F.xxhash64("query"), F.lit(max(sides["c"], 1))).cast("int")).withColumn("b", F.explode(cuts["b"]))
        placed = items.withColumn("b", F.pmod(F.xxhash64("item"), F.lit(sides["b"])).cast("int")).withColumn("c", F.explode(cuts["c"]))
        found = asked.groupBy("b", "c").cogroup(placed.groupBy("b", "c")).applyInPandas(_search_unit(k, digits), found_as)
    order = W.partitionBy("query").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "item", "score")


def recommend(users: DataFrame, items: DataFrame, train: DataFrame, k: int, digits: int = 6, user: str = "user", item: str = "item") -> DataFrame:
    """(user, rank, item, score): the Top-K of each user among items not in training. Held-out items may come out."""
    seen = train.groupBy(user).agg(F.collect_set(item).alias("seen"))  # at most the catalogue
    queries = users.join(seen, user, "left").select(F.col(user).alias("query"), "vec", F.coalesce("seen", F.array().cast("array<int>")).alias("seen"))
    bias = F.coalesce(F.col("bias").cast("double"), F.lit(0.0)) if "bias" in items.columns else F.lit(0.0)
    found = top_k(queries, items.select(F.col(item).alias("item"), "vec", bias.alias("bias")), k, digits)
    return found.select(F.col("query").alias(user), "rank", F.col("item").alias(item), "score")


def item_neighbours(items: DataFrame, k: int, digits: int = 6, normalize: bool = True, item: str = "item") -> DataFrame:
    """(item, rank, neighbor, inner_product): the k items of the greatest inner product, itself left out."""
    vec = normalised(F.col("vec")) if normalize else F.col("vec").cast("array<double>")
    rows = items.select(F.col(item).alias("item"), vec.alias("vec"), F.lit(0.0).alias("bias"))
    queries = rows.select(F.col("item").alias("query"), "vec", F.array("item").alias("seen"))
    found = top_k(queries, rows, k, digits)
    return found.select(F.col("query").alias(item), "rank", F.col("item").alias("neighbor"), F.col("score").alias("inner_product"))
