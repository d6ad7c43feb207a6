"""The most similar vectors of every vector, by additive quantisation and exact reranking.

A vector is the sum of one full-dimensional codeword from each of ``levels`` codebooks, fitted by residual k-means
to a bounded sample and chosen for each vector by beam search. What is stored of a vector is its codes, the
norm of that sum, and the length of what it leaves. A query's inner products with all sums are sums of entries of
one lookup table, its products with all codewords; with the norms they give its distances to the sums.

The index is laid out by cells, of which there are as many as the square root of the collection; where that is more
than one codebook should hold, a cell is a pair of words of two, the second for what the first leaves, and so on. A
vector's codes go to its ``spill`` nearest cells, as they are small; a query, which is large, goes to its nearest cell
only. The codes that a batch has for a cell travel as one row. A cell of any size is cut into blocks of codes and
blocks of queries; each pair of blocks is one unit of work. Every pair goes on to be scored exactly, unless its score
plus a margin for the quantiser's error is below ``min_similarity``, or below the ``k``-th best score less that margin;
the best ``rerank`` of a query in each unit go on in any case.

Items of one direction are one class. Classes are indexed and searched by their first item; what is found is
then given to all items of a class, each neighbouring class standing for its ``k + 1`` smallest items.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.session import settle


#: Directions and similarities that agree to so many decimals are equal: scaling a vector moves the last bits only.
DIGITS = 12
#: What a product loses by the query's 11 bits, as a share of the sum's length.
HALF = 2.0**-11
#: Codes scored at once against a block of queries.
CODES = 1_024
#: Items, all but the first of their classes, that are broadcast at most; beyond, they are joined.
SPOKEN = 1_000_000


def _assign(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1) - 2.0 * x @ words.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    words = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _assign(x, words)
        n = np.bincount(at, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, at, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            words[empty] = x[rng.choice(len(x), size=len(empty))]
    return words


@dataclass
class Quantiser:
    """coarse: one or more codebooks that together make the cells; books: levels x codewords x dimensions."""

    coarse: list[np.ndarray]
    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and reconstructions: at each level the ``beam`` best partial sums of each vector go on."""
        n, rest = len(x), x[:, None, :]
        codes = np.zeros((n, 1, 0), dtype=np.uint8)
        for words in self.books:
            b = rest.shape[1]
            flat = np.ascontiguousarray(rest).reshape(n * b, -1)
            cost = ((flat**2).sum(1)[:, None] - 2.0 * flat @ words.T + (words**2).sum(1)).reshape(n, -1)
            keep = min(beam, cost.shape[1])
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.tile(np.arange(keep), (n, 1))
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1), 1)
            who, word = best // len(words), best % len(words)
            rest = np.take_along_axis(rest, who[:, :, None], 1) - words[word]
            codes = np.concatenate([np.take_along_axis(codes, who[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0], x - rest[:, 0]

    def cells(self, x: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` nearest cells of each vector, nearest first, by a beam as wide."""
        at, rest = np.zeros((len(x), 1), dtype=np.int64), x[:, None, :]
        for words in self.coarse:
            b = rest.shape[1]
            flat = np.ascontiguousarray(rest).reshape(len(x) * b, -1)
            cost = ((flat**2).sum(1)[:, None] - 2.0 * flat @ words.T + (words**2).sum(1)).reshape(len(x), -1)
            keep = min(most, cost.shape[1])
            near = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.tile(np.arange(keep), (len(x), 1))
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(cost, near, 1), axis=1), 1)
            who, word = near // len(words), near % len(words)
            if words is not self.coarse[-1]:
                rest = np.take_along_axis(rest, who[:, :, None], 1) - words[word]
            at = np.take_along_axis(at, who, 1) * len(words) + word
        return at


def fit(x: np.ndarray, cells: int, levels: int, words: int, rounds: int = 6, seed: int = 11, coarse_words: int = 4096) -> Quantiser:
    """Residual k-means on the sample; then the cells, from one codebook or, beyond ``coarse_words``, from several of equal sizes."""
    rng = np.random.default_rng(seed)
    books, rest = [], x
    for _ in range(levels):
        book = k_means(rest, words, rounds, rng)
        if len(book) < words:
            book = np.concatenate([book, np.zeros((words - len(book), x.shape[1]), dtype=x.dtype)])
        rest = rest - book[_assign(rest, book)]
        books.append(book)
    coarse, rest, parts = [], x, max(1, math.ceil(math.log(max(cells, 2)) / math.log(coarse_words)))
    for _ in range(parts):
        coarse.append(k_means(rest, math.ceil(cells ** (1 / parts)), rounds, rng))
        rest = rest - coarse[-1][_assign(rest, coarse[-1])]
    return Quantiser(coarse, np.stack(books).astype(np.float32))


def usable(df: DataFrame, item: str, vector: str, parts: int) -> DataFrame:
    """(item, v): one vector an item, partitioned by item, of those that are not null, not all zero, and finite throughout.

    Of several usable vectors of an item the first in order counts. The most frequent length must be all
    lengths: a mixture raises an error when scored.
    """
    rows = _fine(df, item, vector).repartition(parts, "item")
    return rows.groupBy("item").agg(F.min("v").alias("v"))


def _fine(df: DataFrame, item: str, vector: str) -> DataFrame:
    kind = df.schema[vector].dataType.simpleString()
    rows = df.select(F.col(item).alias("item"), F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where("item IS NOT NULL AND v IS NOT NULL").where(fine)


def _unit(series: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in series])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_ENCODED = "key binary, codes binary, norm float, error float, cells array<int>"


def _encode(model, beam: int, spill: int):
    """What is stored of a vector: its direction to DIGITS as a key, its codes, the sum's norm, what it leaves, and its cells."""

    @F.pandas_udf(_ENCODED)
    def run(vectors: pd.Series) -> pd.DataFrame:
        q, out = model.value, []
        for lo in range(0, len(vectors), 1024):
            unit = _unit(vectors.iloc[lo : lo + 1024])
            x = unit.astype(np.float32)
            codes, sums = q.encode(x, beam)
            keys = np.rint(unit * 10.0**DIGITS).astype(np.int64)
            out.append(
                pd.DataFrame(
                    {
                        "key": [hashlib.sha256(r.tobytes()).digest() for r in keys],
                        "codes": [c.tobytes() for c in codes],
                        "norm": np.linalg.norm(sums, axis=1),
                        "error": np.linalg.norm(x - sums, axis=1),
                        "cells": list(q.cells(x, spill).astype(np.int32)),
                    }
                )
            )
        return pd.concat(out, ignore_index=True)

    return run


def _half():
    """Unit vectors in 16 bits a number."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([v.tobytes() for v in _unit(vectors).astype(np.float16)] if len(vectors) else [], dtype=object)

    return run


_CODE = np.dtype([("norm", "<f4"), ("slack", "<f4")])


def _packed(plan, margin: float):
    """The codes of a batch, laid end to end for each cell and block: items, codes, and norms with slacks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, blocks = plan.value
        for batch in batches:
            if not len(batch):
                continue
            spill = len(batch["cells"].iloc[0])
            cell = np.concatenate(batch["cells"].to_list())
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            asked = cells[at] == cell  # a cell without queries needs no codes
            who, cell, at = np.repeat(np.arange(len(batch)), spill)[asked], cell[asked], at[asked]
            part = batch["place"].to_numpy()[who] % blocks[at]
            order = np.lexsort((part, cell))
            who, cell, part = who[order], cell[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])) if len(cell) else np.zeros(0, dtype=int)
            items = batch["two"].to_numpy()
            codes = np.frombuffer(b"".join(batch["codes"]), dtype=np.uint8).reshape(len(batch), -1)
            extra = np.empty(len(batch), dtype=_CODE)
            extra["norm"] = batch["norm"].to_numpy()
            extra["slack"] = margin * batch["error"].to_numpy() + HALF * extra["norm"]
            cuts = [slice(lo, hi) for lo, hi in zip(first, np.append(first[1:], len(who)))]
            yield pd.DataFrame(
                {
                    "cell": cell[first],
                    "c": part[first],
                    "twos": [items[who[x]].tobytes() for x in cuts],
                    "codes": [codes[who[x]].tobytes() for x in cuts],
                    "extra": [extra[who[x]].tobytes() for x in cuts],
                }
            )

    return run


def _contenders(dot: np.ndarray, half: np.ndarray, slack: np.ndarray, k: int, rerank: int) -> np.ndarray:
    """Of each row, all that may be among its ``k`` best, and the ``rerank`` nearest with all that tie with the last."""
    k, rerank = min(k, dot.shape[1]), min(rerank, dot.shape[1])
    sure = -np.partition(slack - dot, k - 1, axis=1)[:, k - 1 : k]
    near = dot - half  # in order of distance to the sums
    last = -np.partition(-near, rerank - 1, axis=1)[:, rerank - 1 : rerank]
    return np.isfinite(dot) & ((dot + slack >= sure) | (near >= last))


def _search(books: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, slack: np.ndarray, k: int, rerank: int, least: float) -> tuple[np.ndarray, ...]:
    """(query, code, score) of the pairs that go on. Rows of the lookup tables hold one codeword's products with all queries, so that a code reads whole lines."""
    tables = [np.ascontiguousarray(words @ x.T) for words in books]
    found, held = [], np.empty((CODES, len(x)), dtype=np.float32)
    for lo in range(0, len(codes), CODES):
        part = codes[lo : lo + CODES]
        score, line = tables[0][part[:, 0]], held[: len(part)]
        for level in range(1, len(books)):
            np.take(tables[level], part[:, level], axis=0, out=line, mode="clip")
            score += line
        good = score >= (least - slack[lo : lo + CODES])[:, None]
        many = np.flatnonzero(good.sum(axis=0) > rerank)
        if len(many):
            dense = np.where(good[:, many], score[:, many], -np.inf).T
            good[:, many] = _contenders(dense, norm[lo : lo + CODES] ** 2 / 2, slack[lo : lo + CODES], k + 1, rerank + 1).T
        what, who = np.nonzero(good)
        found.append((who, what + lo, score[what, who]))
    who, what, score = (np.concatenate(f) for f in zip(*found))
    return who, what, score


def _score(model, kind: np.dtype, k: int, rerank: int, min_similarity: float):
    """One unit: all queries of one block against all codes of one block."""

    def run(queries: pd.DataFrame, packs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(packs):
            books = model.value.books
            codes = np.frombuffer(b"".join(packs["codes"]), dtype=np.uint8).reshape(-1, len(books)).astype(np.intp)
            items, extra = np.frombuffer(b"".join(packs["twos"]), dtype=kind), np.frombuffer(b"".join(packs["extra"]), dtype=_CODE)
            norm, slack = np.ascontiguousarray(extra["norm"]), np.ascontiguousarray(extra["slack"])
            for lo in range(0, len(queries), 256):
                part = queries.iloc[lo : lo + 256]
                x = np.frombuffer(b"".join(part["q"]), dtype=np.float16).reshape(len(part), -1).astype(np.float32)
                mine = part["one"].to_numpy()
                who, what, score = _search(books, x, codes, norm, slack, k, rerank, min_similarity)
                other = mine[who] != items[what]
                who, what, score = who[other], what[other], score[other]
                # of the pairs from all pieces of the block, those that still may count
                order = np.argsort(who, kind="stable")
                who, what, score = who[order], what[order], score[order]
                counts = np.bincount(who, minlength=len(part))
                keep, ends = np.ones(len(who), dtype=bool), np.cumsum(counts)
                for q in np.flatnonzero(counts > rerank):
                    at = slice(ends[q] - counts[q], ends[q])
                    keep[at] = _contenders(score[None, at], norm[what[at]] ** 2 / 2, slack[what[at]], k, rerank)[0]
                out.append(pd.DataFrame({"one": mine[who[keep]], "two": items[what[keep]]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"one": [], "two": []})

    return run


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            s = (_unit(batch["v1"]) * _unit(batch["v2"])).sum(axis=1)
            yield pd.DataFrame({"one": batch["one"], "two": batch["two"], "similarity": s})


def neighbours(
    df: DataFrame,
    item: str,
    vector: str,
    k: int = 5,
    min_similarity: float = -1.0,
    levels: int = 8,
    words: int = 256,
    beam: int = 4,
    spill: int = 16,
    rerank: int = 32,
    margin: float = 0.5,
    fit_rows: int = 16_384,
    block: int = 8_192,
    coarse_words: int = 4_096,
) -> DataFrame:
    """(item, rank, neighbour, similarity): for every item the ``k`` most similar others, of cosine ``min_similarity`` or more.

    Equally similar ones come in order of the item. Null, all-zero and non-finite vectors take no part; an item counts once.
    Items with vectors of one direction, however many, are neighbours of similarity 1. The codebooks are fitted on ``fit_rows``
    rows chosen by a hash of their item; every class is indexed and every class is a query. A score may fall short by
    ``margin`` times the length of what the quantiser leaves of a vector before its pair is given up. An empty
    table gives no rows. Other columns of ``df`` are ignored.
    """
    if k < 1 or words > 256:
        raise ValueError("k must be at least 1, words at most 256")
    spark = df.sparkSession
    fine = _fine(df, item, vector)
    n = fine.count()
    if not n:
        return spark.createDataFrame([], f"item {df.schema[item].dataType.simpleString()}, rank int, neighbour {df.schema[item].dataType.simpleString()}, similarity double")
    sample = fine.orderBy(F.xxhash64("item"), "item").limit(fit_rows).toPandas().drop_duplicates("item")
    cells = 1 << max(2, round(math.log2(math.sqrt(n))))
    x = _unit(sample["v"]).astype(np.float32)
    model = spark.sparkContext.broadcast(fit(x, min(cells, len(x)), levels, min(words, len(x)), coarse_words=coarse_words))
    parts = max(spark.sparkContext.defaultParallelism, n // 50_000)
    encoded = usable(df, item, vector, parts).withColumn("e", _encode(model, beam, spill)("v")).select("item", "v", "e.*")
    encoded = settle(encoded)
    classes = settle(encoded.groupBy("key").agg(F.min("item").alias("class"), F.count(F.lit(1)).alias("n")))
    # items that another one of their class stands for
    spoken = encoded.select("item", "key").join(classes.where("n > 1"), "key").where("item <> class").select("item")
    many = classes.agg(F.sum("n") - F.count(F.lit(1))).first()[0]
    firsts = encoded.join(F.broadcast(spoken) if many <= SPOKEN else spoken, "item", "left_anti") if many else encoded
    pairs = _class_pairs(firsts, encoded.select("item", "v"), model, k, min_similarity, rerank, margin, block)
    return _for_members(encoded.select("item", "key"), classes, pairs, k, min_similarity)


def _class_pairs(firsts: DataFrame, vectors: DataFrame, model, k: int, min_similarity: float, rerank: int, margin: float, block: int) -> DataFrame:
    """(one, two, similarity), one < two: the pairs of classes that were found, scored exactly."""
    spark, kind = vectors.sparkSession, vectors.schema["item"].dataType.simpleString()
    queries = firsts.select(F.col("item").alias("one"), "codes", "norm", "error", "cells", "v")
    # codes and queries of each cell, for the sizes of its blocks: as many rows as there are cells, the root of the items
    sizes = queries.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("codes"))
    asked = queries.groupBy(F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("queries"))
    plan = sizes.join(asked, "cell").orderBy("cell").toPandas()
    cells, code_blocks, query_blocks = (plan["cell"].to_numpy(), *(-(-plan[c].to_numpy() // block) for c in ("codes", "queries")))
    # both sides of the cogroup need the same types: equal numbers of other types hash to other partitions
    blocks = spark.createDataFrame([(int(c), int(n), int(m)) for c, n, m in zip(cells, code_blocks, query_blocks)] or [], "cell int, cs int, bs int")
    held = spark.sparkContext.broadcast((cells, code_blocks))
    place = F.pmod(F.xxhash64("one"), F.lit(2**31 - 1))
    codes = queries.select(F.col("one").alias("two"), place.alias("place"), "codes", "norm", "error", "cells")
    codes = codes.mapInPandas(_packed(held, margin), "cell int, c int, twos binary, codes binary, extra binary")
    codes = codes.join(F.broadcast(blocks.select("cell", "bs")), "cell").select("cell", "c", F.explode(F.sequence(F.lit(0), F.col("bs") - 1)).alias("b"), "twos", "codes", "extra")
    mine = queries.select("one", _half()("v").alias("q"), F.col("cells")[0].alias("cell"), place.alias("place")).join(F.broadcast(blocks), "cell")
    mine = mine.select("one", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)).alias("c"), F.pmod("place", F.col("bs")).cast("int").alias("b"))
    unit = ["cell", "c", "b"]
    numbers = np.dtype({"int": "<i4", "bigint": "<i8", "smallint": "<i2", "tinyint": "<i1"}[kind])
    found = mine.groupBy(*unit).cogroup(codes.groupBy(*unit)).applyInPandas(_score(model, numbers, k, rerank, min_similarity), f"one {kind}, two {kind}")
    # a pair found from either side serves both
    found = found.select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).distinct()
    for side, v in (("one", "v1"), ("two", "v2")):
        found = found.join(vectors.select(F.col("item").alias(side), F.col("v").alias(v)), side)
    found = found.select("one", "two", "v1", "v2").mapInPandas(_exact, f"one {kind}, two {kind}, similarity double")
    return found.where(F.col("similarity") >= min_similarity).withColumn("similarity", F.round("similarity", DIGITS))


def _for_members(members: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, min_similarity: float, spread: int = 65_536) -> DataFrame:
    """(item, rank, neighbour, similarity) of all members, from the pairs of classes.

    The ``k`` best classes beside its own, each by its ``k + 1`` smallest members, hold the ``k`` best of any member. A
    class has one list of ``k + 1``, of which a class of more than ``spread`` members has a copy for as many; a member leaves itself out of it.
    """
    one, two = F.struct(F.col("one").alias("class"), F.col("two").alias("near"), "similarity"), F.struct(F.col("two").alias("class"), F.col("one").alias("near"), "similarity")
    both = pairs.select(F.explode(F.array(one, two)).alias("p")).select("p.*")
    best = W.partitionBy("class").orderBy(F.desc("similarity"), "near")
    both = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    members = settle(members.join(classes, "key").select("class", "item", F.ceil(F.col("n") / spread).cast("int").alias("copies")))
    first = members.withColumn("rank", F.row_number().over(W.partitionBy("class").orderBy("item"))).where(F.col("rank") <= k + 1)
    first = settle(first.select(F.col("class").alias("near"), F.col("item").alias("neighbour")))
    own = first.select(F.col("near").alias("class"), "neighbour", F.lit(1.0).alias("similarity")).where(F.col("similarity") >= min_similarity)
    listed = both.join(first, "near").select("class", "neighbour", "similarity").unionByName(own)
    order = W.partitionBy("class").orderBy(F.desc("similarity"), "neighbour")
    listed = listed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    listed = listed.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("list")).where(F.size("list") > 1)
    large = F.broadcast(classes.select("class", F.ceil(F.col("n") / spread).cast("int").alias("copies")).where("copies > 1"))  # at most one in ``spread`` items
    salts = F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)
    listed = listed.join(large, "class", "left").select("class", "list", F.explode(salts).alias("salt"))
    members = members.select("class", "item", F.pmod(F.xxhash64("item"), F.col("copies")).cast("int").alias("salt"))
    found = members.join(listed, ["class", "salt"])
    found = found.select("item", F.posexplode(F.slice(F.filter("list", lambda x: x["neighbour"] != F.col("item")), 1, k)).alias("pos", "n"))
    return found.select("item", (F.col("pos") + 1).alias("rank"), F.col("n.neighbour").alias("neighbour"), F.col("n.similarity").alias("similarity"))


def similar_pairs(found: DataFrame) -> DataFrame:
    """(item_a, item_b) of ``neighbours``, each pair once, whichever of the two has the other among its neighbours."""
    return found.select(F.least("item", "neighbour").alias("item_a"), F.greatest("item", "neighbour").alias("item_b")).distinct()
