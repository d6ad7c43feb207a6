"""Texts laid into windows of fixed capacity: mixture-controlled packing by deficit round-robin.

Every source is a queue with a target share of all tokens. At each window a queue earns its share of the
window, and pays for what is taken of it; the window is filled from the queue that is owed most among those
that hold something that still fits, always with the largest such piece. So each window is near the target
mixture, and what one window owes a source the next ones make up for.

Texts are dealt to partitions of bounded size, which are packed at the same time. What a partition inherits from
those before it follows from their supplies, for all that is dealt to a partition is laid there: a source is
owed its share of all tokens so far, less its own tokens so far. One small aggregation gives all these
deficits at once, and no partition waits for another.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.rows import side_by_side
from cairn.session import settle

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's tokenizer cuts a text before it merges bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tiktoken

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counts(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(path).encode_ordinary
        for batch in batches:
            yield batch[["id", "source", "h"]].assign(n=[len(encode(t)) for t in batch["text"]])

    return run


def count_tokens(df: DataFrame, doc_id: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, h, n) with a hash and the number of tokens of each text that is neither null nor empty.

    The vocabulary file is sent to the executors; only the driver needs to have it.
    """
    if os.path.exists(vocabulary):
        df.sparkSession.sparkContext.addFile(vocabulary)
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.where("text <> ''").withColumn("h", F.xxhash64("text")).mapInPandas(_counts(vocabulary), f"id {kind}, source string, h long, n long")


class Queue:
    """Pieces of one source by size; the largest that fits is found by a bit mask of the sizes at hand."""

    def __init__(self):
        self.by_size: dict[int, list[int]] = {}
        self.mask = 0

    def put(self, size: int, piece: int) -> None:
        self.by_size.setdefault(size, []).append(piece)
        self.mask |= 1 << size

    def largest(self, room: int) -> int:
        return (self.mask & ((1 << room + 1) - 1)).bit_length() - 1

    def take(self, size: int) -> int:
        stack = self.by_size[size]
        piece = stack.pop()
        if not stack:
            self.mask &= ~(1 << size)
        return piece


def pack(sizes: list[int], sources: list[str], capacity: int, shares: dict[str, float], owed: dict[str, float]) -> list[tuple[int, int]]:
    """(window, start in it) of each piece, of sizes from 1 to ``capacity``. ``owed`` is what each source starts with."""
    queues = {s: Queue() for s in sorted(set(sources))}
    for i in reversed(range(len(sizes))):
        queues[sources[i]].put(sizes[i], i)
    deficit = {s: owed.get(s, 0.0) for s in queues}
    at, window = [(0, 0)] * len(sizes), 0
    while queues:
        total = sum(shares.get(s, 0.0) for s in queues)
        for s in queues:
            deficit[s] += capacity * (shares.get(s, 0.0) / total if total > 0 else 1 / len(queues))
        room = capacity
        while room:
            best, chosen, size = None, None, 0
            for s, queue in queues.items():
                if (best is None or deficit[s] > best) and (fits := queue.largest(room)) > 0:
                    best, chosen, size = deficit[s], s, fits
            if chosen is None:
                break
            at[queues[chosen].take(size)] = window, capacity - room
            deficit[chosen] -= size
            room -= size
        queues = {s: q for s, q in queues.items() if q.mask}
        window += 1
    return at


def _pack_part(capacity: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "piece"], kind="stable").reset_index(drop=True)
        per = part.drop_duplicates("source").set_index("source")
        at = pack(part["n"].tolist(), part["source"].tolist(), capacity, per["share"].to_dict(), per["owed"].to_dict())
        return part[["id", "source", "piece", "part", "n"]].assign(window=[w for w, _ in at], start=[s for _, s in at])

    return run


def _owed(counted: DataFrame, shares: dict[str, float] | None) -> DataFrame:
    """(part, source, share, owed) of the sources of each part: a source's share of all tokens in earlier parts, less its own there.

    One row a part and source that has texts in it: no source is paired with parts it is not in, and no source comes to the driver.
    """
    supply = settle(counted.groupBy("part", "source").agg(F.sum("n").alias("own")))
    totals = supply.groupBy("source").agg(F.sum("own").alias("total"))
    if shares is None:
        weights = totals.withColumn("weight", F.col("total").cast("double"))
    else:
        given = counted.sparkSession.createDataFrame([(s, float(v)) for s, v in shares.items()] or [("", 0.0)], "source string, weight double")
        weights = totals.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    whole = weights.agg(F.sum("weight")).first()[0] or 1.0
    weights = weights.select("source", (F.col("weight") / F.lit(whole)).alias("share"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for ``texts_per_part`` texts
    sums = supply.groupBy("part").agg(F.sum("own").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("all_before"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    mine = supply.select("part", "source", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("own_before"))
    found = mine.join(sums, "part").join(weights, "source")
    return found.select("part", "source", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("owed"))


def packing_report(laid: DataFrame, source: str, capacity: int) -> DataFrame:
    """One row on laid windows: how many there are, how full, and how far a window's mixture of sources is from that of all (half the sum of differences)."""
    windows = laid.groupBy("part", "window").agg(F.sum("n_tokens").alias("used"))
    mix = laid.groupBy("part", "window", source).agg(F.sum("n_tokens").alias("own"))
    shares = laid.groupBy(source).agg(F.sum("n_tokens").alias("all"))
    whole = shares.agg(F.sum("all")).first()[0] or 1
    mix = mix.join(shares, source).join(windows, ["part", "window"])
    # a source that a window lacks adds its whole share: 1 less the shares of those it has
    share = F.col("all") / F.lit(whole)
    away = mix.groupBy("part", "window", "used").agg(((F.sum(F.abs(F.col("own") / F.col("used") - share)) + 1 - F.sum(share)) / 2).alias("away"))
    return away.agg(
        F.count(F.lit(1)).alias("windows"),
        (F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("fill"),
        F.avg("away").alias("mean_distance"),
        F.percentile_approx("away", 0.99).alias("distance_99"),
    )


def packing_faults(laid: DataFrame, counted: DataFrame, doc_id: str, capacity: int) -> DataFrame:
    """One row: texts laid; and how many windows are overfull, have overlaps or gaps, texts are divided although they would fit, or have other numbers of tokens than counted."""
    spans = laid.groupBy("part", "window").agg(F.sum("n_tokens").alias("used"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.min("start").alias("first"))
    next_start = F.lead("start").over(W.partitionBy("part", "window").orderBy("start"))  # a window's texts are at most ``capacity``
    apart = laid.select((F.coalesce(next_start, F.col("start") + F.col("n_tokens")) != F.col("start") + F.col("n_tokens")).cast("long").alias("apart"))
    texts = laid.groupBy(doc_id).agg(F.sum("n_tokens").alias("laid"), F.max("piece").alias("pieces"))
    want = counted.groupBy(F.col("id").alias(doc_id)).agg(F.sum("n").alias("counted"), F.max("n").alias("longest"))
    both = texts.join(want.where("counted > 0"), doc_id, "full")
    return side_by_side(
        spans.agg(F.count_if((F.col("used") > capacity) | (F.col("end") > capacity) | (F.col("first") != 0)).alias("n_overfull")),
        apart.agg(F.coalesce(F.sum("apart"), F.lit(0)).alias("n_apart")),
        both.agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.count_if((F.col("pieces") > 0) & (F.col("longest") <= capacity)).alias("n_divided"),
            F.count_if(~F.col("laid").eqNullSafe(F.col("counted"))).alias("n_lost"),
        ),
    )


def pack_texts(
    df: DataFrame,
    doc_id: str,
    text: str,
    source: str,
    capacity: int = 2048,
    shares: dict[str, float] | None = None,
    vocabulary: str = VOCABULARY,
    texts_per_part: int = 20_000,
) -> DataFrame:
    """(doc_id, source, piece, n_tokens, part, window, start): where each text, or piece of a text, lies.

    A window is (part, window). A text of at most ``capacity`` tokens is one piece; a longer one is cut into
    full windows and one shorter piece. Null and empty texts have no tokens and no row. ``shares`` gives the
    sources' target shares of tokens, by default those of the corpus; sources it leaves out come last. A null
    source counts as ''. Repeated rows are laid each by itself. An empty table gives no rows. Other columns
    of ``df`` are ignored.
    """
    if capacity < 1 or texts_per_part < 1:
        raise ValueError("capacity and texts_per_part must be positive")
    counted = settle(count_tokens(df, doc_id, text, source, vocabulary))
    n = counted.count()
    parts = max(1, -(-n // texts_per_part))
    # rows that are alike in all are told apart by their place in the settled table, so that no part grows beyond its size
    dealt = F.pmod(F.xxhash64("id", "h", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    counted = settle(counted.withColumn("part", dealt).drop("h"))
    grid = _owed(counted, shares)

    last = F.ceil(F.col("n") / capacity).cast("int") - 1
    pieces = counted.where("n > 0").join(grid, ["part", "source"]).withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    pieces = pieces.withColumn("n", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity))
    kind = counted.schema["id"].dataType.simpleString()
    laid = pieces.groupBy("part").applyInPandas(_pack_part(capacity), f"id {kind}, source string, piece int, part int, n long, window int, start int")
    return laid.select(F.col("id").alias(doc_id), F.col("source").alias(source), "piece", F.col("n").alias("n_tokens"), "part", "window", "start")
