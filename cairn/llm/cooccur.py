"""Items that appear together, by stripes, and how much more often than chance.

Two exact bounds act before any pair is formed. A pair kept for ``min_support`` baskets consists of items
that are in as many; and a pair's lift is at most n / max(n_a, n_b), so that an item in more than
n / ``min_lift`` baskets is in no pair kept.

A stripe is, for one item, the array of its co-occurring items with their counts. Each task turns its
baskets into stripes, merges them in arrays and sends one stripe an item for millions of pairs; the stripes
of an item are merged where they meet. An item's stripe holds only items at least as frequent as itself, so
that frequent items, whose stripes would be the longest, have the shortest.

A basket above ``block`` items is cut into blocks by a hash of the item, and each pair of blocks is a unit of
work of its own: no basket, however large, is gathered whole, and none of its pairs is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import settle

#: Pairs gathered in a task before they are merged into stripes.
BUFFER = 1_000_000
STRIPE = "a long, b array<long>, n array<long>"
_STRIPES = pa.schema([("a", pa.int64()), ("b", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])


def _count(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, with the sums of n, or with their numbers."""
    ids = np.unique(np.concatenate([a, b]))
    key = np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b)
    if n is None:
        key, total = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        total = np.add.reduceat(n[order], first) if len(first) else n[:0]
    return ids[key // max(len(ids), 1)], ids[key % max(len(ids), 1)], total


def _to_stripes(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    keys, first = np.unique(a, return_index=True)
    offsets = pa.array(np.append(first, len(a)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (b, n)]
    return pa.RecordBatch.from_arrays([pa.array(keys), *lists], schema=_STRIPES)


def basket_pairs(sizes: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (smaller, larger) within baskets laid end to end, for equal sizes at once."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for size in np.unique(sizes):
        if size > 1:
            i, j = np.triu_indices(size, 1)
            step = max(1, BUFFER // len(i))
            at = starts[sizes == size]
            for lo in range(0, len(at), step):
                rows = np.sort(items[at[lo : lo + step, None] + np.arange(size)], axis=1)
                yield rows[:, i].ravel(), rows[:, j].ravel()


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left, right, held = [], [], 0

    def merged():
        return _to_stripes(*_count(np.concatenate(left), np.concatenate(right)))

    def take(a, b):
        nonlocal held
        left.append(a)
        right.append(b)
        held += len(a)

    for batch in batches:
        ones, twos = batch.column("one"), batch.column("two")
        first = np.asarray(ones.value_lengths()), np.asarray(ones.flatten())
        second = np.asarray(twos.value_lengths()), np.asarray(twos.flatten())
        alone = second[0] == 0
        for a, b in basket_pairs(first[0][alone], first[1][np.repeat(alone, first[0])]):
            take(a, b)
            if held >= BUFFER:
                yield merged()
                left, right, held = [], [], 0
        ends = [np.concatenate([[0], np.cumsum(x[0])]) for x in (first, second)]
        for r in np.flatnonzero(~alone):
            x, y = (x[1][e[r] : e[r + 1]] for x, e in zip((first, second), ends))
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            take(np.minimum(a, b), np.maximum(a, b))
            if held >= BUFFER:
                yield merged()
                left, right, held = [], [], 0
    if held:
        yield merged()


def _merge(min_support: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stripes come in order of their item; those of one item are merged as they come."""
        parts, held = [], 0

        def unpack(batch):
            lengths = np.asarray(batch.column("b").value_lengths())
            return np.repeat(np.asarray(batch.column("a")), lengths), np.asarray(batch.column("b").flatten()), np.asarray(batch.column("n").flatten())

        def out(a, b, n):
            keep = n >= min_support
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, n)], names=["a", "b", "n_ab"])

        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(unpack(batch))
            held += len(parts[-1][0])
            if held >= BUFFER:
                a, b, n = _count(*(np.concatenate(x) for x in zip(*parts)))
                done = a < a.max()  # the last item's stripes may go on
                yield out(a[done], b[done], n[done])
                parts, held = [(a[~done], b[~done], n[~done])], 0
        if parts:
            yield out(*_count(*(np.concatenate(x) for x in zip(*parts))))

    return run


def pairs(df: DataFrame, basket: str, item: str, min_support: int = 1, min_lift: float = 0.0, min_llr: float = 0.0, block: int = 512) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, llr), item_a < item_b, one row per pair.

    n_ab, n_a and n_b count the distinct baskets with both, with a and with b; n all distinct baskets. lift is
    n_ab * n / (n_a * n_b); llr the log-likelihood ratio of the pair's 2 x 2 table, signed by whether the pair
    is more frequent than chance. Rows with a null basket or item do not count, repeated rows count once.
    An empty table gives no rows. Other columns of ``df`` are ignored.
    """
    if min_support < 1 or block < 2:
        raise ValueError("min_support must be at least 1, block at least 2")
    rows = df.select(F.col(basket).alias("u"), F.col(item).alias("i")).where("u IS NOT NULL AND i IS NOT NULL").distinct()
    rows = settle(rows)
    n = rows.select("u").distinct().count()
    counts = rows.groupBy("i").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min_support)
    if min_lift > 0:
        counts = counts.where(F.col("c") * F.lit(min_lift) <= n * (1 + 1e-9))
    # in order of frequency, so that the smaller id of a pair is the rarer item
    items = settle(counts.orderBy("c", "i").select("i", "c", F.monotonically_increasing_id().alias("x")))
    kept = rows.join(items.select("i", "x"), "i").select("u", "x")
    large = kept.groupBy("u").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > block)
    large = large.select("u", F.ceil(F.col("d") / block).cast("int").alias("blocks"))
    kept = kept.join(large, "u", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    kept = kept.select("u", "x", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    unit = kept.groupBy("u", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    units = unit.agg(
        F.collect_list(F.when(F.col("mine") <= F.col("other"), F.col("x"))).alias("one"),
        F.collect_list(F.when(F.col("mine") > F.col("other"), F.col("x"))).alias("two"),
    ).where((F.size("one") > 1) | (F.size("two") > 0)).select("one", F.when(F.col("p") == F.col("q"), F.array().cast("array<long>")).otherwise(F.col("two")).alias("two"), (F.col("p") < F.col("q")).alias("apart"))
    units = units.where(~F.col("apart") | ((F.size("one") > 0) & (F.size("two") > 0))).select("one", "two")
    stripes = units.mapInArrow(_stripes, STRIPE).repartition("a").sortWithinPartitions("a")
    found = stripes.mapInArrow(_merge(min_support), "a long, b long, n_ab long")
    for side in "ab":
        found = found.join(items.select(F.col("x").alias(side), F.col("i").alias(f"i_{side}"), F.col("c").alias(f"c_{side}")), side)
    first = F.col("i_a") < F.col("i_b")
    found = found.select(
        F.least("i_a", "i_b").alias("item_a"),
        F.greatest("i_a", "i_b").alias("item_b"),
        "n_ab",
        F.when(first, F.col("c_a")).otherwise(F.col("c_b")).alias("n_a"),
        F.when(first, F.col("c_b")).otherwise(F.col("c_a")).alias("n_b"),
        F.lit(n).cast("long").alias("n"),
    )
    found = found.withColumn("lift", F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
    return found.withColumn("llr", _llr()).where((F.col("lift") >= min_lift) & (F.col("llr") >= min_llr if min_llr > 0 else F.lit(True)))


def _llr():
    """2 * sum of k ln(k n / (row * column)) over the four cells."""

    def cell(k, row, column):
        return F.when(k > 0, k * F.ln(k.cast("double") * F.col("n") / (row.cast("double") * column))).otherwise(0.0)

    ab, a, b, n = (F.col(c) for c in ("n_ab", "n_a", "n_b", "n"))
    total = cell(ab, a, b) + cell(a - ab, a, n - b) + cell(b - ab, n - a, b) + cell(n - a - b + ab, n - a, n - b)
    return 2 * F.when(F.col("lift") >= 1, total).otherwise(-total)
