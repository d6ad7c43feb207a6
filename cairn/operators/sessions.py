"""Sessions by inactivity gap, by start-end pairing.

A row starts a session if no row of its user lies within the gap before it, and ends one if none lies
within the gap after it: two RANGE frames. Starts and ends are numbered separately; the n-th start
belongs to the n-th end. Nothing is kept per session while rows are scanned.

A window over a whole user would put a user that holds a third of all rows into one task. Rows are
first merged to one per (user, time), with partial aggregation before the shuffle, then cut into time
slices; a window covers one (user, slice), at most ``slice_seconds`` rows whatever the data. Rows
within a gap of a slice's edge are also sent to the neighbouring slice, where they only serve as
predecessors or successors. Numbers within slices become numbers within users through the running
totals of the user's slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.session import settle


def _slice(ts: Column, width: int) -> Column:
    return F.floor(ts / F.lit(width)).cast("long")


def boundaries(df: DataFrame, user: str, ts: str, gap: int = 1800, slice_seconds: int = 86_400) -> DataFrame:
    """(u, k, t, n, starts, ends, s, e, c): the rows at which sessions start or end, and each slice's last row.

    s, e and c are the running numbers of starts, ends and rows within the slice, this row included.
    """
    if gap < 0 or slice_seconds <= 0:
        raise ValueError("gap must be 0 or more, slice_seconds positive")
    width = max(slice_seconds, gap)
    rows = df.select(F.col(user).alias("u"), F.col(ts).cast("long").alias("t"))
    rows = rows.where(F.col("u").isNotNull() & F.col("t").isNotNull() & (F.col("t") > 0))
    rows = rows.groupBy("u", "t").agg(F.count(F.lit(1)).alias("n"))
    near = F.array_distinct(F.array(*(_slice(F.col("t") + d, width) for d in (-gap, 0, gap))))
    rows = rows.select("u", "t", "n", F.explode(near).alias("k"))
    rows = rows.withColumn("own", F.col("k") == _slice(F.col("t"), width))

    group = W.partitionBy("u", "k")
    order = group.orderBy("t")
    before = F.count(F.lit(1)).over(order.rangeBetween(-gap, -1)) if gap else F.lit(0)
    after = F.count(F.lit(1)).over(order.rangeBetween(1, gap)) if gap else F.lit(0)
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("*", (F.col("own") & (before == 0)).alias("starts"), (F.col("own") & (after == 0)).alias("ends"))
    rows = rows.select(
        "*",
        F.sum(F.col("starts").cast("long")).over(so_far).alias("s"),
        F.sum(F.col("ends").cast("long")).over(so_far).alias("e"),
        F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).over(so_far).alias("c"),
        F.max(F.when(F.col("own"), F.col("t"))).over(group).alias("last"),
    )
    kept = rows.where(F.col("starts") | F.col("ends") | (F.col("own") & (F.col("t") == F.col("last"))))
    return kept.select("u", "k", "t", "n", "starts", "ends", "s", "e", "c")


def sessionize(df: DataFrame, user: str, ts: str, gap: int = 1800, slice_seconds: int = 86_400) -> DataFrame:
    """One row per session: user, start_ts, end_ts, duration, n_events.

    Rows with a null user, a null ts or ts <= 0 do not count. Rows whose times differ by exactly ``gap``
    belong together; equal times always do, and repeated rows count as events. A single row is a session
    of duration 0. An empty table gives no rows. Other columns of ``df``, whatever their names, are ignored.
    """
    kept = settle(boundaries(df, user, ts, gap, slice_seconds))
    totals = kept.groupBy("u", "k").agg(F.max("s").alias("s"), F.max("e").alias("e"), F.max("c").alias("c"))
    earlier = W.partitionBy("u").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("u", "k", *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}0") for x in "sec"))
    rows = kept.where(F.col("starts") | F.col("ends")).join(offsets, ["u", "k"])
    starts = rows.where("starts").select("u", (F.col("s") + F.col("s0")).alias("no"), F.col("t").alias("start_ts"), (F.col("c") - F.col("n") + F.col("c0")).alias("rows_before"))
    ends = rows.where("ends").select("u", (F.col("e") + F.col("e0")).alias("no"), F.col("t").alias("end_ts"), (F.col("c") + F.col("c0")).alias("rows_so_far"))
    return starts.join(ends, ["u", "no"]).select(
        F.col("u").alias(user),
        "start_ts",
        "end_ts",
        (F.col("end_ts") - F.col("start_ts")).alias("duration"),
        (F.col("rows_so_far") - F.col("rows_before")).alias("n_events"),
    )
