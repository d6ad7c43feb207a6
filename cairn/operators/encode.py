"""Numbers in order, without a window over the whole table or over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import settle


def number_rows(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """``df`` with the rank of each row from 0 in a total order, as ``name``.

    Rows are range partitioned and sorted, which cuts a key of any size into several partitions; a rank is the
    number of rows in the partitions before, for which only their sizes are collected, plus the position.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits of this id are the partition's number, the lower 33 the position within it
    placed = settle(rows.withColumn("__at", F.monotonically_increasing_id()))
    part, low = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "__p long, __before long")
    placed = placed.withColumn("__p", part).join(F.broadcast(offsets), "__p")  # one row a partition
    return placed.withColumn(name, F.col("__before") + low).drop("__p", "__at", "__before")


def dense_ids(df: DataFrame, order: str, name: str) -> DataFrame:
    """Distinct non-null values of ``order`` with their rank from 0, as ``name``."""
    values = df.select(order).where(F.col(order).isNotNull()).distinct()
    return number_rows(values, order, name=name).select(order, F.col(name).cast("int").alias(name))


def require_known(df: DataFrame, catalogue: DataFrame, key: str) -> None:
    """Raise if a row's ``key`` is not in the catalogue."""
    stray = df.select(key).join(catalogue.select(key), key, "left_anti").limit(1).collect()
    if stray:
        raise ValueError(f"{key} {stray[0][0]} is not in the catalogue")


def strays(df: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """(key, n_rows): the non-null values of ``key`` that the catalogue does not have. Rows are counted before the join."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(catalogue.select(key), key, "left_anti")
