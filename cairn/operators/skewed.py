"""Per-key results where a few keys hold most rows: two-stage salted aggregation.

The keys that may hold ``heavy_share`` of all rows are named by a sketch of frequent items, in one pass whose
partial results are of a fixed size: no key is counted to find them. Their rows get a salt and are aggregated per (key, salt) first, spread
over all tasks; the partial results, at most ``salts`` a key, are then merged by key. All other keys have the one salt 0.
A key that the sketch leaves out or adds costs balance, never correctness.

The salt is drawn from a hash of a row-unique column rather than from ``rand()``: a task that runs again
after an executor was lost then draws the same salts, so no partial result counts twice or is missed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Measure:
    """An aggregate that can be merged from partial ones. kind: rows, count, sum, min, max or mean."""

    name: str
    kind: str
    column: str | None = None

    def __post_init__(self):
        if self.kind not in ("rows", "count", "sum", "min", "max", "mean"):
            raise ValueError(f"unknown kind of measure: {self.kind}")
        if self.kind != "rows" and not self.column:
            raise ValueError(f"{self.kind} needs a column")


def _partial(m: Measure, at: int):
    x = f"v{at}"
    if m.kind == "rows":
        return [F.count(F.lit(1)).alias(f"p{at}")]
    if m.kind == "count":
        return [F.count(x).alias(f"p{at}")]
    if m.kind == "mean":
        return [F.sum(F.col(x).cast("double")).alias(f"p{at}"), F.count(x).alias(f"q{at}")]
    return [getattr(F, m.kind)(x).alias(f"p{at}")]


def _merged(m: Measure, at: int):
    if m.kind in ("rows", "count", "sum"):
        return F.sum(f"p{at}").alias(m.name)
    if m.kind == "mean":
        return F.try_divide(F.sum(f"p{at}"), F.sum(f"q{at}")).alias(m.name)
    return getattr(F, m.kind)(f"p{at}").alias(m.name)


def heavy_hashes(rows: DataFrame, key: Column, heavy_share: float) -> list[int]:
    """The hashes of the keys that may hold ``heavy_share`` of the rows: at most ``2 / heavy_share``.

    The sketch tracks ``16 / heavy_share`` keys, which bounds its error by a quarter of ``heavy_share``.
    """
    most = min(math.ceil(2 / heavy_share), 125_000)  # of the sketch's limit of a million tracked keys; fewer cost balance only
    sketch = F.call_function("approx_top_k", key, F.lit(most), F.lit(max(16, 8 * most)))
    found = rows.agg(sketch.alias("top"), F.count(F.lit(1)).alias("n")).first()
    return sorted(t["item"] for t in found["top"] or [] if t["count"] >= 0.75 * heavy_share * found["n"])


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Measure],
    salt_by: Sequence[str] | None = None,
    heavy_share: float = 0.005,
    salts: int = 64,
) -> DataFrame:
    """One row per key: the key columns, then the measures by name.

    Rows in which a key column is null belong to no key and are left out. Measures skip nulls, as SQL does;
    a mean or sum of nothing is null. ``salt_by`` names columns that differ between the rows of a key (by
    default, all columns); rows equal in all of them share a salt, which costs balance, never correctness.
    An empty table gives no rows. Columns of ``df`` that are not named are ignored.
    """
    if not 0 < heavy_share <= 1 or salts < 1:
        raise ValueError("heavy_share must be above 0 and at most 1, salts at least 1")
    names = [f"k{i}" for i in range(len(keys))]
    salt = F.pmod(F.xxhash64(*(F.col(c) for c in (salt_by or df.columns))), F.lit(salts)).cast("int")
    rows = df.select(
        *(F.col(k).alias(n) for k, n in zip(keys, names)),
        *(F.col(m.column).alias(f"v{i}") for i, m in enumerate(measures) if m.column),
        salt.alias("salt"),
    )
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    key = F.xxhash64(*names)
    heavy = heavy_hashes(rows, key, heavy_share)
    rows = rows.withColumn("salt", F.when(key.isin(heavy), F.col("salt")).otherwise(0) if heavy else F.lit(0))
    partial = rows.groupBy(*names, "salt").agg(*(p for i, m in enumerate(measures) for p in _partial(m, i)))
    merged = partial.groupBy(*names).agg(*(_merged(m, i) for i, m in enumerate(measures)))
    return merged.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), *(m.name for m in measures))


def key_statistics(df: DataFrame, kinds: dict[str, str], measures: Sequence[Measure], salt_by: Sequence[str] | None = None, **options) -> DataFrame:
    """``salted_aggregate`` for several key columns in one pass: key_kind, key_id, then the measures.

    ``kinds`` maps a kind's name to the column that holds its keys; all of these need the same type.
    """
    kept = dict.fromkeys([*(m.column for m in measures if m.column), *(salt_by or df.columns)])
    pairs = F.array(*(F.struct(F.lit(kind).alias("key_kind"), F.col(column).alias("key_id")) for kind, column in kinds.items()))
    rows = df.select(F.explode(pairs).alias("__key"), *(F.col(c).alias(f"in_{c}") for c in kept))
    rows = rows.select("__key.key_kind", "__key.key_id", *(f"in_{c}" for c in kept))
    renamed = [Measure(m.name, m.kind, m.column and f"in_{m.column}") for m in measures]
    return salted_aggregate(rows, ["key_kind", "key_id"], renamed, [f"in_{c}" for c in (salt_by or df.columns)], **options)
