"""Terms of ranking and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def kl_term(x: Column, m: Column) -> Column:
    """One term of the divergence of x from m; 0 where x is 0."""
    return F.when(x > 0, x * F.ln((x + EPS) / (m + EPS))).otherwise(0.0)


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def gain(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)


def reciprocal(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0 / rank).otherwise(0.0)

