"""Results of one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One row with the columns of all ``frames``, each of one row and with columns of its own: no join is needed."""
    names = [c for f in frames for c in f.columns]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.agg(*(F.max(c).alias(c) for c in names))
