"""Genre profiles kept up to date from a stream of interactions. The batch pipeline does not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def genre_mass(interactions: DataFrame, shares: DataFrame, user: str = "user", item: str = "item") -> DataFrame:
    """(user, genre, w) of a stream, for update or complete mode: each interaction adds its item's genre shares.

    ``shares`` is a static table. Every row counts, as in the batch profiles; the state is one number a user
    and genre. Normalise w by user when it is read.
    """
    return interactions.join(shares, item).groupBy(user, "genre").agg(F.sum("share").alias("w"))
