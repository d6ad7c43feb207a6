"""Iterative k-core of a bipartite interaction log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import settle

#: Pairs that one task takes through all rounds that are left: three numbers each, 24 MB.
ONE_TASK = 1_000_000


def k_core(df: DataFrame, minimum: int, user: str = "user", item: str = "item", one_task: int = ONE_TASK) -> tuple[DataFrame, list[int]]:
    """The rows left when every user and item has ``minimum`` rows or more, and the rows kept in each round.

    Rows count, not distinct pairs. In each round users and items are counted on the same rows, and both
    conditions applied at once. Rounds see one row (user, item, rows) for each pair, settled and so the only thing
    that is rewritten; ``df`` is read twice, for these counts and for the rows of the users and items that are left.
    As soon as no more than ``one_task`` pairs are left, one task goes through the remaining rounds on arrays: they
    are many, and what a round costs a cluster is then more than its work.
    """
    if minimum < 1:
        raise ValueError("minimum must be at least 1")
    source = df.select(F.col(user).alias("u"), F.col(item).alias("i"))
    left = settle(source.groupBy("u", "i").agg(F.count(F.lit(1)).alias("n")))
    pairs, rows = _size(left)
    kept, total = [], rows
    while not kept or rows != before:
        before = rows
        if pairs <= one_task:
            left, kept = _finish(left, minimum, kept)
            break
        for side in "ui":
            enough = left.groupBy(side).agg(F.sum("n").alias("all")).where(F.col("all") >= minimum).select(side)
            some = some.join(enough, side, "left_semi") if side == "i" else left.join(enough, side, "left_semi")
        left = settle(some.select("u", "i", "n"))
        pairs, rows = _size(left)
        kept.append(rows)
        if rows == 0:
            break
    if kept[-1] == 0:
        raise ValueError("empty core")
    if kept[-1] == total:
        return settle(df), kept
    columns = df.columns
    for side, name in (("u", user), ("i", item)):
        df = df.join(left.select(F.col(side).alias(name)).distinct(), name, "left_semi")
    return settle(df.select(*columns)), kept


def _size(pairs: DataFrame) -> tuple[int, int]:
    """Pairs and rows."""
    n, rows = pairs.agg(F.count(F.lit(1)), F.sum("n")).first()
    return n, rows or 0


def _finish(pairs: DataFrame, minimum: int, kept: list[int]) -> tuple[DataFrame, list[int]]:
    """The pairs left after all further rounds, and the rows kept in each round."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    ended = settle(pairs.coalesce(1).mapInPandas(_rounds(minimum), f"{kinds}, gone int"))
    # in which round rows went, 0 where they stay: as many numbers as rounds
    gone = {r["gone"]: r["n"] for r in ended.groupBy("gone").agg(F.sum("n").alias("n")).collect()}
    rows, last = sum(gone.values()), max(gone, default=0)
    for no in range(1, last + 1):
        rows -= gone.get(no, 0)
        kept = [*kept, rows]
    # the round that finds nothing more is one as well
    return ended.where("gone = 0").select("u", "i", "n"), kept if kept and rows == 0 else [*kept, rows]


def _rounds(minimum: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        # rows without a user or an item never stay; -1 is theirs
        (u, users), (i, items) = (pd.factorize(rows[c]) for c in "ui")
        n, gone = rows["n"].to_numpy(), np.zeros(len(rows), dtype=np.int32)
        at, no = np.arange(len(rows)), 0
        while len(at):
            no += 1
            stays = np.ones(len(at), dtype=bool)
            for ids, names in ((u, users), (i, items)):
                mine = ids[at]
                sums = np.bincount(mine[mine >= 0], weights=n[at][mine >= 0], minlength=len(names))
                stays &= (mine >= 0) & (np.append(sums, 0)[mine] >= minimum)
            if stays.all():
                break
            gone[at[~stays]] = no
            at = at[stays]
        yield rows.assign(gone=gone)

    return run
