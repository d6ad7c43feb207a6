"""The N best items of every group, by statistics-guided skipping.

The table is laid out once: clustered by group, rows of a group in descending score. Range partitioning by (group, hash
of item) cuts a group of any size into files of about equal size, and keeps all rows of one item of a group in one file.
A file's row groups are cut at the borders of large groups: a row group holds either rows of one large group, or small groups as
a whole. Each file is then read on its own, row groups in descending order of their maximal score, which the footer
holds. A row group whose maximum is strictly below the current N-th score of every group in it is skipped unread; one
whose maximum equals it is read, for its items may win the tie. Small groups lie in one row group each, of which nothing
is known before it is read; of a large group the first row groups of each file are read, and what lies behind is skipped.
At most N rows a group and file meet in the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.session import remove_path, scratch_path, settle
from cairn.sources.paths import open_input, open_output

#: Rows of a row group; of small groups read at once.
ROW_GROUP, WAVE = 2_048, 65_536


def _cuts(groups: pa.Array, size: int) -> list[int]:
    """Where row groups end over rows sorted by group: each is ``size`` rows of one group or the rest of it, or whole groups of fewer rows together."""
    if not len(groups):
        return []
    runs = pc.run_end_encode(groups)
    ends = np.asarray(runs.run_ends.to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts, begin, start = [], 0, 0
    for end in ends.tolist():
        if end - start > size:
            if start > begin:
                cuts.append(start)
            cuts += [*range(start + size, end, size), end]
            begin = end
        elif end - begin > size:
            cuts.append(start)
            begin = start
        start = end
    if begin < len(groups):
        cuts.append(len(groups))
    return cuts


def _writer(folder: str, schema: pa.Schema, size: int):
    """Each partition as one file; its name comes back from the attempt that ended well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri, sink, held = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.parquet", None, None

        def put(table: pa.Table, last: bool) -> pa.Table:
            """Write what is sure to be complete: all but the last group, of which more may come, unless it fills row groups by itself."""
            cuts, at = _cuts(table["g"].combine_chunks(), size), 0
            if not last and cuts:
                final = table["g"][-1]
                while cuts and table["g"][cuts[-1] - 1] == final and (cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0) < size or table["g"][cuts[-2] if len(cuts) > 1 else 0] != final):
                    cuts.pop()
            for cut in cuts:
                sink.write_table(table.slice(at, cut - at), row_group_size=cut - at)
                at = cut
            return table.slice(at)

        stream = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                stream = open_output(uri)
                sink = pq.ParquetWriter(stream, schema, use_dictionary=["g"], write_statistics=True)
            table = pa.Table.from_batches([batch]).cast(schema)
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= 4 * size:
                held = put(held, False)
        if sink is not None:
            put(held, True)
            sink.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri]})

    return run


def cluster(df: DataFrame, groups: Sequence[str], item: str, score: str, folder: str, row_group: int = ROW_GROUP) -> DataFrame:
    """(uri) of the files written below ``folder``: the usable rows of ``df`` as (g, item, score), clustered by group. g is the group as JSON."""
    key = F.to_json(F.struct(*(F.col(c).alias(f"g{i}") for i, c in enumerate(groups))), {"ignoreNullFields": "false"})
    rows = df.select(key.alias("g"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    rows = rows.where(F.col("item").isNotNull() & finite)
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(), "float": pa.float32()}
    schema = pa.schema([("g", pa.string()), ("item", kinds[rows.schema["item"].dataType.simpleString()]), ("score", pa.float64())])
    rows = rows.repartitionByRange("g", F.xxhash64("item")).sortWithinPartitions("g", F.desc("score"))
    return settle(rows.mapInArrow(_writer(folder, schema, row_group), "uri string"))


def best(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n best items of each g; an item counts once, with its highest score; ties go to the smaller item."""
    rows = rows.sort_values(["g", "score", "item"], ascending=[True, False, True], kind="stable")
    rows = rows.drop_duplicates(["g", "item"])
    return rows[rows.groupby("g", sort=False).cumcount() < n]


@dataclass
class Found:
    """The best rows of one file, and how many row groups and rows were read for them and skipped."""

    rows: pd.DataFrame
    read: int = 0
    skipped: int = 0
    rows_read: int = 0
    rows_skipped: int = 0


def read_best(uri: str, n: int) -> Found:
    """The n best items of each group of one file. Of each group only its own n rows are held and sorted again."""
    with open_input(uri) as handle:
        file = pq.ParquetFile(handle)
        names = {file.metadata.schema.column(i).path: i for i in range(len(file.metadata.schema))}
        todo = []
        for r in range(file.num_row_groups):
            meta = file.metadata.row_group(r)
            g, s = meta.column(names["g"]).statistics, meta.column(names["score"]).statistics
            top = s.max if s is not None and s.has_min_max else float("inf")
            only = g.min if g is not None and g.has_min_max and g.min == g.max else None
            todo.append((top, r, only, meta.num_rows))
        todo.sort(key=lambda x: (-x[0], x[1]))
        found, parts, large = Found(file.schema_arrow.empty_table().to_pandas()), [], {}
        wave, size = [], 0

        def small() -> None:
            if wave:
                parts.append(best(file.read_row_groups(wave).to_pandas(), n))
                wave.clear()

        for top, r, only, rows in todo:
            mine = large.get(only) if only is not None else None
            if mine is not None and len(mine) >= n and top < mine["score"].iloc[-1]:
                found.skipped, found.rows_skipped = found.skipped + 1, found.rows_skipped + rows
                continue
            found.read, found.rows_read = found.read + 1, found.rows_read + rows
            if only is None:
                wave.append(r)
                size += rows
                if size >= WAVE:
                    small()
                    size = 0
            else:
                fresh = file.read_row_group(r).to_pandas()
                large[only] = best(fresh if mine is None else pd.concat([mine, fresh], ignore_index=True), n)
        small()
        parts += large.values()
        if parts:
            found.rows = pd.concat(parts, ignore_index=True)
        return found


def _reader(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["uri"]:
                found = read_best(uri, n)
                yield found.rows.assign(read=None, skipped=None, rows_read=None, rows_skipped=None)
                yield pd.DataFrame({"g": [None], "item": [None], "score": [None], "read": [found.read], "skipped": [found.skipped], "rows_read": [found.rows_read], "rows_skipped": [found.rows_skipped]})

    return run


def _search(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int, row_group: int) -> DataFrame:
    """The best rows of each file, and a row of counts a file. The files are gone when this returns."""
    if n < 1 or row_group < 1:
        raise ValueError("n and row_group must be at least 1")
    spark = df.sparkSession
    folder = scratch_path(spark, "groups")
    files = cluster(df, groups, item, score, folder, row_group)
    kind = df.schema[item].dataType.simpleString()
    try:
        found = files.repartition(max(1, files.count()), "uri").mapInPandas(_reader(n), f"g string, item {kind}, score double, read long, skipped long, rows_read long, rows_skipped long")
        return settle(found)
    finally:
        remove_path(spark, folder)


def top_n(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int, row_group: int = ROW_GROUP) -> DataFrame:
    """(groups..., item, score, rank): the n best items of every group, or all if there are fewer.

    Rows with a null item or a null, NaN or infinite score do not count. An item counts once per group, with
    its highest score; repeated rows change nothing. Equal scores go to the smaller item. A group column may
    be null: nulls form a group. An empty table gives no rows. Other columns of ``df`` are ignored.
    """
    found = _search(df, groups, item, score, n, row_group).where("g IS NOT NULL")
    order = W.partitionBy("g").orderBy(F.desc("score"), "item")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    schema = "struct<" + ",".join(f"g{i}:{df.schema[c].dataType.simpleString()}" for i, c in enumerate(groups)) + ">"
    found = found.withColumn("g", F.from_json("g", schema))
    return found.select(*(F.col(f"g.g{i}").alias(c) for i, c in enumerate(groups)), F.col("item").alias(item), F.col("score").alias(score), "rank")


def skipping(df: DataFrame, groups: Sequence[str], item: str, score: str, n: int, row_group: int = ROW_GROUP) -> DataFrame:
    """One row: the row groups and the rows that ``top_n`` reads and skips."""
    found = _search(df, groups, item, score, n, row_group).where("g IS NULL")
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "skipped", "rows_read", "rows_skipped")))
