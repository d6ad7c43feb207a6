"""Files in and out: archives, CSV, Parquet, JSON, array files, and the cache of stages."""

from __future__ import annotations

import hashlib
import io
import json
import logging
import shutil
import urllib.request
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.encode import number_rows
from cairn.sources import paths

RATINGS = "userId INT, movieId INT, rating FLOAT, timestamp BIGINT"
MOVIES = "movieId INT, title STRING, genres STRING"
log = logging.getLogger("cairn")


def fetch(url: str, target: str, force: bool = False) -> Path:
    """Download a file once; a copy that is there is kept unless ``force``. A broken download leaves no file."""
    path = Path(target)
    if force or not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(path.name + ".part")
        with urllib.request.urlopen(url) as source, open(part, "wb") as sink:
            shutil.copyfileobj(source, sink, 1 << 20)
        part.replace(path)
    return path


def extract(archive: str, folder: str) -> Path:
    """Unpack a ZIP file after its checksums held; members may not leave the folder."""
    with zipfile.ZipFile(archive) as z:
        if (bad := z.testzip()) is not None:
            raise RuntimeError(f"damaged archive member: {bad}")
        z.extractall(folder)
    return Path(folder)


def file_hashes(spark: SparkSession, path: str, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(path, length, sha256) of files of any size: each is read once, in chunks."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def rows(batches):
        for batch in batches:
            hashes = []
            for uri in batch["path"]:
                found = hashlib.sha256()
                with paths.open_input(uri) as f:
                    while chunk := f.read(chunk_bytes):
                        found.update(chunk)
                hashes.append(found.hexdigest())
            yield batch.assign(sha256=hashes)

    return files.mapInPandas(rows, "path string, length long, sha256 string")


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of a scan in the order of its files and of the places in them, however it is cut into tasks."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("no"))
    return number_rows(df.withColumn("__place", at), "__place", name="__row").where(F.col("__row") < n).drop("__place", "__row")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, max_rows: int | None = None) -> DataFrame:
    """RFC 4180 CSV with a header; the types are given, or inferred where they aren't. ``max_rows`` keeps the first in file order."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df if max_rows is None else first_rows(df, max_rows)


def read_ratings(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """One line a rating, without quoted line breaks, so that a file is read in parts."""
    df = spark.read.option("header", True).schema(RATINGS).csv(path)
    return df if max_rows is None else first_rows(df, max_rows)


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue with catalog_pos, the row's place in the file."""
    return read_csv(spark, path, MOVIES).withColumn("catalog_pos", F.monotonically_increasing_id())


def obtain(url: str, folder: str, names: Sequence[str], force: bool = False) -> Path:
    """``folder`` with the files ``names``, from a ZIP file at ``url`` unless all are there; they may lie in a folder of the archive."""
    home = Path(folder)
    if force or not all((home / n).exists() for n in names):
        extract(str(fetch(url, str(home / url.rpartition("/")[2]), force)), folder)
        for n in names:
            found = [p for p in home.rglob(n)]
            if not found:
                raise FileNotFoundError(f"{n} is not in {url}")
            if home / n not in found:
                found[0].replace(home / n)
    return home


_KINDS = {"i4": "int", "i8": "bigint", "f4": "float", "f8": "double", "b1": "boolean"}


def _arrays(uri: str, names: Sequence[str] | None) -> dict[str, np.ndarray]:
    """The arrays named of one file; the members of an archive that aren't named stay unread."""
    with paths.open_input(uri) as f:
        found = np.load(f, allow_pickle=False)
        return {"value": found} if isinstance(found, np.ndarray) else {k: found[k] for k in (names or found.files)}


def read_arrays(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Arrays of equal length from NPZ or NPY files as columns; only the arrays named are unpacked.

    Files are opened where they lie, one a task, and only the types of the first one's arrays come to the driver.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    sample = files.first()
    if sample is None:
        raise FileNotFoundError(path)

    def kinds(batches):
        for batch in batches:
            rows = [(k, _KINDS[v.dtype.str[1:]], v.ndim) for uri in batch["path"] for k, v in _arrays(uri, names).items()]
            yield pd.DataFrame(rows, columns=["name", "kind", "dims"])

    first = spark.createDataFrame([tuple(sample)], "path string").mapInPandas(kinds, "name string, kind string, dims int").collect()
    schema = ", ".join(f"`{r['name']}` " + "array<" * (r["dims"] - 1) + r["kind"] + ">" * (r["dims"] - 1) for r in first)

    def rows(batches):
        for batch in batches:
            for uri in batch["path"]:
                yield pd.DataFrame({k: list(v) if v.ndim > 1 else v for k, v in _arrays(uri, names).items()})

    return files.mapInPandas(rows, schema)


def write_arrays(df: DataFrame, folder: str, name: str = "part") -> list[str]:
    """The columns of ``df`` as arrays of one NPZ file a partition; the files' URIs. Array columns must be of equal length throughout."""
    columns = df.columns

    def rows(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            whole, uri = pd.concat(parts), f"{folder}/{name}-{TaskContext.get().partitionId():05d}.npz"
            held = io.BytesIO()
            np.savez(held, **{c: np.stack(whole[c]) if whole[c].dtype == object else whole[c].to_numpy() for c in columns})
            with paths.open_output(uri) as f:
                f.write(held.getvalue())
            yield pd.DataFrame({"uri": [uri]})

    return [r["uri"] for r in df.mapInPandas(rows, "uri string").collect()]


def write_split(df: DataFrame, path: str) -> None:
    """One folder a split, so that a reader of one split never opens the others."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` is for reports of bounded size."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def ragged(df: DataFrame, user: str = "user", item: str = "item", order: str = "pos") -> DataFrame:
    """(user, items): each user's items in order, as one array."""
    lists = df.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(order, item))).alias("x"))
    return lists.select(user, F.col(f"x.{item}").alias("items"))


def save_json(path: str, value) -> None:
    """Sorted keys, two spaces, non-ASCII as it is."""
    text = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"
    with paths.open_output(path) as f:
        f.write(text.encode())


def load_json(path: str):
    with paths.open_input(path) as f:
        return json.loads(f.read())


def save_row(df: DataFrame, path: str) -> dict:
    """The one row of ``df`` as JSON."""
    (row,) = df.take(2)
    save_json(path, row.asDict(recursive=True))
    return row.asDict(recursive=True)


def cached(spark: SparkSession, path: str, key: str, make: Callable[[], DataFrame], force: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """The table at ``path`` if it was written under the same ``key``, else ``make()``, written there.

    The key is a hash of the settings and the input files the table depends on: others never meet an old table. The mark
    is written last, so that a stage cut short is made again.
    """
    mark = spark.read.text(f"{path}.key") if not force and _exists(spark, f"{path}.key") else None
    if mark is not None and mark.first()[0] == key:
        log.info("reusing %s", path)
        return spark.read.parquet(path)
    log.info("making %s", path)
    make().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    spark.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.key")
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
