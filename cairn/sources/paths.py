"""Files by their URI, wherever they lie: opened in Python on executors, written through Hadoop on the driver."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

#: Hadoop's names of schemes that have another one in Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasbs": "abfss"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a URI, and the path in it. A path without a scheme, or file:/x, is local."""
    scheme, sep, rest = uri.partition(":")
    if not sep or scheme == "file":
        return pafs.LocalFileSystem(), ("/" + rest.lstrip("/")) if sep else uri
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def open_input(uri: str):
    """A seekable file, of which only what is asked for is read."""
    fs, path = filesystem(uri)
    return fs.open_input_file(path)


def open_output(uri: str):
    fs, path = filesystem(uri)
    if folder := path.rpartition("/")[0]:
        fs.create_dir(folder, recursive=True)
    return fs.open_output_stream(path)


def stamps(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, time of change) of a file, or of the files of a folder, in order: tells one input from another."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where))
