"""Sessions, and the shared folder in which intermediate tables live.

An executor's own disk is lost with the executor. Lineage is therefore cut only by reliable
checkpoints or by tables written below ``spark.checkpoint.dir``, which all executors share.
"""

from __future__ import annotations

import gc
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every plan of this library is written for; a cluster may override each of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoints go when nothing refers to them any more, and are kept compressed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.checkpoint.compress": "true",
}


def local_session(cpus: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A session on this machine, for tests, the bench and the command line."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("cairn")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate data, on its own file system.

    Only a session on this very machine gets one made for it, as in tests; elsewhere a folder must be named.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cairn-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return qualified(spark, named)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system: one without a scheme lies on the session's default."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: survives lost executors, cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let go of shuffles and checkpoints that nothing refers to any more.

    Spark removes them when the driver collects its garbage, which in a loop of few and large jobs may never come.
    """
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a session that doesn't have it installed."""
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="cairn-ship-")  # on the driver, from where executors fetch it
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/cairn-package", "zip", home.parent, home.name))


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
