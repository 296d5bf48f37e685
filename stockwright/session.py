"""Session settings and lineage cutting."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# AQE picks broadcast joins from measured sizes, splits skewed join partitions and merges small
# shuffle partitions.  No operator forces a broadcast of a side that grows with the data.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of long texts reach the Python workers in batches of this size: a batch stands several times in an executor's memory
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # percentile() and collect_list() keep hashing up to this many groups per task before sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "8192",
}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='stockwright-')}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply ``SETTINGS`` to a session (only runtime SQL settings are touched) and ship the package."""
    ship(spark)
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one of this machine only in local mode."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="stockwright-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that later branches neither recompute it nor lose it with an executor.

    Writes to the folder of ``spark.checkpoint.dir``; a temporary folder is used only in local mode where none is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared checkpoint folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again: cuts lineage where rows are many."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
