"""Session settings the library is designed for, and the checkpoint directory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE picks broadcast joins from *measured* sizes, splits skewed join partitions
# and merges small ones, so the library never hints a broadcast by hand.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# Whether a query that has ended leaves its shuffle files behind.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the library's settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  Only a local
    session without one gets a temporary folder; a cluster without one is an
    error, because a machine-local checkpoint is lost with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a table written below the checkpoint directory: lineage cut by one pass over it.

    A checkpoint computes its rows twice, once to count and once to write them.  ``options`` go to
    the writer (``compression="zstd"`` for long texts).  What was shuffled for the table is deleted
    when it is written, not when the driver happens to collect its garbage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/cuts/{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(SHUFFLE_CLEANUP, "false")
    df.sparkSession.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        df.sparkSession.conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
