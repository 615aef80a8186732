"""Tables written to the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corrobora.session import ensure_checkpoint_dir


def folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, on storage all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and return the written table.

    Later reads prune its columns, and a lost executor costs no recomputation.
    """
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shielded(docs: DataFrame, *named: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns but ``named`` out of the way of an operator's own; the map leads back."""
    away = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in named}
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; call it when results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
