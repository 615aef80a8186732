"""Identifiers that are never reissued."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corrobora import vocab
from corrobora.session import ensure_checkpoint_dir


def high_water(texts: DataFrame, column: str) -> DataFrame:
    """(prefix, top): highest number seen per id prefix in ids or running text.

    Union live ids, report bodies and frozen citations first; ids in text retire
    as surely as ids in tables.
    """
    ids = F.regexp_extract_all(F.col(column), F.lit(vocab.MINTED_ID), F.lit(0))
    one = texts.select(F.explode(F.array_distinct(ids)).alias("id"))
    return (one.select(F.regexp_extract("id", r"^(.*-)\d+$", 1).alias("prefix"),
                       F.regexp_extract("id", r"(\d+)$", 1).cast("decimal(38,0)").alias("n"))
            .groupBy("prefix").agg(F.max("n").cast("long").alias("top")))


def mint(rows: DataFrame, order: str, top: DataFrame, buckets: int | None = None, width: int = 2) -> DataFrame:
    """Number ``rows(prefix, <order>)`` per prefix above ``top``, by ``order``.

    ``order`` is unique within its prefix.  Rows are range-partitioned on (prefix,
    order), so ranges are even however they are spread; each range is numbered
    on its own and starts after the rows of the ranges before it.  The ranges are
    frozen in a checkpoint: a task that runs again sees the same ones.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    parts = [buckets] if buckets else []
    placed = (rows.repartitionByRange(*parts, "prefix", order)
              .withColumn("bucket", F.spark_partition_id()).checkpoint())
    sizes = placed.groupBy("prefix", "bucket").agg(F.count("*").alias("n"))
    # One row per range and prefix reaches this window.
    before = Window.partitionBy("prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("prefix", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = starts.join(top, "prefix", "left").select(
        "prefix", "bucket", (F.col("start") + F.coalesce("top", F.lit(0))).alias("start"))
    within = F.row_number().over(Window.partitionBy("prefix", "bucket").orderBy(order))
    digits = (F.col("start") + F.col("rk")).cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return (placed.withColumn("rk", within).join(starts, ["prefix", "bucket"])
            .withColumn("id", F.concat("prefix", padded)).drop("bucket", "rk", "start"))
