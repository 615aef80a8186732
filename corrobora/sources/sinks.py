"""Sinks: keyed upserts, the registry sync, append-only ledgers and snapshots.

No table format is assumed.  An upsert is a new snapshot directory; a ledger
takes numbered batches; a citation snapshot merges into the folders it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.session import written


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str, keep: tuple = ()) -> DataFrame:
    """Base with the delta's rows on top: last write per key wins.

    Columns in ``keep`` are not overwritten by a null.  ``order`` ranks writes
    within the delta.  Both sides combine per key before the shuffle, so a key
    written a million times moves once per task.
    """
    columns = [c for c in base.columns if c not in keys]
    tagged = base.withColumn("_w", F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("seq"))).unionByName(
        delta.withColumn("_w", F.struct(F.lit(1).alias("side"), F.col(order).cast("long").alias("seq"))).select(*base.columns, "_w"))
    plain = [c for c in columns if c not in keep]
    aggs = [F.max_by(F.struct(*plain), "_w").alias("_last")]
    # max_by over non-null values only: the newest value that is there.
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_w"))).alias(c) for c in keep]
    out = tagged.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[F.col(f"_last.{c}") for c in plain], *keep).select(*base.columns)


def sync_registry(base: DataFrame, incoming: DataFrame, archive: DataFrame) -> DataFrame:
    """Registry after a sync: incoming rows are the truth, nothing is deleted.

    ``archive(registry_id, archived_on)`` lists sources to retire; a retired one
    keeps its first date, one no longer listed is revived.
    """
    columns = [c for c in base.columns if c not in ("registry_id", "archived_on")]
    old = base.select("registry_id", F.lit(True).alias("_o"), F.struct(*columns, "archived_on").alias("_old"))
    new = incoming.select("registry_id", F.lit(True).alias("_n"), F.struct(*columns).alias("_new"))
    gone = archive.select("registry_id", F.col("archived_on").alias("_gone"))
    out = old.join(new, "registry_id", "full_outer").join(gone, "registry_id", "left")
    pick = [F.when(F.col("_n"), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns]
    retired = F.when(F.col("_gone").isNotNull(), F.coalesce(F.col("_old.archived_on"), F.col("_gone"))) \
        .when(F.col("_n"), F.lit(None)).otherwise(F.col("_old.archived_on"))
    return out.select("registry_id", *pick, retired.alias("archived_on"))


def _names(spark, path: str) -> list[str]:
    """Names in a folder of any file system Spark knows, none if it is not there; reads no file."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def append_gaps(gaps: DataFrame, path: str, batch: int) -> None:
    """Add a batch of refusals to the gap ledger, one folder per batch and rule.

    A batch that is written again replaces itself, so a retry leaves no row twice.
    """
    gaps.write.mode("overwrite").partitionBy("raised_by").parquet(f"{path.rstrip('/')}/batch={int(batch)}")


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Write a whole table as a numbered snapshot; readers take the latest."""
    path = f"{root.rstrip('/')}/v={version:010d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_latest(spark, root: str) -> DataFrame:
    """The newest snapshot below ``root``, found by folder name."""
    versions = [n for n in _names(spark, root) if n.startswith("v=")]
    if not versions:
        raise ValueError(f"no snapshot below {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{max(versions)}")


def write_citations(frozen: DataFrame, path: str, buckets: int = 256) -> None:
    """Freeze citations: replace the reports of the frame, keep all others.

    Reports hash into a fixed number of folders, since a folder per report
    would be millions of small files.  Only folders that the frame touches are
    read, merged and written.  The frame is worked out once, and the merged rows are cut
    from what they replace by a written table.
    """
    spark = frozen.sparkSession
    bucket = F.pmod(F.xxhash64("report_id"), F.lit(buckets))
    out = frozen
    if any(n.startswith("bucket=") for n in _names(spark, path)):
        frozen = written(frozen)
        touched = frozen.select(bucket.alias("bucket")).distinct()
        out = bucketed_merge(spark.read.parquet(path).join(touched, "bucket", "left_semi"), frozen)
        out = written(out)
    (out.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def bucketed_merge(stored: DataFrame, frozen: DataFrame) -> DataFrame:
    """Stored citation rows with the reports of ``frozen`` replaced by their new rows."""
    rest = stored.drop("bucket").join(frozen.select("report_id").distinct(), "report_id", "left_anti")
    return rest.unionByName(frozen.select(*rest.columns))


def write_review(plan: DataFrame, path: str) -> None:
    """The review sheet as CSV files with a header."""
    plan.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
