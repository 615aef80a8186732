"""Structured Streaming jobs: keyed intake, daily counts, read markers, stale requests.

Every sink is idempotent: a micro-batch overwrites the folder of its own batch
id, so a batch that runs twice after a lost executor leaves one result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from corrobora.session import ensure_checkpoint_dir, written


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_table_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet",
                      files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of what is there now.

    ``pattern`` names files; if it is the name of one table that is itself a folder of
    files, those are the stream.
    """
    table = spark._jvm.org.apache.hadoop.fs.Path(folder, pattern)
    system = table.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(table) and system.getFileStatus(table).isDirectory():
        folder, pattern = table.toString(), "*"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def upsert_batches(stream: DataFrame, keys: list[str], order: str, root: str, checkpoint: str, mode: str = "append"):
    """Start a writer that keeps the newest row per key of every micro-batch.

    Rows are merged on read (:func:`current_rows`), so a batch never rewrites
    the table; :func:`compact` folds the batches when there are many.
    """
    columns = [c for c in stream.columns if c not in keys]

    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("r"))
        last.select(*keys, "r.*").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def current_rows(spark: SparkSession, root: str, keys: list[str], order: str) -> DataFrame:
    """The newest row per key over all batches, whichever batch brought it: a combined aggregate.

    ``order`` decides; between rows of equal order the later batch does.
    """
    table = spark.read.option("basePath", root).parquet(root)
    columns = [c for c in table.columns if c not in keys and c != "batch"]
    return (table.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(F.col(order), F.col("batch").cast("long"))).alias("r"))
            .select(*keys, "r.*"))


def compact(spark: SparkSession, root: str, target: str, keys: list[str], order: str) -> None:
    """Fold all batches into one new folder that starts a fresh table."""
    current_rows(spark, root, keys, order).write.mode("overwrite").parquet(f"{target}/batch=0")


def daily_counts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Rows per day and type of an event stream with columns ts and event_type."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
            .agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n"))


def rolling_counts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Rows in the last seven days, renewed every day."""
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type")
            .agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), "event_type", "n"))


def mark_read(stream: DataFrame, keys: list[str], log: str, checkpoint: str, process: Callable[[DataFrame, int], None]):
    """Start a reader that hands each item to ``process(items, batch_id)`` once, however late a repeat comes.

    An item is marked only after ``process`` has returned: if it fails, the item is handed out
    again.  The log holds a folder per batch, and a batch that runs again ignores its own, so
    it hands out the same items.  There is no horizon and no state in memory; each batch is one
    anti-join with the log (:func:`fold_log` keeps its files few).  Null keys are items too.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        items = batch.select(*keys).distinct()
        seen = logged(spark, log)
        if seen is not None:
            seen = seen.where(F.col("batch") != batch_id).select(*[F.col(k).alias(f"seen_{k}") for k in keys])
            same = [items[k].eqNullSafe(seen[f"seen_{k}"]) for k in keys]
            items = items.join(seen, reduce(and_, same), "left_anti")
        items = written(items)
        process(items, batch_id)
        items.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return (stream.select(*keys).writeStream.option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(step).start())


def logged(spark: SparkSession, log: str) -> DataFrame | None:
    """What a read log holds, with the batch; None before the first mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    rows = spark.read.option("basePath", log).parquet(log)
    return rows.withColumn("batch", F.col("batch").cast("long"))


def fold_log(spark: SparkSession, log: str, target: str, keys: list[str]) -> None:
    """Copy a read log into one new folder, under a batch number no batch has."""
    logged(spark, log).select(*keys).distinct().write.mode("overwrite").parquet(f"{target}/batch=-1")


def stale_requests(requests: DataFrame, starts: DataFrame, on: str = "request_id", minutes: int = 120,
                   delay: str = "10 minutes") -> DataFrame:
    """Requests that nobody started within ``minutes``, as an outer join of two streams.

    ``requests(request_id, <on>, queued_at)``, ``starts(<on>, started_at)``: a request
    leaves, unmatched, when both watermarks have passed its limit.  Rows of either
    side may come first; each is held no longer than the limit and the delay.
    """
    queued = requests.withWatermark("queued_at", delay)
    begun = starts.withWatermark("started_at", delay).select(F.col(on).alias("_of"), "started_at")
    limit = F.expr(f"INTERVAL {int(minutes)} MINUTES")
    within = ((F.col(on) == F.col("_of")) & (F.col("started_at") >= F.col("queued_at"))
              & (F.col("started_at") <= F.col("queued_at") + limit))
    return (queued.join(begun, within, "left_outer").where("started_at IS NULL")
            .select("request_id", "queued_at", F.lit(f"abandoned — queued over {minutes} minutes").alias("reason")))


# --- batch twins -----------------------------------------------------------------------------

def request_status(requests: DataFrame, starts: DataFrame, as_of: str, minutes: int = 120) -> DataFrame:
    """Status of each request at ``as_of``: STARTED, FAILED (stale) or QUEUED.

    ``requests(request_id, user_id, ts)``, ``starts(user_id, ts)``.  Whether a
    start lies within the limit is decided from the first and last start per
    (user, slot of ``minutes``): two equi-joins on small aggregates instead of a
    range join, so a user with very many rows forms no pairs.
    """
    width = minutes * 60
    now = F.lit(as_of).cast("timestamp")
    slot = lambda c: F.floor(F.unix_micros(c) / F.lit(width * 1_000_000)).cast("long")
    seen = starts.where(F.col("ts") <= now).groupBy("user_id", slot(F.col("ts")).alias("slot")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    here = seen.select("user_id", "slot", "last_ts")
    after = seen.select("user_id", (F.col("slot") - 1).alias("slot"), "first_ts")
    out = (requests.where(F.col("ts") <= now).withColumn("slot", slot(F.col("ts")))
           .join(here, ["user_id", "slot"], "left").join(after, ["user_id", "slot"], "left"))
    limit = F.make_dt_interval(mins=F.lit(minutes))
    started = (F.coalesce(F.col("last_ts") >= F.col("ts"), F.lit(False))
               | F.coalesce(F.col("first_ts") <= F.col("ts") + limit, F.lit(False)))
    stale = F.col("ts") < now - limit
    return out.select("request_id", "user_id", "ts", F.when(started, "STARTED").when(stale, "FAILED")
                      .otherwise("QUEUED").alias("status"))


def next_waiting(status: DataFrame, as_of: str, at_least: int = 3, at_most: int = 120) -> DataFrame:
    """The oldest request that has waited long enough but not too long."""
    now = F.lit(as_of).cast("timestamp")
    age = lambda m: now - F.make_dt_interval(mins=F.lit(m))
    return (status.where((F.col("status") == "QUEUED") & (F.col("ts") < age(at_least)) & (F.col("ts") > age(at_most)))
            .orderBy("ts", "request_id").limit(1))
