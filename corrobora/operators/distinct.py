"""Exact distinct counts that merge: what several groups hold is counted by OR, not again.

An item (a document, a signal) gets a bit once, however many groups hold it.  Items are
laid out by their first group, so a group's bits lie in few buckets of 32,768; what
moves afterwards are bitmaps of 4 kB per (group, bucket), never rows per item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ITEMS = "items"


def bitmaps(pairs: DataFrame, group: str, item: str, marks: tuple = ()) -> DataFrame:
    """(group, bucket, items, *marks): a bitmap of the distinct items of each group and bucket.

    ``marks`` are boolean columns of ``pairs`` that depend on the item alone; each gets a bitmap
    of the items for which it holds.  A null item or group is no item.  An item's
    groups are gathered in one row, so they are bounded by the catalogue of groups.  Ids
    follow the sorted order of a range, so a task that runs again gives the same ones.
    """
    one = (pairs.where(F.col(item).isNotNull() & F.col(group).isNotNull()).groupBy(item)
           .agg(F.array_sort(F.collect_set(group)).alias("groups"), *[F.max(m).alias(m) for m in marks])
           .withColumn("first", F.get("groups", F.lit(0))))
    placed = (one.repartitionByRange("first", item).sortWithinPartitions("first", item)
              .withColumn("id", F.monotonically_increasing_id()))
    bit = F.bitmap_bit_position("id")
    return (placed.select(F.explode("groups").alias(group), "id", *marks)
            .groupBy(group, F.bitmap_bucket_number("id").alias("bucket"))
            .agg(F.bitmap_construct_agg(bit).alias(ITEMS),
                 *[F.bitmap_construct_agg(F.when(F.col(m), bit)).alias(m) for m in marks]))


def counts_above(members: DataFrame, key: str, group: str, bits: DataFrame, name: str) -> DataFrame:
    """(key, name, *marks): distinct items of all groups below each key; ``members(key, group)``."""
    columns = [c for c in bits.columns if c not in (group, "bucket")]
    merged = (members.select(key, group).distinct().join(bits, group) if key != group else bits.join(members.select(key).distinct(), key))
    merged = merged.groupBy(key, "bucket").agg(*[F.bitmap_or_agg(c).alias(c) for c in columns])
    return merged.groupBy(key).agg(*[F.sum(F.bitmap_count(c)).alias(name if c == ITEMS else c) for c in columns])


def counts_by_sets(members: DataFrame, key: str, group: str, pairs: DataFrame, item: str, marks: tuple, name: str) -> DataFrame:
    """What ``counts_above`` over ``bitmaps`` gives, for items that mostly lie in the same few sets of groups.

    Items of one set of groups are counted together before the keys multiply them, so no
    item is numbered or put in order.  Items with sets of their own stay one row each and key.
    """
    one = (pairs.where(F.col(item).isNotNull() & F.col(group).isNotNull()).groupBy(item)
           .agg(F.array_sort(F.collect_set(group)).alias("set"), *[F.max(m).alias(m) for m in marks]))
    sets = one.groupBy("set").agg(F.count("*").alias(name), *[F.count_if(m).alias(m) for m in marks])
    sums = [name, *marks]
    above = members.select(key).distinct().withColumn(group, F.col(key)) if key == group else members.select(key, group).distinct()
    met = (sets.select("*", F.explode("set").alias("in")).join(above.select(F.col(key).alias("at"), F.col(group).alias("in")), "in")
           .groupBy("at", "set").agg(*[F.first(c).alias(c) for c in sums]))
    return met.groupBy(F.col("at").alias(key)).agg(*[F.sum(c).alias(c) for c in sums])
