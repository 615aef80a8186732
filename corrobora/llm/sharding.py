"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard.  At every level the children draw
``-ln(u) / weight`` with ``u`` hashed from the document's id and the child's
name, and the smallest draw wins.  A child's draw does not depend on its siblings,
so when weights change, rows move only into subtrees that gained weight or out
of those that lost it.  Capacity that comes as a region of its own takes rows
only into itself.

Defined results: a null text has size 1 and checksum 0; a null id counts as an
empty name; equal rows keep slots of their own; an empty table gives an empty
table; other columns are carried only when asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.llm.storage import stored


@dataclass(frozen=True)
class Leaf:
    """A shard at its place in the tree."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int) -> tuple[Leaf, ...]:
    """Equal shards, two to a rack, two racks to a region."""
    return tuple(Leaf(i // 4, i // 2, i) for i in range(shards))


def with_new_region(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, in a region and rack of its own."""
    return (*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1,
                        max(x.shard for x in tree) + 1, weight))


def _draw(name: Column, level: str, child: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(level), F.lit(str(child)), name)), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("long") + 0.5) / float(2 ** 52)) / weight


def _winner(name: Column, level: str, children: dict[int, float]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct(_draw(name, level, c, w).alias("draw"), F.lit(c).alias("child")) for c, w in sorted(children.items())]
    return F.array_min(F.array(*draws))["child"]


def _pick(chosen: Column, level: str, name: Column, below: dict[int, dict[int, float]]) -> Column:
    out = F.lit(None).cast("int")
    for parent, children in sorted(below.items(), reverse=True):
        out = F.when(chosen == parent, _winner(name, level, children)).otherwise(out)
    return out


def place(docs: DataFrame, tree: tuple[Leaf, ...], column: str) -> DataFrame:
    """Add the shard each row descends to as ``column``."""
    regions: dict[int, float] = {}
    racks: dict[int, dict[int, float]] = {}
    shards: dict[int, dict[int, float]] = {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
        racks.setdefault(x.region, {})[x.rack] = racks.get(x.region, {}).get(x.rack, 0.0) + x.weight
        shards.setdefault(x.rack, {})[x.shard] = x.weight
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    region, rack = f"{column}_region", f"{column}_rack"
    return (docs.withColumn(region, _winner(name, "region", regions))
            .withColumn(rack, _pick(F.col(region), "rack", name, racks))
            .withColumn(column, _pick(F.col(rack), "shard", name, shards).cast("int")).drop(region, rack))


def shard_documents(docs: DataFrame, shards: int = 8, buckets: int = 1_024, carry: tuple[str, ...] = ()) -> DataFrame:
    """Place ``docs(doc_id, text)`` into equal shards, with the plan for one shard more.

    Slots count from 0 inside a shard.  They are dealt by hashed bucket, then
    doc_id, so that ``shards * buckets`` tasks can number rows at once; one pass
    over the ids alone gives each bucket its first slot.
    """
    tree = balanced_tree(shards)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bucket = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("slot"), name)), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    counts = (place(docs.select("doc_id"), tree, "shard").withColumn("bucket", bucket)
              .groupBy("shard", "bucket").agg(F.count("*").alias("rows_in")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("shard", "bucket", F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias("first_slot")))
    text = F.coalesce("text", F.lit(""))
    extra = [c for c in carry if c not in ("doc_id",)]
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *extra)
    rows = place(rows, tree, "shard").withColumn("bucket", bucket)
    rows = place(rows, with_new_region(tree), "grown_shard")
    order = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("within", F.row_number().over(order)).join(starts, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("first_slot") + F.col("within") - 1).alias("slot"), "grown_shard", *extra))
