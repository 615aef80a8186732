"""Distinct counts from bitmaps against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from corrobora.operators.distinct import bitmaps, counts_above


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_are_exact(spark, seed):
    """Items in several groups, groups below several keys, nulls, repeats, marks; one group with a third of all rows."""
    rng = random.Random(seed)
    pairs = [(rng.choice(["g1"] * 5 + [f"g{i}" for i in range(2, 12)]), rng.randrange(300)) for _ in range(2_000)] + [(None, 1), ("g1", None)]
    reach = [(f"k{rng.randrange(6)}", f"g{rng.randrange(1, 14)}") for _ in range(30)]
    df = spark.createDataFrame(pairs, "g STRING, item INT").withColumn("even", F.col("item") % 2 == 0).repartition(5)
    members = spark.createDataFrame(reach + reach[:5], "k STRING, g STRING")
    got = {r.k: (r.n, r.even) for r in counts_above(members, "k", "g", bitmaps(df, "g", "item", ("even",)), "n").collect()}
    of = {}
    for g, item in pairs:
        if g is not None and item is not None:
            of.setdefault(g, set()).add(item)
    want = {}
    for k, g in reach:
        want.setdefault(k, set()).update(of.get(g, ()))
    assert got == {k: (len(v), sum(i % 2 == 0 for i in v)) for k, v in want.items() if v}
    own = {r.g: r.n for r in counts_above(df.select("g"), "g", "g", bitmaps(df, "g", "item"), "n").collect()}
    assert own == {g: len(v) for g, v in of.items()}


def test_many_items_need_several_buckets(spark):
    df = spark.range(150_000).select(F.explode(F.array(F.lit("a"), F.when(F.col("id") % 3 == 0, "b").otherwise("c"))).alias("g"), "id")
    members = spark.createDataFrame([("top", g) for g in "abc"], "k STRING, g STRING")
    bits = bitmaps(df, "g", "id")
    assert counts_above(members, "k", "g", bits, "n").first().n == 150_000
    assert bits.count() < 100


def test_empty(spark):
    df = spark.createDataFrame([], "g STRING, item INT")
    assert counts_above(df.select(F.col("g").alias("k"), "g"), "k", "g", bitmaps(df, "g", "item"), "n").collect() == []


def test_neighbours_are_counted_without_pairs(spark):
    from corrobora.operators import graph as G
    topics = [(f"t{i}", [f"f{i % 4}", f"f{i % 3}", f"f{i % 4}"] if i % 7 else [f"own{i}", None], i % 5 == 0) for i in range(40)] + [("t99", None, False)]
    df = spark.createDataFrame(topics, "topic_id STRING, functions ARRAY<STRING>, retired BOOLEAN")
    live = {t: {f for f in fs if f} for t, fs, gone in topics if not gone and fs}
    want = {t: (len(fs), sum(bool(fs & live[u]) for u in live if u != t)) for t, fs in live.items()}
    assert {r.topic_id: (r.functions, r.neighbours) for r in G.neighbour_counts(df).collect()} == want


def test_stress_completeness_is_a_set_difference(spark):
    from corrobora.operators import strategy as S
    options = spark.createDataFrame([("s", "A"), ("s", "B"), ("t", "C"), ("u", "D")], "scope STRING, option_id STRING")
    scenarios = spark.createDataFrame([("s", "S1"), ("s", "S2"), ("t", "S1"), ("t", None)], "scope STRING, scenario_id STRING")
    cells = spark.createDataFrame([("s", "A", "S2"), ("s", "B", "S1"), ("s", "B", "S2"), ("s", "B", "S9"), ("t", "C", None)], "scope STRING, option_id STRING, scenario_id STRING")
    got = {r.option_id: (r.missing, r.complete) for r in S.stress_completeness(options, scenarios, cells).collect()}
    assert got == {"A": (["S1"], False), "B": ([], True), "C": (["S1"], False), "D": ([], True)}
