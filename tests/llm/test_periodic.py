"""Periodic runs against every period tried at every word."""

import random

import brute
import numpy as np
import pytest
from conftest import edge_rows

from corrobora.llm import periodic, queries

SMALL = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _texts():
    """Random words over small alphabets with runs of every scale; overlong squares, nested and touching runs."""
    rng, out = random.Random(5), []
    for _ in range(250):
        n = rng.choice([0, 1, 23, 24, 25, 60, 200, 700])
        words = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(n)]
        for _ in range(rng.randrange(4)):
            p, s = rng.randrange(1, max(2, n // 3)), rng.randrange(max(1, n))
            for i in range(s + p, min(n, s + p * rng.randrange(2, 9))):
                words[i] = words[i - p]
        out.append(words)
    thue = [0]
    for _ in range(11):
        thue += [1 - x for x in thue]
    return [*out, ["a", "b"] * 3_000, (["a"] * 100 + ["b"]) * 60, ["x"] * 5_000, [str(x) for x in thue], ["A", "a"] * 30]


TEXTS = _texts()
WANT = [brute.runs(w) for w in TEXTS]


@pytest.mark.parametrize("tile", [64, 256, 8_192])
def test_runs(spark, tile):
    """The same runs whether a text is one tile or is stitched from many."""
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    got = [[] for _ in TEXTS]
    for r in periodic.find_runs(df, periodic.RunSpec(tile=tile)).collect():
        got[r.doc_id].append((r.start, r.length, r.period))
    assert [sorted(g, key=lambda r: (r[0], r[2])) for g in got] == WANT


def test_blocks_lie_in_every_run():
    """Any stretch of matches of a run covers a whole block behind a boundary."""
    spec = periodic.RunSpec()
    for octave in range(16):
        least = min(int(spec.matches(q)) for q in range(1 << octave, 2 << octave))
        assert 2 * spec.block(octave) - 1 <= least


def test_stretches_do_not_cross_texts():
    spec, words = periodic.RunSpec(), np.zeros(40, np.uint32)
    assert len(periodic.stretches(words, np.array([0, 20]), np.array([20, 40]), range(4), spec)) == 0


def test_query_rows(spark):
    got = queries.op12_periodic_runs(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = [brute.run_digest(*d) for d in docs]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == sorted(want)
    assert sum(w[1] > 0 for w in want) > 10


def test_edge_rows(spark, edge, none):
    rows = [(r[0], r[1]) for r in edge_rows()]
    rows += [(7, "same row " * 20), (7, "same row " * 20)]
    docs = edge.select("doc_id", "text").union(spark.createDataFrame(rows[-2:], "doc_id long, text string"))
    got = periodic.run_digests(docs, periodic.RunSpec(tile=4_096))
    want = [brute.run_digest(*r, planted=False) for r in rows if r[1] is None or len(r[1]) < 100_000]
    long = max(rows, key=lambda r: len(r[1] or ""))
    rest = [tuple(r[c] for c in COLUMNS) for r in got.collect()]
    assert sorted((r for r in rest if r[0] != long[0]), key=repr) == sorted((w for w in want if w[0] != long[0]), key=repr)
    assert [r[1] for r in rest if r[0] == long[0]] == [0]      # its period of 977 * 31 words fits less than three times
    assert periodic.run_digests(none).collect() == [] and periodic.run_digests(none).columns == got.columns


def test_planted_rewriting(spark):
    """Ids of every remainder, wordless and short texts."""
    rows = [(i, " ".join(f"t{j}" for j in range(i % 90))) for i in range(300)] + [(None, "a b c"), (41, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in periodic.run_digests(periodic.with_planted_runs(df)).collect()), key=repr)
    assert got == sorted((brute.run_digest(*r) for r in rows), key=repr)
