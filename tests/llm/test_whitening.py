"""Whitening against the eigendecomposition of the whole covariance matrix."""

import numpy as np
import pytest

from corrobora.llm import queries, whitening
from corrobora.llm.whitening import Spectrum, WhitenSpec

SMALL = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, n int, state string"


def _scatter(x):
    away = x - x.mean(axis=0)
    return away.T @ away


def _brute(rows, spec=WhitenSpec()):
    """{(vec_id, row): (deviation, whitened row up to signs)} and explained shares, by numpy alone."""
    ids = [r[0] for r in rows]
    x = np.array([[int(np.floor(spec.scale * float(np.float32(c)))) + spec.shift for c in r[1]] for r in rows])
    n, sums = len(x), x.sum(axis=0)
    deviations = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for row in x]
    values, vectors = np.linalg.eigh(_scatter(x) / n)
    top = np.argsort(-values)[:spec.components]
    top = top[values[top] > 1e-11 * values.max()]
    return ids, deviations, (x - sums / n) @ vectors[:, top] / np.sqrt(values[top]), values[top] / values.sum()


def _check(got, rows):
    ids, deviations, white, shares = _brute(rows)
    size = white.shape[1]
    assert len(got) == len(rows) * size and {r.n for r in got} == {len(rows)}
    assert max(r.identity_error for r in got) <= 1e-4 and len({r.identity_error for r in got}) == 1
    mine = {}
    for r in got:
        assert abs(r.explained - shares[r.component - 1]) <= 1e-9
        mine.setdefault(r.vec_id, []).append((r.component, r.deviation, r.whitened))
    for k in range(size):
        of = {i: [w for c, _, w in mine[i] if c == k + 1] for i in mine}
        want = {}
        for i, w in zip(ids, white[:, k]):
            want.setdefault(i, []).append(w)
        flip = 1 if sum(sum(of[i]) * sum(want[i]) for i in of) > 0 else -1
        for i in of:
            assert np.allclose(sorted(of[i]), sorted(flip * w for w in want[i]), atol=1e-7)
    for i, d in zip(ids, deviations):
        assert d in {x for _, x, _ in mine[i]}


@pytest.mark.parametrize("dims", [1, 2, 3, 8, 64])
def test_updates(dims):
    """Vectors taken in one by one and merged: the spectrum of the whole scatter."""
    rng = np.random.default_rng(dims)
    x = np.floor(rng.normal(size=(400, dims)) * 100).astype(np.int64) + 100_000
    if dims == 8:
        x[:, 3], x[:, 5] = x[:, 2], 7                      # no full rank
        x[50:80] = x[50]                                   # repeats
    a, b = Spectrum(dims), Spectrum(dims)
    a.add(x[:250])
    b.add(x[250:])
    a.merge(b)
    want = _scatter(x)
    assert a.sums == x.sum(axis=0).tolist() and a.n == 400
    assert np.allclose(a.U.T @ a.U, np.eye(dims), atol=1e-12)
    assert np.abs(a.U @ np.diag(a.d) @ a.U.T - want).max() <= 1e-11 * np.abs(want).max()


def test_deflation_of_equal_eigenvalues():
    x = np.repeat(np.eye(6, dtype=np.int64) * 1_000, 20, axis=0)
    s = Spectrum(6)
    s.add(x)
    assert np.abs(s.U @ np.diag(s.d) @ s.U.T - _scatter(x)).max() <= 1e-12 * np.abs(_scatter(x)).max()


def test_roots_solve_the_secular_equation():
    rng = np.random.default_rng(9)
    d, z = np.sort(rng.random(20)) * 100, rng.normal(size=20)
    origin, x, gaps = whitening.secular_roots(d, z, 0.5)
    assert np.allclose(origin + x, np.linalg.eigvalsh(np.diag(d) + 0.5 * np.outer(z, z)), rtol=1e-13)
    assert (origin + x >= d).all() and (origin[:-1] + x[:-1] <= d[1:]).all()


def test_query_rows(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    _check(queries.op11_embedding_whitening(spark, SMALL).collect(), rows)


def test_edge_rows(spark):
    """Nulls, non-finite entries, other lengths, repeated rows and ids, clashing columns; many partitions, some empty."""
    rng = np.random.default_rng(4)
    good = [(i % 40, [float(np.float32(c)) for c in rng.normal(size=5)]) for i in range(60)]
    good += [(7, good[7][1]), (None, good[8][1])]
    odd = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0, 3.0, 4.0]), (104, [float("nan")] + [1.0] * 4),
           (105, [float("inf")] + [1.0] * 4), (106, [3e38] * 5)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + odd], KIND).repartition(40)
    _check(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_nothing_varies(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], 1, "x") for i in range(5)], KIND)
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(same.limit(0)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0], 1, "x") for i in range(5)], KIND)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2 ** 38 + 3 ** i), float(i)]) for i in range(12)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], KIND)
    _, deviations, _, _ = _brute(rows)
    want = {i: d if d < 1 << 63 else None for (i, _), d in zip(rows, deviations)}
    assert {r.vec_id: r.deviation for r in whitening.whiten(df).collect()} == want
