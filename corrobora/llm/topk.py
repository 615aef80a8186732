"""Exact top-k by inner product with pivot-table elimination.

Vectors become integer vectors.  An added component gives all of them the same
norm ``R``, so a larger inner product is a smaller distance:
``d(q, x)^2 = |q|^2 + R^2 - 2 q.x``.  Distances from every vector to ``pivots``
vectors are computed once; ``max |d(q, p) - d(x, p)|`` bounds ``d(q, x)`` from below.
Candidates are evaluated in the order of their bounds, until no score that a
remaining bound allows reaches the k-th best.

Queries and candidates meet block by block.  A block pair is one task's work, so
memory is bounded by the block sizes; the best k of every block are merged per
query.  All candidates take part in every query.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; a query meets candidates of its own length only; of rows
that repeat a vec_id each is a candidate, for the others too, and each of a repeated
query has a list of its own; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corrobora.llm.storage import stored


@dataclass(frozen=True)
class TopSpec:
    """Blocks are at most about ``query_block`` by ``candidate_block`` rows."""

    k: int = 20
    scale: int = 64
    every: int = 20
    pivots: int = 32
    query_block: int = 512
    candidate_block: int = 32_768
    first: int = 512
    run: int = 64


def whole_vectors(vectors: DataFrame, spec: TopSpec) -> DataFrame:
    """row (a key of its own), vec_id, v (integers) and dim of the vectors that take part."""
    double = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(fine & (F.size("embedding") > 0))
            .select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform(double, lambda x: F.floor(spec.scale * x).cast("long")).alias("v"),
                    F.size("embedding").alias("dim")))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _to_pivots(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors to lifted pivots."""
    square = ((x ** 2).sum(1) + lift ** 2)[:, None] + ((pivots ** 2).sum(1) + pivot_lift ** 2)[None, :]
    return np.sqrt(np.maximum(square - 2 * (x @ pivots.T + np.outer(lift, pivot_lift)), 0))


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= least)
        ids, score = ids[near], score[near]
    keep = np.lexsort((ids, -score))[:k]
    return ids[keep], score[keep]


def block_best(q_rows: np.ndarray, q: np.ndarray, x_rows: np.ndarray, x_ids: np.ndarray, x: np.ndarray, spec: TopSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate, score): the k best of a block for each of its queries.

    The ``first`` candidates by bound are scored for every query alone.  Candidates
    whose bound still reaches the k-th of these scores come next; a run of
    queries scores them with one matrix product.  Below that bound nothing can
    enter, so the search stops there.
    """
    exact = float(max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))) ** 2 * q.shape[1] < 2 ** 52
    order = np.argsort(x_ids, kind="stable")
    x_rows, x_ids, x = x_rows[order], x_ids[order], x[order]
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    norms = (xf ** 2).sum(1)
    radius = norms.max()
    lift = np.sqrt(radius - norms)
    pivots = np.linspace(0, len(x) - 1, min(spec.pivots, len(x))).astype(int)
    table = np.ascontiguousarray(_to_pivots(xf, lift, xf[pivots], lift[pivots]).T, np.float32)
    to_query = _to_pivots(qf, np.zeros(len(q)), xf[pivots], lift[pivots]).astype(np.float32)
    q_norm = (qf ** 2).sum(1)
    if exact:
        q, x = qf, xf
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first = max(spec.first, spec.k + 1)
    for low in range(0, len(q), spec.run):
        run = range(low, min(low + spec.run, len(q)))
        open_rows, known, floors = [], [], []
        for i in run:
            near = np.abs(table[0] - to_query[i, 0])
            for p in range(1, len(pivots)):
                np.maximum(near, np.abs(table[p] - to_query[i, p]), out=near)
            # Distances are rounded to single precision, scores are exact: the bounds get the slack.
            near = np.maximum(near - np.float32(4e-6) * np.float32(np.sqrt(q_norm[i]) + 2 * np.sqrt(radius) + 1), 0)
            most = (q_norm[i] + radius - near.astype(np.float64) ** 2) / 2 + 1
            top = np.argpartition(-most, first)[:first] if len(most) > first else np.arange(len(most))
            top = top[x_rows[top] != q_rows[i]]
            ids, score = _best(x_ids[top], (x[top] @ q[i]).astype(np.int64), spec.k)
            known.append((ids, score))
            allowed = most >= score[-1] if len(score) == spec.k else np.ones(len(most), bool)
            allowed[top] = False
            allowed[x_rows == q_rows[i]] = False
            open_rows.append(allowed)
        together = np.flatnonzero(np.logical_or.reduce(open_rows))
        scores = (q[run.start:run.stop] @ x[together].T).astype(np.int64)
        for i, allowed, (ids, score), row in zip(run, open_rows, known, scores):
            mine = allowed[together]
            ids, score = _best(np.concatenate([ids, x_ids[together[mine]]]), np.concatenate([score, row[mine]]), spec.k)
            out.append((np.full(len(ids), i), ids, score))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), x_ids[:0], np.zeros(0, np.int64))


def _task(spec: TopSpec):
    def task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        side = table.column("is_query").to_numpy()
        rows, ids = table.column("row").to_numpy(), table.column("vec_id").to_numpy()
        v = _matrix(table.column("v"), dim)
        at, candidate, score = block_best(rows[side], v[side], rows[~side], ids[~side], v[~side], spec) if (~side).any() else (np.zeros(0, np.int64),) * 3
        return pa.table({"query": pa.array(rows[side][at], pa.int64()), "query_id": pa.array(ids[side][at], pa.int64()),
                         "vec_id": pa.array(candidate, pa.int64()), "score": pa.array(score, pa.int64())})
    return task


def top_k(vectors: DataFrame, spec: TopSpec = TopSpec()) -> DataFrame:
    """query_id, rank, vec_id and score of every query's ``k`` best candidates."""
    rows = stored(whole_vectors(vectors, spec))
    queries = rows.where(F.col("vec_id") % spec.every == 0)
    blocks = lambda df, size: max(1, -(-df.count() // size))  # noqa: E731  numbers only
    n_q, n_x = blocks(queries, spec.query_block), blocks(rows, spec.candidate_block)
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = queries.select("dim", own(n_q).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))).alias("j"), "row", "vec_id", "v", F.lit(True).alias("is_query"))
    right = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("i"), own(n_x).alias("j"), "row", "vec_id", "v", F.lit(False).alias("is_query"))
    best = left.unionByName(right).groupBy("dim", "i", "j").applyInArrow(_task(spec), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= spec.k)
            .select("query_id", "rank", "vec_id", "score"))
