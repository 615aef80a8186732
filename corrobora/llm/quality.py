"""Quality from overlapping heuristic labellers, without hand labels.

Nine labellers look at statistics of a whole text and vote good, bad or nothing;
those that look for one kind of fault never vote good.
Votes of all rows are counted by pattern; expectation-maximisation over the
pattern counts estimates how often each labeller votes and is right, given a
good and a bad text, and with it the probability that a pattern's text is good.
Those posteriors are the labels of a hashed linear scorer, logistic regression on
hashed shape trigrams and repeats, fitted on a bounded sample; the scorer
decides every row.

Defined results: null and wordless texts are rejected with score 0; repeated rows
are scored one by one; an empty table gives an empty table; other columns are
kept by the filter and ignored by the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrobora.llm.kernel import LOWER, SPACE, flat, runs, word_bounds, word_hashes
from corrobora.llm.storage import shielded


@dataclass(frozen=True)
class QualitySpec:
    """``prior`` is where the share of good texts starts; ``sample`` bounds the rows the scorer
    is fitted on; a text is rejected below ``threshold``, on the side of keeping."""

    prior: float = 0.85
    rounds: int = 100
    sample: int = 6_000
    bits: int = 11
    steps: int = 300
    ridge: float = 1e-5
    threshold: float = 0.3


LABELLERS = ("repeats", "symbols", "capitals", "bars", "tails", "lengths", "variety", "digits", "sentences")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#$%&*+<=>@[]\\^_`{|}~!", np.uint8)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = (LOWER >= 0x61) & (LOWER <= 0x7A) | (LOWER >= 0x80)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[np.frombuffer(b".,;:?", np.uint8)] = True
#: Bytes by shape: letters, capitals and digits as one sign each, the rest as they are.
_SHAPE = np.where(SPACE, 0x20, np.where(_UPPER, 65, np.where(_ALPHA, 97, np.where(_DIGIT, 48, LOWER)))).astype(np.uint32)
_TIMES = np.uint32(0x9E3779B1)
#: Added to the number of features of a text: a short text says little and stays near the bias.
SMOOTH = 40.0


def _bad(flags: np.ndarray) -> np.ndarray:
    """1 (bad) or 0 (no vote): a text free of one fault may have another."""
    return np.where(flags, 1, 0)


def _either(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    """1 (bad), 2 (good) or 0 (no vote)."""
    return np.where(bad, 1, np.where(good, 2, 0))


def read_rows(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(votes, n_words, slots, row starts) of runs of rows; slots are hashed features, starts their ranges."""
    data, offsets = flat(column)
    for low, high in runs(offsets):
        part, bounds = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        starts, ends, first = word_bounds(part, bounds)
        n = np.diff(first)
        words = np.maximum(n, 1)
        lengths = np.maximum(np.diff(bounds), 1)
        h = word_hashes(part, starts, ends)
        same = np.zeros(len(h) + 1, bool)
        same[1:len(h)] = h[1:] == h[:-1]
        same[first[:-1]] = False
        same = same[:len(h)]

        def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return total[at[1:]] - total[at[:-1]]

        letters = np.maximum(per_row(_ALPHA[part], bounds), 1)
        last = part[ends - 1]
        size = ends - starts
        tails = _SYMBOL[last] & (size > 1)
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())])
        repeats, symbols = per_row(same, first) / words, per_row(_SYMBOL[part], bounds) / lengths
        capitals, bars = per_row(_UPPER[part], bounds) / letters, per_row((size == 1) & _SYMBOL[last], first) / words
        mean_length = per_row(size, first) / words
        variety = distinct / np.sqrt(words)      # of its own length, as long texts repeat words
        stops = per_row(_STOP[last] & (size > 1), first) / words
        votes = np.stack([
            _bad(repeats >= 0.30), _bad(symbols >= 0.06), _bad(capitals >= 0.50), _bad(bars >= 0.20),
            _bad(per_row(tails, first) / words >= 0.30), _bad(np.abs(mean_length - 8) >= 8),
            _either((n >= 20) & (variety < 2.0), (variety > 3.0) | ((n < 20) & (distinct > 0.6 * n))), _bad(per_row(_DIGIT[part], bounds) / lengths >= 0.30),
            _either((n >= 20) & (stops < 0.005), (stops > 0.02) & ((stops < 0.5) | (n < 20)))], 1)

        shape = _SHAPE[part]
        change = np.ones(len(shape), bool)
        change[1:] = shape[1:] != shape[:-1]
        change[bounds[:-1][bounds[:-1] < len(shape)]] = True
        runs_ = shape[change]
        of = np.searchsorted(np.flatnonzero(change), bounds)
        tri = runs_.copy()
        tri[1:] |= runs_[:-1] << np.uint32(8)
        tri[2:] |= runs_[:-2] << np.uint32(16)
        shape_slots = ((tri ^ tri >> np.uint32(9)) * _TIMES) >> np.uint32(33 - bits)                  # lower half: shapes
        word_slots = (1 << bits - 1) + same.astype(np.int64)                                          # upper half: repeats
        row_of = np.concatenate([np.repeat(np.arange(len(n)), np.diff(of)), np.repeat(np.arange(len(n)), n)])
        order = np.argsort(row_of, kind="stable")
        slots = np.concatenate([shape_slots.astype(np.int64), word_slots])[order]
        yield votes, n, slots, np.concatenate([[0], np.cumsum(np.diff(of) + n)])


def _pattern_of(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def _read(spec: QualitySpec):
    """Task function: the vote pattern and hashed features of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = [np.where(n > 0, _pattern_of(votes), -1) for votes, n, _, _ in read_rows(batch.column("text"), spec.bits)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(patterns) if patterns else np.zeros(0, np.int64))], names=["pattern"])
    return task


def _sampled(spec: QualitySpec):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, slots, counts = [], [], []
            for votes, n, found, at in read_rows(batch.column("text"), spec.bits):
                patterns += np.where(n > 0, _pattern_of(votes), -1).tolist()
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    s, c = np.unique(found[a:b], return_counts=True)
                    slots.append(s.astype(np.uint16).tobytes())
                    counts.append(c.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.int64()), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["pattern", "slots", "counts"])
    return task


def estimate_labellers(patterns: np.ndarray, counts: np.ndarray, spec: QualitySpec) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good by pattern, accuracy of each labeller) by expectation-maximisation.

    ``vote[c, j, v]`` is the probability that labeller ``j`` votes ``v`` on a text of
    class ``c`` (0 bad, 1 good).  It starts at labellers that find a third of the
    bad texts and rarely blame a good one.
    """
    votes = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    vote = np.array([[[0.47, 0.33, 0.2]] * len(LABELLERS), [[0.48, 0.02, 0.5]] * len(LABELLERS)])
    prior = np.array([1 - spec.prior, spec.prior])
    labeller = np.arange(len(LABELLERS))
    good = np.zeros(len(patterns))
    for _ in range(spec.rounds):
        log = np.log(prior)[:, None] + np.log(vote[:, labeller, votes]).sum(2)
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        for v in range(3):
            vote[:, :, v] = (weight @ (votes == v) + 0.5) / (weight.sum(1)[:, None] + 1.5)
    right = prior[0] * vote[0, :, 1] + prior[1] * vote[1, :, 2]
    return good, right / np.maximum(right + prior[0] * vote[0, :, 2] + prior[1] * vote[1, :, 1], 1e-12)


def fit_scorer(x: np.ndarray, y: np.ndarray, spec: QualitySpec) -> tuple[np.ndarray, float, np.ndarray]:
    """Logistic regression on soft labels: (weights, bias, scale)."""
    scale = 1 / np.sqrt((x ** 2).mean(0) + 1e-6)
    x = x * scale
    share = np.full(len(y), 1 / max(1, len(y)))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, spec.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        error = share * (p - y)
        gradient = np.append(error @ x + spec.ridge * w, error.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        move = 0.05 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return w * scale, b, scale


def _scored(tables, spec: QualitySpec):
    """Task function: append score and posterior to the rows it is given."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, posterior = tables.value
        for batch in batches:
            scores, weak = [], []
            for votes, n, slots, at in read_rows(batch.column("text"), spec.bits):
                total = np.concatenate([[0.0], np.cumsum(weights[slots], dtype=np.float64)])
                margin = (total[at[1:]] - total[at[:-1]]) / (np.diff(at) + SMOOTH) + bias
                scores.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(margin, -30, 30))), 0.0))
                weak += [posterior.get(p, 0.0) if k else 0.0 for p, k in zip(_pattern_of(votes).tolist(), n.tolist())]
            score = np.concatenate(scores) if scores else np.zeros(0)
            own = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array(weak, pa.float64())], names=batch.schema.names)
    return task


def scored(docs: DataFrame, spec: QualitySpec = QualitySpec(), columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs(doc_id, text)`` with quality_score and quality_weak (the labellers' posterior)."""
    spark = docs.sparkSession
    text = docs.select("text")
    votes = text.mapInArrow(_read(spec), "pattern long").groupBy("pattern").agg(F.count("*").alias("n")).where("pattern >= 0").collect()
    patterns, counts = np.array([r[0] for r in votes], np.int64), np.array([r[1] for r in votes], float)   # at most 3 ** 9 patterns
    good, _ = estimate_labellers(patterns, counts, spec)
    posterior = dict(zip(patterns.tolist(), good.tolist()))
    part = min(1.0, spec.sample / max(1.0, counts.sum()))
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id", F.crc32("text")), F.lit(1 << 30)) / float(1 << 30)
    rows = docs.where(F.col("text").isNotNull() & (draw < part)).select("text").limit(2 * spec.sample).mapInArrow(
        _sampled(spec), "pattern long, slots binary, counts binary").where("pattern >= 0").collect()
    x, y = np.zeros((len(rows), 1 << spec.bits), np.float32), np.zeros(len(rows))
    for i, r in enumerate(rows):
        c = np.frombuffer(r["counts"], np.float32)
        x[i, np.frombuffer(r["slots"], np.uint16)] = c / (float(c.sum()) + SMOOTH)
        y[i] = posterior[r["pattern"]]
    weights, bias, _ = fit_scorer(x, y, spec) if len(rows) else (np.zeros(1 << spec.bits), 0.0, None)
    tables = spark.sparkContext.broadcast((weights.astype(np.float64), bias, posterior))
    own = list(dict.fromkeys(["text", *columns]))
    wide = docs.select(*own, F.lit(0.0).alias("quality_score"), F.lit(0.0).alias("quality_weak"))
    return wide.mapInArrow(_scored(tables, spec), wide.schema).select(*columns, "quality_score", "quality_weak")


def classify(docs: DataFrame, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """doc_id, score, weak_label and kept of every row."""
    rows = scored(docs, spec)
    return rows.select("doc_id", F.col("quality_score").alias("score"), F.col("quality_weak").alias("weak_label"),
                       (F.col("quality_score") >= spec.threshold).alias("kept"))


def good_documents(docs: DataFrame, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, in their own columns."""
    rows, back = shielded(docs, "doc_id", "text")
    return (scored(rows, spec, columns=tuple(rows.columns)).where(F.col("quality_score") >= spec.threshold)
            .select(*rows.columns).withColumnsRenamed(back))
