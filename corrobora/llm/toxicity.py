"""Toxicity by cumulative-link ordinal regression on sparse words.

``P(grade <= k | x) = sigmoid(threshold_k - w . x)``: one weight vector is shared
by all ordered thresholds, and the expected grade is the severity.

Words are runs of letters and digits, A-Z lower-cased, identified by 64-bit hash;
``x`` says which of the model's words a text holds.  The model is fitted on a
bounded, hash-drawn sample of labelled rows: its words are those that the sample
finds far more often in toxic rows than in others.  Labels only say yes or no, so
a toxic row's grade counts its distinct model words: 1 up to one, 2 for two or
three, 3 from four.  Scoring covers whole texts of all rows.

Defined results: null and wordless texts hold no model word and get the severity
of that; without labelled rows of both kinds severity is 0; of labels that
repeat a doc_id the highest counts; repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corrobora.llm.kernel import LOWER, flat, runs, word_bounds, word_hashes
from corrobora.llm.storage import stored

_GAP = ~((LOWER >= 0x61) & (LOWER <= 0x7A) | (LOWER >= 0x30) & (LOWER <= 0x39) | (LOWER >= 0x80))


@dataclass(frozen=True)
class ToxicSpec:
    """At most ``sample`` labelled rows are learned from, half of them toxic at most."""

    sample: int = 12_000
    most_words: int = 2_048
    least_rows: int = 3
    lift: float = 6.0
    least_z: float = 3.5
    ridge: float = 2e-4
    rounds: int = 400
    threshold: float = 0.5


def row_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, first word numbers) of runs of rows."""
    data, offsets = flat(column)
    for low, high in runs(offsets):
        part = data[offsets[low]:offsets[high]]
        starts, ends, first = word_bounds(part, offsets[low:high + 1] - offsets[low], _GAP)
        yield word_hashes(part, starts, ends), first


def learning_rows(docs: DataFrame, labels: DataFrame, spec: ToxicSpec) -> DataFrame:
    """(toxic, words): distinct word hashes of the sampled rows, a written table of at most ``sample`` rows.

    Labelled ids are drawn first, then rows of ``docs`` among those that carry them, so a repeated
    id brings no more rows than it is worth.
    """
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))

    def share(rows: DataFrame) -> tuple:
        """The part of the rows of each class that fills half of the sample."""
        sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        part = {t: min(1.0, spec.sample / 2 / max(1, sizes.get(t, 0))) for t in (True, False)}
        return F.when(F.col("toxic"), part[True]).otherwise(part[False]), sizes

    def draw(seed: str, *columns: str):
        return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)

    # At most twice ``sample`` ids and marks go to the texts, which stay in place.
    drawn = F.broadcast(marks.where(draw("toxicity sample", "doc_id") < share(marks)[0]).limit(2 * spec.sample))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id"))
    kept = share(docs.select("doc_id").join(drawn, "doc_id"))[0]
    chosen = rows.join(drawn, "doc_id").where(draw("toxicity rows", "row_id") < kept).select("toxic", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.unique(h[a:b]).view(np.int64) for h, first in row_words(batch.column("text")) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.int64()))], names=["toxic", "words"])

    return stored(chosen.mapInArrow(task, "toxic boolean, words array<long>").limit(spec.sample))


def model_words(rows: DataFrame, spec: ToxicSpec) -> tuple[np.ndarray, int, int]:
    """(word hashes, toxic rows, other rows): the ``most_words`` that mark toxic rows most clearly, counted in Spark."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_yes, n_no = sizes.get(True, 0), sizes.get(False, 0)
    if not n_yes or not n_no:
        return np.zeros(0, np.uint64), n_yes, n_no
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if("toxic").alias("yes"), F.count_if(~F.col("toxic")).alias("no"))
    p, q = F.col("yes") / n_yes, F.col("no") / n_no
    even = (F.col("yes") + F.col("no")) / (n_yes + n_no)
    z = (p - q) / F.sqrt(F.greatest(even * (1 - even) * (1 / n_yes + 1 / n_no), F.lit(1e-12)))
    good = counts.where((F.col("yes") >= spec.least_rows) & (p >= spec.lift * q)).select("word", z.alias("z")).where(F.col("z") >= spec.least_z)
    top = good.orderBy(F.desc("z"), "word").limit(spec.most_words).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64)), n_yes, n_no


class Severity:
    """Model words, their weights and the ordered thresholds."""

    def __init__(self, rows: DataFrame, spec: ToxicSpec):
        """Learn from ``rows(toxic, words)``; of each row only the model words it holds come to the driver."""
        self.words, n_yes, n_no = model_words(rows, spec)
        self.weights, self.thresholds = np.zeros(0), np.zeros(0)
        if not n_yes or not n_no:
            return
        words = self.words

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column("words")
                place, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
                held = []
                for a, b in zip(place[:-1].tolist(), place[1:].tolist()):
                    mine = values[a:b]
                    at = np.minimum(np.searchsorted(words, mine), max(0, len(words) - 1))
                    held.append(at[words[at] == mine].astype(np.int32) if len(words) else at[:0].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(held, pa.list_(pa.int32()))], names=["toxic", "held"])

        got = rows.mapInArrow(task, "toxic boolean, held array<int>").collect()
        toxic = np.array([r["toxic"] for r in got], bool)
        x = np.zeros((len(got), len(words)), np.float32)
        for i, r in enumerate(got):
            x[i, r["held"]] = 1
        held = x.sum(1)
        grade = np.where(toxic, np.clip(1 + (held >= 2) + (held >= 4), 1, 3), 0)
        self._fit(x, grade.astype(int), spec)

    def _fit(self, x: np.ndarray, grade: np.ndarray, spec: ToxicSpec) -> None:
        """Adam on the negative log likelihood; thresholds are a first one and log gaps."""
        cuts = int(grade.max())
        w, first, gaps = np.zeros(x.shape[1]), 1.0, np.zeros(cuts - 1)
        mean, square = np.zeros(len(w) + cuts), np.zeros(len(w) + cuts)
        n = len(x)
        sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
        for t in range(1, spec.rounds + 1):
            theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            score = x @ w.astype(np.float32)
            edges = np.concatenate([[-np.inf], theta, [np.inf]])
            high, low = sigmoid(edges[grade + 1] - score), sigmoid(edges[grade] - score)
            p = np.maximum(high - low, 1e-12)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            d_score = d_high - d_low
            g_theta = np.array([-(d_high[grade == k].sum() - d_low[grade == k + 1].sum()) for k in range(cuts)]) / n
            g_gaps = np.array([g_theta[k + 1:].sum() * np.exp(gaps[k]) for k in range(cuts - 1)])
            gradient = np.concatenate([d_score @ x / n + spec.ridge * w, [g_theta.sum()], g_gaps])
            mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
            move = 0.1 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-9)
            w, first, gaps = w - move[:len(w)], first - move[len(w)], gaps - move[len(w) + 1:]
        self.weights = w
        self.thresholds = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])

    def scores(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(severity, P(grade >= 1), model words held) of each row."""
        n = len(first) - 1
        if not len(self.thresholds):
            return np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        score, held = np.zeros(n), np.zeros(n, np.int64)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            found = np.flatnonzero(self.words[at] == hashes)
            row = np.searchsorted(first, found, "right") - 1
            pairs = np.unique(row * len(self.words) + at[found])
            row, word = pairs // len(self.words), pairs % len(self.words)
            score, held = np.bincount(row, self.weights[word], n), np.bincount(row, minlength=n)
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        return above.sum(1), above[:, 0], held


def _graded(tables):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tables.value
        for batch in batches:
            parts = [model.scores(h, first) for h, first in row_words(batch.column("text"))]
            severity, p, held = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0), np.zeros(0), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(severity), pa.array(p), pa.array(held.astype(np.int64))],
                                             names=["doc_id", "severity", "p_toxic", "n_toxic_words"])
    return task


def grade_documents(docs: DataFrame, labels: DataFrame, spec: ToxicSpec = ToxicSpec()) -> DataFrame:
    """doc_id, severity (0 to 3), p_toxic, n_toxic_words and toxic of ``docs(doc_id, text)``."""
    model = Severity(learning_rows(docs, labels, spec), spec)
    tables = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_graded(tables), f"doc_id {kind}, severity double, p_toxic double, n_toxic_words long")
    return rows.withColumn("toxic", F.col("p_toxic") >= spec.threshold)
