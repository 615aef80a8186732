"""Periodic runs of words, found in scale-tiled pieces of the texts.

A run is a stretch of words with smallest period q, at least ``max(shortest, periods * q)``
words long, that no neighbouring word extends.  Words i and i + q that are the same are a
*match* at i; a run of period q is a maximal stretch of matches, so every period octave
[P, 2P) is solved by itself:

* Boundaries lie ``max(8, P)`` words apart, so close that each stretch of matches covers
  the whole block behind one of them.  At a boundary the Z-values of all shifts of the octave
  (how far the words from here equal the words q further on) are first tested for that
  block, and only shifts that pass are extended to both sides.  Equal ranges are
  compared by fingerprints of doubling lengths.
* A text longer than a tile is exploded into overlapping tiles per octave, which other tasks
  solve; a tile sees two periods and two blocks of its neighbour.  The stretches that
  tiles report are shuffled by (row, period) and those that touch become one.
* Only stretches are shuffled.  Texts without one leave their task once, as digests.

Defined results: a null or wordless text has no words and no runs; equal rows and
rows without an id are rows of their own; an empty table gives an empty table; other
columns are left behind.  A task holds about 20 times the bytes of a tile, and the words of
one whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.llm.kernel import mixed
from corrobora.llm.storage import stored

_U64 = np.uint64
_PAIR = _U64(0x9E3779B97F4A7C15)
_SPAN = "array<struct<low:long,high:long,period:long>>"
NO_RUNS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class RunSpec:
    """What counts as a run, and the words of a tile."""

    shortest: int = 24
    periods: int = 3
    tile: int = 8_192

    def matches(self, period):
        """Matches that a run of this period has at least."""
        return np.maximum(self.shortest - period, (self.periods - 1) * period)

    def block(self, octave: int) -> int:
        """Distance of the boundaries: every stretch of matches covers a block of so many words."""
        least = int(self.matches(np.arange(1 << octave, 2 << octave)).min())
        return 1 << max(0, ((least + 1) // 2).bit_length() - 1)

    def overlap(self, octave: int) -> int:
        """Words that neighbouring tiles share."""
        return (2 << octave) + 2 * self.block(octave)

    def octaves(self, words: int) -> int:
        """Number of octaves with a period that fits a text of so many words."""
        return (words // self.periods).bit_length() if words >= self.shortest else 0


class Names:
    """Fingerprints of all stretches of doubling lengths of one array of word numbers."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.levels = [mixed(codes.astype(np.uint64) + _PAIR)]
        for k in range(max(0, longest.bit_length() - 1)):
            now, step = self.levels[-1], 1 << k
            ahead = np.zeros_like(now)
            ahead[:-step or None] = now[step:]
            self.levels.append(mixed(now * _PAIR + (ahead ^ (ahead >> _U64(29)))))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from a equal those from b."""
        out = np.zeros(len(a), bool)
        level = np.frexp(length)[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            x, y, far = a[at], b[at], length[at] - (1 << int(k))
            n = self.levels[k]
            out[at] = (n[x] == n[y]) & (n[x + far] == n[y + far])
        return out

    def ahead(self, a: np.ndarray, q: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First position from a on that is no match of shift q, below ``end - q``."""
        at = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            go = at + q + (1 << k) <= end
            x = at[go]
            go[go] = self.levels[k][x] == self.levels[k][x + q[go]]
            at[go] += 1 << k
        return at

    def back(self, a: np.ndarray, q: np.ndarray, start: np.ndarray) -> np.ndarray:
        """First position of the matches that end before a, not below ``start``."""
        at = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            go = at - (1 << k) >= start
            x = at[go] - (1 << k)
            go[go] = self.levels[k][x] == self.levels[k][x + q[go]]
            at[go] -= 1 << k
        return at


def _primes(q: int) -> list[int]:
    """Prime divisors."""
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def _primitive(names: Names, a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q words from a are no repetition of fewer."""
    keep = np.ones(len(a), bool)
    for period in np.unique(q).tolist():
        rows = np.flatnonzero(q == period)
        for p in _primes(period):
            step = period // p
            keep[rows] &= ~names.same(a[rows], a[rows] + step, np.full(len(rows), period - step))
    return keep


def stretches(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, octaves: range, spec: RunSpec, inner: np.ndarray | None = None) -> np.ndarray:
    """Rows (piece, low, high, period): maximal stretches of matches that belong to runs.

    ``inner`` holds two flags a piece: whether words are missing before and behind
    it; stretches that reach such an edge are reported at any length.
    """
    lengths = ends - starts
    names = Names(codes, int(lengths.max(initial=1)))
    found = [np.zeros((0, 4), np.int64)]
    for octave in octaves:
        P, B = 1 << octave, spec.block(octave)
        level = names.levels[B.bit_length() - 1] if B.bit_length() <= len(names.levels) else None
        pieces = np.flatnonzero(lengths >= max(P + B, 1 if inner is not None else max(spec.shortest, spec.periods * P)))
        if not len(pieces) or level is None:
            continue
        count = (lengths[pieces] - P - B) // B + 1
        first = np.cumsum(count) - count
        piece = np.repeat(pieces, count)
        at = starts[piece] + (np.arange(len(piece)) - np.repeat(first, count)) * B
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([level, np.zeros(P, np.uint64)]), P)
        rows = max(1, (1 << 20) // P)
        for i in range(0, len(at), rows):
            c, of = at[i:i + rows], piece[i:i + rows]
            hit = windows[c + P] == level[c][:, None]
            if not hit.any():
                continue
            hit &= np.arange(P) <= (ends[of] - B - c - P)[:, None]
            known = hit[:-1] & (of[1:] == of[:-1])[:, None]
            hit[1:] &= ~known
            r, s = np.nonzero(hit)
            a, q, of = c[r], s + P, of[r]
            keep = _primitive(names, a, q)
            a, q, of = a[keep], q[keep], of[keep]
            low, high = names.back(a, q, starts[of]), names.ahead(a + B, q, ends[of])
            keep = high - low >= spec.matches(q)
            if inner is not None:
                keep |= inner[of, 0] & (low == starts[of]) | inner[of, 1] & (high == ends[of] - q)
            found.append(np.stack([of, low - starts[of], high - starts[of], q], 1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def _numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint32, len(words))


def _spans(rows: np.ndarray) -> list[dict]:
    return [{"low": a, "high": b, "period": q} for a, b, q in rows.tolist()]


def _whole_texts(spec: RunSpec, most: int = 1 << 18):
    """Task function: digests of texts without stretches, the words of the others, the stretches of texts within a tile."""
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64()), ("period", pa.int64())]))

    def parts(column) -> Iterator[tuple[list[list[bytes]], list[np.ndarray]]]:
        texts, codes, size = [], [], 0
        for text in column:
            words = (text.as_py() or b"").split()
            texts.append(words)
            codes.append(_numbered(words))
            size += len(words)
            if size >= most:
                yield texts, codes
                texts, codes, size = [], [], 0
        if texts:
            yield texts, codes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts, codes in parts(batch.column("text").cast(pa.binary())):
                short = [c if len(c) <= spec.tile else c[:0] for c in codes]
                ends = np.cumsum([len(c) for c in short])
                starts = ends - [len(c) for c in short]
                found = stretches(np.concatenate(short), starts, ends, range(spec.octaves(max(map(len, short)))), spec)
                cut = np.searchsorted(found[:, 0], np.arange(len(texts) + 1))
                spans = [_spans(found[cut[i]:cut[i + 1], 1:]) for i in range(len(texts))]
                joined = [b" ".join(w) for w in texts]
                kept = [j if s or len(w) > spec.tile else None for j, s, w in zip(joined, spans, texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(done, len(texts)), batch.column("doc_id").slice(done, len(texts)),
                     pa.array([len(w) for w in texts], pa.int64()), pa.array(kept, pa.binary()),
                     pa.array([hashlib.sha256(j).hexdigest() if k is None else None for j, k in zip(joined, kept)], pa.string()),
                     pa.array(spans, kind)], names=["row", "doc_id", "n_words", "body", "digest", "spans"])
                done += len(texts)
    return task


def _tiles(spec: RunSpec):
    """Task function: overlapping tiles of each octave; the octaves of short periods share theirs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body in zip(batch.column("row"), batch.column("body")):
                codes = _numbered(body.as_py().split(b" "))
                n, top = len(codes), spec.octaves(len(codes))
                shared = max((k + 1 for k in range(top) if 4 * spec.overlap(k) <= spec.tile), default=0)
                for low, high in [(0, shared), *((k, k + 1) for k in range(shared, top))]:
                    if high == low:
                        continue
                    over = spec.overlap(high - 1)
                    size = max(spec.tile, 4 * over)
                    bases = list(range(0, max(1, n - over), size - over))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row.as_py()] * len(bases), pa.int64()), pa.array([low] * len(bases), pa.int32()), pa.array([high] * len(bases), pa.int32()),
                         pa.array(bases, pa.int64()), pa.array([b + size < n for b in bases], pa.bool_()),
                         pa.array([codes[b:b + size].tobytes() for b in bases], pa.binary())],
                        names=["row", "octave", "octave_end", "base", "more", "codes"])
    return task


def _solved(spec: RunSpec):
    """Task function: the stretches of each tile, in words of the whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, low, high, base, more, codes = (batch.column(c)[i].as_py() for c in ("row", "octave", "octave_end", "base", "more", "codes"))
                codes = np.frombuffer(codes, np.uint32)
                found = stretches(codes, np.array([0]), np.array([len(codes)]), range(low, high), spec, np.array([[base > 0, more]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(found), pa.int64()), *(pa.array(x, pa.int64()) for x in (found[:, 1] + base, found[:, 2] + base, found[:, 3]))],
                    names=["row", "low", "high", "period"])
    return task


def stitched(spans: DataFrame, spec: RunSpec) -> DataFrame:
    """(row, start, length, period) of the runs: stretches of one row and period that touch are one."""
    line = Window.partitionBy("row", "period").orderBy("low", "high")
    far = F.max("high").over(line.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(far.isNull() | (F.col("low") > far), 1).otherwise(0)
    need = F.greatest(F.lit(spec.shortest) - F.col("period"), (spec.periods - 1) * F.col("period"))
    return (spans.withColumn("new", new).withColumn("group", F.sum("new").over(line))
            .groupBy("row", "period", "group").agg(F.min("low").alias("start"), F.max("high").alias("high"))
            .where(F.col("high") - F.col("start") >= need)
            .select("row", "start", (F.col("high") - F.col("start") + F.col("period")).alias("length"), "period"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: strongest run and digests of texts that may have runs."""
    for batch in batches:
        out = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
        for body, runs in zip(batch.column("body"), batch.column("runs")):
            words, runs = body.as_py().split(b" ") if len(body.as_py()) else [], [tuple(r.values()) for r in runs.as_py() or []]
            best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
            drop = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                drop[start + period] += 1
                drop[start + length] -= 1
            kept = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            row = (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                   hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
            for c, x in zip(out, row):
                out[c].append(x)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out.values(), kinds))], names=["doc_id", *out])


def _staged(docs: DataFrame, spec: RunSpec) -> tuple[DataFrame, DataFrame]:
    """(stored digests and words of every row, runs of every row)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    base = stored(rows.mapInArrow(_whole_texts(spec), f"row long, doc_id {kind}, n_words long, body binary, digest string, spans {_SPAN}"))
    tiles = (base.where(F.col("n_words") > spec.tile).select("row", "body")
             .mapInArrow(_tiles(spec), "row long, octave int, octave_end int, base long, more boolean, codes binary")
             .repartition("row", "octave", "base"))
    spans = (base.where(F.size("spans") > 0).select("row", F.inline("spans"))
             .unionByName(tiles.mapInArrow(_solved(spec), "row long, low long, high long, period long")))
    return base, stitched(spans, spec)


def find_runs(docs: DataFrame, spec: RunSpec = RunSpec()) -> DataFrame:
    """(doc_id, start, length, period): one row per run of ``docs(doc_id, text)``."""
    base, runs = _staged(docs, spec)
    return runs.join(base.select("row", "doc_id"), "row").select("doc_id", "start", "length", "period")


def run_digests(docs: DataFrame, spec: RunSpec = RunSpec()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: its number of runs, the strongest, and digests.

    A word that a run contains after the run's first period is dropped from the collapsed text.
    """
    base, runs = _staged(docs, spec)
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    lists = lists.withColumn("runs", F.transform("runs", lambda r: F.struct(r["start"], r["length"], r["period"])))
    some = (base.where(F.col("body").isNotNull()).join(lists, "row", "left").select("doc_id", "body", "runs")
            .mapInArrow(_digests, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"))
    empty = F.lit(None).cast("long")
    rest = base.where(F.col("body").isNull()).select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *(empty.alias(c) for c in ("start", "length", "period", "exponent_milli")),
        F.lit(NO_RUNS).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"))
    return some.unionByName(rest)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in which each tenth text, by its id, ends in a long period.

    Let h = crc32 of the id and g = h / 10.  Where h % 10 = 0, word i from a = g % n on becomes
    word a + (i - a) % p, with p = 1 + (n - a) / (3 + g % 8).  A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def rewritten(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " "))

    # an array of one element binds the words to a name, so that they are split once a text
    changed = F.get(F.transform(F.array(words), rewritten), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(changed, "text")).otherwise(F.col("text")).alias("text"))
