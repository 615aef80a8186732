"""Language-model scores by context-tree weighting over byte contexts.

A text is its words in small letters (A-Z only), joined by one space and closed by
one end byte; before its first byte lies a history of end bytes.  The next byte is
coded as eight binary choices, and each of the 255 choices has a context tree over
the last ``depth`` bytes.  A node holds a Krichevsky-Trofimov estimate and is mixed
with its children, ``P_w = P_kt / 2 + prod(P_w of children) / 2``, over all depths.

All counts come from the whole training part, and every context has a node of its
own.  The texts lie in chunks of about ``chunk`` bytes.  A chunk's distinct grams (context
and byte; a gram that only held-out texts hold counts 0) are sorted by context, the last
byte first, and packed: differences as byte planes, compressed, about 1.5 bytes a gram with
its count, one blob for each bucket of contexts of ``_CUT`` bytes.  A bucket is
one task: it sums its blobs as they come and grows the whole subtrees of its distinct
grams, a slice at a time, so its memory is bounded by these and not by the chunks.  The
shorter contexts are mixed on the driver: at most 255 choices of 256 ** (_CUT - 1) contexts,
whatever the corpus.  In a second pass the bucket's code lengths come first, and each blob
of a chunk is answered by an array of code lengths in its own order; these meet the
chunk's texts, so that no table of the whole tree is held anywhere.

With ``nodes`` set, only the contexts of the highest counts have nodes of their own,
at most ``nodes`` over all depths; the others of a parent share one node.  A context
never counts more than the shorter one it ends in, so the nodes form trees.  The
trees of one last byte are built in one task, and the frozen mixture becomes a table
of code lengths per (node, byte) and of the node that follows, which is broadcast.

The unigram base counts every word of the training part.  The words of the
highest counts, at most ``frequent``, are broadcast; all others are joined.

Defined results: a null or wordless text is the end token alone; texts are
scored one by one, repeated rows too; without training texts every byte costs
8 bits and every token has count 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.kernel import LOWER, SPACE, flat, mixed, runs, word_bounds, word_hashes
from corrobora.llm.storage import stored

END = 0x0A
_LINE = np.where(SPACE, 0x20, LOWER).astype(np.uint8)
_STRETCH = 2_048
_SLICE = 1 << 20        # bytes of text handled at once
_HALF = np.log(0.5)
_CUT = 3                # contexts of this many bytes are never split over tasks
_BUCKET = 1 << 24       # bytes of text to a bucket of contexts, between the bounds below
_BUCKETS = (64, 1 << 14)
_GRAMS = 1 << 16        # grams whose subtrees are handled at once


@dataclass(frozen=True)
class TreeSpec:
    depth: int = 5
    nodes: int | None = None
    frequent: int = 1 << 19
    chunk: int = 1 << 24
    held_out_of: int = 5
    held_out: int = 1


# --- texts as byte streams ------------------------------------------------------------

def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(bytes, row ends, word bounds): the coded texts one after the other."""
    starts, ends, first = word_bounds(data, offsets)
    keep = ~SPACE[data]
    inner = np.ones(len(starts), bool)
    inner[first[:-1][first[:-1] < first[1:]]] = False
    keep[starts[inner] - 1] = True
    upto = np.concatenate([[0], np.cumsum(keep)])[offsets[1:]]
    return np.insert(_LINE[data][keep], upto, END), upto + np.arange(1, len(upto) + 1), (starts, ends, first)


def grams(text: np.ndarray, row_ends: np.ndarray, depth: int) -> np.ndarray:
    """Each byte with its context: byte ``j`` of the number is the byte ``j`` places back."""
    wide = text.astype(np.uint64)
    key = wide.copy()
    for j in range(1, depth + 1):
        key[j:] |= wide[:-j] << np.uint64(8 * j)
    begins, ends = np.concatenate([[0], row_ends[:-1]]), row_ends
    for t in range(depth):
        at = begins + t
        at = at[at < ends]
        history = sum(END << 8 * j for j in range(t + 1, depth + 1))
        key[at] = key[at] & np.uint64((1 << 8 * (t + 1)) - 1) | np.uint64(history)
    return key


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(v) for v in zip(*parts))
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, counts, len(unique)).astype(np.int64)


def _counted(depth: int):
    """Task function: (kind, key, n) of grams (0), words (1) and rows (2), summed per task."""

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            k = keys[i:i + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i:i + 100_000])], names=["kind", "key", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list] = [[], []]
        n_rows = 0
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            n_rows += batch.num_rows
            for low, high in runs(offsets, _SLICE):
                part = data[offsets[low]:offsets[high]]
                text, row_ends, (starts, ends, _) = stream(part, offsets[low:high + 1] - offsets[low])
                for kind, keys in ((0, grams(text, row_ends, depth)), (1, word_hashes(part, starts, ends))):
                    parts[kind].append(np.unique(keys, return_counts=True))
                    if sum(len(k) for k, _ in parts[kind]) > 1_500_000:
                        parts[kind] = [_merged(parts[kind])]
                        if len(parts[kind][0][0]) > 750_000:
                            yield from rows(kind, *parts[kind].pop())
        for kind in (0, 1):
            if parts[kind]:
                yield from rows(kind, *_merged(parts[kind]))
        yield from rows(2, np.zeros(1, np.uint64), np.array([n_rows], np.int64))
    return task


def _chunked(size: int):
    """Task function: number the chunks of the texts, of about ``size`` bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            chunk = first + (done + offsets[:-1]) // size
            done += int(offsets[-1])
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(np.diff(offsets)), *batch.columns], names=["chunk", "size", *batch.schema.names])
    return task


def turned(keys: np.ndarray, depth: int) -> np.ndarray:
    """Grams with their context from the last byte down, so that sorting keeps subtrees together; its own inverse."""
    out = keys & np.uint64(255)
    for j in range(1, depth + 1):
        out |= (keys >> np.uint64(8 * j) & np.uint64(255)) << np.uint64(8 * (depth + 1 - j))
    return out


def _stem(keys: np.ndarray, cut: int, depth: int) -> np.ndarray:
    """Last ``cut`` bytes of the context of each turned gram."""
    return keys >> np.uint64(8 * (depth + 1 - cut))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: pa.Scalar, many: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob.as_buffer(), 8 * many, codec="zstd"), np.uint8).reshape(8, many)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(blob: pa.Scalar, many: int) -> np.ndarray:
    return np.cumsum(unpacked(blob, many), dtype=np.uint64)


_PACKED = "kind int, key long, n long, bucket int, many int, grams binary, counts binary"


def _packed_chunks(depth: int, cut: int, buckets: int):
    """Task function: the packed grams of each chunk and bucket (kind 0, key: the chunk), words (1) and rows (2) of training texts.

    Counts are of training texts only, a gram of held-out texts alone has 0.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("bucket", pa.int32()), ("many", pa.int32()),
                        ("grams", pa.binary()), ("counts", pa.binary())])

    def blobs(chunk: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        bucket = (mixed(_stem(keys, cut, depth)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        keys, n, bucket = keys[order], n[order], bucket[order]
        edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        pairs = list(zip(edges[:-1], edges[1:]))
        many = len(pairs)
        return pa.RecordBatch.from_arrays([
            pa.array(np.zeros(many, np.int32)), pa.array(np.full(many, chunk, np.int64)), pa.array(np.zeros(many, np.int64)),
            pa.array(bucket[edges[:-1]]), pa.array(np.diff(edges).astype(np.int32)),
            pa.array([packed_keys(keys[a:b]) for a, b in pairs], pa.binary()), pa.array([packed(n[a:b]) for a, b in pairs], pa.binary())], schema=schema)

    def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            k = keys[i:i + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i:i + 100_000]),
                                              *[pa.nulls(len(k), f.type) for f in list(schema)[3:]]], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_parts, word_parts, current, n_rows = [], [], None, 0
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            chunks = batch.column("chunk").to_numpy()
            learn = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            n_rows += int(learn.sum())
            edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if gram_parts and chunks[a] != current:
                    yield blobs(current, *_merged(gram_parts))
                    gram_parts = []
                current = int(chunks[a])
                for low, high in runs(offsets[a:b + 1] - offsets[a], _SLICE):
                    low, high = low + a, high + a
                    part = data[offsets[low]:offsets[high]]
                    text, row_ends, (starts, ends, first) = stream(part, offsets[low:high + 1] - offsets[low])
                    keys = turned(grams(text, row_ends, depth), depth)
                    of_byte = np.repeat(learn[low:high], np.diff(row_ends, prepend=0))
                    gram_parts.append(np.unique(keys[of_byte], return_counts=True))
                    rest = np.unique(keys[~of_byte])
                    gram_parts.append((rest, np.zeros(len(rest), np.int64)))
                    words = word_hashes(part, starts, ends)[np.repeat(learn[low:high], np.diff(first))]
                    word_parts.append(np.unique(words, return_counts=True))
                    if sum(len(k) for k, _ in gram_parts) > 1_500_000:
                        gram_parts = [_merged(gram_parts)]
                    if sum(len(k) for k, _ in word_parts) > 1_500_000:
                        word_parts = [_merged(word_parts)]
                        if len(word_parts[0][0]) > 750_000:
                            yield from rows(1, *word_parts.pop())
        if gram_parts:
            yield blobs(current, *_merged(gram_parts))
        if word_parts:
            yield from rows(1, *_merged(word_parts))
        yield from rows(2, np.zeros(1, np.uint64), np.array([n_rows], np.int64))
    return task


# --- trees ----------------------------------------------------------------------------

def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma(x) for x > 0 by Stirling's series above 8."""
    small = np.maximum(0, np.ceil(8 - x)).astype(int)
    shift = np.zeros_like(x)
    for k in range(int(small.max(initial=0))):
        shift += np.where(k < small, np.log(x + k), 0)
    y = x + small
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def choices(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 binary choices of (n, 256) byte counts."""
    n = len(counts)
    halves = [counts.reshape(n, 1 << level, 2, 1 << 7 - level).sum(3) for level in range(8)]
    return np.concatenate([h[:, :, 0] for h in halves], 1), np.concatenate([h[:, :, 1] for h in halves], 1)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence under the Krichevsky-Trofimov estimator."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def _node(counts: np.ndarray, child_counts: np.ndarray, child_log: np.ndarray, has_child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(log P_w, share of the own estimate, own estimate, estimate of the shared child)."""
    zeros, ones = choices(counts)
    rest = choices(counts - child_counts)
    own = log_kt(zeros, ones)
    total = np.where(has_child[:, None], np.logaddexp(own, child_log + log_kt(*rest)) + _HALF, own)
    share = np.where(has_child[:, None], np.exp(np.minimum(0, _HALF + own - total)), 1.0)
    return total, share, _kt(zeros, ones), _kt(*rest)


def _subtree(depth: int):
    """Task function on the kept contexts of one last byte."""

    def task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        depths, contexts = table.column("depth").to_numpy(), table.column("context").to_numpy()
        byte_lists, count_lists = table.column("bytes").to_pylist(), table.column("counts").to_pylist()
        ids, counts = {}, {}
        for d in range(1, depth + 1):
            rows = np.flatnonzero(depths == d)
            rows = rows[np.argsort(contexts[rows])]
            ids[d] = contexts[rows]
            counts[d] = np.zeros((len(rows), 256))
            for i, r in enumerate(rows.tolist()):
                counts[d][i, byte_lists[r]] = count_lists[r]
        nodes: dict[int, tuple] = {}
        parent: dict[int, np.ndarray] = {}
        for d in range(depth, 0, -1):
            n = len(ids[d])
            child_counts, child_log, has = np.zeros((n, 256)), np.zeros((n, 255)), np.zeros(n, bool)
            if d < depth and len(ids[d + 1]):
                parent[d + 1] = np.searchsorted(ids[d], ids[d + 1] & (1 << 8 * d) - 1)
                np.add.at(child_counts, parent[d + 1], counts[d + 1])
                np.add.at(child_log, parent[d + 1], nodes[d + 1][0])
                has[parent[d + 1]] = True
            nodes[d] = _node(counts[d], child_counts, child_log, has)
        out: dict[str, list] = {"depth": [], "context": [], "choice": [], "log_weighted": []}
        fixed = open_ = None
        for d in range(1, depth + 1):
            log_w, share, own, rest = nodes[d]
            up, into = (0.0, 1.0) if d == 1 else (fixed[parent[d]], open_[parent[d]]) if len(ids[d]) else (own, own)
            fixed, open_ = up + into * share * own, into * (1 - share)
            p = (fixed + open_ * rest).astype(np.float32)
            for i, c in enumerate(ids[d].tolist()):
                out["depth"].append(d)
                out["context"].append(c)
                out["choice"].append(p[i].tobytes())
                out["log_weighted"].append(log_w[i].tobytes() if d == 1 else None)
        return pa.table({"depth": pa.array(out["depth"], pa.int32()), "context": pa.array(out["context"], pa.int64()),
                         "choice": pa.array(out["choice"], pa.binary()), "log_weighted": pa.array(out["log_weighted"], pa.binary())})
    return task


class Model:
    """The frozen mixture as tables: code length in log10 and next node by (node, byte)."""

    def __init__(self, depth: int, depths: np.ndarray, contexts: np.ndarray, chance: np.ndarray):
        """``chance[i + 1]`` holds the 255 choices of node ``i``, ordered by depth and context; row 0 is the root."""
        self.depth = depth
        self.cost = np.empty((len(chance), 256), np.float32)
        for i in range(0, len(chance), 1_024):
            self.cost[i:i + 1_024] = self._bytes(chance[i:i + 1_024].astype(np.float64))
        self.ids = {d: contexts[depths == d] for d in range(1, depth + 1)}
        self.base = {d: 1 + sum(len(self.ids[e]) for e in range(1, d)) for d in range(1, depth + 1)}
        self.follow = self._follow()
        history = sum(END << 8 * j for j in range(depth))
        self.start = int(self._deepest(np.array([history]), np.array([depth]))[0])
        self.follow[:, END] = self.start
        if len(self.follow) <= 1 << 16:
            self.follow = self.follow.astype(np.uint16)
        self.cost, self.follow = self.cost.ravel(), self.follow.ravel()

    @staticmethod
    def _bytes(p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(p), 1))
        for level in range(8):
            q = np.clip(p[:, (1 << level) - 1:(2 << level) - 1], 1e-12, 1 - 1e-12)
            out = (out[:, :, None] + np.stack([np.log10(1 - q), np.log10(q)], 2)).reshape(len(p), -1)
        return out

    def _deepest(self, context: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Number of the deepest node that ends each context of up to ``most`` bytes."""
        node = np.zeros(len(context), np.int32)
        for d in range(1, self.depth + 1):
            if len(self.ids[d]):
                cut = context & (1 << 8 * d) - 1
                at = np.minimum(np.searchsorted(self.ids[d], cut), len(self.ids[d]) - 1)
                good = (self.ids[d][at] == cut) & (most >= d)
                node[good] = self.base[d] + at[good]
        return node

    def _follow(self) -> np.ndarray:
        out = np.zeros((len(self.cost), 256), np.int32)
        letters = np.arange(256)
        out[0] = self._deepest(letters, np.ones(256, int))
        for d in range(1, self.depth + 1):
            for i in range(0, len(self.ids[d]), 1_024):
                ids = self.ids[d][i:i + 1_024]
                context = (ids[:, None] << 8 | letters).ravel()
                out[self.base[d] + i:self.base[d] + i + len(ids)] = self._deepest(context, np.full(len(context), d + 1)).reshape(-1, 256)
        return out

    def log10(self, text: np.ndarray, row_ends: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a stream.

        Stretches of the stream are walked in step; each starts ``depth`` bytes
        early, after which its node depends on its own bytes alone.
        """
        n, lead = len(text), self.depth
        rows = -(-n // _STRETCH)
        square = np.full((rows, _STRETCH), END, np.uint8)
        square.ravel()[:n] = text
        before = np.full((rows, lead), END, np.uint8)
        before[1:] = square[:-1, -lead:]
        steps = np.ascontiguousarray(np.hstack([before, square]).T).astype(np.int32)
        gained = np.empty((_STRETCH, rows), np.float32)
        node = np.full(rows, self.start, np.int32)
        for t in range(lead + _STRETCH):
            at = (node << 8) + steps[t]
            if t >= lead:
                np.take(self.cost, at, out=gained[t - lead])
            node = self.follow[at].astype(np.int32)
        total = np.concatenate([[0.0], np.cumsum(gained.T.ravel()[:n], dtype=np.float64)])
        return total[row_ends] - total[np.concatenate([[0], row_ends[:-1]])]


# --- the whole tree, gram by gram -----------------------------------------------------

class _Mixture:
    """The choices that some grams meet in their contexts of ``low`` to ``high`` bytes.

    A choice is the number ``context << 8 | place``, its place in the tree of the 255
    choices counted from 1.  Choices without a gram have no counts and need no row.
    """

    def __init__(self, choice: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None, low: int, high: int):
        """``below`` is the log P_w product of the children of the choices of ``high`` bytes, None if they have none."""
        self.low, self.high = low, high
        self.ids, self.inverse, self.own, self.share, self.log = {}, {}, {}, {}, {}
        place, context = choice & 255, choice >> 8
        above = None
        for d in range(high, low - 1, -1):
            ids, first, inverse = np.unique((context & (1 << 8 * d) - 1) << 8 | place, return_index=True, return_inverse=True)
            n0, n1 = np.bincount(inverse, zeros, len(ids)), np.bincount(inverse, ones, len(ids))
            own = log_kt(n0, n1)
            child = np.bincount(inverse[above], self.log[d + 1], len(ids)) if d < high else None if below is None else np.bincount(inverse, below, len(ids))
            total = own if child is None else np.logaddexp(own, child) + _HALF
            self.share[d] = np.ones(len(ids)) if child is None else np.exp(np.minimum(0, _HALF + own - total))
            self.ids[d], self.inverse[d], self.own[d], self.log[d] = ids, inverse, _kt(n0, n1), total
            self.zeros, self.ones, above = n0, n1, first

    def down(self, up: np.ndarray, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate so far, share left to the children) of each given choice in its context of ``high`` bytes.

        ``up`` and ``into`` are the same of each given choice in its context of ``low - 1`` bytes.
        """
        for d in range(self.low, self.high + 1):
            at, share = self.inverse[d], self.share[d][self.inverse[d]]
            up, into = up + into * share * self.own[d][at], into * (1 - share)
        return up, into


def _choices_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(choice, bit) of the eight choices of each gram, (n, 8)."""
    level = np.arange(8)
    byte, context = keys[:, None] & 255, keys[:, None] >> 8
    return context << 8 | 1 << level | byte >> 8 - level, byte >> 7 - level & 1


def _whole_subtrees(keys: np.ndarray, cut: int, depth: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``_GRAMS`` sorted grams that split no context of ``cut`` bytes."""
    edges = np.append(np.flatnonzero(np.diff(_stem(keys, cut, depth), prepend=~np.uint64(0))), len(keys))
    start = 0
    while start < len(keys):
        stop = int(edges[max(np.searchsorted(edges, start + _GRAMS, "right") - 1, np.searchsorted(edges, start, "right"))])
        yield start, stop
        start = stop


def _grown(keys: np.ndarray, n: np.ndarray, cut: int, depth: int) -> tuple[_Mixture, np.ndarray, np.ndarray]:
    choice, bit = _choices_of(turned(keys, depth).view(np.int64))
    times = np.repeat(n, 8).astype(np.float64)
    return _Mixture(choice.ravel(), np.where(bit.ravel(), 0, times), np.where(bit.ravel(), times, 0), None, cut, depth), choice, bit


_SUMMED = "bucket int, place long, many int, grams binary, counts binary, choice array<long>, log array<double>, zeros array<double>, ones array<double>"


def _summed(cut: int, depth: int):
    """Task function on the blobs sorted by bucket: all grams of a bucket with their counts, a row a slice.

    Each row also holds sums over the choices of ``cut`` bytes by their choice of ``cut - 1`` bytes.
    """
    doubles = pa.list_(pa.float64())
    schema = pa.schema([("bucket", pa.int32()), ("place", pa.int64()), ("many", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()),
                        ("choice", pa.list_(pa.int64())), ("log", doubles), ("zeros", doubles), ("ones", doubles)])

    def rows(bucket: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for place, (a, b) in enumerate(_whole_subtrees(keys, cut, depth)):
            tree, _, _ = _grown(keys[a:b], n[a:b], cut, depth)
            ids = tree.ids[cut]
            shorter, inverse = np.unique((ids >> 8 & (1 << 8 * (cut - 1)) - 1) << 8 | ids & 255, return_inverse=True)
            sums = [np.bincount(inverse, v, len(shorter)) for v in (tree.log[cut], tree.zeros, tree.ones)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (bucket, place, b - a, packed_keys(keys[a:b]), packed(n[a:b]), shorter, *sums), schema)], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, current = [], None
        for batch in batches:
            for bucket, many, k, n in zip(batch.column("bucket").to_pylist(), batch.column("many").to_pylist(), batch.column("grams"), batch.column("counts")):
                if parts and bucket != current:
                    yield from rows(current, *_merged(parts))
                    parts = []
                current = bucket
                parts.append((unpacked_keys(k, many), unpacked(n, many).view(np.int64)))
                if len(parts) > 1 and sum(len(x) for x, _ in parts) > max(1_000_000, 3 * len(parts[0][0])):
                    parts = [_merged(parts)]
        if parts:
            yield from rows(current, *_merged(parts))
    return task


def _priced(cut: int, depth: int, shorter):
    """Task function on the sums of each bucket and then its blobs: the code lengths of each blob in its own order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, up, into = shorter.value

        def costs(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
            tree, choice, bit = _grown(keys, n, cut, depth)
            at = np.searchsorted(ids, ((choice >> 8 & (1 << 8 * (cut - 1)) - 1) << 8 | choice & 255).ravel())
            one = np.clip(tree.down(up[at], into[at])[0].reshape(-1, 8), 1e-12, 1 - 1e-12)
            return np.log10(np.where(bit, one, 1 - one)).sum(1).astype(np.float32)

        table, current = [], None
        for batch in batches:
            out: list[tuple] = []
            for bucket, chunk, many, k, n in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("many").to_pylist(),
                                                 batch.column("grams"), batch.column("counts")):
                if bucket != current:
                    table, current = [], bucket
                keys = unpacked_keys(k, many)
                if chunk is None:
                    table.append((keys, costs(keys, unpacked(n, many).view(np.int64))))
                    continue
                if len(table) > 1:
                    table = [tuple(np.concatenate(v) for v in zip(*table))]
                known, cost = table[0]
                out.append((chunk, many, k.as_py(), cost[np.searchsorted(known, keys)].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["chunk", "many", "grams", "costs"])
    return task


def gram_costs(blobs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """(chunk, many, grams, costs): log10 probability of the grams of each of ``blobs`` under the frozen mixture of the whole tree."""
    cut = min(_CUT, depth)
    tasks = max(1, buckets // 2)
    sums = stored(blobs.select("bucket", "many", "grams", "counts").repartition(tasks, "bucket").sortWithinPartitions("bucket")
                  .mapInArrow(_summed(cut, depth), _SUMMED))
    table = (sums.select(F.explode(F.arrays_zip("choice", "log", "zeros", "ones")).alias("x")).select("x.*")
             .groupBy("choice").agg(*[F.sum(c).alias(c) for c in ("log", "zeros", "ones")]).orderBy("choice").toArrow())
    choice, log, zeros, ones = (table.column(c).to_numpy() for c in ("choice", "log", "zeros", "ones"))
    top = _Mixture(choice, zeros, ones, log, 0, cut - 1)
    shorter = blobs.sparkSession.sparkContext.broadcast((choice, *top.down(np.zeros(len(choice)), np.ones(len(choice)))))
    none = F.lit(None).cast("long")
    both = (sums.select("bucket", "place", none.alias("chunk"), "many", "grams", "counts")
            .union(blobs.select("bucket", none.alias("place"), F.col("key").alias("chunk"), "many", "grams", F.lit(None).cast("binary").alias("counts"))))
    return (both.repartition(tasks, "bucket").sortWithinPartitions("bucket", F.col("place").asc_nulls_last())
            .mapInArrow(_priced(cut, depth, shorter), "chunk long, many int, grams binary, costs binary"))


def _level(count: Column) -> Column:
    """Quarter octave of a count."""
    return F.floor(F.log2(count) * 4).cast("int")


def _lowest(levels: list[tuple[int, int]], most: int) -> int:
    """Lowest level that, with all above it, holds at most ``most`` rows."""
    lowest, held = 1 << 30, 0
    for value, many in sorted(levels, reverse=True):
        held += many
        if held > most:
            break
        lowest = value
    return lowest


def train(counts: DataFrame, spec: TreeSpec) -> Model:
    """Build the trees from the gram counts of the training part."""
    gram = counts.where("kind = 0").select((F.shiftright("key", 8)).alias("long_context"), F.col("key").bitwiseAND(255).cast("int").alias("byte"), "n")
    cut = F.array(*[F.struct(F.lit(d).alias("depth"), F.col("long_context").bitwiseAND((1 << 8 * d) - 1).alias("context")) for d in range(1, spec.depth + 1)])
    by_byte = (gram.select(F.explode(cut).alias("at"), "byte", "n").select("at.depth", "at.context", "byte", "n")
               .groupBy("depth", "context", "byte").agg(F.sum("n").alias("n")))
    contexts = stored(by_byte.groupBy("depth", "context").agg(_level(F.sum("n")).alias("level"), F.collect_list(F.struct("byte", "n")).alias("next"))
                      .select("depth", "context", "level", F.col("next.byte").alias("bytes"), F.col("next.n").alias("counts")))
    levels = contexts.groupBy("level").agg(F.count("*")).collect()
    kept = contexts.where(F.col("level") >= _lowest(levels, spec.nodes)).drop("level")
    built = kept.withColumn("last", F.col("context").bitwiseAND(255)).groupBy("last").applyInArrow(
        _subtree(spec.depth), "depth int, context long, choice binary, log_weighted binary")
    built = stored(built)
    root_counts = np.zeros((1, 256))
    for byte, n in gram.groupBy("byte").agg(F.sum("n")).collect():
        root_counts[0, byte] = n
    child = np.zeros((1, 256))
    for bytes_, ns in kept.where("depth = 1").select("bytes", "counts").collect():
        child[0, bytes_] += ns
    logs = [np.frombuffer(r[0]) for r in built.where("depth = 1").select("log_weighted").collect()]
    _, share, own, rest = _node(root_counts, child, np.sum(logs, axis=0)[None, :] if logs else np.zeros((1, 255)), np.array([bool(logs)]))
    nodes = built.select("depth", "context", "choice").toArrow()      # at most ``nodes`` rows of 1 KB
    depths, contexts = nodes.column("depth").to_numpy(), nodes.column("context").to_numpy()
    order = np.lexsort((contexts, depths))
    chance = np.empty((len(order) + 1, 255), np.float32)
    chance[0] = rest[0]
    place, at = np.argsort(order) + 1, 0
    for part in nodes.column("choice").chunks:
        chance[place[at:at + len(part)]] = np.frombuffer(flat(part)[0], np.float32).reshape(-1, 255)
        at += len(part)
    del nodes
    for i in range(0, len(chance), 4_096):
        chance[i:i + 4_096] = share[0] * own[0] + (1 - share[0]) * chance[i:i + 4_096]
    return Model(spec.depth, depths[order], contexts[order], chance)


# --- scores ---------------------------------------------------------------------------

def _rows_scored(batch: pa.RecordBatch | pa.Table, log10: Callable[[np.ndarray, np.ndarray], np.ndarray], words: np.ndarray, logs: np.ndarray) -> list[pa.Array]:
    """Columns of ``_SCORED``: code length, sums over frequent words, and the other words of each row."""
    data, offsets = flat(batch.column("text"))
    n = batch.num_rows
    score, base, known, tokens = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    print_a, rare = np.zeros(n, np.uint64), []
    for low, high in runs(offsets, _SLICE):
        part = data[offsets[low]:offsets[high]]
        text, row_ends, (starts, ends, first) = stream(part, offsets[low:high + 1] - offsets[low])
        score[low:high] = log10(text, row_ends)
        h = word_hashes(part, starts, ends)
        unique, place = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(words, unique), max(len(words) - 1, 0))
        found = words[at] == unique if len(words) else np.zeros(len(unique), bool)
        gain = np.where(found, logs[at], 0.0) if len(words) else np.zeros(len(unique))
        hit = found[place]
        sums = np.concatenate([[0.0], np.cumsum(gain[place])])
        hits = np.concatenate([[0], np.cumsum(hit)])
        base[low:high], known[low:high] = sums[first[1:]] - sums[first[:-1]], hits[first[1:]] - hits[first[:-1]]
        tokens[low:high] = np.diff(first) + 1
        order = np.arange(len(h), dtype=np.uint64)
        spread = mixed(h + mixed(order - first[np.searchsorted(first, np.arange(len(h)), "right") - 1].astype(np.uint64))) if len(h) else h
        marks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread)])
        print_a[low:high] = marks[first[1:]] - marks[first[:-1]]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            rare.append(h[a:b][~hit[a:b]].view(np.int64))
    return [batch.column("doc_id"), pa.array(print_a.view(np.int64)), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)),
                                     pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)))]


_SCORED = ["doc_id", "words_print", "n_tokens", "frequent_known", "frequent_log", "score", "others"]


def _scored(tables):
    """Task function on texts, with the table of a bounded model."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words, logs = tables.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_rows_scored(batch, model.log10, words, logs), names=_SCORED)
    return task


def _chunk_scored(tables, depth: int):
    """Task function on a chunk's texts and the code lengths of its grams."""

    def task(texts: pa.Table, costs: pa.Table) -> pa.Table:
        words, logs = tables.value
        keys = np.concatenate([np.zeros(0, np.uint64), *[unpacked_keys(k, many) for k, many in zip(costs.column("grams"), costs.column("many").to_pylist())]])
        cost = np.concatenate([np.zeros(0, np.float32), *[np.frombuffer(c.as_buffer(), np.float32) for c in costs.column("costs")]])
        order = np.argsort(keys)
        keys, cost = keys[order], cost[order]

        def log10(text: np.ndarray, row_ends: np.ndarray) -> np.ndarray:
            unique, place = np.unique(turned(grams(text, row_ends, depth), depth), return_inverse=True)
            total = np.concatenate([[0.0], np.cumsum(cost[np.searchsorted(keys, unique)][place], dtype=np.float64)])
            return total[row_ends] - total[np.concatenate([[0], row_ends[:-1]])]

        return pa.table(_rows_scored(texts, log10, words, logs), names=_SCORED)
    return task


def score_documents(docs: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % spec.held_out_of == spec.held_out, F.lit(False))
    if spec.nodes is None:
        texts = stored(docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
            _chunked(spec.chunk), f"chunk long, size long, doc_id {kind}, text string, held_out boolean"))
        size = texts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        buckets = min(max(size // _BUCKET, _BUCKETS[0]), _BUCKETS[1])
        in_chunks = stored(texts.select("chunk", "text", "held_out").mapInArrow(_packed_chunks(spec.depth, min(_CUT, spec.depth), buckets), _PACKED))
        found = gram_costs(in_chunks.where("kind = 0"), spec.depth, buckets).groupBy("chunk")
        counts = stored(in_chunks.where("kind > 0").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    else:
        counts = stored(docs.where(~held_out).select("text").mapInArrow(_counted(spec.depth), "kind int, key long, n long")
                        .groupBy("kind", "key").agg(F.sum("n").alias("n")))
        model = train(counts, spec)

    words = counts.where("kind = 1")
    n_rows = int(counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    level = _level(F.col("n"))
    by_level = words.groupBy(level.alias("level")).agg(F.count("*"), F.sum("n")).collect()
    n_train = sum(r[2] for r in by_level) + n_rows
    distinct = sum(r[1] for r in by_level) + (n_rows > 0)
    lowest = _lowest([(r[0], r[1]) for r in by_level], spec.frequent)
    table = words.where(level >= lowest).select("key", "n").toPandas()       # at most ``frequent`` rows
    keys = table["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    logs = np.log10(table["n"].to_numpy(np.float64)[order] + 0.5)
    columns = f"doc_id {kind}, words_print long, n_tokens long, frequent_known long, frequent_log double, score double, others array<long>"
    if spec.nodes is None:
        tables = spark.sparkContext.broadcast((keys[order], logs))
        rows = stored(texts.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(found).applyInArrow(_chunk_scored(tables, spec.depth), columns))
    else:
        tables = spark.sparkContext.broadcast((model, keys[order], logs))
        rows = stored(docs.select("doc_id", "text").mapInArrow(_scored(tables), columns))

    # Texts with equal words look their rarer words up once.
    others = (rows.where("size(others) > 0").groupBy("words_print", "n_tokens").agg(F.min("others").alias("others"))
              .select("words_print", "n_tokens", F.explode("others").alias("key")))
    looked_up = (others.join(words.where(level < lowest).select("key", "n"), "key", "left")
                 .groupBy("words_print", "n_tokens")
                 .agg(F.count("n").alias("other_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("other_log")))
    norm = float(np.log10(n_train + 0.5 * (distinct + 1)))
    end = float(np.log10(n_rows + 0.5))
    zero = F.lit(0).cast("long")
    return (rows.drop("others").join(looked_up, ["words_print", "n_tokens"], "left")
            .select("doc_id", held_out.alias("held_out"), "n_tokens",
                    (F.col("frequent_known") + F.coalesce("other_known", zero) + F.lit(int(n_rows > 0)).cast("long")).alias("n_known"),
                    F.lit(int(n_train)).cast("long").alias("train_tokens"),
                    (F.col("frequent_log") + F.coalesce("other_log", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
                    "score"))
