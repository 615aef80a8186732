"""Benchmark decontamination with Wu-Manber multi-pattern search.

The strings searched for are the windows of the benchmark items, written as
`` w1 w2 ... `` with a space on either side; a document is rewritten the same way.
For a class of strings of at least ``m`` bytes, the shift table tells for a block
of text how far the search may move on; shift 0 leads to the bucket of strings
whose ``m``-byte head ends in that block, of which those with the right first
bytes are compared directly.  Many cursors, each with a stretch of the text
of its own, move in step as one array operation.

Classes keep short items from shortening the shifts of long ones.  The strings
are broadcast in blocks of ``block_bytes`` at most; with more, the documents pass
once for each block and gather their hits as they go.

Defined results: null and wordless texts have no words and no hits; null and
wordless items have no windows; windows of an item without an id mark words but
are listed under no item; repeated rows are searched one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.kernel import LOWER, flat, runs
from corrobora.llm.storage import shielded, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
CLASSES = ((32, 8), (16, 8), (8, 4), (0, 2))     # shortest string, bytes of a block
STRETCH = 2_048
HASH_BITS = 18

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_PLAIN = np.where(_IN_WORD[LOWER], LOWER, 0x20).astype(np.uint8)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(words, items): each distinct window with the ids of the items that hold it."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"),
                         F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    last = F.greatest(F.lit(1), F.size("w") - window + 1)
    return (words.select("item_id", "w", F.explode(F.sequence(F.lit(1), last)).alias("at"))
            .select("item_id", F.array_join(F.slice("w", F.col("at"), window), " ").alias("words"))
            .groupBy("words").agg(F.collect_set("item_id").alias("items")))


class Searcher:
    """Shift tables, buckets and strings of one block of windows."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        self.strings = [b" " + w.encode() + b" " for w, _ in windows]
        self.items = [i for _, i in windows]
        self.classes = []
        lengths = np.array([len(s) for s in self.strings], np.int64)
        upper = np.inf
        for least, block in CLASSES:
            numbers = np.flatnonzero((lengths >= least) & (lengths < upper))
            upper = least
            if len(numbers):
                self.classes.append(self._tables(numbers, block))

    def _tables(self, numbers: np.ndarray, block: int) -> dict:
        m = min(len(self.strings[i]) for i in numbers)
        heads = np.frombuffer(b"".join(self.strings[i][:m] for i in numbers), np.uint8).reshape(-1, m)
        shift = np.full(1 << HASH_BITS, m - block + 1, np.uint16 if m < 65_536 else np.int64)
        for j in range(m - block + 1):
            value = np.zeros(len(numbers), np.uint64)
            for b in range(block):
                value |= heads[:, j + b].astype(np.uint64) << np.uint64(8 * b)
            np.minimum.at(shift, self._slot(value), m - block - j)
        order = np.argsort(value, kind="stable")       # value holds the last block of every head
        first = [self.strings[i][:8].ljust(8, b"\0") for i in numbers]
        size = np.array([min(8, len(self.strings[i])) for i in numbers], np.uint64)
        mask = ~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * size)
        return {"m": m, "block": np.uint64(64 - 8 * block), "shift": shift, "suffix": value[order], "number": numbers[order],
                "first": np.frombuffer(b"".join(first), "<u8").astype(np.uint64)[order], "mask": mask[order]}

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return (value * _MULTIPLIER) >> np.uint64(64 - HASH_BITS)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, string number) of every occurrence in ``text``."""
        n = len(text)
        padded = np.concatenate([np.zeros(8, np.uint8), text, np.zeros(16, np.uint8)])
        eight = np.ndarray((n + 16,), "<u8", padded, 0, (1,))     # eight[i]: the bytes i - 8 to i - 1 of text
        whole = padded.tobytes()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for c in self.classes:
            ends = self._candidates(c, eight, n)
            if not len(ends):
                continue
            value = eight[ends + 1] >> c["block"]
            low, high = np.searchsorted(c["suffix"], value, "left"), np.searchsorted(c["suffix"], value, "right")
            for part in range(0, len(ends), 65_536):
                rows = slice(part, part + 65_536)
                many = (high - low)[rows]
                at = np.repeat(ends[rows] - c["m"] + 1, many)
                entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[rows], many)
                same = (eight[at + 8] & c["mask"][entry]) == c["first"][entry]
                at, number = at[same], c["number"][entry[same]]
                sure = np.fromiter((whole.startswith(self.strings[k], p + 8) for p, k in zip(at.tolist(), number.tolist())), bool, len(at))
                found.append((at[sure], number[sure]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([k for _, k in found])

    def _candidates(self, c: dict, eight: np.ndarray, n: int) -> np.ndarray:
        """Last positions of ``m``-byte stretches whose last block ends a head."""
        begin = np.arange(0, n, STRETCH)
        end = np.minimum(begin + STRETCH, n)
        at = np.maximum(begin, c["m"] - 1)
        at, end = at[at < end], end[at < end]
        hits = []
        while len(at):
            step = c["shift"][self._slot(eight[at + 1] >> c["block"])]
            zero = step == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.maximum(step, 1)
            more = at < end
            if not more.all():
                at, end = at[more], end[more]
        return np.concatenate(hits) if hits else np.zeros(0, np.int64)


def plain_text(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as ``\\0 w1 w2 ... wn `` one after the other, and where each begins."""
    n = len(offsets) - 1
    wide = np.full(len(data) + 3 * n + 1, 0x20, np.uint8)
    marks = offsets[:-1] + 3 * np.arange(n) + 1
    for i in range(n):
        wide[marks[i] + 2:marks[i] + 2 + offsets[i + 1] - offsets[i]] = _PLAIN[data[offsets[i]:offsets[i + 1]]]
    wide[marks] = 0
    word = wide > 0x20
    keep = word | (wide == 0)
    keep[1:] |= word[:-1] | (wide[:-1] == 0)
    text = wide[keep]
    return text, np.append(np.flatnonzero(text == 0), len(text))


def _merge(old: bytes | None, new: np.ndarray) -> bytes:
    """Union of two sorted lists of word numbers."""
    return (np.union1d(np.frombuffer(old, np.int64), new) if old else new).tobytes()


def searched(searcher_of: Callable[[], Searcher]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task function: fill n_words, hit_words (64-bit word numbers) and items of each row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = searcher_of()
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            n_words = np.zeros(batch.num_rows, np.int64)
            hit_words = batch.column("hit_words").to_pylist()
            items = batch.column("items").to_pylist()
            for low, high in runs(offsets, 1 << 22):
                text, begin = plain_text(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                heads = np.flatnonzero((text[1:] > 0x20) & (text[:-1] == 0x20)) + 1
                first = np.searchsorted(heads, begin)
                n_words[low:high] = np.diff(first)
                at, number = searcher.occurrences(text)
                if not len(at):
                    continue
                cover = np.zeros(len(text) + 1, np.int32)
                lengths = np.array([len(searcher.strings[k]) for k in number])
                np.add.at(cover, at + 1, 1)
                np.add.at(cover, at + lengths - 1, -1)
                hit = np.flatnonzero(np.cumsum(cover)[heads] > 0)
                row_of_hit, row_of = np.searchsorted(first, hit, "right") - 1, np.searchsorted(begin, at, "right") - 1
                for row in np.unique(row_of).tolist():
                    hit_words[low + row] = _merge(hit_words[low + row], hit[row_of_hit == row] - first[row])
                    names = {x for k in np.unique(number[row_of == row]).tolist() for x in searcher.items[k]}
                    items[low + row] = sorted(names.union(items[low + row] or ()))
            columns = {"n_words": pa.array(n_words), "hit_words": pa.array(hit_words, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([columns.get(f, batch.column(i)) for i, f in enumerate(batch.schema.names)], names=batch.schema.names)

    return task


def find_hits(docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = (), window: int = WINDOW,
              block_bytes: int = 32_000_000) -> DataFrame:
    """Search ``docs(doc_id, text)`` for the windows of ``items(item_id, text)``.

    Returns doc_id, n_words, hit_words (word numbers as 64-bit integers), items and
    the columns in ``carry``, which may include text.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(items, window))
    total = windows.agg(F.coalesce(F.sum(F.octet_length("words") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    own = list(dict.fromkeys(["text", *carry]))
    rows = docs.select("doc_id", *own, F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hit_words"),
                       F.lit(None).cast("array<string>").alias("items"))
    for k in range(blocks):
        part = [(r[0], r[1]) for r in windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).collect()]
        tables = spark.sparkContext.broadcast(Searcher(part))
        last = k == blocks - 1
        keep = ["doc_id", *([c for c in own if c in carry] if last else own), "n_words", "hit_words", "items"]
        schema = rows.schema
        rows = rows.mapInArrow(searched(lambda tables=tables: tables.value), schema)
        rows = rows.select(*keep)
        if not last:
            rows = stored(rows)
    return rows


def contamination(hits: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and digest of :func:`find_hits`."""
    n_hit = F.coalesce((F.octet_length("hit_words") / 8).cast("long"), F.lit(0).cast("long"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort(names), ",").cast("binary"), 256).alias("items_sha256"),
                       (n_hit > 0).alias("contaminated"), *carry)


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, in their own columns."""
    rows, back = shielded(docs, "doc_id", "text")
    hits = find_hits(rows, items, carry=tuple(c for c in rows.columns if c != "doc_id"))
    return hits.where(F.col("hit_words").isNull()).select(*rows.columns).withColumnsRenamed(back)
