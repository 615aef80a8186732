"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass turns a text into its set of word shingles (64-bit hashes), a
   128-bit fingerprint of the set and ``bands * rows`` minhash values.
2. Equal sets are one class, named by its smallest row key.  A row's key is a 64-bit
   hash of its doc_id and text, so neither null nor repeated ids matter; two of
   10 ** 7 rows share a key by chance with probability 3e-6.
3. Each band of the signature is a bucket.  First every member is paired with the
   smallest member of its bucket, so a group of copies gives one pair per
   member.  Members that this leaves in different components are then compared
   with each other, block by block, so that in the end no two members of a bucket
   in different components are untested.
4. A pair's signatures are compared batch by batch.  With a uniform prior on the
   similarity, ``P(similarity >= threshold | m of n equal)`` is
   ``P(Binomial(n + 1, threshold) <= m)``; below ``miss`` the pair is pruned.
5. Survivors are confirmed on their full sets, and links make components.

A pair at the threshold itself is missed by all buckets with probability
``(1 - threshold ** rows) ** bands``, 3e-6 here, and by the pruning with at most
``batches * miss``.

Defined results: null and wordless texts have an empty set and are linked with
nothing; rows with a null id link like others, their component has a null id if
it holds no other; texts that share an id are documents of their own.  ``kept``
marks the rows that bear their component's id; the stage keeps one row of each
component, the smallest id first and null ids last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.kernel import flat, mixed, runs, word_bounds, word_hashes
from corrobora.llm.storage import stored
from corrobora.operators.graph import connected_components


@dataclass(frozen=True)
class DedupSpec:
    """``words`` to a shingle; links at ``100 * both >= percent * either``."""

    words: int = 5
    percent: int = 80
    bands: int = 24
    rows: int = 4
    batch: int = 32
    miss: float = 1e-5
    chunk: int = 512


_U64 = np.uint64
_SEEDS = np.random.default_rng(7).integers(1, 1 << 31, (2, 4_096), dtype=np.uint32)
_PLACE = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * _U64(2) + _U64(1)


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; empty without words."""
    data, offsets = flat(column)
    for low, high in runs(offsets):
        part, bounds = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        starts, ends, first = word_bounds(part, bounds)
        h = word_hashes(part, starts, ends)
        spread = [mixed(h + _PLACE[i]) * _PLACE[i] for i in range(min(words, len(h)))]
        full = len(h) - words + 1
        shingles = mixed(sum(spread[i][i:full + i] for i in range(words))) if full > 0 else h[:0]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(shingles[a:b - words + 1])
            elif b > a:
                short = h[a:b]
                yield mixed(np.array([sum(int(mixed(short[i:i + 1] + _PLACE[i])[0]) * int(_PLACE[i]) for i in range(b - a)) + b - a & (1 << 64) - 1], np.uint64))
            else:
                yield h[:0]


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` minhash values of a set."""
    flip, times = _SEEDS[0, :size, None], _SEEDS[1, :size, None] * np.uint32(2) + np.uint32(1)
    low = np.full(size, 0xFFFFFFFF, np.uint32)
    x = (shingles >> _U64(32)).astype(np.uint32)
    for i in range(0, len(x), 2_048):
        np.minimum(low, ((x[None, i:i + 2_048] ^ flip) * times).min(axis=1), out=low)
    return low


def _prints(spec: DedupSpec):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, high, low, signatures = [], [], [], []
            for s in shingle_sets(batch.column("text"), spec.words):
                sizes.append(len(s))
                high.append(int(mixed(s + _PLACE[20]).sum(dtype=np.uint64).view(np.int64)))
                low.append(int(mixed(s ^ _PLACE[21]).sum(dtype=np.uint64).view(np.int64)))
                signatures.append(signature(s, spec.bands * spec.rows).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.array(signatures, pa.binary())], names=["doc_id", "row_key", "n_shingles", "print_a", "print_b", "signature"])
    return task


def row_key() -> Column:
    """Key of a row from its doc_id and text."""
    return F.xxhash64("doc_id", "text")


def fingerprints(docs: DataFrame, spec: DedupSpec) -> DataFrame:
    """doc_id, row_key, n_shingles, print_a, print_b and signature of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(
        _prints(spec), f"doc_id {kind}, row_key long, n_shingles long, print_a long, print_b long, signature binary")


def least_matches(compared: int, spec: DedupSpec) -> int:
    """Smallest number of equal values that keeps a pair after ``compared`` of them."""
    t, n, below = spec.percent / 100, compared + 1, 0.0
    for m in range(n + 1):
        below += comb(n, m) * t ** m * (1 - t) ** (n - m)
        if below >= spec.miss:
            return m
    return n


def _batches(spec: DedupSpec) -> list[tuple[int, int, int]]:
    """(from, to, least matches so far) of each signature batch."""
    size = spec.bands * spec.rows
    return [(i, min(i + spec.batch, size), least_matches(min(i + spec.batch, size), spec)) for i in range(0, size, spec.batch)]


def _pruned(spec: DedupSpec):
    """Task function on pairs with both signatures: keep those that may be similar."""
    plan = _batches(spec)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            left, equal = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j, least in plan:
                equal[left] += (a[left, i:j] == b[left, i:j]).sum(axis=1)
                left = left[equal[left] >= least]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in ("a_id", "b_id")], names=["a_id", "b_id"])
    return task


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link: 100 * both >= percent * either."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int):
    """Task function on pairs with both sets: keep those that are similar."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
                    for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a_id", "b_id")], names=["a_id", "b_id"])
    return task


def id_filter(ids: DataFrame, most_bits: int = 28) -> np.ndarray:
    """Bloom filter of ``ids(row_key)`` with two places in 16 bits an id, 32 MB at most.

    A fuller filter lets more rows pass, it never loses one.
    """
    size = 1 << min(most_bits, max(16, (16 * ids.count()).bit_length()))
    place = F.explode(F.array(*[F.pmod(h, F.lit(size)) for h in (F.xxhash64("row_key"), F.xxhash64(F.lit(1), "row_key"))]))
    words = (ids.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toPandas())
    out = np.zeros(size >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _sets(words: int, wanted):
    """Task function: the sets of the rows whose key may be wanted."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value.view(np.uint64)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for c in ("place_a", "place_b"):
                at = batch.column(c).to_numpy()
                keep &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & _U64(1) == 1
            first = np.zeros(batch.num_rows, bool)
            first[np.unique(batch.column("row_key").to_numpy(), return_index=True)[1]] = True
            rows = batch.filter(pa.array(keep & first))
            sets, size = [], 0
            for i, s in enumerate(shingle_sets(rows.column("text"), words)):
                sets.append(s.tobytes())
                size += len(sets[-1])
                if size > 1 << 24 or i == rows.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([rows.column("row_key").slice(i + 1 - len(sets), len(sets)), pa.array(sets, pa.binary())],
                                                     names=["row_key", "shingles"])
                    sets, size = [], 0
    return task


def shingle_table(docs: DataFrame, wanted: DataFrame, spec: DedupSpec) -> DataFrame:
    """row_key and shingles (sorted hashes) of at least the keys in ``wanted``.

    The texts stay where they are: a filter of the wanted keys goes to them.
    """
    tables = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))
    size = 64 * len(tables.value)
    places = (docs.select(row_key().alias("row_key"), "text")
              .select("row_key", "text", F.pmod(F.xxhash64("row_key"), F.lit(size)).alias("place_a"),
                      F.pmod(F.xxhash64(F.lit(1), "row_key"), F.lit(size)).alias("place_b")))
    # Rows that share a key have equal texts.
    return stored(places.mapInArrow(_sets(spec.words, tables), "row_key long, shingles binary")
                  .groupBy("row_key").agg(F.min("shingles").alias("shingles")))


def links(pairs: DataFrame, docs: DataFrame, spec: DedupSpec) -> DataFrame:
    """The pairs (a_id, b_id) whose full sets are similar enough."""
    sets = shingle_table(docs, pairs.select(F.col("a_id").alias("row_key")).union(pairs.select("b_id")).distinct(), spec)
    both = (pairs.join(sets.withColumnsRenamed({"row_key": "a_id", "shingles": "set_a"}), "a_id")
            .join(sets.withColumnsRenamed({"row_key": "b_id", "shingles": "set_b"}), "b_id"))
    return stored(both.select("a_id", "b_id", "set_a", "set_b").mapInArrow(_confirmed(spec.percent), "a_id long, b_id long"))


def likely(pairs: DataFrame, classes: DataFrame, spec: DedupSpec) -> DataFrame:
    """The pairs (a_id, b_id) whose signatures do not rule a link out."""
    sig = classes.select("rep", "signature")
    return stored(pairs.join(sig.withColumnsRenamed({"rep": "a_id", "signature": "sig_a"}), "a_id")
                  .join(sig.withColumnsRenamed({"rep": "b_id", "signature": "sig_b"}), "b_id")
                  .select("a_id", "b_id", "sig_a", "sig_b").mapInArrow(_pruned(spec), "a_id long, b_id long"))


def _compared(spec: DedupSpec):
    """Task function on one block of a bucket: links between members of different components.

    A pair is looked at in the first of its buckets only; its signatures are compared
    in batches, and what they do not rule out is decided on the full sets.
    """
    plan = _batches(spec)

    def task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rep, label = table.column("rep").to_numpy(), table.column("label").to_numpy()
        band = table.column("band")[0].as_py()
        side = table.column("is_left").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(rep), -1)
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        found: list[tuple] = []
        for x in left.tolist():
            rest = right[label[right] != label[x]]
            if band:
                before = (sig[rest, :band * spec.rows] == sig[x, :band * spec.rows]).reshape(len(rest), band, spec.rows)
                rest = rest[~before.all(axis=2).any(axis=1)]
            equal = np.zeros(len(rest), np.int64)
            for i, j, least in plan:
                equal = equal + (sig[rest, i:j] == sig[x, i:j]).sum(axis=1)
                good = equal >= least
                rest, equal = rest[good], equal[good]
            found += [(rep[x], rep[y]) for y in rest.tolist() if similar(sets[x], sets[y], spec.percent)]
        a, b = (np.array(v, rep.dtype) for v in zip(*found)) if found else (rep[:0], rep[:0])
        return pa.table({"a_id": np.minimum(a, b), "b_id": np.maximum(a, b)})
    return task


def open_links(members: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, spec: DedupSpec) -> DataFrame:
    """Links inside buckets between different components; the first members are known and left aside.

    Members outside the bucket's largest component meet all members, in blocks of
    ``chunk`` by ``chunk`` rows, so that no task holds a whole bucket.  Only links
    leave a block, never the pairs it compares.
    """
    labelled = stored(members.where("rep <> leader").join(roots.withColumnsRenamed({"id": "rep"}), "rep", "left")
                      .select("bucket", "band", "rep", F.coalesce("root", "rep").alias("label")))
    state = (labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                            F.mode("label", True).alias("most"), F.count("*").alias("n")).where("low <> high"))
    rows = stored(labelled.join(state, "bucket").withColumn("blocks", F.ceil(F.col("n") / spec.chunk).cast("int"))
                  .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    sets = shingle_table(docs, rows.select(F.col("rep").alias("row_key")).distinct(), spec)
    rows = rows.join(classes.select("rep", "signature"), "rep").join(sets.withColumnRenamed("row_key", "rep"), "rep")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    shared = ("bucket", "band", "rep", "label", "signature", "shingles")
    left = rows.where("label <> most").select(*shared, F.col("own").alias("i"), every.alias("j"), F.lit(True).alias("is_left"))
    right = rows.select(*shared, every.alias("i"), F.col("own").alias("j"), F.lit(False).alias("is_left"))
    return stored(left.unionByName(right).groupBy("bucket", "i", "j")
                  .applyInArrow(_compared(spec), "a_id long, b_id long").distinct())


def components(docs: DataFrame, spec: DedupSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints of all rows, classes with their root, first row of each root)."""
    prints = stored(fingerprints(docs, spec))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    classes = stored(prints.where("n_shingles > 0").groupBy("print_a", "print_b", "n_shingles")
                     .agg(F.min("row_key").alias("rep"), F.min("signature").alias("signature"), F.min(row).alias("first")))
    width = 4 * spec.rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("signature", width * i + 1, width)) for i in range(spec.bands)])
    banded = classes.select("rep", F.posexplode(keys).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("other")).where("leader <> other")
    members = stored(banded.join(shared.select("bucket", "leader"), "bucket"))
    stars = members.where("rep <> leader").select(F.col("leader").alias("a_id"), F.col("rep").alias("b_id")).distinct()
    linked = links(likely(stars, classes, spec), docs, spec)
    roots = stored(connected_components(linked))
    more = open_links(members, roots, classes, docs, spec)
    if more.limit(1).count():
        roots = stored(connected_components(linked.unionByName(more)))
    rooted = (classes.join(roots.withColumnsRenamed({"id": "rep"}), "rep", "left")
              .select("print_a", "print_b", "n_shingles", "first", F.coalesce("root", "rep").alias("root")))
    return prints, rooted, rooted.groupBy("root").agg(F.min("first").alias("head"))


def near_duplicates(docs: DataFrame, spec: DedupSpec = DedupSpec()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``."""
    prints, rooted, heads = components(docs, spec)
    by_class = rooted.join(heads, "root").select("print_a", "print_b", "n_shingles", F.col("head.doc_id").alias("component"))
    out = prints.drop("signature").join(by_class, ["print_a", "print_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return (out.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def first_of_each_group(docs: DataFrame, spec: DedupSpec = DedupSpec()) -> DataFrame:
    """The one row of ``docs`` that is first of each component, and all wordless rows, in their own columns."""
    prints, _, heads = components(docs, spec)
    heads = stored(heads.select("head.row_key"))
    repeated = stored(prints.where("n_shingles > 0").groupBy("row_key").count().where("count > 1").select("row_key"))
    key = "_row"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, row_key())
    single = heads.join(repeated, "row_key", "left_anti").union(prints.where("n_shingles = 0").select("row_key"))
    out = keyed.join(single, keyed[key] == single["row_key"], "left_semi").drop(key)
    several = heads.join(repeated, "row_key", "left_semi")
    if repeated.limit(1).count():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        again = (keyed.join(several, keyed[key] == several["row_key"], "left_semi").groupBy(key, "doc_id", "text")
                 .agg(F.min_by(whole, F.to_json(whole)).alias("whole")).select("whole.*"))
        out = out.unionByName(again)
    return out
