"""Mixing sources to target weights by Sainte-Lague apportionment.

DataFrame functions only.  The words of a source are cut into shards; the words
of a shard, its documents in seeded order, form a line cut into blocks of equal
length.  Blocks are the seats that the method hands out, first to sources by
their target, then to the shards of a source by their length, always to the
highest quotient ``votes / (2 * seats + 1)``.  A shard then takes a run of blocks
around the circle of its line, from a seeded start, once round for each full
repeat.

Defined results: null and empty texts have size 0 and nothing is taken of them;
a null source is a source of its own; rows that agree in every column take part
one by one; an empty table gives an empty table; columns besides those named are
carried only when asked for with ``carry``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corrobora.llm.storage import shielded, stored

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSpec:
    """``most_repeats`` bounds how often a word is taken; a shard holds about
    ``shard_words`` words but a source never has more than ``most_shards`` shards
    (its shards grow instead); a block is a thousandth of the smallest target,
    between 1 and ``most_block`` words."""

    seed: str = "mix"
    most_repeats: int = 3
    shard_words: int = 65_536
    most_shards: int = 4_096
    most_block: int = 1_024
    broadcast_sources: int = 10_000


def size_of(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(*parts: Column | str) -> Column:
    """Seeded 48-bit number of a key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """One row per source: its number, size, weight, target and block length.

    The windows run over one row per source.  A source is filled to its bound when
    bound / weight lies below the level that the words left give the sources
    left; the highest such level over the sources, ordered by bound / weight, is
    the level at which resharing stops.
    """
    everything = Window.partitionBy()
    by_bound = Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    size, weight = F.col("source_size"), F.col("weight")
    return (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
            .withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
            .withColumn("weight", (F.col("source_no") - 1) % 3 + 1)
            .withColumn("bound", F.lit(spec.most_repeats) * size)
            .withColumn("ratio", F.col("bound") / weight)
            .withColumn("total", F.sum(size).over(everything))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("bound").over(by_bound), F.lit(0)))
                        / (F.sum(weight).over(everything) - F.coalesce(F.sum(weight).over(by_bound), F.lit(0))))
            .withColumn("target", F.least(F.col("bound").cast("double"), weight * F.max("level").over(everything)))
            .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(spec.most_block), F.floor(
                F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything) / 1000))).cast("long"))
            .select("source_no", "source", "source_size", "weight", "target", "total", "block"))


def apportion(rows: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Add ``quota``: the seats of each row among ``seats`` of its group, by highest quotients.

    Rounding each exact share leaves the seat count off by at most half the number
    of rows; only the quotients that can decide this difference are listed
    (``rows * share / 2 + 1`` of a row), so the work stays linear.
    """
    whole = Window.partitionBy(*group)
    share = F.when(F.col("votes_all") > 0, F.col(votes) / F.col("votes_all")).otherwise(0.0)
    base = (rows.withColumn("votes_all", F.sum(votes).over(whole))
            .withColumn("n_rows", F.count("*").over(whole))
            .withColumn("share", share)
            .withColumn("base", F.floor(F.col("share") * F.col(seats) + 0.5))
            .withColumn("short", F.when(F.col("votes_all") > 0, F.col(seats) - F.sum("base").over(whole)).otherwise(0)))
    steps = F.ceil(F.col("n_rows") * F.col("share") / 2) + 1
    listed = (base.where(F.col("short") != 0)
              .select(*group, key, "base", "short", F.col(votes).alias("v"), F.explode(F.sequence(F.lit(1), steps)).alias("step"))
              .withColumn("held", F.when(F.col("short") > 0, F.col("base") + F.col("step") - 1)
                          .otherwise(F.col("base") - F.col("step")))
              .where("held >= 0 AND v > 0")
              .withColumn("quotient", F.col("v") / (2 * F.col("held") + 1)))
    best = Window.partitionBy(*group).orderBy(
        F.when(F.col("short") > 0, -F.col("quotient")).otherwise(F.col("quotient")), key, "step")
    moved = (listed.withColumn("place", F.row_number().over(best)).where(F.col("place") <= F.abs("short"))
             .groupBy(*group, key).agg(F.sum(F.signum("short")).cast("long").alias("moved")))
    return (base.join(moved, [*group, key], "left")
            .withColumn("quota", (F.col("base") + F.coalesce("moved", F.lit(0))).cast("long"))
            .drop("votes_all", "n_rows", "share", "base", "short", "moved"))


def placed(docs: DataFrame, sources: DataFrame, spec: MixSpec) -> DataFrame:
    """Give each row its source's columns, its shard and its seeded key."""
    small = sources.limit(spec.broadcast_sources + 1).count() <= spec.broadcast_sources
    right = sources.withColumnRenamed("source", "source_name")
    right = F.broadcast(right) if small else right
    shards = F.least(F.lit(spec.most_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / spec.shard_words)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return (docs.join(right, docs["source"].eqNullSafe(right["source_name"])).drop("source_name")
            .withColumn("shard", (_draw(F.lit(spec.seed), F.lit("shard"), name) % shards).cast("int"))
            .withColumn("order_key", _draw(F.lit(spec.seed), F.lit("order"), name)))


def shard_quotas(rows: DataFrame, sources: DataFrame, spec: MixSpec) -> DataFrame:
    """(source_no, shard, words, blocks, quota, start): the seats of every shard."""
    cut = (rows.groupBy("source_no", "shard", "block", "target", "total").agg(F.sum("size").alias("words"))
           .withColumn("blocks", F.ceil(F.col("words") / F.col("block"))))
    seats = sources.withColumn("everything", F.lit(0)).withColumn("seats", F.floor(F.col("total") / F.col("block") + 0.5))
    seats = apportion(seats, ["everything"], "source_no", "target", "seats").select("source_no", F.col("quota").alias("source_seats"))
    quotas = apportion(cut.join(seats, "source_no"), ["source_no"], "shard", "words", "source_seats")
    start = _draw(F.lit(spec.seed), F.lit("start"), F.col("source_no").cast("string"), F.col("shard").cast("string"))
    return quotas.select(
        "source_no", "shard", "words", "blocks",
        F.least("quota", spec.most_repeats * F.col("blocks")).alias("quota"),
        F.when(F.col("blocks") > 0, start % F.col("blocks")).otherwise(0).alias("start"))


def mix(docs: DataFrame, spec: MixSpec = MixSpec(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Mix ``docs(doc_id, text, source)``.

    Returns doc_id, source, size, source_size, target, taken, ``copies`` (whole
    copies taken) and the word ranges taken besides, ``first_from``/``first_to`` and
    ``again_from``/``again_to`` (the second only where the run passes the end of
    the line), plus the columns in ``carry``.
    """
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *carry)
    narrow = stored(sized.select("doc_id", "source", "size"))
    sources = stored(source_targets(narrow, spec))
    quotas = stored(shard_quotas(placed(narrow, sources, spec), sources, spec))
    rows = placed(sized if carry else narrow, sources, spec)
    line = Window.partitionBy("source_no", "shard").orderBy("order_key", "doc_id", "size")
    rows = rows.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    rows = rows.join(quotas, ["source_no", "shard"])
    rest = F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0)
    until = F.col("start") + F.col("rest")
    inside = lambda low, high: (F.greatest(F.lit(0), low - F.col("begin")), F.least("size", high - F.col("begin")))
    first = inside(F.col("start") * F.col("block"), F.least("words", until * F.col("block")))
    again = inside(F.lit(0), F.greatest(F.lit(0), until - F.col("blocks")) * F.col("block"))
    length = lambda a, b: F.greatest(F.lit(0), F.col(b) - F.col(a))
    return (rows.withColumn("rest", rest)
            .withColumn("copies", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).cast("long"))
            .withColumn("first_from", first[0]).withColumn("first_to", first[1])
            .withColumn("again_from", again[0]).withColumn("again_to", again[1])
            .withColumn("taken", (F.col("copies") * F.col("size") + length("first_from", "first_to")
                                  + length("again_from", "again_to")).cast("long"))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "copies",
                    "first_from", "first_to", "again_from", "again_to", *carry))


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The documents of the mix, in the columns of ``docs``.

    A document appears once per whole copy, as it is; a partly taken one appears
    once more for each range, its words joined by single spaces.
    """
    inner, back = shielded(docs, "doc_id", "source", "text")
    rows = mix(inner, spec, carry=tuple(c for c in inner.columns if c not in ("doc_id", "source")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = lambda a, b: F.when(
        F.col(b) > F.col(a),
        F.when((F.col(a) == 0) & (F.col(b) == F.col("size")), F.col("text"))
        .otherwise(F.array_join(F.slice(words, (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int")), " ")))
    texts = F.concat(F.array_repeat(F.col("text"), F.col("copies").cast("int")),
                     F.filter(F.array(cut("first_from", "first_to"), cut("again_from", "again_to")), lambda x: x.isNotNull()))
    return (rows.where("taken > 0").withColumn("piece", F.explode(texts)).withColumn("text", F.col("piece"))
            .select(*inner.columns).withColumnsRenamed(back))
