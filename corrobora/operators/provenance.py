"""Provenance: who stands behind a row, and what that makes it worth.

Shapes used throughout
    registry(registry_id, tier, publisher)      documents(document_id, registry_id)
    evidence(evidence_id, ...)                  evidence_sources(evidence_id, document_id)
    signal_evidence(signal_id, evidence_id)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.functions import rules


def _with_publisher(left: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join on the publisher; rows without one are spread over all tasks.

    Unresolved publishers share one null key, which would gather them in one
    task; here each gets a key of its own that matches nothing.
    """
    key = F.coalesce(F.col("registry_id").cast("string"), F.concat(F.lit("~"), F.col("document_id").cast("string")))
    right = registry.withColumn("_k", F.col("registry_id").cast("string")).drop("registry_id")
    return left.withColumn("_k", key).join(right, "_k", "left").drop("_k")


def provenance_rows(evidence_sources: DataFrame, documents: DataFrame,
                    registry: DataFrame) -> DataFrame:
    """One row per (evidence, document) with its publisher and tier.

    A document whose publisher is unresolved keeps a null ``registry_id``: it is
    a document, but never a publisher.  Both joins are equi-joins on ids; AQE
    broadcasts the registry when it measures it small and splits hot documents.
    """
    docs = documents.select("document_id", "registry_id")
    tiers = registry.select("registry_id", "tier")
    known = evidence_sources.select("evidence_id", "document_id").join(docs, "document_id", "left")
    return _with_publisher(known, tiers)


def publishers_of(rows: DataFrame, key: str) -> DataFrame:
    """Distinct (key, publisher) with the publisher's tier.

    The first aggregate combines before its shuffle, so however many rows a hot
    key has, what moves is bounded by its publishers.
    """
    return rows.where("registry_id IS NOT NULL").groupBy(key, "registry_id").agg(F.min("tier").alias("tier"))


def provenance(rows: DataFrame, key: str) -> DataFrame:
    """Publishers and best tier per key: all that the rules need."""
    return (publishers_of(rows, key).groupBy(key)
            .agg(F.count("*").alias("publishers"), F.min("tier").alias("best_tier")))


def provenance_detail(rows: DataFrame, key: str) -> DataFrame:
    """Distinct documents, distinct publishers and the tiers seen, per key.

    A document has one publisher, so distinct documents add up over publishers:
    one distinct aggregate at (key, publisher) replaces two at key level.
    """
    per_pub = (rows.groupBy(key, "registry_id")
               .agg(F.count_distinct("document_id").alias("docs"), F.min("tier").alias("tier")))
    return per_pub.groupBy(key).agg(
        F.sum("docs").alias("documents"), F.count("registry_id").alias("publishers"),
        F.min("tier").alias("best_tier"), F.array_sort(F.collect_set("tier")).alias("tiers"))


def classify_evidence(evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """Class and confidence of every given evidence row.

    Pass live rows only; a row without any source gets C / LOW.
    """
    prov = provenance(rows, "evidence_id")
    pubs = F.coalesce("publishers", F.lit(0))
    return (evidence.select("evidence_id").join(prov, "evidence_id", "left")
            .select("evidence_id", pubs.alias("publishers"),
                    rules.evidence_class(F.col("best_tier"), pubs).alias("class"),
                    rules.evidence_confidence(F.col("best_tier"), pubs).alias("confidence")))


def score_signals(signals: DataFrame, signal_evidence: DataFrame, live_evidence: DataFrame,
                  rows: DataFrame) -> DataFrame:
    """Strength of every signal and the direction a lone tier-4 source forces.

    Archived evidence contributes nothing; a signal without evidence stays WEAK.
    """
    live = signal_evidence.join(live_evidence.select("evidence_id"), "evidence_id", "left_semi")
    prov = provenance(live.join(publishers_of(rows, "evidence_id"), "evidence_id"), "signal_id")
    pubs = F.coalesce("publishers", F.lit(0))
    scored = signals.join(prov, "signal_id", "left")
    forced = rules.forced_direction(pubs, F.col("best_tier"))
    return scored.select(
        "signal_id", pubs.alias("publishers"), F.col("best_tier"),
        rules.signal_strength(pubs, F.col("best_tier")).alias("strength"),
        forced.alias("forced_direction"),
        F.coalesce(forced, F.col("direction")).alias("direction"))


def inference_gates(evidence: DataFrame, classes: DataFrame, rows: DataFrame, spine: DataFrame,
                    existing: DataFrame, key: str = "pillar") -> DataFrame:
    """State of the national-inference gate per key.

    ``evidence`` is live; ``classes`` are the ones computed in this run.  Every
    key of ``spine`` appears unless its gate is satisfied and never existed.
    """
    national = (evidence.where(F.col("env_layer") == "UAE").select("evidence_id", key)
                .join(classes.where(F.col("class").isin("A", "B")).select("evidence_id"), "evidence_id"))
    n_rows = national.groupBy(key).agg(F.count("*").alias("n_rows"))
    pubs = (publishers_of(national.join(publishers_of(rows, "evidence_id"), "evidence_id"), key)
            .groupBy(key).agg(F.count("*").alias("publishers")))
    joined = (spine.select(key).join(n_rows, key, "left").join(pubs, key, "left")
              .join(existing.select(key, F.col("status").alias("was")), key, "left")
              .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
              .withColumn("publishers", F.coalesce("publishers", F.lit(0))))
    state = rules.gate_state(rules.gate_satisfied(F.col("n_rows"), F.col("publishers")), F.col("was"))
    return joined.select(key, "n_rows", "publishers", "was", state.alias("status")).where("status IS NOT NULL")


def trigger_indicators(indicators: DataFrame, links: DataFrame, signals: DataFrame) -> DataFrame:
    """Watching indicators reach their threshold when they monitor a strong signal."""
    strong = signals.where(F.col("strength").isin("STRONG_EMERGING", "STRONG"))
    hit = (links.where(F.col("rel") == "monitors")
           .join(strong.select(F.col("signal_id").alias("to_id")), "to_id", "left_semi")
           .select(F.col("from_id").alias("indicator_id")).distinct().withColumn("hit", F.lit(True)))
    return (indicators.join(hit, "indicator_id", "left")
            .withColumn("status", F.when((F.col("status") == "WATCHING") & F.col("hit"), "THRESHOLD_MET")
                        .otherwise(F.col("status"))).drop("hit"))


def changed_rows(stored: DataFrame, computed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose computed values differ from the stored ones (the dry-run diff)."""
    old = stored.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    new = computed.select(key, *columns)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(c))
    return old.join(new, key).where(~same)


def document_reference(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Document reference view: documents with publisher and tier, no body."""
    ref = registry.select("registry_id", "publisher", "tier")
    return _with_publisher(documents.drop("raw_text", "text"), ref)


def publisher_lists(rows: DataFrame, registry: DataFrame, key: str = "evidence_id") -> DataFrame:
    """(key, publishers): the distinct publisher names behind each row, sorted, comma-joined.

    Names are made distinct before they are gathered, so a list is as long as its
    row has publishers.
    """
    named = rows.where("registry_id IS NOT NULL").join(registry.select("registry_id", "publisher"), "registry_id")
    return (named.select(key, "publisher").distinct().groupBy(key)
            .agg(F.array_join(F.array_sort(F.collect_list("publisher")), ", ").alias("publishers")))
