"""Citations over time: what an id said when a report was issued, and what it says now."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.functions import audit as A


def cited_in_prose(reports: DataFrame) -> DataFrame:
    """(report_id, cited_id) of ids in the prose, the reference list left out."""
    return reports.select("report_id", F.explode(A.prose_ids(F.col("body_md"))).alias("cited_id"))


def resolved_objects(evidence: DataFrame, evidence_sources: DataFrame, documents: DataFrame,
                     registry: DataFrame, others: DataFrame) -> DataFrame:
    """One row per citable object: text, quote, class, and its first source.

    ``evidence(evidence_id, cited_id, text, quote, class)``; ``others(cited_id,
    kind, text)`` are findings, signals, risks and so on.  The first source is
    the one with the smallest document id.
    """
    first = evidence_sources.groupBy("evidence_id").agg(F.min("document_id").alias("document_id"))
    docs = documents.select("document_id", "registry_id", "url", "title")
    pubs = registry.select("registry_id", "publisher", "tier")
    ev = (evidence.join(first, "evidence_id", "left").join(docs, "document_id", "left").join(pubs, "registry_id", "left")
          .select("cited_id", F.lit("evidence").alias("kind"), "text", "quote", "class", "publisher", "tier", "url"))
    return ev.unionByName(others.select("cited_id", "kind", "text"), allowMissingColumns=True)


def freeze(reports: DataFrame, objects: DataFrame) -> DataFrame:
    """Typed citation rows of each report as the graph stands now.

    Ids the graph lacks have no row; freezing twice gives the same rows.
    """
    return cited_in_prose(reports).join(objects, "cited_id")


def unfrozen(reports: DataFrame, frozen: DataFrame) -> DataFrame:
    """Reports without any frozen row."""
    return reports.join(frozen.select("report_id").distinct(), "report_id", "left_anti")


def current_citations(cited: DataFrame, frozen: DataFrame, objects: DataFrame) -> DataFrame:
    """Each cited id as frozen, or as live only where no frozen row exists."""
    f = frozen.select("report_id", "cited_id", F.col("text").alias("ft"), F.lit(True).alias("is_frozen"))
    live = objects.select("cited_id", F.col("text").alias("lt"))
    out = cited.join(f, ["report_id", "cited_id"], "left").join(live, "cited_id", "left")
    origin = F.when(F.col("is_frozen"), "frozen").when(F.col("lt").isNotNull(), "live").otherwise("missing")
    text = F.when(F.col("is_frozen"), F.col("ft")).otherwise(F.col("lt"))
    return out.select("report_id", "cited_id", text.alias("text"), origin.alias("origin"))


def citation_numbers(reports: DataFrame) -> DataFrame:
    """Numbers of cited ids by first appearance; row-local, since a report is a row."""
    from corrobora import vocab
    groups = F.regexp_extract_all("body_md", F.lit(vocab.CITATION_GROUP), F.lit(1))
    ids = F.array_distinct(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[;,]\s*"))))
    return reports.select("report_id", F.posexplode(ids).alias("at", "cited_id")) \
        .select("report_id", "cited_id", (F.col("at") + 1).alias("number"))


def reference_lines(cited: DataFrame, evidence_sources: DataFrame, documents: DataFrame,
                    registry: DataFrame) -> DataFrame:
    """One reference per (report, document) with every cited id drawn from it.

    ``cited(report_id, evidence_id, cited_id)``.  A list is bounded by its
    report; ``first_id`` orders the references of a report.
    """
    docs = documents.join(registry.select("registry_id", "publisher"), "registry_id", "left")
    per = (cited.join(evidence_sources, "evidence_id").groupBy("report_id", "document_id")
           .agg(F.array_sort(F.collect_set("cited_id")).alias("ids")))
    date = F.when(F.col("published_on").isNotNull(), F.concat(F.lit(", "), F.col("published_on").cast("string"))).otherwise("")
    line = F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("] "), F.col("title"), F.lit(" — "),
                    F.coalesce("publisher", F.lit("")), date, F.lit(". "), F.col("url"))
    return per.join(docs, "document_id").select("report_id", F.element_at("ids", 1).alias("first_id"), "url", line.alias("line"))


def existing_graph(evidence: DataFrame, signal_evidence: DataFrame, links: DataFrame) -> DataFrame:
    """(signal_id, finding_id): signals touching the given evidence and their findings."""
    touched = signal_evidence.join(evidence.select("evidence_id"), "evidence_id", "left_semi").select("signal_id").distinct()
    found = links.where("from_type = 'signal' AND to_type = 'finding'") \
        .select(F.col("from_id").alias("signal_id"), F.col("to_id").alias("finding_id"))
    return touched.join(found, "signal_id", "left")
