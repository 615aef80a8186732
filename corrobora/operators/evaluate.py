"""Evaluation against a human benchmark: registers, recall, text metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrobora import vocab
from corrobora.functions import audit as A, rules, text


def pattern_registers(lines: DataFrame, minimum: int = 4) -> DataFrame:
    """(source, kind, id, text) of the id schemes found in benchmark lines.

    ``lines(source, line_no, line)``.  First mention of an id wins; a source with
    fewer than ``minimum`` items has no scheme and yields nothing.
    """
    found = []
    for kind, pattern in vocab.REGISTER_PATTERNS.items():
        item = F.regexp_extract("line", pattern, 1)
        body = text.strip(F.regexp_extract("line", pattern, 2))
        found.append(F.when(item != "", F.struct(F.lit(kind).alias("kind"), item.alias("id"), body.alias("text"))))
    rows = lines.select("source", "line_no", F.inline(F.array_compact(F.array(*found))))
    first = rows.groupBy("source", "kind", "id").agg(F.min_by("text", "line_no").alias("text"))
    enough = first.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= minimum)
    return first.join(enough.select("source"), "source", "left_semi")


def chain_completeness(findings: DataFrame, links: DataFrame, signal_evidence: DataFrame, key: str) -> DataFrame:
    """Findings with an evidence -> signal -> finding path, per ``key``; rate in thousandths."""
    alive = signal_evidence.select(F.col("signal_id").alias("from_id")).distinct()
    whole = (links.where("from_type = 'signal' AND to_type = 'finding'").join(alive, "from_id", "left_semi")
             .select(F.col("to_id").alias("finding_id")).distinct().withColumn("whole", F.lit(True)))
    out = findings.join(whole, "finding_id", "left").groupBy(key).agg(
        F.count("*").alias("findings"), F.count_if(F.coalesce("whole", F.lit(False))).alias("complete"))
    return out.withColumn("rate_milli", rules.ratio(F.col("complete"), F.col("findings"), 1000))


def recall(matches: DataFrame, pillar: str) -> DataFrame:
    """Totals, in-scope items and matches per register; recall null without scope.

    ``matches(kind, domain, matched)``.
    """
    scope = F.col("domain").isin(pillar, "CROSS_CUTTING")
    out = matches.groupBy("kind").agg(
        F.count("*").alias("total"), F.count_if(scope).alias("in_scope"),
        F.count_if(scope & F.col("matched")).alias("in_scope_matched"), F.count_if("matched").alias("matched"))
    return out.withColumn("recall_milli", F.when(F.col("in_scope") > 0, rules.ratio(
        F.col("in_scope_matched"), F.col("in_scope"), 1000)))


def text_metrics(sentences: DataFrame, key: str, citation: str = vocab.OBJECT_REF) -> DataFrame:
    """Sentence, word and citation counts per text, with the two headline rates.

    The unsourced rule here is the simple one: no exemption for statements about
    the document or for conditions.  Rates are integers: citations per 10,000
    words and unsourced per thousand sentences, rounded half to even.
    """
    s = F.col("sentence")
    words = F.size(F.filter(F.split(text.squash(s), " "), lambda w: w != ""))
    cited = F.rlike(s, F.lit(citation))
    base = sentences.select(key, words.alias("w"), cited.alias("c"), A.is_unsourced(s, cited, simple=True).alias("u"))
    out = base.groupBy(key).agg(F.count("*").alias("sentences"), F.sum("w").alias("words"),
                                F.count_if("c").alias("cited"), F.count_if("u").alias("unsourced"))
    return (out.withColumn("cites_per_10k", rules.ratio(F.col("cited"), F.greatest("words", F.lit(1)), 10000))
            .withColumn("unsourced_milli", rules.ratio(F.col("unsourced"), F.greatest("sentences", F.lit(1)), 1000)))


def report_stats(reports: DataFrame, objects: DataFrame) -> DataFrame:
    """Sentences, cited sentences, and the evidence, publishers and tier-1 rows cited.

    ``objects(cited_id, kind, publisher, tier)``.  Headings and the reference
    section are no prose.
    """
    prose = F.filter(A.section_blocks(F.col("body_md")), lambda b: b["title"].isNotNull()
                     & (F.lower(F.regexp_replace(b["title"], "[^A-Za-z0-9]+", "-")) != "references"))
    joined = F.array_join(F.transform(prose, lambda b: b["text"]), "\n")
    lines = F.split(F.regexp_replace(joined, "\n+", " "), r"(?<=[.!?])\s+(?=[A-Z])")
    kept = F.filter(lines, lambda s: F.length(text.strip(s)) > 20)
    base = reports.select("report_id", joined.alias("prose"), kept.alias("s"))
    base = base.select("report_id", F.size("s").alias("sentences"),
                       F.size(F.filter("s", lambda x: F.rlike(x, F.lit(vocab.PROSE_ID)))).alias("cited"),
                       F.array_distinct(F.regexp_extract_all("prose", F.lit(vocab.PROSE_ID), F.lit(1))).alias("ids"))
    hits = (base.select("report_id", F.explode("ids").alias("cited_id")).join(objects.where("kind = 'evidence'"), "cited_id")
            .groupBy("report_id", "publisher").agg(F.count("*").alias("n"), F.count_if(F.col("tier") == 1).alias("t1")))
    agg = hits.groupBy("report_id").agg(F.sum("n").alias("evidence"), F.count("publisher").alias("publishers"),
                                        F.sum("t1").alias("tier1"))
    return (base.drop("ids").join(agg, "report_id", "left").na.fill(0, ["evidence", "publishers", "tier1"]))


def novel_items(ours: DataFrame, matches: DataFrame) -> DataFrame:
    """Our items that no benchmark item matched."""
    used = matches.where(F.col("matched") & F.col("our_id").isNotNull()).select(F.col("our_id").alias("id"))
    return ours.join(used, "id", "left_anti")


def benchmark_sentences(lines: DataFrame) -> DataFrame:
    """Benchmark lines that count as sentences: over 40 characters, no bullet."""
    return lines.where((F.length("line") > 40) & ~F.startswith("line", F.lit("•")))


def scoped_rows(rows: DataFrame, links: DataFrame, section: Column | str) -> DataFrame:
    """Rows linked to a section; every row, flagged unscoped, when it has no links.

    Whether links exist is a scalar subquery over the (filtered) link table.
    """
    mine = links.where((F.col("from_type") == "report_section") & (F.col("from_id") == section)).select(
        F.col("to_id").alias("id")).distinct()
    n = mine.agg(F.count("*")).scalar()
    hit = rows.join(mine.withColumn("linked", F.lit(True)), "id", "left")
    scoped = n > 0
    return (hit.withColumn("scoped", scoped).where(~F.col("scoped") | F.col("linked").isNotNull()).drop("linked"))
