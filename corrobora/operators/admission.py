"""Admission: proposed rows join the graph, or are refused with a named rule.

Proposals of every scope are decided at once.  References come in long form,
``refs(scope, proposal_id, pos, ref)``; :func:`explode_refs` makes it from an
array column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrobora import vocab
from corrobora.functions import rules, text
from corrobora.operators.provenance import publishers_of


def explode_refs(proposals: DataFrame, column: str = "refs") -> DataFrame:
    """Long form of an array of references, with their positions."""
    return proposals.select("scope", "proposal_id", F.posexplode(column).alias("pos", "ref"))


def lookup_forms(admitted: DataFrame, existing: DataFrame) -> DataFrame:
    """``(scope, form, target)``: every text an object may be referred to by.

    ``admitted(scope, target, key, statement)`` are objects of this run: id, key
    and statement.  ``existing(scope, target, statement)`` answer to id,
    statement and statement without its final dots, and win over the former.
    """
    def forms(df: DataFrame, rank: int, *columns: Column) -> DataFrame:
        texts = F.array_distinct(F.array_compact(F.array(*columns)))
        return df.select("scope", "target", F.explode(texts).alias("form"), F.lit(rank).alias("rank"))

    target = F.col("target").cast("string")
    new = forms(admitted, 1, target, text.strip(F.col("key")), F.col("statement"))
    old = forms(existing, 2, target, F.col("statement"), _undotted(F.col("statement")))
    return (new.unionByName(old).groupBy("scope", "form")
            .agg(F.max_by("target", F.struct("rank", "target")).alias("target")))


def _undotted(ref: Column) -> Column:
    return F.regexp_replace(text.strip(ref), r"\.+$", "")


def resolve_refs(refs: DataFrame, lookup: DataFrame) -> DataFrame:
    """(scope, proposal_id, target, pos): resolved references, each target once.

    A reference matches a form exactly, or else without surrounding blanks and
    final dots.  Two equi-joins; unresolved references drop out.
    """
    exact = lookup.select("scope", F.col("form").alias("ref"), F.col("target").alias("t1"))
    loose = lookup.select("scope", F.col("form").alias("bare"), F.col("target").alias("t2"))
    hit = (refs.withColumn("bare", _undotted(F.col("ref")))
           .join(exact, ["scope", "ref"], "left").join(loose, ["scope", "bare"], "left")
           .withColumn("target", F.coalesce("t1", "t2")).where("target IS NOT NULL"))
    return hit.groupBy("scope", "proposal_id", "target").agg(F.min("pos").alias("pos"))


def known_refs(refs: DataFrame, valid: DataFrame, column: str) -> DataFrame:
    """Distinct references that exist: ``valid`` holds ``column``, and scope if given."""
    on = [c for c in ("scope", column) if c in valid.columns]
    return (refs.withColumnRenamed("ref", column).join(valid.select(*on), on, "left_semi")
            .groupBy("scope", "proposal_id", column).agg(F.min("pos").alias("pos")))


def admit_signals(proposals: DataFrame, refs: DataFrame, valid_evidence: DataFrame,
                  rows: DataFrame) -> DataFrame:
    """Evidence rows and publishers behind each proposed signal, and the refusal.

    ``reason`` is null for an admitted proposal: at least two known evidence
    rows from at least two independent publishers.
    """
    cited = known_refs(refs, valid_evidence, "evidence_id")
    n_rows = cited.groupBy("proposal_id").agg(F.count("*").alias("n_rows"))
    pubs = publishers_of(cited.join(publishers_of(rows, "evidence_id"), "evidence_id"), "proposal_id") \
        .groupBy("proposal_id").agg(F.count("*").alias("publishers"))
    out = (proposals.join(n_rows, "proposal_id", "left").join(pubs, "proposal_id", "left")
           .na.fill(0, ["n_rows", "publishers"]))
    n, p = F.col("n_rows"), F.col("publishers")
    reason = (F.when(n < vocab.MIN_EVIDENCE_PER_SIGNAL,
                     F.format_string("only %d evidence row(s)", n))
              .when(p < vocab.MIN_PUBLISHERS_PER_SIGNAL,
                    F.format_string("only %d independent publisher(s) behind %d evidence rows", p, n)))
    return out.withColumn("reason", reason)


def admit_trends(proposals: DataFrame, resolved: DataFrame) -> DataFrame:
    """A trend needs one admitted signal; its direction is clamped to the domain."""
    n = resolved.groupBy("proposal_id").agg(F.count("*").alias("signals"))
    return (proposals.join(n, "proposal_id", "left").na.fill(0, ["signals"])
            .withColumn("direction", rules.clamp_direction(F.col("direction")))
            .withColumn("raised_by", F.when(F.col("signals") < 1, "trend_admission")))


def admit_findings(proposals: DataFrame, resolved: DataFrame, signal_evidence: DataFrame,
                   classes: DataFrame) -> DataFrame:
    """Findings in rule order: a signal behind it, substance, an A/B row behind it.

    ``resolved`` targets are signal ids.  ``raised_by`` is the first rule that
    refuses, null when admitted; ``why`` is its reason.
    """
    n = resolved.groupBy("proposal_id").agg(F.count("*").alias("signals"))
    strong_signal = (signal_evidence.join(classes.where(F.col("class").isin(*vocab.STRONG_CLASSES))
                                          .select("evidence_id"), "evidence_id", "left_semi")
                     .select(F.col("signal_id").alias("target")).distinct())
    strong = (resolved.join(strong_signal, "target", "left_semi").select("proposal_id").distinct()
              .withColumn("strong", F.lit(True)))
    out = proposals.join(n, "proposal_id", "left").join(strong, "proposal_id", "left") \
        .na.fill(0, ["signals"])
    out = out.withColumn("thin", text.platitude(F.col("statement")))
    thin = F.col("thin")
    why = (F.when(F.col("signals") < 1, "no admitted signal behind it")
           .when(thin != "", thin)
           .when(F.col("strong").isNull(), "rests only on Class C/D evidence — a hypothesis, not a finding"))
    rule = (F.when(F.col("signals") < 1, "finding_admission")
            .when(thin != "", "finding_substance")
            .when(F.col("strong").isNull(), "finding_class"))
    return out.withColumn("raised_by", rule).withColumn("why", why).drop("strong", "thin")


def evidence_behind(owner_edges: DataFrame, finding_signals: DataFrame,
                    signal_evidence: DataFrame) -> DataFrame:
    """Distinct (owner_id, evidence_id) along finding -> signal -> evidence."""
    return (owner_edges.select("owner_id", "finding_id").distinct()
            .join(finding_signals.select("finding_id", "signal_id"), "finding_id")
            .select("owner_id", "signal_id").distinct()
            .join(signal_evidence.select("signal_id", "evidence_id"), "signal_id")
            .select("owner_id", "evidence_id").distinct())


def band_scores(behind: DataFrame, evidence: DataFrame) -> DataFrame:
    """Likelihood, impact and score of each owner from the evidence behind it.

    ``evidence`` carries class and topic.  Rows combine per (owner, topic) first,
    so the distinct-topic count adds no second shuffle of evidence rows.
    """
    per_topic = (behind.join(evidence.select("evidence_id", "class", "topic_id"), "evidence_id", "left")
                 .groupBy("owner_id", "topic_id")
                 .agg(F.count_if(F.col("class").isin(*vocab.STRONG_CLASSES)).alias("strong")))
    agg = per_topic.groupBy("owner_id").agg(F.sum("strong").alias("strong_rows"),
                                            F.count("topic_id").alias("topics"))
    out = agg.withColumn("likelihood", rules.likelihood(F.col("strong_rows"))) \
        .withColumn("impact", rules.impact(F.col("topics")))
    return out.withColumn("score", F.col("likelihood") * F.col("impact"))


def gap_rows(refused: DataFrame, pillar: Column, gap: Column, rule: Column, cap: int | None = None) -> DataFrame:
    """Refusals in the shape of the gap ledger."""
    return refused.select(pillar.alias("pillar"), (gap if cap is None else F.left(gap, F.lit(cap))).alias("gap"),
                          rule.alias("raised_by"))
