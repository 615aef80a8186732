"""The strategy layer: drivers, cross impacts, scenarios, implications, options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrobora import vocab
from corrobora.functions import rules, text


def admit_by_refs(proposals: DataFrame, refs: DataFrame, valid: DataFrame, minimum: int,
                  rule: str) -> DataFrame:
    """Refuse proposals with fewer than ``minimum`` distinct known references.

    ``refs(proposal_id, ref)``, ``valid(ref)``.  Used for drivers (trends),
    scenarios (uncertainties), opportunities and options (anchors).
    """
    n = (refs.select("proposal_id", "ref").distinct().join(valid.select("ref"), "ref", "left_semi")
         .groupBy("proposal_id").agg(F.count("*").alias("n_refs")))
    return (proposals.join(n, "proposal_id", "left").na.fill(0, ["n_refs"])
            .withColumn("raised_by", F.when(F.col("n_refs") < minimum, rule)))


def distinct_scenarios(counted: DataFrame) -> DataFrame:
    """Refuse a scenario whose slug an earlier admitted one of its scope has taken.

    The reference count is judged first; the earliest position per slug is a
    combined ``min``, joined back, so no group is gathered in one task.
    """
    named = counted.withColumn("slug", text.slug(F.col("name")))
    first = (named.where("raised_by IS NULL").groupBy("scope", "slug").agg(F.min("pos").alias("first_pos")))
    out = named.join(first, ["scope", "slug"], "left")
    late = F.col("raised_by").isNull() & (F.col("pos") > F.col("first_pos"))
    horizon = F.when(F.col("horizon").isin(*vocab.HORIZONS), F.col("horizon")).otherwise("H3_5")
    return (out.withColumn("raised_by", F.when(late, "scenario_distinctness").otherwise(F.col("raised_by")))
            .withColumn("horizon", horizon).drop("first_pos"))


def cross_impacts(proposals: DataFrame, trends: DataFrame) -> DataFrame:
    """Severity of trend pairs; unknown or identical ends are refused.

    ``trends(trend_id, strength)``; a trend without strength counts as WEAK.
    """
    a = trends.select(F.col("trend_id").alias("from_trend"), F.col("strength").alias("sa"), F.lit(True).alias("ka"))
    b = trends.select(F.col("trend_id").alias("to_trend"), F.col("strength").alias("sb"), F.lit(True).alias("kb"))
    out = proposals.join(a, "from_trend", "left").join(b, "to_trend", "left")
    bad = F.col("ka").isNull() | F.col("kb").isNull() | (F.col("from_trend") == F.col("to_trend"))
    severity = rules.cross_impact_severity(F.col("sa"), F.col("sb"))
    return (out.withColumn("raised_by", F.when(bad, "cross_impact_admission"))
            .withColumn("severity", F.when(~bad, severity)).drop("sa", "sb", "ka", "kb"))


def admit_implications(proposals: DataFrame, findings: DataFrame) -> DataFrame:
    """The actor must be a known authority, then the finding must be admitted."""
    known = findings.select("finding_id").withColumn("known", F.lit(True))
    actor = F.upper(text.strip(F.coalesce("actor", F.lit(""))))
    out = proposals.withColumn("actor", actor).join(known, "finding_id", "left")
    rule = (F.when(~F.col("actor").isin(*vocab.ACTORS), "implication_actor")
            .when(F.col("known").isNull(), "implication_admission"))
    return out.withColumn("raised_by", rule).drop("known")


def fallback_rows(behind: DataFrame, evidence: DataFrame, owners: DataFrame, key: str,
                  n: int = 3) -> DataFrame:
    """Evidence of owners; an owner with none gets the first ``n`` ids of its ``key``.

    The ranking keeps only ``n`` rows per key from each task before it shuffles
    (rank-limit pushdown), so a hot key is never gathered whole.
    """
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy(key).orderBy("evidence_id"))
    first = evidence.select(key, "evidence_id").withColumn("rk", rank).where(F.col("rk") <= n).drop("rk")
    without = owners.join(behind.select("owner_id"), "owner_id", "left_anti")
    return behind.unionByName(without.join(first, key).select("owner_id", "evidence_id"))


def admit_options(counted: DataFrame) -> DataFrame:
    """One option per (scope, letter): the last admitted proposal wins."""
    letter = F.left(F.upper(text.strip(F.coalesce("letter", F.lit("")))), F.lit(1))
    kept = counted.where("raised_by IS NULL").withColumn("letter", F.when(letter == "", "X").otherwise(letter))
    best = F.max_by(F.struct("proposal_id", "name"), F.col("pos"))
    return (kept.groupBy("scope", "letter").agg(best.alias("b"))
            .select("scope", F.concat(F.lit("OPT-"), F.col("letter")).alias("option_id"), "b.proposal_id", "b.name"))


def _prefixes(slug: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.least(F.length(slug), F.lit(12))),
                       lambda n: F.left(slug, n))


def match_scenarios(names: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``names(name_id, scope, name)`` to the scenario they mean.

    An equal slug wins; else the earliest scenario for which one slug begins
    with the other's first twelve characters.  Prefixes are exploded, so both
    arms of the prefix test are equi-joins.  Names with one slug mean the same, so a
    slug of a scope is matched once.
    """
    want = names.withColumn("slug", text.slug(F.col("name")))
    kept = scenarios.select("scope", "slug", "pos", "scenario_id")
    slugs = want.select("scope", "slug").distinct()
    exact = kept.groupBy("scope", "slug").agg(F.max_by("scenario_id", "pos").alias("exact_id"))
    short = lambda c: F.left(c, F.lit(12))
    # The earliest scenario per prefix is settled before the join, so a short
    # name meets one row per prefix instead of every scenario it opens.
    first = lambda df: df.groupBy("scope", "p").agg(F.min(F.struct("pos", "scenario_id")).alias("b"))
    by_key = first(kept.withColumn("p", short(F.col("slug"))))
    by_key_prefix = first(kept.withColumn("p", F.explode(_prefixes(F.col("slug")))))
    # An exploded side is larger than its estimate, which would have it broadcast.
    opened = slugs.withColumn("p", F.explode(_prefixes(F.col("slug")))).hint("merge")
    hits = (opened.join(by_key, ["scope", "p"]).select("scope", "slug", "b")
            .unionByName(slugs.withColumn("p", short(F.col("slug"))).join(by_key_prefix, ["scope", "p"]).select("scope", "slug", "b")))
    loose = hits.groupBy("scope", "slug").agg(F.min("b").alias("b")).select("scope", "slug", F.col("b.scenario_id").alias("loose_id"))
    found = exact.join(loose, ["scope", "slug"], "full_outer").select("scope", "slug", F.coalesce("exact_id", "loose_id").alias("scenario_id"))
    return want.join(found, ["scope", "slug"], "left").select("name_id", "scope", "name", "scenario_id")


def stress_cells(tests: DataFrame, options: DataFrame) -> DataFrame:
    """Cells of the stress matrix: resolved, with a valid result, last one wins.

    ``tests(scope, option_letter, scenario_id, result, pos)``.
    """
    letter = F.left(F.upper(text.strip(F.coalesce("option_letter", F.lit("")))), F.lit(1))
    named = tests.withColumn("option_id", F.concat(F.lit("OPT-"), letter))
    ok = (named.where(F.col("scenario_id").isNotNull() & F.col("result").isin(*vocab.ROBUSTNESS))
          .join(options.select("scope", "option_id"), ["scope", "option_id"], "left_semi"))
    return ok.groupBy("scope", "option_id", "scenario_id").agg(F.max_by("result", "pos").alias("result"))


def missing_cells(options: DataFrame, scenarios: DataFrame, cells: DataFrame) -> DataFrame:
    """Option/scenario pairs of a scope that no cell covers (equi-join on scope)."""
    wanted = options.select("scope", "option_id").join(scenarios.select("scope", "scenario_id"), "scope")
    return wanted.join(cells.select("scope", "option_id", "scenario_id"),
                       ["scope", "option_id", "scenario_id"], "left_anti")


def stress_completeness(options: DataFrame, scenarios: DataFrame, cells: DataFrame) -> DataFrame:
    """(scope, option_id, missing, complete): one row per option, with the scenarios of its scope that no cell covers.

    The difference of two sets, so no (option, scenario) pair is made; a scope's scenarios
    are a short list, and an option's cells are combined before they move.
    """
    key = ["scope", "option_id"]
    listed = scenarios.where("scenario_id IS NOT NULL").groupBy("scope").agg(F.collect_set("scenario_id").alias("wanted"))
    covered = cells.where("scenario_id IS NOT NULL").groupBy(*key).agg(F.collect_set("scenario_id").alias("covered"))
    out = options.select(*key).distinct().join(listed, "scope", "left").join(covered, key, "left")
    none = F.array().cast("array<string>")
    missing = F.array_sort(F.array_except(F.coalesce(F.col("wanted").cast("array<string>"), none), F.coalesce(F.col("covered").cast("array<string>"), none)))
    return out.select(*key, missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def working_hypothesis(cells: DataFrame) -> DataFrame:
    """Per scope the option robust in most scenarios; ties go to the smallest id."""
    tally = cells.groupBy("scope", "option_id").agg(F.count_if(F.col("result") == "ROBUST").alias("robust"))
    best = F.min_by(F.struct("option_id", "robust"), F.struct(-F.col("robust"), F.col("option_id")))
    return tally.groupBy("scope").agg(best.alias("b")).select("scope", "b.option_id", "b.robust")


def observable_thresholds(indicators: DataFrame) -> DataFrame:
    """Indicators with the refusal for thresholds nobody could see crossed."""
    return indicators.withColumn("raised_by", F.when(
        ~text.is_observable(F.col("threshold")), "indicator_threshold"))
