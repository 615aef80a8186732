"""Re-filing evidence under topics: propose, review, apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora.functions import text


def refile_plan(evidence: DataFrame, placements: DataFrame, topics: DataFrame) -> DataFrame:
    """Action per live evidence row.

    ``evidence(evidence_id, pillar, topic_id, claim)``, ``placements(evidence_id,
    proposed, hook, reason)``, ``topics(topic_id, pillar)`` live.  A missing or
    invalid proposal goes to REVIEW, NONE archives, a hook that is not in the
    claim goes to REVIEW, the same topic is kept, anything else is refiled; the
    pillar follows the topic.
    """
    live = topics.select(F.col("topic_id").alias("proposed"), F.col("pillar").alias("new_pillar"))
    p = placements.withColumn("proposed", text.strip(F.col("proposed")))
    out = evidence.join(p, "evidence_id", "left").join(live, "proposed", "left")
    valid = (F.col("proposed") == "NONE") | F.col("new_pillar").isNotNull()
    none = F.col("proposed") == "NONE"
    hooked = text.hook_in_claim(F.col("hook"), F.col("claim"))
    action = (F.when(~F.coalesce(valid, F.lit(False)), "REVIEW").when(none, "archive").when(~hooked, "REVIEW")
              .when(F.col("proposed") == F.col("topic_id"), "keep").otherwise("refile"))
    reason = (F.when(~F.coalesce(valid, F.lit(False)), "no valid proposal after a retry").when(none, F.col("reason"))
              .when(~hooked, F.concat(F.lit("hook '"), F.coalesce("hook", F.lit("")), F.lit("' is not in the claim — "), F.col("reason")))
              .otherwise(F.col("reason")))
    named = F.coalesce(valid, F.lit(False)) & ~none
    return out.select("evidence_id", action.alias("action"), F.col("pillar").alias("old_pillar"),
                      F.col("topic_id").alias("old_topic"), F.coalesce("new_pillar", F.lit("")).alias("new_pillar"),
                      F.when(named, F.col("proposed")).otherwise("").alias("new_topic"), reason.alias("reason"))


def apply_plan(evidence: DataFrame, plan: DataFrame, topics: DataFrame, now) -> DataFrame:
    """Evidence after a reviewed plan, with ``applied``: what was done to each row."""
    live = topics.select(F.col("topic_id").alias("new_topic"), F.col("pillar").alias("live_pillar"))
    rows = (plan.select("evidence_id", text.strip(F.col("action")).alias("action"),
                        text.strip(F.col("new_topic")).alias("new_topic"), "reason").join(live, "new_topic", "left"))
    out = evidence.join(rows, "evidence_id", "left")
    move = (F.col("action") == "refile") & F.col("live_pillar").isNotNull()
    retire = F.col("action") == "archive"
    applied = (F.when(F.col("action").isNull(), F.lit(None)).when(move, "refile").when(retire, "archive")
               .when(F.col("action") == "keep", "keep").otherwise("skipped"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (out.withColumn("applied", applied)
            .withColumn("topic_id", F.when(yes(move), F.col("new_topic")).otherwise(F.col("topic_id")))
            .withColumn("pillar", F.when(yes(move), F.col("live_pillar")).otherwise(F.col("pillar")))
            .withColumn("archived_on", F.when(yes(retire), now).otherwise(F.col("archived_on")))
            .withColumn("archived_reason", F.when(yes(retire), F.concat(F.lit("no link — "), F.col("reason"))))
            .drop("action", "new_topic", "reason", "live_pillar"))


def plan_summary(plan: DataFrame, topics: DataFrame) -> DataFrame:
    """(part, name, n): rows per action, rows per topic after applying (zeros
    included), and archived rows by old pillar."""
    acts = plan.groupBy(F.col("action").alias("name")).agg(F.count("*").alias("n")).withColumn("part", F.lit("action"))
    after = plan.where("action IN ('keep', 'refile')").groupBy("new_topic").agg(F.count("*").alias("n"))
    per = (topics.select(F.col("topic_id").alias("name")).join(after.withColumnRenamed("new_topic", "name"), "name", "left")
           .na.fill(0, ["n"]).withColumn("part", F.lit("topic")))
    gone = (plan.where("action = 'archive'").groupBy(F.col("old_pillar").alias("name")).agg(F.count("*").alias("n"))
            .withColumn("part", F.lit("archived")))
    return acts.unionByName(per).unionByName(gone).select("part", "name", "n")
