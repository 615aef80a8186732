"""Forecasts: who stands behind a projection, how far to trust it, whether to admit it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corrobora import vocab
from corrobora.functions import rules, text
from corrobora.operators.provenance import publishers_of


def publishers_behind(signals_of: DataFrame, evidence_of: DataFrame, signal_evidence: DataFrame,
                      rows: DataFrame) -> DataFrame:
    """Distinct publishers behind each forecast: its signals' evidence and its own.

    Archived evidence counts here, unlike in signal strength.
    """
    via = signals_of.select("forecast_id", "signal_id").join(
        signal_evidence.select("signal_id", "evidence_id"), "signal_id").select("forecast_id", "evidence_id")
    behind = via.unionByName(evidence_of.select("forecast_id", "evidence_id")).distinct()
    return (publishers_of(behind.join(publishers_of(rows, "evidence_id"), "evidence_id"), "forecast_id")
            .groupBy("forecast_id").agg(F.count("*").alias("publishers")))


def calibrate(forecasts: DataFrame, signals_of: DataFrame, signals: DataFrame,
              publishers: DataFrame, uncertainties_of: DataFrame) -> DataFrame:
    """Plausibility band and confidence of each forecast, with the points behind them."""
    strengths = (signals_of.select("forecast_id", "signal_id").distinct()
                 .join(signals.select("signal_id", "strength"), "signal_id", "left")
                 .groupBy("forecast_id").agg(
                     F.max(rules.strength_points(F.col("strength"))).alias("base"),
                     F.array_sort(F.collect_set(F.coalesce("strength", F.lit("WEAK")))).alias("strengths")))
    unc = uncertainties_of.groupBy("forecast_id").agg(
        F.count_distinct("uncertainty_id").alias("uncertainties"))
    out = (forecasts.join(strengths, "forecast_id", "left").join(publishers, "forecast_id", "left")
           .join(unc, "forecast_id", "left").na.fill(0, ["publishers", "uncertainties"]))
    basis = rules.calibrate(F.col("base"), F.col("publishers"), F.col("horizon"), F.col("uncertainties"))
    return (out.withColumn("basis", basis).select("*", "basis.*").drop("basis", "base"))


def admit_forecasts(proposals: DataFrame, verdicts: DataFrame, signals_of: DataFrame,
                    open_gates: DataFrame) -> DataFrame:
    """First rule that refuses a forecast, null when it is admitted.

    ``proposals(forecast_id, scope, statement, falsifier, horizon, env_layer)``;
    ``verdicts(forecast_id, follows, probability)`` may lack rows: a missing
    verdict passes and is flagged ``ungated``.  ``open_gates(scope)``.
    """
    n = signals_of.groupBy("forecast_id").agg(F.count_distinct("signal_id").alias("n_signals"))
    gate = open_gates.select("scope").distinct().withColumn("gate_open", F.lit(True))
    out = (proposals.join(verdicts.select("forecast_id", "follows", "probability"), "forecast_id", "left")
           .join(n, "forecast_id", "left").join(gate, "scope", "left"))
    layer = F.when(F.col("env_layer").isin(*vocab.ENV_LAYERS), F.col("env_layer")).otherwise("GLOBAL")
    refused = F.col("probability").isNotNull() & (
        ~F.col("follows") | (F.col("probability") < vocab.FORECAST_SUPPORT_THRESHOLD))
    horizon_ok = F.coalesce(F.col("horizon"), F.lit("")).isin(*vocab.HORIZONS)
    rule = (F.when(refused, "inference")
            .when(F.coalesce("n_signals", F.lit(0)) < 1, "no_signal")
            .when(text.has_placeholder(F.col("statement")) | text.has_placeholder(F.col("falsifier")),
                  "placeholder")
            .when(~horizon_ok, "horizon")
            .when((layer == "UAE") & F.col("gate_open").isNotNull(), "gate_open"))
    return (out.withColumn("refused_by", rule).withColumn("env_layer", layer)
            .withColumn("ungated", F.col("probability").isNull())
            .drop("follows", "n_signals", "gate_open"))
