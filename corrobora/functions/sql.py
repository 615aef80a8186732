"""The rules and the topic tree as SQL functions, for users who write queries as text.

The text of a rule function is generated from the rule's Column expression, so each
rule is written down once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from corrobora.functions import rules

# Name, parameters as SQL writes them, and the rule.
_RULES: tuple[tuple[str, str, Callable[..., Column]], ...] = (
    ("evidence_class", "best_tier INT, publishers BIGINT", rules.evidence_class),
    ("evidence_confidence", "best_tier INT, publishers BIGINT", rules.evidence_confidence),
    ("signal_strength", "publishers BIGINT, best_tier INT", rules.signal_strength),
    ("forced_direction", "publishers BIGINT, best_tier INT", rules.forced_direction),
    ("clamp_direction", "direction STRING", rules.clamp_direction),
    ("gate_satisfied", "n_rows BIGINT, publishers BIGINT", rules.gate_satisfied),
    ("gate_state", "satisfied BOOLEAN, existing STRING", rules.gate_state),
    ("risk_band", "n BIGINT, two BIGINT, three BIGINT", rules.three_band),
    ("likelihood", "strong_rows BIGINT", rules.likelihood),
    ("impact", "topics BIGINT", rules.impact),
    ("cross_impact_severity", "a_strength STRING, b_strength STRING", rules.cross_impact_severity),
    ("strength_points", "strength STRING", rules.strength_points),
    ("horizon_penalty", "horizon STRING", rules.horizon_penalty),
    ("calibrate", "base_points BIGINT, publishers BIGINT, horizon STRING, uncertainties BIGINT", rules.calibrate),
    ("readiness", "evidence BIGINT, publishers BIGINT, live_signals BIGINT", rules.readiness),
    ("label", "value STRING", rules.label),
)


def rule_text(spark: SparkSession, parameters: str, rule: Callable[..., Column]) -> tuple[str, str]:
    """(SQL type, SQL text) of a rule over the given parameters."""
    names = [p.split()[0] for p in parameters.split(", ")]
    rows = spark.createDataFrame([], parameters).select(rule(*[F.col(n) for n in names]).alias("value"))
    body = rows._jdf.queryExecution().analyzed().expressions().head().child().sql()
    return rows.schema["value"].dataType.simpleString(), body


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions of all rules; returns their names."""
    for name, parameters, rule in _RULES:
        kind, body = rule_text(spark, parameters, rule)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [name for name, _, _ in _RULES]


def register_tree_functions(spark: SparkSession, nodes: str, topics: str, deepest: int = 90) -> list[str]:
    """Create table functions over two views: ``subtree(root)``, ``node_topics(node)`` and ``path_to_root(node)``.

    ``nodes(node_id, parent_id, kind)``, ``topics(topic_id, node_id, functions, retired)``.  They may stand
    behind LATERAL, with a column as argument.  The tree is climbed by a recursive
    query of at most ``deepest`` levels, so a circle ends there; ``graph.closure`` has no such bound.
    """
    below = f"""below(root_id, node_id, kind, depth) AS (
        SELECT node_id, node_id, kind, 0 FROM {nodes}
        UNION ALL
        SELECT b.root_id, n.node_id, n.kind, b.depth + 1 FROM below b JOIN {nodes} n ON n.parent_id = b.node_id WHERE b.depth < {deepest})"""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION subtree(root STRING) RETURNS TABLE(node_id STRING, kind STRING, depth INT) RETURN
        WITH RECURSIVE {below} SELECT node_id, kind, min(depth) FROM below WHERE root_id = subtree.root GROUP BY node_id, kind""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION path_to_root(node STRING) RETURNS TABLE(node_id STRING, distance INT) RETURN
        WITH RECURSIVE {below} SELECT root_id, min(depth) FROM below WHERE node_id = path_to_root.node GROUP BY root_id""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION node_topics(node STRING) RETURNS TABLE(topic_id STRING, via STRING) RETURN
        WITH RECURSIVE {below},
        reached AS (SELECT b.root_id, t.topic_id, 'home' AS via FROM below b JOIN {topics} t ON t.node_id = b.node_id WHERE NOT t.retired
                    UNION ALL
                    SELECT b.root_id, u.topic_id, 'link' FROM below b
                    JOIN (SELECT topic_id, explode(functions) AS node_id FROM {topics} WHERE NOT retired) u ON u.node_id = b.node_id
                    WHERE b.kind = 'function')
        SELECT topic_id, min(via) FROM reached WHERE root_id = node_topics.node GROUP BY topic_id""")
    return ["subtree", "path_to_root", "node_topics"]
