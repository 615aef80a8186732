"""Queries on provenance, the rule engine and dirty checks."""

from pyspark.sql import functions as F

from corrobora.operators import provenance as P
from corrobora.plans.registry import query

# Publishers and best tier per evidence, in plain SQL.
PROV = """prov AS (
  SELECT evidence_id, count(DISTINCT registry_id) AS publishers, min(tier) AS best_tier
  FROM evidence_sources LEFT JOIN graph_docs USING (document_id) LEFT JOIN registry USING (registry_id)
  GROUP BY evidence_id)"""
CLASSES = PROV + """, classes AS (
  SELECT e.evidence_id, coalesce(publishers, 0) AS publishers,
         CASE WHEN best_tier = 1 THEN 'A' WHEN publishers >= 2 THEN 'B' ELSE 'C' END AS class,
         CASE WHEN best_tier = 1 THEN 'HIGH' WHEN publishers >= 2 THEN 'MEDIUM_HIGH'
              WHEN best_tier <= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM live_evidence e LEFT JOIN prov USING (evidence_id))"""


def rows(t):
    return P.provenance_rows(t.evidence_sources, t.graph_docs, t.registry)


def classes(t):
    return P.classify_evidence(t.live_evidence, rows(t))


@query("a1_projected_scan", "SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber")


@query("c1_live_filter", "SELECT evidence_id, topic_id FROM evidence WHERE NOT archived")
def _(t):
    return t.evidence.where(~F.col("archived")).select("evidence_id", "topic_id")


@query("d1_provenance_rows", """
SELECT evidence_id, document_id, registry_id, tier
FROM evidence_sources LEFT JOIN graph_docs USING (document_id) LEFT JOIN registry USING (registry_id)""")
def _(t):
    return rows(t).select("evidence_id", "document_id", "registry_id", "tier")


@query("d2_document_reference", """
SELECT document_id, url, title, registry_id, publisher, tier
FROM graph_docs LEFT JOIN registry USING (registry_id)""")
def _(t):
    return P.document_reference(t.graph_docs, t.registry).select(
        "document_id", "url", "title", "registry_id", "publisher", "tier")


@query("e1_provenance", """
SELECT evidence_id, count(DISTINCT document_id) AS documents, count(DISTINCT registry_id) AS publishers,
       min(tier) AS best_tier,
       array_to_string(list_sort(list(DISTINCT tier) FILTER (tier IS NOT NULL)), ',') AS tiers
FROM evidence_sources LEFT JOIN graph_docs USING (document_id) LEFT JOIN registry USING (registry_id)
GROUP BY evidence_id""")
def _(t):
    out = P.provenance_detail(rows(t), "evidence_id")
    return out.withColumn("tiers", F.nullif(F.array_join("tiers", ","), F.lit("")))


@query("e2_evidence_class", f"WITH {CLASSES} SELECT * FROM classes")
def _(t):
    return classes(t)


@query("e3_signal_strength", f"""
WITH pubs AS (
  SELECT DISTINCT signal_id, registry_id, tier
  FROM signal_evidence JOIN live_evidence USING (evidence_id, signal_id) JOIN evidence_sources USING (evidence_id)
  JOIN graph_docs USING (document_id) JOIN registry USING (registry_id)),
agg AS (SELECT signal_id, count(*) AS n, min(tier) AS best FROM pubs GROUP BY 1)
SELECT signal_id, coalesce(n, 0) AS publishers, best AS best_tier,
       CASE WHEN n >= 3 THEN 'STRONG' WHEN n = 2 AND best = 1 THEN 'STRONG_EMERGING'
            WHEN n = 2 THEN 'EMERGING' ELSE 'WEAK' END AS strength
FROM signals LEFT JOIN agg USING (signal_id)""")
def _(t):
    return P.score_signals(t.signals, t.signal_evidence, t.live_evidence, rows(t)).select(
        "signal_id", "publishers", "best_tier", "strength")


@query("e4_forced_direction", """
WITH pubs AS (
  SELECT DISTINCT s.signal_id, registry_id, tier
  FROM signal_evidence s JOIN live_evidence USING (evidence_id) JOIN evidence_sources USING (evidence_id)
  JOIN graph_docs USING (document_id) JOIN registry USING (registry_id)),
agg AS (SELECT signal_id, count(*) AS n, min(tier) AS best FROM pubs GROUP BY 1)
SELECT signal_id, CASE WHEN n <= 1 AND best >= 4 THEN 'UNCERTAIN' ELSE direction END AS direction,
       CASE WHEN n <= 1 AND best >= 4 THEN 'UNCERTAIN' END AS forced_direction
FROM signals LEFT JOIN agg USING (signal_id)""")
def _(t):
    return P.score_signals(t.signals, t.signal_evidence, t.live_evidence, rows(t)).select(
        "signal_id", "direction", "forced_direction")


# The stored gate of a customer before this run: some open, some passed, some absent.
EXISTING = """(SELECT c_custkey AS scope, CASE WHEN c_custkey % 3 = 0 THEN 'OPEN' ELSE 'PASSED' END AS status
 FROM customer WHERE c_acctbal > 0)"""


@query("e5_inference_gates", f"""
WITH {CLASSES},
nat AS (SELECT evidence_id, scope FROM live_evidence JOIN classes USING (evidence_id)
        WHERE env_layer = 'UAE' AND classes.class IN ('A', 'B')),
r AS (SELECT scope, count(*) AS n FROM nat GROUP BY 1),
p AS (SELECT scope, count(DISTINCT registry_id) AS p FROM nat JOIN evidence_sources USING (evidence_id)
      JOIN graph_docs USING (document_id) GROUP BY 1),
j AS (SELECT c_custkey AS scope, coalesce(n, 0) AS n_rows, coalesce(p, 0) AS publishers, x.status AS was
      FROM customer LEFT JOIN r ON c_custkey = r.scope LEFT JOIN p ON c_custkey = p.scope
      LEFT JOIN {EXISTING} x ON c_custkey = x.scope),
s AS (SELECT *, CASE WHEN NOT (n_rows >= 2 AND publishers >= 2) THEN 'OPEN' WHEN was = 'OPEN' THEN 'PASSED' ELSE was END AS status FROM j)
SELECT * FROM s WHERE status IS NOT NULL""")
def _(t):
    existing = t.sql(f"SELECT * FROM {EXISTING}")
    spine = t.customer.select(F.col("c_custkey").alias("scope"))
    return P.inference_gates(t.live_evidence, classes(t), rows(t), spine, existing, key="scope")


# Indicators watch the signals of one customer each.
INDICATORS = """SELECT c_custkey AS indicator_id,
 CASE WHEN c_acctbal < 0 THEN 'FIRED' ELSE 'WATCHING' END AS status FROM customer"""
MONITORS = """SELECT DISTINCT scope AS from_id, signal_id AS to_id,
 CASE WHEN segment = 'BUILDING' THEN 'feeds' ELSE 'monitors' END AS rel FROM evidence"""


@query("e6_indicator_trigger", f"""
WITH i AS ({INDICATORS}), m AS ({MONITORS})
SELECT indicator_id, CASE WHEN i.status = 'WATCHING' AND EXISTS (
   SELECT 1 FROM m JOIN signals s ON s.signal_id = m.to_id
   WHERE m.from_id = i.indicator_id AND m.rel = 'monitors' AND s.strength IN ('STRONG_EMERGING', 'STRONG'))
   THEN 'THRESHOLD_MET' ELSE i.status END AS status FROM i""")
def _(t):
    return P.trigger_indicators(t.sql(INDICATORS), t.sql(MONITORS), t.signals).select("indicator_id", "status")


@query("b6_changed_rows", f"""
WITH {CLASSES}
SELECT e.evidence_id, e.class AS old_class, e.confidence AS old_confidence, c.class, c.confidence
FROM live_evidence e JOIN classes c USING (evidence_id)
WHERE e.class IS DISTINCT FROM c.class OR e.confidence IS DISTINCT FROM c.confidence""")
def _(t):
    return P.changed_rows(t.live_evidence, classes(t), "evidence_id", ["class", "confidence"])


@query("i_publisher_list", """
SELECT evidence_id, string_agg(DISTINCT publisher, ', ' ORDER BY publisher) AS publishers
FROM evidence_sources JOIN graph_docs USING (document_id) JOIN registry USING (registry_id) GROUP BY 1""")
def _(t):
    return P.publisher_lists(rows(t).select("evidence_id", "registry_id"), t.registry)
