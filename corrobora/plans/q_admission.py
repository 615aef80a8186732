"""Queries on admission, forecasts, strategy and identifiers."""

from pyspark.sql import functions as F

from corrobora import vocab
from corrobora.operators import admission as A, forecast as FC, ids, strategy as S
from corrobora.operators.provenance import publishers_of
from corrobora.plans.q_provenance import CLASSES, classes, rows
from corrobora.plans.registry import query
from corrobora.plans.views import view

# --- proposals derived from the tables ---------------------------------------------
# A signal is proposed from all orders of one customer and priority, with some
# ids that do not exist.
view("signal_refs", """
SELECT scope, signal_id AS proposal_id, evidence_id AS pos,
       CASE WHEN length(segment) = 8 AND nation_key % 5 = 0 THEN -evidence_id ELSE evidence_id END AS ref FROM evidence
""")
view("signal_texts", """
SELECT scope, signal_id, statement, CASE CAST(substr(signal_id, length(CAST(scope AS STRING)) + 2, 1) AS INT)
         WHEN 1 THEN signal_id WHEN 2 THEN statement WHEN 3 THEN concat(' ', statement, '. ')
         WHEN 4 THEN concat('unknown ', signal_id) ELSE concat('S', CAST(scope AS STRING)) END AS ref,
       CAST(substr(signal_id, length(CAST(scope AS STRING)) + 2, 1) AS INT) AS pos
FROM signals
""")
view("finding_proposals", """
SELECT concat('FP-', CAST(scope AS STRING)) AS proposal_id, scope, pillar, direction,
       concat(CASE scope % 8 WHEN 0 THEN 'Coverage is increasingly important for '
                WHEN 1 THEN 'Forces should invest in ' WHEN 2 THEN 'Spoofing outpaces mitigations near '
                WHEN 3 THEN 'Delivery means that ' WHEN 4 THEN 'Lock-in shifts away from '
                WHEN 5 THEN 'There is news on ' WHEN 6 THEN 'Supply cannot cover ' ELSE 'Demand erodes ' END, statement) AS statement
FROM (SELECT scope, min(pillar) AS pillar, min(statement) AS statement,
             CASE scope % 4 WHEN 0 THEN 'STRENGTHENING' WHEN 1 THEN 'UNCERTAIN' WHEN 2 THEN 'SIDEWAYS' ELSE NULL END AS direction
      FROM signals GROUP BY scope) s
""")


def signal_lookup(t):
    texts = t.signal_texts
    admitted = texts.where("pos = 5").select(
        "scope", F.col("signal_id").alias("target"), F.col("ref").alias("key"), "statement")
    existing = texts.where("pos <> 5").select("scope", F.col("signal_id").alias("target"), "statement")
    return A.lookup_forms(admitted, existing)


def finding_refs(t):
    return t.signal_texts.select("scope", F.concat(F.lit("FP-"), F.col("scope").cast("string")).alias("proposal_id"), "pos", "ref")


def resolved_signals(t):
    return A.resolve_refs(finding_refs(t), signal_lookup(t))


RESOLVED = """resolved AS (
  SELECT concat('FP-', CAST(scope AS STRING)) AS proposal_id, scope, signal_id AS target, pos FROM signal_texts WHERE pos <> 4)"""


@query("d7_resolve_references", f"WITH {RESOLVED} SELECT proposal_id, target, pos FROM resolved")
def _(t):
    return resolved_signals(t).select("proposal_id", "target", "pos")


@query("e7_signal_admission", """
WITH c AS (SELECT DISTINCT proposal_id, ref AS evidence_id FROM signal_refs WHERE ref IN (SELECT evidence_id FROM live_evidence)),
a AS (SELECT proposal_id, count(DISTINCT c.evidence_id) AS n, count(DISTINCT registry_id) AS p
      FROM c LEFT JOIN evidence_sources USING (evidence_id) LEFT JOIN graph_docs USING (document_id) GROUP BY 1)
SELECT s.signal_id AS proposal_id, coalesce(n, 0) AS n_rows, coalesce(p, 0) AS publishers,
       CASE WHEN coalesce(n, 0) < 2 THEN format('only {} evidence row(s)', coalesce(n, 0))
            WHEN p < 2 THEN format('only {} independent publisher(s) behind {} evidence rows', p, n) END AS reason
FROM signals s LEFT JOIN a ON a.proposal_id = s.signal_id""")
def _(t):
    proposals = t.signals.select(F.col("signal_id").alias("proposal_id"))
    return A.admit_signals(proposals, t.signal_refs, t.live_evidence.select("evidence_id"), rows(t)) \
        .select("proposal_id", "n_rows", "publishers", "reason")


@query("e8_trend_admission", f"""
WITH {RESOLVED}, n AS (SELECT proposal_id, count(*) AS signals FROM resolved WHERE pos > 2 GROUP BY 1)
SELECT p.proposal_id, coalesce(signals, 0) AS signals,
       CASE WHEN direction IN ('STRENGTHENING', 'UNCERTAIN', 'WEAKENING') THEN direction ELSE 'UNCERTAIN' END AS direction,
       CASE WHEN signals IS NULL THEN 'trend_admission' END AS raised_by
FROM finding_proposals p LEFT JOIN n USING (proposal_id)""")
def _(t):
    late = A.resolve_refs(finding_refs(t).where("pos > 2"), signal_lookup(t))
    return A.admit_trends(t.finding_proposals, late).select("proposal_id", "signals", "direction", "raised_by")


BOOST = r"(?i)\b(is|are|remains?|becomes?|be)\s+(increasingly\s+|a\s+|an\s+)?(critical|crucial|essential|important|vital|pivotal|key|necessary|paramount|priority|imperative)\b"
VAGUE = r"(?i)\b(must|should)\s+(prioriti[sz]e|enhance|improve|strengthen|adopt|embrace|focus on|invest in|consider)\b"
DISC = (r"(?i)\b(more|less|rather than|instead of|not merely|not only|beyond|outpaces?|faster than|slower than|outstrips?|exceeds?|"
        r"because|therefore|so that|drives?|causes?|creates?|compresses?|reduces?|enables?|weakens?|undermines?|erodes?|shifts?|displaces?|"
        r"in its own right|is actually|amounts? to|means? that|becom\w+|determinant|enabler|bottleneck|constraint|prerequisite|"
        r"precondition|centre of gravity|center of gravity|cannot|will not|no longer|ceases? to|fails? to|"
        r"insufficient|inadequate|not enough|leaves? \w+ exposed|only)\b|\bnot\s+(\w+\s+){0,4}alone\b")
# The lookahead of the last marker, decomposed: what follows the *last* such
# phrase holds no booster.  Without a line break in between this is the same.
MUST = r"(?i)\b(must|should)\s+be\s+"
BOOSTED = r"(?i)\b(critical|essential|important|priority)\b"


def platitude_sql(c: str) -> str:
    tail = f"regexp_extract({c}, '(?is)^.*\\b(?:must|should)\\s+be\\s+(.*)$', 1)"
    return f"""CASE WHEN regexp_matches({c}, '{BOOST}') THEN 'asserts that something is important rather than what is true'
 WHEN regexp_matches({c}, '{VAGUE}') THEN 'is a generic recommendation, not an analytical conclusion'
 WHEN NOT (regexp_matches({c}, '{DISC}') OR (regexp_matches({c}, '{MUST}') AND NOT regexp_matches({tail}, '{BOOSTED}')))
 THEN 'makes no discriminating claim — it does not say X rather than Y, X causes Y, or X is actually Z' ELSE '' END"""


@query("c11_platitude", f"SELECT proposal_id, {platitude_sql('statement')} AS why FROM statements")
def _(t):
    from corrobora.functions.text import platitude
    return t.statements.select("proposal_id", platitude(F.col("statement")).alias("why"))


FINDINGS = f"""{CLASSES}, {RESOLVED},
n AS (SELECT proposal_id, count(*) AS signals FROM resolved GROUP BY 1),
st AS (SELECT DISTINCT proposal_id FROM resolved JOIN signal_evidence s ON s.signal_id = target JOIN classes USING (evidence_id)
       WHERE classes.class IN ('A', 'B')),
f AS (SELECT p.proposal_id, p.pillar, p.scope, p.statement, coalesce(signals, 0) AS signals,
  CASE WHEN signals IS NULL THEN 'no admitted signal behind it' WHEN {platitude_sql('statement')} <> '' THEN {platitude_sql('statement')}
       WHEN st.proposal_id IS NULL THEN 'rests only on Class C/D evidence — a hypothesis, not a finding' END AS why,
  CASE WHEN signals IS NULL THEN 'finding_admission' WHEN {platitude_sql('statement')} <> '' THEN 'finding_substance'
       WHEN st.proposal_id IS NULL THEN 'finding_class' END AS raised_by
  FROM finding_proposals p LEFT JOIN n USING (proposal_id) LEFT JOIN st USING (proposal_id))"""


def findings(t):
    return A.admit_findings(t.finding_proposals, resolved_signals(t), t.signal_evidence, classes(t))


@query("e9_finding_admission", f"WITH {FINDINGS} SELECT proposal_id, signals, raised_by, why FROM f")
def _(t):
    return findings(t).select("proposal_id", "signals", "raised_by", "why")


GAPS = """gaps AS (SELECT pillar, concat('Finding rejected — ', why, ': ', statement) AS gap, raised_by
  FROM f WHERE raised_by IS NOT NULL)"""


def gap_ledger(t):
    refused = findings(t).where("raised_by IS NOT NULL")
    return A.gap_rows(refused, F.col("pillar"), F.concat(
        F.lit("Finding rejected — "), F.col("why"), F.lit(": "), F.col("statement")), F.col("raised_by"))


@query("b3_gap_rows", f"WITH {FINDINGS}, {GAPS} SELECT pillar, gap, raised_by FROM gaps")
def _(t):
    return gap_ledger(t)


@query("e30_refusals_by_rule", f"""
WITH {FINDINGS}, {GAPS}, r AS (SELECT raised_by, count(*) AS n, min(gap) AS sample FROM gaps GROUP BY 1)
SELECT *, 'synthesize' AS stage FROM r""")
def _(t):
    from corrobora.operators.readiness import refusals_by_rule
    return refusals_by_rule(gap_ledger(t))


RISK_EDGES = """SELECT DISTINCT concat('R-', CAST(CASE WHEN scope % 4 = 0 THEN scope - 1 ELSE scope END AS STRING)) AS owner_id,
  concat('F-', CAST(scope AS STRING)) AS finding_id FROM evidence WHERE segment <> 'FURNITURE' OR env_layer = 'UAE'"""
FINDING_SIGNALS = "SELECT from_id AS signal_id, to_id AS finding_id FROM links WHERE to_type = 'finding'"


def _scores_sql(edges: str) -> str:
    return f"""WITH {CLASSES}, oe AS ({edges}), fs AS ({FINDING_SIGNALS}),
b AS (SELECT DISTINCT owner_id, evidence_id FROM oe JOIN fs USING (finding_id) JOIN signal_evidence USING (signal_id)),
a AS (SELECT owner_id, count(*) FILTER (c.class IN ('A', 'B')) AS strong_rows, count(DISTINCT e.topic_id) AS topics
      FROM b LEFT JOIN live_evidence e USING (evidence_id) LEFT JOIN classes c USING (evidence_id) GROUP BY 1),
s AS (SELECT *, CASE WHEN strong_rows >= 2 THEN 3 WHEN strong_rows = 1 THEN 2 ELSE 1 END AS likelihood,
             CASE WHEN topics >= 3 THEN 3 WHEN topics = 2 THEN 2 ELSE 1 END AS impact FROM a)
SELECT *, likelihood * impact AS score FROM s"""


def classed_evidence(t):
    return t.live_evidence.drop("class").join(classes(t).select("evidence_id", "class"), "evidence_id")


@query("e10_risk_scores", _scores_sql(RISK_EDGES))
def _(t):
    behind = A.evidence_behind(t.sql(RISK_EDGES), t.sql(FINDING_SIGNALS), t.signal_evidence)
    return A.band_scores(behind, classed_evidence(t))


OPPORTUNITIES = """SELECT DISTINCT concat('O-', CAST(scope AS STRING)) AS owner_id,
  CASE WHEN nation_key % 4 = 0 THEN 'F-none' ELSE concat('F-', CAST(scope AS STRING)) END AS finding_id, segment FROM evidence"""


@query("e11_opportunity_scores", f"""WITH {CLASSES}, oe AS ({OPPORTUNITIES}), fs AS ({FINDING_SIGNALS}),
b AS (SELECT DISTINCT owner_id, evidence_id FROM oe JOIN fs USING (finding_id) JOIN signal_evidence USING (signal_id)),
first3 AS (SELECT segment, evidence_id FROM live_evidence QUALIFY row_number() OVER (PARTITION BY segment ORDER BY evidence_id) <= 3),
b2 AS (SELECT * FROM b UNION ALL SELECT owner_id, evidence_id FROM (SELECT DISTINCT owner_id, segment FROM oe) JOIN first3 USING (segment)
       WHERE owner_id NOT IN (SELECT owner_id FROM b)),
a AS (SELECT owner_id, count(*) FILTER (c.class IN ('A', 'B')) AS strong_rows, count(DISTINCT e.topic_id) AS topics
      FROM b2 LEFT JOIN live_evidence e USING (evidence_id) LEFT JOIN classes c USING (evidence_id) GROUP BY 1),
s AS (SELECT *, CASE WHEN strong_rows >= 2 THEN 3 WHEN strong_rows = 1 THEN 2 ELSE 1 END AS attractiveness,
             CASE WHEN topics >= 3 THEN 3 WHEN topics = 2 THEN 2 ELSE 1 END AS feasibility FROM a)
SELECT *, attractiveness * feasibility AS score FROM s""")
def _(t):
    edges = t.sql(OPPORTUNITIES)
    behind = A.evidence_behind(edges, t.sql(FINDING_SIGNALS), t.signal_evidence)
    full = S.fallback_rows(behind, t.live_evidence, edges.select("owner_id", "segment").distinct(), "segment")
    return (A.band_scores(full, classed_evidence(t))
            .withColumnsRenamed({"likelihood": "attractiveness", "impact": "feasibility"}))


# --- forecasts --------------------------------------------------------------------------
view("forecasts", """
SELECT concat('FC-', CAST(scope AS STRING)) AS forecast_id, scope, pillar,
       CASE scope % 6 WHEN 0 THEN 'H0_3' WHEN 1 THEN 'H3_5' WHEN 2 THEN 'H5_10' WHEN 3 THEN 'H7_PLUS' WHEN 4 THEN 'H0_3' ELSE 'SOON' END AS horizon,
       CASE scope % 5 WHEN 0 THEN 'UAE' WHEN 1 THEN 'REGIONAL' WHEN 2 THEN 'ORBIT' ELSE 'GLOBAL' END AS env_layer,
       concat(CASE scope % 9 WHEN 0 THEN 'By [Year], ' WHEN 1 THEN 'With [SIG-CS-04], ' WHEN 2 THEN 'Some <n> of ' ELSE '' END, statement) AS statement,
       CASE WHEN scope % 13 = 0 THEN 'TBD' ELSE 'No delivery by 2027' END AS falsifier
FROM (SELECT scope, min(pillar) AS pillar, min(statement) AS statement FROM signals GROUP BY scope) s
""")
FC_SIGNALS = """SELECT concat('FC-', CAST(scope AS STRING)) AS forecast_id, signal_id FROM signals WHERE direction <> 'UNCERTAIN' OR scope % 7 > 0"""
FC_EVIDENCE = """SELECT concat('FC-', CAST(scope AS STRING)) AS forecast_id, evidence_id FROM evidence WHERE env_layer = 'UAE'"""
FC_UNCERTAIN = """SELECT concat('FC-', CAST(scope AS STRING)) AS forecast_id, evidence_id AS uncertainty_id FROM evidence WHERE confidence = 'HIGH'"""
VERDICTS = """SELECT concat('FC-', CAST(c_custkey AS STRING)) AS forecast_id, c_custkey % 10 <> 3 AS follows,
  CAST(50 + c_custkey % 50 AS DOUBLE) / 100 AS probability FROM customer WHERE c_acctbal > 1000"""

BEHIND = f"""fsig AS ({FC_SIGNALS}), fev AS ({FC_EVIDENCE}),
behind AS (SELECT forecast_id, evidence_id FROM fsig JOIN signal_evidence USING (signal_id) UNION SELECT forecast_id, evidence_id FROM fev),
pubs AS (SELECT forecast_id, count(DISTINCT registry_id) AS publishers FROM behind JOIN evidence_sources USING (evidence_id)
         JOIN graph_docs USING (document_id) GROUP BY 1)"""


def behind(t):
    return FC.publishers_behind(t.sql(FC_SIGNALS), t.sql(FC_EVIDENCE), t.signal_evidence, rows(t))


@query("f6_publishers_behind_forecast", f"WITH {BEHIND} SELECT forecast_id, publishers FROM pubs WHERE publishers > 0")
def _(t):
    return behind(t)


@query("j2_union_distinct_evidence", f"WITH {BEHIND} SELECT forecast_id, evidence_id FROM behind")
def _(t):
    via = t.sql(FC_SIGNALS).join(t.signal_evidence, "signal_id").select("forecast_id", "evidence_id")
    return via.unionByName(t.sql(FC_EVIDENCE)).distinct()


@query("e19_forecast_calibration", f"""
WITH {BEHIND}, st AS (SELECT forecast_id, max(CASE strength WHEN 'STRONG' THEN 3 WHEN 'STRONG_EMERGING' THEN 2 WHEN 'EMERGING' THEN 1 ELSE 0 END) AS b,
   array_to_string(list_sort(list(DISTINCT strength)), '+') AS strengths FROM fsig JOIN signals USING (signal_id) GROUP BY 1),
u AS (SELECT forecast_id, count(DISTINCT uncertainty_id) AS u FROM ({FC_UNCERTAIN}) GROUP BY 1),
j AS (SELECT forecast_id, coalesce(publishers, 0) AS publishers, coalesce(strengths, '') AS strengths, coalesce(b, 0) AS signal_points,
   CASE WHEN publishers >= 3 THEN 2 WHEN publishers = 2 THEN 1 ELSE 0 END AS publisher_points,
   CASE horizon WHEN 'H0_3' THEN 0 WHEN 'H3_5' THEN -1 WHEN 'H5_10' THEN -2 WHEN 'H7_PLUS' THEN -3 ELSE -2 END AS horizon_penalty,
   -least(coalesce(u, 0), 2) AS uncertainty_penalty
   FROM forecasts LEFT JOIN st USING (forecast_id) LEFT JOIN pubs USING (forecast_id) LEFT JOIN u USING (forecast_id)),
s AS (SELECT *, signal_points + publisher_points + horizon_penalty + uncertainty_penalty AS score FROM j)
SELECT *, CASE WHEN score >= 4 THEN 'LIKELY' WHEN score >= 2 THEN 'POSSIBLE' WHEN score >= 1 THEN 'UNCERTAIN' ELSE 'SPECULATIVE' END AS plausibility,
  CASE WHEN score >= 4 AND publishers >= 3 AND signal_points >= 3 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM_HIGH'
       WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s""")
def _(t):
    out = FC.calibrate(t.forecasts, t.sql(FC_SIGNALS), t.signals, behind(t), t.sql(FC_UNCERTAIN))
    return out.select("forecast_id", "publishers", F.coalesce(F.array_join("strengths", "+"), F.lit("")).alias("strengths"),
                      "signal_points", "publisher_points", "horizon_penalty", "uncertainty_penalty", "score",
                      "plausibility", "confidence")


OPEN_SCOPES = "SELECT c_custkey AS scope FROM customer WHERE c_mktsegment <> 'BUILDING'"


def placeholder_sql(c: str) -> str:
    cleaned = rf"regexp_replace({c}, '(?i)\[(EV|SIG|F|R|FC|FIG|TR|CU)-', '(', 'g')"
    return rf"regexp_matches({cleaned}, '(?i)(\[[^\]]{{0,24}}\]|<[^>]{{0,24}}>|\{{[^}}]{{0,24}}\}}|\bTBD\b|\bN/?A\b|\bXX+\b|\bYYYY\b|\binsert\b)')"


@query("e20_forecast_admission", f"""
WITH v AS ({VERDICTS}), n AS (SELECT DISTINCT forecast_id FROM ({FC_SIGNALS})), o AS ({OPEN_SCOPES})
SELECT f.forecast_id, v.probability IS NULL AS ungated,
  CASE WHEN env_layer IN ('UAE', 'REGIONAL', 'GLOBAL') THEN env_layer ELSE 'GLOBAL' END AS env_layer,
  CASE WHEN v.probability IS NOT NULL AND (NOT v.follows OR v.probability < 0.7) THEN 'inference'
       WHEN n.forecast_id IS NULL THEN 'no_signal'
       WHEN {placeholder_sql('statement')} OR {placeholder_sql('falsifier')} THEN 'placeholder'
       WHEN horizon NOT IN ('H0_3', 'H3_5', 'H5_10', 'H7_PLUS') THEN 'horizon'
       WHEN env_layer = 'UAE' AND scope IN (SELECT scope FROM o) THEN 'gate_open' END AS refused_by
FROM forecasts f LEFT JOIN v USING (forecast_id) LEFT JOIN n USING (forecast_id)""")
def _(t):
    return FC.admit_forecasts(t.forecasts, t.sql(VERDICTS), t.sql(FC_SIGNALS), t.sql(OPEN_SCOPES)) \
        .select("forecast_id", "ungated", "env_layer", "refused_by")


@query("c12_placeholder", f"SELECT proposal_id, {placeholder_sql('statement')} AS placeholder FROM statements")
def _(t):
    from corrobora.functions.text import has_placeholder
    return t.statements.select("proposal_id", has_placeholder(F.col("statement")).alias("placeholder"))


@query("g3_forecasts_by_horizon", """
SELECT forecast_id, horizon FROM forecasts ORDER BY coalesce(horizon, ''), forecast_id LIMIT 30""")
def _(t):
    return t.forecasts.orderBy(F.coalesce("horizon", F.lit("")), "forecast_id").limit(30).select("forecast_id", "horizon")


# --- strategy -----------------------------------------------------------------------------
TRENDS = "SELECT DISTINCT concat('TR-', CAST(nation_key AS STRING), '-', segment) AS ref FROM evidence WHERE NOT archived AND env_layer = 'UAE'"
DRIVERS = "SELECT c_custkey AS proposal_id, c_name AS name FROM customer"
DRIVER_REFS = """SELECT c_custkey AS proposal_id, concat('TR-', CAST(c_nationkey AS STRING), '-', c_mktsegment) AS ref FROM customer
UNION ALL SELECT c_custkey, concat('TR-', CAST((c_nationkey + c_custkey % 3) % 27 AS STRING), '-', c_mktsegment) FROM customer
UNION ALL SELECT c_custkey, concat('TR-', CAST(c_custkey % 40 AS STRING), '-', 'BUILDING') FROM customer WHERE c_acctbal > 5000"""


@query("e13_driver_admission", f"""
WITH r AS (SELECT DISTINCT proposal_id, ref FROM ({DRIVER_REFS}) WHERE ref IN ({TRENDS})), n AS (SELECT proposal_id, count(*) AS n FROM r GROUP BY 1)
SELECT proposal_id, coalesce(n, 0) AS n_refs, CASE WHEN coalesce(n, 0) < 2 THEN 'driver_admission' END AS raised_by
FROM ({DRIVERS}) LEFT JOIN n USING (proposal_id)""")
def _(t):
    return S.admit_by_refs(t.sql(DRIVERS), t.sql(DRIVER_REFS), t.sql(TRENDS), 2, "driver_admission").drop("name")


TREND_STRENGTH = """SELECT ref AS trend_id, CASE length(ref) % 4 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'STRONG_EMERGING' WHEN 2 THEN NULL ELSE 'WEAK' END AS strength
FROM (SELECT DISTINCT concat('TR-', CAST(nation_key AS STRING), '-', segment) AS ref FROM evidence WHERE nation_key < 23) x"""
CROSS = """SELECT c_custkey AS proposal_id, concat('TR-', CAST(c_nationkey AS STRING), '-', c_mktsegment) AS from_trend,
 concat('TR-', CAST((c_nationkey + c_custkey % 4) % 26 AS STRING), '-', CASE WHEN c_acctbal > 3000 THEN 'BUILDING' ELSE c_mktsegment END) AS to_trend FROM customer"""


@query("e12_cross_impact_severity", f"""
WITH t AS ({TREND_STRENGTH}), c AS ({CROSS}),
r AS (SELECT trend_id, CASE strength WHEN 'STRONG' THEN 3 WHEN 'STRONG_EMERGING' THEN 2 WHEN 'EMERGING' THEN 2 ELSE 1 END AS r FROM t)
SELECT proposal_id, from_trend, to_trend,
  CASE WHEN a.r IS NULL OR b.r IS NULL OR from_trend = to_trend THEN 'cross_impact_admission' END AS raised_by,
  CASE WHEN a.r IS NOT NULL AND b.r IS NOT NULL AND from_trend <> to_trend THEN greatest(1, least(3, (a.r + b.r) // 2)) END AS severity
FROM c LEFT JOIN r a ON a.trend_id = from_trend LEFT JOIN r b ON b.trend_id = to_trend""")
def _(t):
    return S.cross_impacts(t.sql(CROSS), t.sql(TREND_STRENGTH))


view("scenario_proposals", """
SELECT p_partkey AS proposal_id, p_partkey AS pos, p_brand AS scope, concat(p_name, ' -- ', p_type) AS name,
       CASE p_size % 5 WHEN 0 THEN 'H0_3' WHEN 1 THEN 'H3_5' WHEN 2 THEN 'LATER' ELSE 'H5_10' END AS horizon FROM part
""")
# Large lines refer to uncertainties that do not exist.
SCENARIO_REFS = """SELECT l_partkey AS proposal_id, CASE WHEN l_quantity < 8 THEN l_suppkey ELSE -l_suppkey END AS ref FROM lineitem"""
UNCERTAINTIES = "SELECT s_suppkey AS ref FROM supplier WHERE s_acctbal > 2000"
SLUG = "coalesce(nullif(left(trim(regexp_replace(upper(name), '[^A-Z0-9]+', '-', 'g'), '-'), 28), ''), 'X')"
SCENARIOS = f"""r AS (SELECT DISTINCT proposal_id, ref FROM ({SCENARIO_REFS}) WHERE ref IN ({UNCERTAINTIES})),
n AS (SELECT proposal_id, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT p.*, coalesce(n, 0) AS n_refs, {SLUG} AS slug FROM scenario_proposals p LEFT JOIN n USING (proposal_id)),
sc AS (SELECT proposal_id, scope, pos, slug, name, n_refs, CASE WHEN horizon IN ('H0_3', 'H3_5', 'H5_10', 'H7_PLUS') THEN horizon ELSE 'H3_5' END AS horizon,
  CASE WHEN n_refs < 2 THEN 'scenario_admission' WHEN row_number() OVER (PARTITION BY scope, slug, n_refs >= 2 ORDER BY pos) > 1 THEN 'scenario_distinctness' END AS raised_by FROM c)"""


def scenarios(t):
    counted = S.admit_by_refs(t.scenario_proposals, t.sql(SCENARIO_REFS), t.sql(UNCERTAINTIES), 2, "scenario_admission")
    return S.distinct_scenarios(counted)


@query("e14_scenario_admission", f"WITH {SCENARIOS} SELECT proposal_id, slug, n_refs, horizon, raised_by FROM sc")
def _(t):
    return scenarios(t).select("proposal_id", "slug", "n_refs", "horizon", "raised_by")


IMPLICATIONS = """SELECT o_orderkey AS proposal_id, concat('F-', CAST(CASE WHEN o_orderkey % 6 = 0 THEN -o_custkey ELSE o_custkey END AS STRING)) AS finding_id,
 CASE o_orderkey % 5 WHEN 0 THEN 'MoD ' WHEN 1 THEN 'tawazun' WHEN 2 THEN 'MOD' WHEN 3 THEN NULL ELSE 'Navy' END AS actor FROM orders"""


@query("e15_implication_admission", f"""
SELECT proposal_id, upper(trim(coalesce(actor, ''))) AS actor,
  CASE WHEN upper(trim(coalesce(actor, ''))) NOT IN ('MOD', 'TAWAZUN') THEN 'implication_actor'
       WHEN finding_id NOT IN (SELECT finding_id FROM findings) THEN 'implication_admission' END AS raised_by FROM ({IMPLICATIONS})""")
def _(t):
    return S.admit_implications(t.sql(IMPLICATIONS), t.findings).select("proposal_id", "actor", "raised_by")


OPTIONS = """SELECT o_orderkey AS proposal_id, o_orderkey AS pos, o_custkey AS scope,
 CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(' ', lower(o_orderstatus), 'x') END AS letter, o_orderpriority AS name FROM orders"""
OPTION_REFS = """SELECT l_orderkey AS proposal_id, CASE WHEN l_returnflag = 'A' THEN l_suppkey ELSE -l_suppkey END AS ref FROM lineitem"""
OPTIONS_CTE = f"""o AS ({OPTIONS}), okay AS (SELECT DISTINCT proposal_id FROM ({OPTION_REFS}) WHERE ref IN ({UNCERTAINTIES})),
kept AS (SELECT scope, coalesce(nullif(left(upper(trim(letter)), 1), ''), 'X') AS l, proposal_id, name, pos FROM o WHERE proposal_id IN (SELECT proposal_id FROM okay)),
opts AS (SELECT scope, concat('OPT-', l) AS option_id, proposal_id, name FROM kept QUALIFY row_number() OVER (PARTITION BY scope, l ORDER BY pos DESC) = 1)"""


def options(t):
    return S.admit_options(S.admit_by_refs(t.sql(OPTIONS), t.sql(OPTION_REFS), t.sql(UNCERTAINTIES), 1, "option_admission"))


@query("e16_option_admission", f"WITH {OPTIONS_CTE} SELECT scope, option_id, proposal_id, name FROM opts")
def _(t):
    return options(t)


# Stress tests: each order line tests its order's letter in the scenario of its ship mode.
STRESS = """SELECT o_custkey AS scope, o_orderstatus AS option_letter, concat('S', CAST(1 + l_linenumber % 4 AS STRING)) AS scenario_id,
 CASE WHEN l_quantity < 20 THEN 'ROBUST' WHEN l_quantity < 35 THEN 'CONDITIONAL' WHEN l_quantity < 48 THEN 'FRAGILE' ELSE 'SOLID' END AS result,
 l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
CELLS = f"""cells AS (SELECT scope, concat('OPT-', left(option_letter, 1)) AS option_id, scenario_id, arg_max(result, pos) AS result FROM ({STRESS})
  WHERE result <> 'SOLID' AND (scope, concat('OPT-', left(option_letter, 1))) IN (SELECT (scope, option_id) FROM opts) GROUP BY 1, 2, 3)"""


def stress(t):
    return S.stress_cells(t.sql(STRESS), options(t))


@query("e17_missing_stress_cells", f"""
WITH {OPTIONS_CTE}, {CELLS}, sc AS (SELECT DISTINCT scope, scenario_id FROM ({STRESS}))
SELECT scope, option_id, scenario_id FROM opts JOIN sc USING (scope)
WHERE (scope, option_id, scenario_id) NOT IN (SELECT (scope, option_id, scenario_id) FROM cells)""")
def _(t):
    scen = t.sql(STRESS).select("scope", "scenario_id").distinct()
    return S.missing_cells(options(t), scen, stress(t))


@query("e17_stress_completeness", f"""
WITH {OPTIONS_CTE}, {CELLS}, sc AS (SELECT DISTINCT scope, scenario_id FROM ({STRESS}) WHERE scenario_id IS NOT NULL),
m AS (SELECT scope, option_id, string_agg(CAST(scenario_id AS VARCHAR), ',' ORDER BY CAST(scenario_id AS VARCHAR)) AS missing FROM opts JOIN sc USING (scope)
  WHERE (scope, option_id, scenario_id) NOT IN (SELECT (scope, option_id, scenario_id) FROM cells) GROUP BY 1, 2)
SELECT DISTINCT scope, option_id, coalesce(missing, '') AS missing, missing IS NULL AS complete FROM opts LEFT JOIN m USING (scope, option_id)""")
def _(t):
    scen = t.sql(STRESS).select("scope", "scenario_id").distinct()
    out = S.stress_completeness(options(t), scen, stress(t))
    return out.select("scope", "option_id", F.array_join("missing", ",").alias("missing"), "complete")


@query("e18_working_hypothesis", f"""
WITH {OPTIONS_CTE}, {CELLS}, n AS (SELECT scope, option_id, count(*) FILTER (result = 'ROBUST') AS robust FROM cells GROUP BY 1, 2)
SELECT scope, option_id, robust FROM n QUALIFY row_number() OVER (PARTITION BY scope ORDER BY robust DESC, option_id) = 1""")
def _(t):
    return S.working_hypothesis(stress(t))


WANTED = """SELECT p_partkey AS name_id, p_brand AS scope, CASE p_size % 4 WHEN 0 THEN concat(p_name, ' ', lower(p_type)) WHEN 1 THEN substr(p_name, 1, 4)
 WHEN 2 THEN concat(p_name, ' ', p_type, ' Future') ELSE concat('Other ', p_name) END AS name FROM part"""


@query("d8_scenario_name_match", f"""
WITH {SCENARIOS}, k AS (SELECT scope, slug, pos, proposal_id FROM sc WHERE raised_by IS NULL),
w AS (SELECT *, {SLUG} AS slug FROM ({WANTED})),
e AS (SELECT name_id, proposal_id FROM w JOIN k USING (scope, slug)),
l AS (SELECT name_id, arg_min(proposal_id, k.pos) AS loose FROM w JOIN k ON w.scope = k.scope
      AND (starts_with(k.slug, left(w.slug, 12)) OR starts_with(w.slug, left(k.slug, 12))) GROUP BY 1)
SELECT name_id, coalesce(e.proposal_id, loose) AS scenario_id FROM w LEFT JOIN e USING (name_id) LEFT JOIN l USING (name_id)""")
def _(t):
    kept = scenarios(t).where("raised_by IS NULL").select("scope", "slug", "pos", F.col("proposal_id").alias("scenario_id"))
    return S.match_scenarios(t.sql(WANTED), kept).select("name_id", "scenario_id")


THRESHOLDS = """SELECT o_orderkey AS indicator_id, CASE o_orderkey % 12 WHEN 0 THEN ' ongoing' WHEN 1 THEN 'TBD' WHEN 2 THEN NULL WHEN 3 THEN 'n/a'
 WHEN 4 THEN 'Two primes breached' WHEN 5 THEN 'Any prime breached' WHEN 6 THEN '-' WHEN 7 THEN 'periodically' WHEN 8 THEN 'Within a quarter'
 ELSE concat('More than ', o_orderpriority) END AS threshold FROM orders"""


@query("c13_observable_threshold", rf"""
WITH i AS ({THRESHOLDS}), s AS (SELECT *, trim(coalesce(threshold, '')) AS x FROM i)
SELECT indicator_id, CASE WHEN x = '' OR regexp_matches(x, '(?i)^(tbd|n/?a|-|as appropriate|ongoing|monitor(ed)? closely|regular(ly)?|periodic(ally)?|continuous(ly)?)$')
   OR NOT regexp_matches(x, '(?i)\d|\b(by|within|per|exceeds?|first|any)\b') THEN 'indicator_threshold' END AS raised_by,
   upper(x) NOT IN ('', 'TBD', 'N/A', '-') AS usable FROM s""")
def _(t):
    from corrobora.functions.text import is_usable_threshold
    out = S.observable_thresholds(t.sql(THRESHOLDS))
    return out.select("indicator_id", "raised_by", is_usable_threshold(F.col("threshold")).alias("usable"))


# --- identifiers ---------------------------------------------------------------------------
SEEN = """SELECT concat('SIG-CS-', CAST(s_suppkey AS STRING), ' then TR-EW-', CAST(s_nationkey AS STRING)) AS seen FROM supplier
UNION ALL SELECT body_md FROM reports"""
NEW_OBJECTS = """SELECT o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN 'SIG-CS-' WHEN 1 THEN 'F-CS-' ELSE 'CU-AI-' END AS prefix FROM orders"""


@query("g2_id_minting", rf"""
WITH seen AS ({SEEN}), m AS (SELECT unnest(regexp_extract_all(seen, '\b((?:SIG|TR|F|R|CU|FC)-[A-Z]{{2}}-)(\d+)\b')) AS id FROM seen),
top AS (SELECT regexp_extract(id, '^(.*-)\d+$', 1) AS prefix, max(CAST(regexp_extract(id, '(\d+)$', 1) AS BIGINT)) AS top FROM m GROUP BY 1),
n AS (SELECT pos, prefix, row_number() OVER (PARTITION BY prefix ORDER BY pos) AS k FROM ({NEW_OBJECTS})),
d AS (SELECT pos, n.prefix, CAST(coalesce(top, 0) + k AS VARCHAR) AS digits FROM n LEFT JOIN top USING (prefix))
SELECT pos, concat(prefix, CASE WHEN length(digits) >= 2 THEN digits ELSE lpad(digits, 2, '0') END) AS id FROM d""")
def _(t):
    return ids.mint(t.sql(NEW_OBJECTS), "pos", ids.high_water(t.sql(SEEN), "seen")).select("pos", "id")


# --- refusals of all stages ------------------------------------------------------------------
STAGES = ", ".join(f"('{rule}', '{stage}')" for rule, stage in vocab.REFUSAL_STAGE.items())


@query("e30_stage_map", f"""
WITH im AS (SELECT CASE WHEN upper(trim(coalesce(actor, ''))) NOT IN ('MOD', 'TAWAZUN') THEN 'implication_actor'
       WHEN finding_id NOT IN (SELECT finding_id FROM findings) THEN 'implication_admission' END AS raised_by FROM ({IMPLICATIONS})),
g AS (SELECT raised_by FROM (WITH {FINDINGS}, {GAPS} SELECT raised_by FROM gaps) UNION ALL SELECT raised_by FROM (WITH {SCENARIOS} SELECT raised_by FROM sc)
  WHERE raised_by IS NOT NULL UNION ALL SELECT raised_by FROM im WHERE raised_by IS NOT NULL
  UNION ALL SELECT concat('edit.', lower(o_orderstatus)) FROM orders)
SELECT raised_by, coalesce(stage, 'synthesize') AS stage, count(*) AS n FROM g LEFT JOIN (VALUES {STAGES}) m(rule, stage) ON rule = raised_by GROUP BY 1, 2""")
def _(t):
    from corrobora.operators.readiness import refusals_by_rule
    refused = lambda df: df.where("raised_by IS NOT NULL").select("raised_by", F.lit("").alias("gap"))
    gaps = (gap_ledger(t).select("raised_by", "gap").unionByName(refused(scenarios(t)))
            .unionByName(refused(S.admit_implications(t.sql(IMPLICATIONS), t.findings)))
            .unionByName(refused(t.sql("SELECT concat('edit.', lower(o_orderstatus)) AS raised_by FROM orders"))))
    stages = t.spark.createDataFrame(list(vocab.REFUSAL_STAGE.items()), "raised_by STRING, stage STRING")
    return refusals_by_rule(gaps, stages).select("raised_by", "stage", "n")
