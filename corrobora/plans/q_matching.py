"""Queries on matching, merging, lineage, evaluation, refiling and ledgers."""

from pyspark.sql import functions as F

from corrobora import vocab
from corrobora.functions import audit as A, rules, text as T
from corrobora.operators import audit as U, evaluate as E, graph as G, lineage as L, matching as M, readiness as R, refile as RF
from corrobora.plans.q_audit import CITE, FLAGS, OBJ, SENT, VERBS, any_of, flags, secs
from corrobora.plans.q_provenance import rows
from corrobora.plans.registry import query
from corrobora.plans.views import view
from corrobora.sources import sinks

# --- relevance -----------------------------------------------------------------------------
TERMS = ["counter-thereing erention", "heandion the heronand", "nintion risks"]
FOCUS = M.focus_words(TERMS)
SCORE = "(" + " + ".join(f"CAST(contains(lower(sentence), '{w}') AS INT)" for w in FOCUS) + ")"


@query("k1_relevance", f"""
WITH s AS (SELECT doc_id, pos, doc_id * 100000 + pos AS ord, {SCORE} AS score FROM doc_sentences),
h AS (SELECT count(*) AS h FROM s WHERE score > 0), b AS (SELECT * FROM s ORDER BY score DESC, ord LIMIT 6)
SELECT doc_id, pos, score FROM s, h WHERE h >= 6 AND score > 0 UNION ALL SELECT doc_id, pos, score FROM b, h WHERE h BETWEEN 3 AND 5""")
def _(t):
    rows_ = t.doc_sentences.withColumn("ord", F.col("doc_id") * 100000 + F.col("pos"))
    return M.relevant(rows_, TERMS, ["sentence"], "ord").select("doc_id", "pos", "score")


@query("k2_withheld_counts", f"""
SELECT source AS input, count(*) AS available, count(*) FILTER ({SCORE} > 0) AS passed, count(*) - count(*) FILTER ({SCORE} > 0) AS withheld FROM doc_sentences GROUP BY 1""")
def _(t):
    low = F.lower("sentence")
    hit = T.contains_any(low, FOCUS)
    return t.doc_sentences.groupBy(F.col("source").alias("input")).agg(
        F.count("*").alias("available"), F.count_if(hit).alias("passed"), F.count_if(~hit).alias("withheld"))


# Sections read two inputs each; whole inputs of some hold nothing on the subject.
SECTIONS = """SELECT concat('S', CAST(doc_id % 97 AS STRING)) AS section, source AS input, sentence FROM doc_sentences"""


@query("k2_blocked_sections", f"""
WITH s AS (SELECT section, input, count(*) AS available, count(*) FILTER ({SCORE} > 0) AS passed FROM ({SECTIONS}) GROUP BY 1, 2),
pl AS (SELECT section, input FROM (SELECT DISTINCT section FROM ({SECTIONS})), (SELECT DISTINCT source AS input FROM documents WHERE source IS NOT NULL)),
g AS (SELECT section, bool_or(coalesce(passed = 0, false)) AS any_off, max(coalesce(passed, 0)) AS most, coalesce(string_agg(CASE WHEN passed = 0 THEN input END, ',' ORDER BY input), '') AS absent
  FROM pl LEFT JOIN s USING (section, input) GROUP BY 1)
SELECT section, any_off AND most = 0 AS blocked, CASE WHEN any_off AND most = 0 THEN '' ELSE absent END AS absent FROM g""")
def _(t):
    rows_ = t.sql(SECTIONS)
    ledger = M.input_ledger(rows_, "section", "input", T.contains_any(F.lower("sentence"), FOCUS))
    # Every section asks for every source; sources are a short list.
    sources = t.documents.where("source IS NOT NULL").agg(F.collect_set("source")).scalar()
    plan = rows_.select("section").distinct().select("section", F.explode(sources).alias("input"))
    return M.section_states(plan, ledger)


# --- shingles ---------------------------------------------------------------------------------
SHINGLE = """bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM
   (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))),
bt AS (SELECT item_id, count(*) AS total FROM bs GROUP BY 1),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM
   (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents))),
km AS (SELECT item_id, doc_id, count(*) AS shared, any_value(total) AS total FROM bs JOIN ds USING (sh) JOIN bt USING (item_id) GROUP BY 1, 2 HAVING count(*) >= any_value(total) * 0.5)"""


def register_matches(t):
    return M.shingle_matches(t.benchmark, t.documents)


@query("k3_register_matching", f"WITH {SHINGLE} SELECT item_id, doc_id, shared, total FROM km")
def _(t):
    return register_matches(t)


DOMAINS = """SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'signals' WHEN 1 THEN 'findings' WHEN 2 THEN 'risks' ELSE 'uncertainties' END AS kind,
 CASE item_id % 5 WHEN 0 THEN 'AI' WHEN 1 THEN 'CROSS_CUTTING' WHEN 2 THEN 'PROCUREMENT' ELSE 'CYBERSECURITY' END AS domain FROM benchmark"""


@query("e34_recall", f"""
WITH {SHINGLE}, m AS (SELECT kind, domain IN ('AI', 'CROSS_CUTTING') AS scope, item_id IN (SELECT item_id FROM km) AS matched FROM ({DOMAINS})),
a AS (SELECT kind, count(*) AS total, count(*) FILTER (scope) AS in_scope, count(*) FILTER (scope AND matched) AS in_scope_matched, count(*) FILTER (matched) AS matched FROM m GROUP BY 1)
SELECT *, CASE WHEN in_scope > 0 THEN CAST(round_even(in_scope_matched * 1000.0 / in_scope, 0) AS BIGINT) END AS recall_milli FROM a""")
def _(t):
    hit = register_matches(t).select("item_id").distinct().withColumn("hit", F.lit(True))
    matches = t.sql(DOMAINS).join(hit, "item_id", "left").withColumn("matched", F.col("hit").isNotNull())
    return E.recall(matches, "AI")


@query("j3_novel_documents", f"WITH {SHINGLE} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM km)")
def _(t):
    matches = register_matches(t).select(F.col("doc_id").alias("our_id"), F.lit(True).alias("matched"))
    return E.novel_items(t.documents.select(F.col("doc_id").alias("id")), matches)


# --- near-identical rows ------------------------------------------------------------------------
TOK = r"list_sort(list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')))"
view("claims", """
SELECT doc_id, pos, doc_id * 100000 + pos * 2 AS claim_id, sentence FROM doc_sentences
UNION ALL SELECT doc_id, pos, doc_id * 100000 + pos * 2 + 1, CASE pos % 3 WHEN 0 THEN lower(sentence) WHEN 1 THEN concat('Also ', sentence) ELSE concat(sentence, ' ', sentence) END
FROM doc_sentences WHERE length(sentence) > 90
""")


@query("d15_pair_space", f"""
WITH s AS (SELECT doc_id, {TOK} AS t FROM claims), d AS (SELECT doc_id, t, count(*) AS c FROM s WHERE len(t) > 0 GROUP BY 1, 2)
SELECT doc_id, sum(c) AS "rows", count(*) AS distinct_rows, count(*) * (count(*) - 1) // 2 AS pairs, sum(c) - count(*) AS copies FROM d GROUP BY 1""", longs=('rows', 'copies'))
def _(t):
    return M.pair_space(t.claims, ["doc_id"], "sentence")


@query("k4_same_fact_pairs", f"""
WITH s AS (SELECT doc_id, claim_id, {TOK} AS t FROM claims), d AS (SELECT doc_id, t, min(claim_id) AS id FROM s WHERE len(t) > 0 GROUP BY 1, 2),
cp AS (SELECT id AS a_id, claim_id AS b_id, len(t) AS shared, len(t) AS total FROM s JOIN d USING (doc_id, t) WHERE claim_id <> id),
j AS (SELECT a.id AS a_id, b.id AS b_id, len(list_intersect(a.t, b.t)) AS shared, len(a.t) + len(b.t) AS n FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.id < b.id
      AND least(len(a.t), len(b.t)) >= greatest(len(a.t), len(b.t)) * 0.85)
SELECT * FROM cp UNION ALL SELECT a_id, b_id, shared, n - shared FROM j WHERE shared >= (n - shared) * 0.85""")
def _(t):
    return M.same_fact_pairs(t.claims, ["doc_id"], "claim_id", "sentence")


# Verdicts on orders of one customer; chains form inside it.  Three in ten are sure enough.
PAIRS = """SELECT evidence_id AS a_id, nxt AS b_id, CASE WHEN (evidence_id + nxt) % 3 = 0 THEN 0.85E0 + CAST((evidence_id + nxt) % 4 AS DOUBLE) / 40 ELSE CAST((evidence_id + nxt) % 17 AS DOUBLE) / 20 END AS probability,
  (evidence_id + nxt) % 7 > 0 AS same_fact FROM (
  SELECT evidence_id, lead(evidence_id) OVER (PARTITION BY scope ORDER BY topic_id, evidence_id) AS nxt FROM evidence) x WHERE nxt IS NOT NULL"""


def comp(pairs, sure):
    return f"""pr AS (SELECT a_id, b_id FROM ({pairs}) WHERE same_fact AND probability >= {sure}),
nb AS (SELECT a_id AS x, b_id AS y FROM pr UNION ALL SELECT b_id, a_id FROM pr),
rc AS (SELECT DISTINCT x AS id, x AS root FROM nb UNION SELECT nb.y, rc.root FROM rc JOIN nb ON nb.x = rc.id),
cc AS (SELECT id, min(root) AS root FROM rc GROUP BY 1)"""


COMP = comp(PAIRS, "0.85E0")
# More of the same verdicts: three in four are sure enough, so chains are long.
CHAINED = """SELECT evidence_id AS a_id, nxt AS b_id, CAST((evidence_id + nxt) % 20 AS DOUBLE) / 20 AS probability, (evidence_id + nxt) % 7 > 0 AS same_fact FROM (
  SELECT evidence_id, lead(evidence_id) OVER (PARTITION BY scope ORDER BY topic_id, evidence_id) AS nxt FROM evidence) x WHERE nxt IS NOT NULL"""
SURE = 0.25
CHAINS = comp(CHAINED, SURE)
view("entity_evidence", """
SELECT DISTINCT concat('ENT-', CAST(l_partkey % 997 AS STRING)) AS entity_id, l_orderkey AS evidence_id FROM lineitem
""")


def merged(t, **bridges):
    return G.merge_same_fact(t.evidence, t.sql(PAIRS), bridges)


def chained(t, **bridges):
    return G.merge_same_fact(t.evidence, t.sql(CHAINED), bridges, threshold=SURE)


@query("e21_same_fact_components", f"WITH RECURSIVE {CHAINS} SELECT id, root FROM cc")
def _(t):
    return G.connected_components(G.same_fact(t.sql(CHAINED), SURE))


# The same table, reached in two steps: the components of two thirds of the pairs, then the rest.
@query("e21_updated_components", f"WITH RECURSIVE {COMP} SELECT id, root FROM cc")
def _(t):
    pairs = G.same_fact(t.sql(PAIRS))
    early = (F.col("a_id") + F.col("b_id")) % 3 == F.lit(0)
    first = G.connected_components(pairs.where(early & (F.xxhash64("a_id") % 3 != 0)))
    return G.updated_components(first, pairs.where(~(early & (F.xxhash64("a_id") % 3 != 0))))


@query("e21_merged_evidence", f"""WITH RECURSIVE {COMP}
SELECT evidence_id, topic_id, class FROM evidence WHERE evidence_id NOT IN (SELECT id FROM cc WHERE id <> root)""")
def _(t):
    return merged(t)["evidence"].select("evidence_id", "topic_id", "class")


@query("e21_merged_sources", f"""WITH RECURSIVE {CHAINS}
SELECT DISTINCT coalesce(root, evidence_id) AS evidence_id, document_id FROM evidence_sources LEFT JOIN cc ON id = evidence_id""")
def _(t):
    return chained(t, sources=t.evidence_sources)["sources"]


@query("e21_merged_signal_links", f"""WITH RECURSIVE {CHAINS}
SELECT DISTINCT signal_id, coalesce(root, evidence_id) AS evidence_id FROM signal_evidence LEFT JOIN cc ON id = evidence_id""")
def _(t):
    return chained(t, signals=t.signal_evidence)["signals"]


@query("e21_merged_entity_links", f"""WITH RECURSIVE {COMP}
SELECT DISTINCT entity_id, coalesce(root, evidence_id) AS evidence_id FROM entity_evidence LEFT JOIN cc ON id = evidence_id""")
def _(t):
    return merged(t, entities=t.entity_evidence)["entities"]


# --- best topic -------------------------------------------------------------------------------------
KEYWORDS = {
    "spark": """SELECT concat('B', CAST(item_id % 9 AS STRING)) AS topic_id, word, count(*) AS weight FROM (
      SELECT item_id, explode(regexp_extract_all(lower(text), '[a-z0-9]+', 0)) AS word FROM benchmark) x WHERE length(word) >= 7 GROUP BY 1, 2""",
    "duck": """SELECT concat('B', CAST(item_id % 9 AS STRING)) AS topic_id, word, count(*) AS weight FROM (
      SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark) x WHERE length(word) >= 7 GROUP BY 1, 2"""}


@query("k5_best_topic", f"""
WITH k AS ({KEYWORDS['duck']}), w AS (SELECT DISTINCT proposal_id, unnest(regexp_extract_all(lower(statement), '[a-z0-9]+')) AS word FROM statements),
s AS (SELECT proposal_id, topic_id, sum(weight) AS score FROM w JOIN k USING (word) GROUP BY 1, 2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY score DESC, topic_id) = 1)
SELECT proposal_id AS claim_id, coalesce(topic_id, 'NONE') AS topic_id, coalesce(score, 0) AS score FROM statements LEFT JOIN b USING (proposal_id)""", longs=('score',))
def _(t):
    claims = t.statements.select(F.col("proposal_id").alias("claim_id"), F.col("statement").alias("claim"))
    return M.best_topic(claims, t.sql(KEYWORDS["spark"]))


# --- refile --------------------------------------------------------------------------------------------
FILED = """SELECT evidence_id, pillar, topic_id, concat('An order of ', segment, ' kind, urgency ', topic_id) AS claim, CAST(NULL AS DATE) AS archived_on FROM evidence WHERE NOT archived"""
PLACED = """SELECT CASE WHEN evidence_id % 13 = 0 THEN -1 - evidence_id ELSE evidence_id END AS evidence_id, CASE evidence_id % 9 WHEN 0 THEN 'NONE' WHEN 1 THEN 'T99-1' WHEN 2 THEN concat(' ', topic_id, ' ')
   WHEN 3 THEN topic_id ELSE concat('T', CAST((nation_key + evidence_id) % 25 AS STRING), '-', CAST(1 + evidence_id % 5 AS STRING)) END AS proposed,
 CASE evidence_id % 4 WHEN 0 THEN 'ORDER of' WHEN 1 THEN '"urgency"' WHEN 2 THEN segment ELSE 'radar' END AS hook, concat('because ', segment) AS reason FROM evidence"""
LIVE_TOPICS = "SELECT topic_id, pillar FROM topics WHERE NOT retired"
PLAN = rf"""lt AS ({LIVE_TOPICS}), fe AS ({FILED}), pl AS (SELECT evidence_id, trim(proposed) AS proposed, hook, reason FROM ({PLACED})),
jj AS (SELECT fe.*, pl.proposed, hook, reason, lt.pillar AS np, proposed = 'NONE' OR lt.pillar IS NOT NULL AS valid,
  length(trim(lower(hook), ' .,''"')) >= 3 AND contains(lower(claim), trim(lower(hook), ' .,''"')) AS hooked
  FROM fe LEFT JOIN pl USING (evidence_id) LEFT JOIN lt ON lt.topic_id = proposed),
pn AS (SELECT evidence_id, pillar AS old_pillar, topic_id AS old_topic, coalesce(np, '') AS new_pillar, CASE WHEN valid AND proposed <> 'NONE' THEN proposed ELSE '' END AS new_topic,
  CASE WHEN NOT coalesce(valid, false) THEN 'REVIEW' WHEN proposed = 'NONE' THEN 'archive' WHEN NOT hooked THEN 'REVIEW' WHEN proposed = topic_id THEN 'keep' ELSE 'refile' END AS action,
  CASE WHEN NOT coalesce(valid, false) THEN 'no valid proposal after a retry' WHEN proposed = 'NONE' THEN reason WHEN NOT hooked THEN 'hook ''' || coalesce(hook, '') || ''' is not in the claim — ' || reason ELSE reason END AS reason FROM jj)"""


def plan(t):
    return RF.refile_plan(t.sql(FILED), t.sql(PLACED), t.sql(LIVE_TOPICS))


@query("d19_refile_plan", f"WITH {PLAN} SELECT * FROM pn")
def _(t):
    return plan(t)


@query("d20_apply_plan", f"""WITH {PLAN}
SELECT f.evidence_id, CASE WHEN action = 'refile' THEN new_topic ELSE topic_id END AS topic_id, CASE WHEN action = 'refile' THEN new_pillar ELSE pillar END AS pillar,
  CASE WHEN action = 'archive' THEN '2024-01-31' END AS archived_on, CASE WHEN action = 'REVIEW' THEN 'skipped' ELSE action END AS applied FROM fe f LEFT JOIN pn USING (evidence_id)""")
def _(t):
    out = RF.apply_plan(t.sql(FILED), plan(t), t.sql(LIVE_TOPICS), F.lit("2024-01-31").cast("date"))
    return out.select("evidence_id", "topic_id", "pillar", F.col("archived_on").cast("string"), "applied")


@query("e41_refile_summary", f"""WITH {PLAN}
SELECT 'action' AS part, action AS name, count(*) AS n FROM pn GROUP BY 2
UNION ALL SELECT 'topic', lt.topic_id, count(pn.evidence_id) FROM lt LEFT JOIN pn ON pn.new_topic = lt.topic_id AND action IN ('keep', 'refile') GROUP BY 2
UNION ALL SELECT 'archived', old_pillar, count(*) FROM pn WHERE action = 'archive' GROUP BY 2""")
def _(t):
    return RF.plan_summary(plan(t), t.sql(LIVE_TOPICS))


# --- lineage -------------------------------------------------------------------------------------------------
EV_OBJECTS = "SELECT evidence_id, concat('EV-', CAST(evidence_id AS STRING)) AS cited_id, concat('Order ', CAST(evidence_id AS STRING)) AS text, topic_id AS quote, class FROM evidence"
OTHERS = "SELECT cited_id, kind, concat(kind, ' ', cited_id) AS text FROM graph_objects WHERE kind <> 'evidence'"
OBJECTS = f"""ob AS (SELECT e.cited_id, 'evidence' AS kind, e.text, e.quote, e.class, publisher, tier, url FROM ({EV_OBJECTS}) e
   LEFT JOIN (SELECT evidence_id, min(document_id) AS document_id FROM evidence_sources GROUP BY 1) USING (evidence_id) LEFT JOIN graph_docs USING (document_id) LEFT JOIN registry USING (registry_id)
   UNION ALL SELECT cited_id, kind, text, NULL, NULL, NULL, NULL, NULL FROM ({OTHERS}))"""
PID = vocab.PROSE_ID
CITED = rf"""ci AS (SELECT DISTINCT report_id, unnest(regexp_extract_all(string_split(body_md, chr(10) || '## References')[1], '{PID}', 1)) AS cited_id FROM reports)"""


def objects(t):
    return L.resolved_objects(t.sql(EV_OBJECTS), t.evidence_sources, t.graph_docs, t.registry, t.sql(OTHERS))


@query("f5_upstream_lineage", f"WITH {OBJECTS} SELECT cited_id, kind, text, quote, class, publisher, tier, url FROM ob")
def _(t):
    return objects(t)


@query("f9_frozen_citations", f"WITH {OBJECTS}, {CITED} SELECT report_id, cited_id, kind, text, quote, class, publisher, tier, url FROM ci JOIN ob USING (cited_id)")
def _(t):
    return L.freeze(t.reports, objects(t))


# Snapshots of other reports lie beside those of the reports at hand.
FROZEN = "SELECT DISTINCT CASE WHEN source <> 'src1' AND length(sentence) % 2 = 0 THEN doc_id ELSE -1 - doc_id END AS report_id, concat('EV-', CAST(doc_id * 7 + pos * 13 AS STRING)) AS cited_id, concat('as issued: ', substr(sentence, 1, 9)) AS text FROM doc_sentences"


@query("f9_unfrozen_reports", f"SELECT report_id FROM reports WHERE report_id NOT IN (SELECT report_id FROM ({FROZEN}))")
def _(t):
    return L.unfrozen(t.reports, t.sql(FROZEN)).select("report_id")


@query("f10_drifted_citations", f"""WITH {OBJECTS}, {CITED}, fz AS (SELECT report_id, cited_id, text FROM ({FROZEN}))
SELECT report_id, cited_id, CASE WHEN fz.text IS NOT NULL THEN fz.text ELSE ob.text END AS text,
 CASE WHEN fz.text IS NOT NULL THEN 'frozen' WHEN ob.text IS NOT NULL THEN 'live' ELSE 'missing' END AS origin FROM ci LEFT JOIN fz USING (report_id, cited_id) LEFT JOIN ob USING (cited_id)""")
def _(t):
    return L.current_citations(L.cited_in_prose(t.reports), t.sql(FROZEN), objects(t))


@query("b5_citation_snapshot", f"""WITH {OBJECTS}, {CITED}, fz AS (SELECT report_id, cited_id, text FROM ({FROZEN})), nw AS (SELECT report_id, cited_id, text FROM ci JOIN ob USING (cited_id))
SELECT * FROM nw UNION ALL SELECT * FROM fz WHERE report_id NOT IN (SELECT report_id FROM nw)""")
def _(t):
    fresh = L.freeze(t.reports, objects(t)).select("report_id", "cited_id", "text")
    return sinks.bucketed_merge(t.sql(FROZEN), fresh)


@query("g11_citation_numbers", rf"""
WITH g AS (SELECT report_id, flatten(list_transform(regexp_extract_all(body_md, '{vocab.CITATION_GROUP}', 1), lambda x: regexp_split_to_array(x, '\s*[;,]\s*'))) AS ids FROM reports),
p AS (SELECT report_id, unnest(ids) AS cited_id, unnest(range(len(ids))) AS k FROM g), m AS (SELECT report_id, cited_id, min(k) AS k FROM p GROUP BY 1, 2)
SELECT report_id, cited_id, row_number() OVER (PARTITION BY report_id ORDER BY k) AS number FROM m""")
def _(t):
    return L.citation_numbers(t.reports)


@query("e40_reference_lines", f"""WITH {CITED},
x AS (SELECT report_id, document_id, list_sort(list(DISTINCT ci.cited_id)) AS ids FROM ci JOIN ({EV_OBJECTS}) e USING (cited_id) JOIN evidence_sources USING (evidence_id) GROUP BY 1, 2)
SELECT report_id, ids[1] AS first_id, url, '[' || array_to_string(ids, ', ') || '] ' || title || ' — ' || coalesce(publisher, '') || coalesce(', ' || CAST(published_on AS VARCHAR), '') || '. ' || url AS line
FROM x JOIN graph_docs USING (document_id) LEFT JOIN registry USING (registry_id)""")
def _(t):
    cited = L.cited_in_prose(t.reports).join(t.sql(EV_OBJECTS).select("evidence_id", "cited_id"), "cited_id")
    return L.reference_lines(cited, t.evidence_sources, t.graph_docs, t.registry)


@query("f8_existing_graph", """
WITH s AS (SELECT DISTINCT signal_id FROM signal_evidence JOIN live_evidence e USING (evidence_id, signal_id) WHERE e.env_layer = 'UAE')
SELECT signal_id, to_id AS finding_id FROM s LEFT JOIN (SELECT * FROM links WHERE from_type = 'signal' AND to_type = 'finding') ON from_id = signal_id""")
def _(t):
    return L.existing_graph(t.live_evidence.where("env_layer = 'UAE'"), t.signal_evidence, t.links)


# --- evaluation -------------------------------------------------------------------------------------------------
view("bench_lines", """
SELECT source, doc_id * 100000 + pos AS line_no,
       CASE (doc_id + pos) % 9 WHEN 0 THEN concat('SIG-', CAST(pos % 40 AS STRING), ' | ', replace(sentence, chr(10), ' '), ' | x')
            WHEN 1 THEN concat('Finding F-', CAST(pos % 30 AS STRING), ': ', replace(sentence, chr(10), ' '))
            WHEN 2 THEN concat('R', CAST(pos % 20 AS STRING), ' — ', replace(sentence, chr(10), ' '), ' — Score 6')
            WHEN 3 THEN concat('CU-', CAST(pos % 25 AS STRING), ' — ', replace(sentence, chr(10), ' '))
            WHEN 4 THEN concat('• ', replace(sentence, chr(10), ' ')) ELSE replace(sentence, chr(10), ' ') END AS line
FROM doc_sentences
""")


@query("a8_pattern_registers", rf"""
WITH r AS (SELECT source, line_no, 'signals' AS kind, regexp_extract(line, '^(SIG-\d+)\s*\|\s*([^|]+)\|', 1) AS id, trim(regexp_extract(line, '^(SIG-\d+)\s*\|\s*([^|]+)\|', 2)) AS text FROM bench_lines
 UNION ALL SELECT source, line_no, 'findings', regexp_extract(line, 'Finding (F-\d+):\s*(.+)', 1), trim(regexp_extract(line, 'Finding (F-\d+):\s*(.+)', 2)) FROM bench_lines
 UNION ALL SELECT source, line_no, 'risks', regexp_extract(line, '^(R\d+)\s*—\s*(.+?)\s*—\s*Score', 1), trim(regexp_extract(line, '^(R\d+)\s*—\s*(.+?)\s*—\s*Score', 2)) FROM bench_lines
 UNION ALL SELECT source, line_no, 'uncertainties', regexp_extract(line, '^(CU-\d+)\s*—\s*(.+)', 1), trim(regexp_extract(line, '^(CU-\d+)\s*—\s*(.+)', 2)) FROM bench_lines),
f AS (SELECT source, kind, id, arg_min(text, line_no) AS text FROM r WHERE id <> '' GROUP BY 1, 2, 3)
SELECT * FROM f WHERE source IN (SELECT source FROM f GROUP BY 1 HAVING count(*) >= 4)""")
def _(t):
    return E.pattern_registers(t.bench_lines)


@query("e33_chain_completeness", """
WITH w AS (SELECT DISTINCT to_id FROM links WHERE from_type = 'signal' AND to_type = 'finding' AND from_id IN (SELECT signal_id FROM live_evidence WHERE env_layer <> 'GLOBAL')),
a AS (SELECT pillar, count(*) AS findings, count(to_id) AS complete FROM findings LEFT JOIN w ON to_id = finding_id GROUP BY 1)
SELECT *, CAST(round_even(complete * 1000.0 / findings, 0) AS BIGINT) AS rate_milli FROM a""")
def _(t):
    se = t.live_evidence.where("env_layer <> 'GLOBAL'").select("signal_id", "evidence_id")
    return E.chain_completeness(t.findings, t.links, se, "pillar")


def _metrics_sql(src: str, key: str, cite: str) -> str:
    return rf"""m0 AS (SELECT {key}, sentence, regexp_matches(sentence, '{cite}') AS c, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) AS w,
  regexp_matches(sentence, '{vocab.ASSERTIVE}') AND NOT {any_of('lower(sentence)', vocab.HEDGES)}
  AND NOT (trim(regexp_split_to_array(lower(regexp_replace(trim(sentence), '^(\d+[\.\)]\s*|[-*+]\s*)?(\*\*)?\s*', '')), '[\s,:]+')[1], '*_') IN ({VERBS}) OR regexp_matches(sentence, '{vocab.MODAL_RECOMMENDATION}')) AS u FROM ({src})),
m1 AS (SELECT {key}, count(*) AS sentences, sum(w) AS words, count(*) FILTER (c) AS cited, count(*) FILTER (u AND NOT c) AS unsourced FROM m0 GROUP BY 1)
SELECT *, CAST(round_even(cited * 10000.0 / greatest(words, 1), 0) AS BIGINT) AS cites_per_10k, CAST(round_even(unsourced * 1000.0 / greatest(sentences, 1), 0) AS BIGINT) AS unsourced_milli FROM m1"""


@query("e35_report_text_metrics", f"WITH {SENT}, {_metrics_sql('SELECT report_id, sentence FROM sent WHERE NOT in_references', 'report_id', OBJ)}", longs=('words',))
def _(t):
    s = U.sentences(secs(t)).where(~F.col("in_references"))
    return E.text_metrics(s, "report_id")


@query("e35_benchmark_text_metrics", "WITH " + _metrics_sql("SELECT source, line AS sentence FROM bench_lines WHERE length(line) > 40 AND NOT starts_with(line, '•')", "source", vocab.NUMERIC_CITATION), longs=('words',))
def _(t):
    lines = E.benchmark_sentences(t.bench_lines).withColumnRenamed("line", "sentence")
    return E.text_metrics(lines, "source", vocab.NUMERIC_CITATION)


@query("e36_report_stats", rf"""WITH {SENT}, {OBJECTS},
pz AS (SELECT report_id, string_agg(text, chr(10) ORDER BY sec) AS prose FROM secs WHERE title IS NOT NULL AND lower(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g')) <> 'references' GROUP BY 1),
ps AS (SELECT report_id, prose, list_filter(string_split(regexp_replace(regexp_replace(prose, chr(10) || '+', ' ', 'g'), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: length(trim(s)) > 20) AS l FROM pz),
st AS (SELECT report_id, len(l) AS sentences, len(list_filter(l, lambda s: regexp_matches(s, '{PID}'))) AS cited FROM ps),
ev AS (SELECT report_id, count(*) AS evidence, count(DISTINCT publisher) AS publishers, count(*) FILTER (tier = 1) AS tier1 FROM
  (SELECT DISTINCT report_id, unnest(regexp_extract_all(prose, '{PID}', 1)) AS cited_id FROM ps) JOIN ob USING (cited_id) WHERE kind = 'evidence' GROUP BY 1)
SELECT report_id, sentences, cited, coalesce(evidence, 0) AS evidence, coalesce(publishers, 0) AS publishers, coalesce(tier1, 0) AS tier1 FROM st LEFT JOIN ev USING (report_id)""")
def _(t):
    return E.report_stats(t.reports, objects(t))


SEC_LINKS = "SELECT 'exec_summary' AS from_id, 'report_section' AS from_type, finding_id AS to_id FROM findings WHERE pillar = 'ASIA'"


@query("d11_section_scope", "SELECT finding_id AS id, true AS scoped FROM findings WHERE pillar = 'ASIA'")
def _(t):
    return E.scoped_rows(t.findings.select(F.col("finding_id").alias("id")), t.sql(SEC_LINKS), "exec_summary")


@query("d11_section_unscoped", "SELECT finding_id AS id, false AS scoped FROM findings")
def _(t):
    return E.scoped_rows(t.findings.select(F.col("finding_id").alias("id")), t.sql(SEC_LINKS), "outlook")


# --- ledgers --------------------------------------------------------------------------------------------------------
FUNNEL = """SELECT 1 AS pos, 'collect' AS stage, count(*) AS n FROM graph_docs UNION ALL SELECT 2, 'extract', count(*) FROM evidence
UNION ALL SELECT 3, 'rules', count(*) FROM live_evidence UNION ALL SELECT 4, 'synthesize', count(*) FROM signals UNION ALL SELECT 5, 'findings', count(*) FROM findings"""


@query("e31_stage_funnel", f"WITH f AS ({FUNNEL}) SELECT pos, stage, n, lag(n) OVER (ORDER BY pos) AS before, greatest(coalesce(lag(n) OVER (ORDER BY pos) - n, 0), 0) AS dropped FROM f")
def _(t):
    counts = None
    for pos, (stage, df) in enumerate((("collect", t.graph_docs), ("extract", t.evidence), ("rules", t.live_evidence),
                                       ("synthesize", t.signals), ("findings", t.findings)), start=1):
        one = df.agg(F.count("*").alias("n")).select(F.lit(pos).alias("pos"), F.lit(stage).alias("stage"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return R.stage_funnel(counts)


view("ledger",
     """SELECT o_custkey AS report_id, o_orderkey AS section_no, map('evidence', CAST(o_orderkey % 9 AS INT), o_orderpriority, 2) AS rows_passed,
 map(o_orderpriority, CAST(o_orderkey % 4 AS INT)) AS rows_withheld, CAST(o_orderkey % 3 AS INT) AS retries, o_orderstatus = 'P' AS withheld,
 split(o_orderpriority, '-') AS citations FROM orders""",
     """SELECT o_custkey AS report_id, o_orderkey AS section_no, MAP {'evidence': CAST(o_orderkey % 9 AS INT), o_orderpriority: 2} AS rows_passed,
 MAP {o_orderpriority: CAST(o_orderkey % 4 AS INT)} AS rows_withheld, CAST(o_orderkey % 3 AS INT) AS retries, o_orderstatus = 'P' AS withheld,
 string_split(o_orderpriority, '-') AS citations FROM orders""")


@query("e32_ledger_totals", """SELECT report_id, count(*) AS sections, sum(retries) AS redrafts, count(*) FILTER (withheld) AS withheld, sum(len(citations)) AS citations FROM ledger GROUP BY 1""", longs=('redrafts', 'citations'))
def _(t):
    return R.ledger_totals(t.ledger)


@query("e32_ledger_inputs", """WITH p AS (SELECT unnest(map_keys(rows_passed)) AS input, unnest(map_values(rows_passed)) AS passed, 0 AS held FROM ledger
 UNION ALL SELECT unnest(map_keys(rows_withheld)), 0, unnest(map_values(rows_withheld)) FROM ledger) SELECT input, sum(passed) AS passed, sum(held) AS held FROM p GROUP BY 1""", longs=('passed', 'held'))
def _(t):
    return R.ledger_inputs(t.ledger)


@query("e39_gates_by_claim", """SELECT blocks, string_agg(gate_id, ',' ORDER BY gate_id) AS gate_ids FROM gates WHERE status = 'OPEN' GROUP BY 1""")
def _(t):
    # Gates are one per nation: a list per claim is bounded by that small table.
    return t.gates.where("status = 'OPEN'").groupBy("blocks").agg(
        F.array_join(F.array_sort(F.collect_list("gate_id")), ",").alias("gate_ids"))


@query("e30_refusal_totals", """
SELECT 'gaps' AS kind, count(*) AS n FROM statements WHERE regexp_matches(statement, '(?i)\\b(must|should)\\s+(prioriti[sz]e|enhance|improve|strengthen|adopt|embrace|focus on|invest in|consider)\\b')
UNION ALL SELECT 'gates', count(*) FROM gates WHERE status = 'OPEN' UNION ALL SELECT 'withheld', count(*) FROM ledger WHERE withheld""".replace("\\\\", "\\"))
def _(t):
    gaps = t.statements.where(F.rlike("statement", F.lit(vocab.VAGUE_IMPERATIVE)))
    total = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return (total(gaps, "gaps").unionByName(total(t.gates.where("status = 'OPEN'"), "gates"))
            .unionByName(total(t.ledger.where("withheld"), "withheld")))


# --- sinks as queries ---------------------------------------------------------------------------------------------------
STORED = "SELECT user_id AS url, event_type AS title, CAST(event_id AS DOUBLE) AS score, CASE WHEN event_id % 3 = 0 THEN event_id END AS published, event_id AS seq FROM events WHERE event_type IN ('view', 'signup')"
FRESH = "SELECT user_id + 20 AS url, event_type AS title, value AS score, CASE WHEN event_id % 2 = 0 THEN event_id END AS published, event_id AS seq FROM events WHERE event_type NOT IN ('view', 'signup')"


UPSERTED = f"""
WITH b AS (SELECT url, arg_max(title, seq) AS title, arg_max(score, seq) AS score, arg_max(published, seq) AS published FROM ({STORED}) GROUP BY 1),
d AS (SELECT url, arg_max(title, seq) AS title, arg_max(score, seq) AS score, arg_max(published, seq) FILTER (published IS NOT NULL) AS published FROM ({FRESH}) GROUP BY 1)
SELECT url, CASE WHEN d.title IS NOT NULL THEN d.title ELSE b.title END AS title, CASE WHEN d.title IS NOT NULL THEN d.score ELSE b.score END AS score,
 coalesce(d.published, b.published) AS published FROM b FULL JOIN d USING (url)"""


@query("b1_upsert", UPSERTED)
def _(t):
    base = t.sql(STORED).groupBy("url").agg(F.max_by("title", "seq").alias("title"), F.max_by("score", "seq").alias("score"),
                                           F.max_by("published", F.when(F.col("published").isNotNull(), F.col("seq"))).alias("published"))
    return sinks.upsert(base, t.sql(FRESH), ["url"], "seq", keep=("published",))


REG_OLD = "SELECT CASE WHEN s_nationkey < 20 THEN s_suppkey ELSE 1000000 + s_suppkey END AS registry_id, s_name AS publisher, CASE WHEN s_suppkey % 5 = 0 THEN DATE '2023-05-01' END AS archived_on FROM supplier"
REG_NEW = "SELECT CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey ELSE 2000000 + s_suppkey END AS registry_id, concat(s_name, ' v2') AS publisher FROM supplier"
REG_GONE = "SELECT CASE WHEN s_suppkey % 10 = 0 OR s_suppkey % 7 = 0 THEN s_suppkey ELSE -s_suppkey END AS registry_id, DATE '2024-01-01' AS archived_on FROM supplier"


@query("b2_registry_sync", f"""
WITH o AS ({REG_OLD}), n AS ({REG_NEW}), g AS ({REG_GONE}), j AS (SELECT registry_id, o.publisher AS op, n.publisher AS np, o.archived_on AS oa FROM o FULL JOIN n USING (registry_id))
SELECT j.registry_id, coalesce(np, op) AS publisher, CAST(CASE WHEN g.archived_on IS NOT NULL THEN coalesce(oa, g.archived_on) WHEN np IS NOT NULL THEN NULL ELSE oa END AS VARCHAR) AS archived_on
FROM j LEFT JOIN g USING (registry_id)""")
def _(t):
    return sinks.sync_registry(t.sql(REG_OLD), t.sql(REG_NEW), t.sql(REG_GONE)).withColumn("archived_on", F.col("archived_on").cast("string"))
