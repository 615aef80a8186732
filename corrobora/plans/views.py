"""Provenance tables derived from the star-schema tables the checks run on.

The ontology (registry, evidence, signals, topics, reports ...) is mapped onto
the given tables by rule, so that every operator runs over whole tables.  Most
views are one SQL text both engines accept; where array or regex dialects
differ, a view has a Spark text and a DuckDB text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corrobora.sources.readers import spread

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Tables whose rows are long texts: work per row, not per byte, dominates.
TEXT_TABLES = ("documents", "pages", "conversations")

SPARK: dict[str, str] = {}
DUCK: dict[str, str] = {}


def view(name: str, sql: str, duck: str | None = None) -> None:
    SPARK[name], DUCK[name] = sql, duck or sql


# --- sources and documents -----------------------------------------------------
view("registry", """
SELECT s_suppkey AS registry_id, s_name AS publisher,
       CAST(CASE WHEN s_suppkey % 20 = 0 THEN 1 WHEN s_suppkey % 20 < 5 THEN 2
                 WHEN s_suppkey % 20 < 11 THEN 3 ELSE 4 END AS INT) AS tier,
       CASE WHEN s_suppkey % 3 = 0 THEN 'rss' WHEN s_suppkey % 3 = 1 THEN 'scrape' ELSE 'search' END AS method,
       r_name AS pillar, s_nationkey AS nation_key, s_suppkey % 23 = 11 AS archived
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")

# One document per (part, supplier); six publishers of ten stay unresolved.
view("graph_docs", """
SELECT concat('D', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS document_id,
       CASE WHEN l_partkey % 5 < 3 THEN NULL ELSE l_suppkey END AS registry_id,
       concat('https://s', CAST(l_suppkey AS STRING), '.example.com/p/', CAST(l_partkey AS STRING)) AS url,
       concat('Part ', CAST(l_partkey AS STRING)) AS title,
       CAST(max(l_shipdate) AS DATE) AS retrieved_on,
       CAST(min(l_shipdate) AS DATE) AS published_on
FROM lineitem GROUP BY l_partkey, l_suppkey
""")

# Every line carries a source.  Most documents are unresolved (graph_docs), so that
# 0, 1, 2 and more publishers all occur.
view("evidence_sources", """
SELECT DISTINCT l_orderkey AS evidence_id,
       concat('D', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS document_id
FROM lineitem
""")

# The same with its repeats, for what counts distinct values later: no row moves to meet its copies.
view("evidence_source_lines", """
SELECT l_orderkey AS evidence_id,
       concat('D', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS document_id
FROM lineitem
""")

view("evidence", """
SELECT o_orderkey AS evidence_id, r_name AS pillar,
       concat('T', CAST(n_nationkey AS STRING), '-', substr(o_orderpriority, 1, 1)) AS topic_id,
       CASE WHEN o_orderkey % 10 < 1 THEN 'UAE' WHEN o_orderkey % 10 < 4 THEN 'REGIONAL'
            ELSE 'GLOBAL' END AS env_layer,
       CASE WHEN o_orderkey % 4 = 0 THEN 'A' WHEN o_orderkey % 4 = 1 THEN 'B' ELSE 'C' END AS class,
       CASE WHEN o_orderkey % 4 = 0 THEN 'HIGH' WHEN o_orderkey % 4 = 1 THEN 'MEDIUM_HIGH' ELSE 'LOW' END AS confidence,
       o_orderkey % 17 = 0 AS archived, CAST(o_orderdate AS DATE) AS created_on, o_custkey AS scope,
       n_nationkey AS nation_key, c_mktsegment AS segment,
       concat(CAST(o_custkey AS STRING), '-', o_orderpriority) AS signal_id
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")

view("live_evidence", "SELECT * FROM evidence WHERE NOT archived")

view("signals", """
SELECT signal_id, min(scope) AS scope, min(pillar) AS pillar,
       concat('Orders of customer ', min(CAST(scope AS STRING)), ' at ', min(signal_id)) AS statement,
       CASE WHEN min(scope) % 4 = 0 THEN 'WEAK' WHEN min(scope) % 4 = 1 THEN 'EMERGING'
            WHEN min(scope) % 4 = 2 THEN 'STRONG_EMERGING' ELSE 'STRONG' END AS strength,
       CASE WHEN min(scope) % 3 = 0 THEN 'STRENGTHENING' WHEN min(scope) % 3 = 1 THEN 'UNCERTAIN'
            ELSE 'WEAKENING' END AS direction,
       max(created_on) AS created_on
FROM evidence GROUP BY signal_id
""")

view("signal_evidence", "SELECT signal_id, evidence_id FROM evidence")

view("findings", """
SELECT concat('F-', CAST(scope AS STRING)) AS finding_id, scope, min(pillar) AS pillar,
       concat('Finding on customer ', CAST(scope AS STRING)) AS statement
FROM evidence GROUP BY scope
""")

view("risks", """
SELECT concat('R-', CAST(nation_key AS STRING), '-', segment) AS risk_id, min(pillar) AS pillar,
       CAST(1 + nation_key % 3 AS INT) AS likelihood, CAST(1 + length(segment) % 3 AS INT) AS impact
FROM evidence GROUP BY nation_key, segment
""")

view("links", """
SELECT DISTINCT signal_id AS from_id, 'signal' AS from_type,
       concat('F-', CAST(scope AS STRING)) AS to_id, 'finding' AS to_type, 'derivedFrom' AS rel FROM evidence
UNION ALL
SELECT DISTINCT signal_id, 'signal', concat('TR-', CAST(nation_key AS STRING), '-', segment), 'trend', 'feeds' FROM evidence
UNION ALL
SELECT DISTINCT concat('F-', CAST(scope AS STRING)), 'finding',
       concat('R-', CAST(nation_key AS STRING), '-', segment), 'risk', 'feeds' FROM evidence
""")

# What hangs off synthesis objects: it goes with them.
view("uncertainties", """
SELECT concat('CU-', topic_id) AS uncertainty_id, min(topic_id) AS topic_id, concat('What next in ', min(topic_id), '?') AS question
FROM evidence GROUP BY topic_id
""")

view("implications", """
SELECT DISTINCT concat('IMP-', CAST(scope AS STRING), '-', env_layer) AS implication_id,
       concat('F-', CAST(scope AS STRING)) AS finding_id, env_layer FROM evidence
""")

view("trend_impacts", """
SELECT DISTINCT concat('TR-', CAST(nation_key AS STRING), '-', segment) AS from_trend,
       concat('TR-', CAST((nation_key * 3 + o.scope) % 25 AS STRING), '-', segment) AS to_trend FROM evidence o
""")

view("scenario_uncertainties", """
SELECT DISTINCT concat('SC-', pillar, '-', segment) AS scenario_id, concat('CU-', topic_id) AS uncertainty_id FROM evidence
""")

view("gates", """
SELECT concat('VG-', substr(r_name, 1, 2), '-', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS gate_id,
       r_name AS pillar, CASE WHEN n_nationkey % 3 = 0 THEN 'PASSED' ELSE 'OPEN' END AS status,
       concat('Any UAE-specific capability-gap claim for the ', r_name, ' pillar') AS blocks
FROM nation JOIN region ON n_regionkey = r_regionkey
""")

# --- topic tree -----------------------------------------------------------------
view("nodes", """
SELECT 'ROOT' AS node_id, CAST(NULL AS STRING) AS parent_id, 'root' AS kind, 'All regions' AS name, count(*) * 0 AS sort FROM region
UNION ALL
SELECT concat('R', CAST(r_regionkey AS STRING)), 'ROOT', 'branch', r_name, r_regionkey FROM region
UNION ALL
SELECT concat('N', CAST(n_nationkey AS STRING)), concat('R', CAST(n_regionkey AS STRING)), 'function', n_name, n_nationkey FROM nation
""")

_TOPICS = """
SELECT topic_id, min(pillar) AS pillar, concat('Topic ', topic_id) AS name,
       concat('N', CAST(nation_key AS STRING)) AS node_id,
       %s AS functions,
       CASE WHEN nation_key %% 6 = 1 THEN '' WHEN nation_key %% 6 = 2 THEN NULL ELSE 'Changes the branch' END AS impact,
       (nation_key + length(topic_id)) %% 11 = 4 AS retired, nation_key
FROM evidence GROUP BY topic_id, nation_key
"""
view("topics",
     _TOPICS % "array(concat('N', CAST(nation_key AS STRING)), concat('N', CAST((nation_key * 7 + 3) % 27 AS STRING)))",
     _TOPICS % "[concat('N', CAST(nation_key AS STRING)), concat('N', CAST((nation_key * 7 + 3) % 27 AS STRING))]")

# Spark joins the few topics of a nation, not its evidence, to its sources.
view("topic_sources",
     "SELECT DISTINCT topic_id, s_suppkey AS registry_id FROM (SELECT DISTINCT topic_id, nation_key FROM evidence) e JOIN supplier ON nation_key = s_nationkey",
     "SELECT DISTINCT topic_id, s_suppkey AS registry_id FROM evidence JOIN supplier ON nation_key = s_nationkey")

# --- text -----------------------------------------------------------------------
view("doc_sentences",
     r"""
SELECT doc_id, source, lang, pos, sentence FROM (
  SELECT doc_id, source, lang, posexplode(split(text, r'(?<=[.!?])\s+(?=[A-Z\[])')) AS (pos, sentence) FROM documents)
""",
     r"""
SELECT doc_id, source, lang, unnest(range(len(l))) AS pos, unnest(l) AS sentence FROM (
  SELECT doc_id, source, lang,
         string_split(regexp_replace(text, '([.!?])\s+([A-Z\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l
  FROM documents)
""")

# Proposed statements: each sentence behind an opening that exercises one rule.
view("statements", """
SELECT doc_id, pos, concat('P', CAST(doc_id AS STRING), '-', CAST(pos AS STRING)) AS proposal_id,
       concat(CASE (doc_id + pos) % 10
                WHEN 0 THEN 'Protection is critical for this: '
                WHEN 1 THEN 'Forces must prioritise this: '
                WHEN 2 THEN 'Jamming outpaces mitigation here: '
                WHEN 3 THEN 'Spectrum shifts lock-in: '
                WHEN 4 THEN 'Sensors should be seen here: '
                WHEN 5 THEN 'By [Year], supply falls: '
                WHEN 6 THEN 'A share of XX percent moves: '
                WHEN 7 THEN 'As [EV-12] says, no longer: '
                WHEN 8 THEN 'Not layered fences alone: '
                ELSE '' END, sentence) AS statement
FROM doc_sentences
""")

# Quotes that name a nation, a region, both as a list, or neither.
view("quotes", """
SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN 'UAE' WHEN 1 THEN 'uae' ELSE 'REGIONAL' END AS proposed,
       concat(CASE (doc_id + pos) % 9
                WHEN 0 THEN 'Middle East, Gulf or UAE targeting rose: '
                WHEN 1 THEN 'Abu Dhabi signed a contract: '
                WHEN 2 THEN 'Across the Gulf: '
                WHEN 3 THEN 'The UAE and the region gain: '
                WHEN 4 THEN 'Dubai, the Gulf and others: '
                WHEN 5 THEN 'The U.A.E. tests it: '
                WHEN 6 THEN 'GCC and Emirati forces: '
                WHEN 7 THEN 'Dubai, though regional talks stall, '
                ELSE '' END, sentence) AS quote
FROM doc_sentences
""")

_DECOR = """concat(
  CASE WHEN {i} % 5 = 0 THEN concat(chr(10), chr(10), '## ',
         CASE (doc_id + CAST(floor({i} / 5) AS BIGINT)) % 7
           WHEN 0 THEN 'Executive Summary' WHEN 1 THEN 'Findings' WHEN 2 THEN 'Limits'
           WHEN 3 THEN 'Scenarios' WHEN 4 THEN 'Recommended Actions' WHEN 5 THEN 'Outlook'
           ELSE 'Unlisted Heading' END, chr(10))
       WHEN {i} % 7 = 3 THEN concat(chr(10), '- ')
       WHEN {i} % 11 = 6 THEN concat(chr(10), chr(10), '**An action title in bold words**', chr(10))
       ELSE ' ' END,
  CASE (doc_id * 7 + {i}) % 13
    WHEN 1 THEN 'The UAE lacks coverage because ' WHEN 2 THEN 'Mandate that '
    WHEN 3 THEN 'So what: ' WHEN 4 THEN '**Trigger**: ' WHEN 5 THEN 'However, if '
    WHEN 6 THEN 'This report is insufficient: '
    WHEN 7 THEN 'The validation gate is open and requires validation of '
    WHEN 8 THEN 'It may be that ' WHEN 9 THEN 'The proposed option is ' ELSE '' END,
  regexp_replace({s}, '[.!? ]+$', ''),
  CASE WHEN {i} % 3 = 0 THEN concat(' [EV-', CAST(doc_id * 7 + {i} * 13 AS STRING), '].')
       WHEN {i} % 10 = 7 THEN concat(' per F-CS-', lpad(CAST({i} % 70 AS STRING), 2, '0'), '.')
       WHEN {i} % 10 = 1 THEN concat(' as [FIG-', CAST({i} % 9 AS STRING), ', FIG-', CAST({i} % 4 AS STRING), '] shows.')
       ELSE '.' END)"""
_REPORT = """
SELECT doc_id AS report_id, doc_id, r_name AS pillar, concat('Report ', CAST(doc_id AS STRING)) AS title, source,
       concat('# Report ', CAST(doc_id AS STRING), %s, chr(10), chr(10), '## References', chr(10), chr(10),
              '[EV-', CAST(doc_id * 7 AS STRING), '] First title — https://example.com/a', chr(10),
              '[EV-9999999991; EV-9999999992] Second title', chr(10), '[EV-', CAST(doc_id * 7 + 39 AS STRING), ', EV-9999999993] Third title') AS body_md
FROM (SELECT doc_id, source, %s AS l FROM documents) d JOIN region ON doc_id %% 5 = r_regionkey
"""
view("reports",
     _REPORT % ("array_join(transform(l, (s, i) -> " + _DECOR.format(i="i", s="s") + "), '')",
                r"split(text, r'(?<=[.!?])\s+(?=[A-Z\[])')"),
     _REPORT % ("array_to_string(list_transform(l, lambda s, j: " + _DECOR.format(i="(j - 1)", s="s") + "), '')",
                r"string_split(regexp_replace(text, '([.!?])\s+([A-Z\[])', '\1' || chr(1) || '\2', 'g'), chr(1))"))

view("template_sections", """
SELECT * FROM (VALUES ('Executive Summary', 'exec_summary'), ('Findings', 'findings'), ('Limits', 'limits'),
  ('Scenarios', 'scenarios'), ('Recommended Actions', 'actions'), ('Outlook', 'outlook')) AS t(title, section_key)
""")

# Everything a report may cite, by kind.
view("graph_objects", """
SELECT concat('EV-', CAST(evidence_id AS STRING)) AS cited_id, 'evidence' AS kind, class FROM evidence WHERE NOT archived
UNION ALL SELECT DISTINCT concat('F-CS-', lpad(CAST(p_size AS STRING), 2, '0')), 'finding', CAST(NULL AS STRING) FROM part
UNION ALL SELECT DISTINCT concat('FIG-', CAST(p_size % 8 AS STRING)), 'figure', CAST(NULL AS STRING) FROM part
UNION ALL SELECT gate_id, 'gate', CAST(NULL AS STRING) FROM gates
""")


# --- access ----------------------------------------------------------------------
_NAMES = re.compile(r"[a-z_]+")


def _used(sql: str) -> list[str]:
    """Names of views a SQL text mentions outside string literals."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", sql)
    return [n for n in dict.fromkeys(_NAMES.findall(bare)) if n in SPARK]


def oracle(sql: str) -> str:
    """A DuckDB text with the views it needs as CTEs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _used(text):
            if name not in order:
                visit(DUCK[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    ctes = [f"{n} AS ({DUCK[n].strip()})" for n in order]
    body = sql.strip()
    if not ctes:
        return body
    found = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if found:
        keyword = "WITH RECURSIVE " if found.group(1) else "WITH "
        return keyword + ",\n".join(ctes) + ",\n" + body[found.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Base tables and derived views of one data directory, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._tag = "v" + re.sub(r"\W", "_", self.sf_dir) + "_"
        self._known: dict[str, DataFrame] = {}

    def sql(self, text: str) -> DataFrame:
        """Run a Spark SQL text that may name base tables and views."""
        for name in _used(text) + [b for b in BASE if re.search(rf"\b{b}\b", text)]:
            getattr(self, name)
        pattern = r"(?<![\w'.])(%s)(?![\w'(])" % "|".join(
            sorted(set(SPARK) | set(BASE), key=len, reverse=True))
        return self.spark.sql(re.sub(r"(?<=FROM )" + pattern + r"|(?<=JOIN )" + pattern,
                                     lambda m: self._tag + (m.group(1) or m.group(2)), text))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in BASE:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                if name in TEXT_TABLES:
                    df = spread(df)
            elif name in SPARK:
                df = self.sql(SPARK[name])
            else:
                raise AttributeError(name)
            df.createOrReplaceTempView(self._tag + name)
            self._known[name] = df
        return self._known[name]
