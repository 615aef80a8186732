"""Queries on increments, streams, file readers and scalar functions."""

from pyspark.sql import functions as F

from corrobora.functions import rules, sql as SQLF, text as T
from corrobora.operators.refile import refile_plan
from corrobora.plans.q_graph import CLOSURE, REACH
from corrobora.plans.q_matching import FILED, LIVE_TOPICS, PLACED, PLAN
from corrobora.plans.q_provenance import CLASSES
from corrobora.plans.registry import query
from corrobora.plans.views import view
from corrobora.operators import graph as G
from corrobora.sources import readers, sinks
from corrobora.streaming import intake as S
from corrobora.vocab import QUESTION_STOPWORDS, REGIONAL_TERMS

AS_OF = "2024-01-30 23:59:59"


def event_stream(t):
    return S.read_table_stream(t.spark, t.sf_dir, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(t, stream, keys, order, mode="append"):
    """Run a stream over what is there and return the newest row per key."""
    root = S.work_dir(t.spark, "stream")
    S.upsert_batches(stream, keys, order, f"{root}/table", f"{root}/log", mode).awaitTermination()
    return S.current_rows(t.spark, f"{root}/table", keys, order)


@query("l1_incremental_intake", """
SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1""")
def _(t):
    stream = S.read_table_stream(t.spark, t.sf_dir, "documents.parquet").select("source", "doc_id", "n_chars")
    return drain(t, stream, ["source"], "doc_id").select("source", "doc_id", "n_chars")


DAILY = """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"""


@query("l2_intake_stream", DAILY)
def _(t):
    out = drain(t, S.daily_counts(event_stream(t), "40 days"), ["day", "event_type"], "n", mode="update")
    return out.select(F.col("day").cast("date").cast("string").alias("day"), "event_type", "n")


@query("l2_intake_batch", """
WITH s AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-01-11', DATE '2024-01-31', INTERVAL 1 DAY) g(d))
SELECT CAST(day AS VARCHAR) AS day, count(event_id) AS n FROM s LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY 1""")
def _(t):
    from corrobora.operators.readiness import daily_intake
    rows = t.events.select("event_id", F.col("ts").cast("date").alias("created_on"))
    return daily_intake(rows, "2024-01-31").select(F.col("day").cast("string"), "n")


@query("l3_rolling_week_stream", """
WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type FROM events), w AS (SELECT CAST(d + CAST(unnest(range(1, 8)) AS INT) AS DATE) AS until, event_type FROM e)
SELECT CAST(until AS VARCHAR) AS until, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def _(t):
    out = drain(t, S.rolling_counts(event_stream(t), "40 days"), ["until", "event_type"], "n", mode="update")
    return out.select(F.col("until").cast("date").cast("string").alias("until"), "event_type", "n")


@query("l3_new_per_branch", f"""WITH RECURSIVE {REACH},
d AS (SELECT DISTINCT r.node_id, document_id, date_diff('day', retrieved_on, DATE '2001-12-31') AS age FROM reach r JOIN live_evidence USING (topic_id)
  JOIN evidence_sources USING (evidence_id) JOIN graph_docs USING (document_id))
SELECT node_id, count(*) FILTER (age BETWEEN 0 AND 7) AS week, count(*) FILTER (age BETWEEN 0 AND 30) AS month FROM d GROUP BY 1""")
def _(t):
    # Only documents of the month count; all others of a topic are one row without a document, which tells that there are some.
    age = F.date_diff(F.lit("2001-12-31").cast("date"), F.col("retrieved_on"))
    counted = t.graph_docs.select("document_id", F.when(age.between(0, 30), age).alias("age"))
    per_topic = (t.live_evidence.select("evidence_id", "topic_id").join(t.evidence_sources, "evidence_id").join(counted, "document_id")
                 .select("topic_id", F.when(F.col("age").isNotNull(), F.col("document_id")).alias("document_id"), "age").distinct())
    docs = (G.node_topics(t.nodes, t.topics).select("node_id", "topic_id").join(per_topic, "topic_id")
            .select("node_id", "document_id", "age").distinct())
    return docs.groupBy("node_id").agg(F.count_if(F.col("age") <= 7).alias("week"), F.count_if(F.col("age") <= 30).alias("month"))


# Every hand-out counts: an item handed out twice shows as 2.
@query("l5_read_markers", "SELECT DISTINCT user_id, event_type, 1 AS handed_out FROM events")
def _(t):
    root = S.work_dir(t.spark, "read")
    # Six files, one a batch, so that most items come back in later batches.
    t.events.select("event_type", "user_id", "ts").repartitionByRange(6, "ts").write.parquet(f"{root}/in")
    stream = S.read_table_stream(t.spark, f"{root}/in", files_per_trigger=1)
    hand_out = lambda items, batch_id: items.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
    S.mark_read(stream, ["event_type", "user_id"], f"{root}/log", f"{root}/state", hand_out).awaitTermination()
    return (t.spark.read.parquet(f"{root}/out").groupBy("user_id", "event_type")
            .agg(F.count("*").alias("handed_out")))


REQ = f"""rq AS (SELECT event_id AS request_id, user_id, ts FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '{AS_OF}'),
st AS (SELECT request_id, user_id, ts, CASE WHEN EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = rq.user_id AND v.ts >= rq.ts
   AND v.ts <= rq.ts + INTERVAL 120 MINUTE AND v.ts <= TIMESTAMP '{AS_OF}') THEN 'STARTED'
   WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 120 MINUTE THEN 'FAILED' ELSE 'QUEUED' END AS status FROM rq)"""


def status(t):
    ev = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    requests = ev.where("event_type = 'signup'").select(F.col("event_id").alias("request_id"), "user_id", "ts")
    return S.request_status(requests, ev.where("event_type = 'view'").select("user_id", "ts"), AS_OF)


@query("l6_request_status", f"WITH {REQ} SELECT request_id, user_id, status FROM st")
def _(t):
    return status(t).select("request_id", "user_id", "status")


@query("l6_next_waiting", f"WITH {REQ} SELECT request_id FROM st WHERE status = 'QUEUED' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 3 MINUTE AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 120 MINUTE ORDER BY ts, request_id LIMIT 1")
def _(t):
    return S.next_waiting(status(t), AS_OF).select("request_id")


# Every signup is a request; a purchase of the same user within two hours starts it.
@query("l6_stale_request_stream", """
WITH r AS (SELECT event_id AS request_id, user_id, ts AS q FROM events WHERE event_type = 'signup'),
p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT request_id, 'abandoned — queued over 120 minutes' AS reason FROM r
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = r.user_id AND p.ts BETWEEN q AND q + INTERVAL 120 MINUTE)
  AND q + INTERVAL 120 MINUTE <= least((SELECT max(q) FROM r), (SELECT max(ts) FROM p)) - INTERVAL 10 MINUTE""")
def _(t):
    ev = event_stream(t)
    requests = ev.where("event_type = 'signup'").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("queued_at"))
    starts = ev.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("started_at"))
    stream = S.stale_requests(requests, starts, on="user_id")
    return drain(t, stream, ["request_id"], "queued_at").select("request_id", "reason")


@query("l7_arrival_lag", """
SELECT date_diff('month', published_on, retrieved_on) // 6 AS half_years, count(*) AS documents FROM (
  SELECT date_trunc('month', published_on) AS published_on, date_trunc('month', retrieved_on) AS retrieved_on FROM graph_docs) GROUP BY 1""")
def _(t):
    months = (F.year("retrieved_on") * 12 + F.month("retrieved_on") - F.year("published_on") * 12 - F.month("published_on"))
    return t.graph_docs.groupBy(F.call_function("div", months, F.lit(6)).alias("half_years")).agg(F.count("*").alias("documents"))


# --- readers --------------------------------------------------------------------------------------
_FEED = """
SELECT concat('https://', CAST(doc_id AS STRING), '.example.com/', CAST(pos AS STRING)) AS link, concat('Story ', CAST(pos AS STRING)) AS title,
       regexp_replace(lower(sentence), '[^a-z ]', ''%s) AS words, CAST(pos AS INT) AS pos, doc_id FROM doc_sentences
"""
view("feed_xml", _FEED % "", _FEED % ", 'g'")


@query("a3_feed_entries", r"""SELECT link, title, trim(regexp_replace(words || ' & more', '\s+', ' ', 'g')) AS summary, CAST(DATE '2024-03-01' + pos % 28 AS VARCHAR) AS published_on FROM feed_xml""")
def _(t):
    f = t.feed_xml
    day = F.date_add(F.lit("2024-03-01").cast("date"), (F.col("pos") % 28).cast("int"))
    date = F.when(F.col("pos") % 2 == 0, F.date_format(day, "'Fri, 'dd MMM yyyy' 10:00:00 GMT'")).otherwise(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    item = F.concat(F.lit("<item><title>"), F.col("title"), F.lit("</title><link> "), F.col("link"), F.lit("</link><description>&lt;p&gt;"),
                    F.col("words"), F.lit("&lt;/p&gt; &amp;amp; more</description><pubDate>"), date, F.lit("</pubDate></item>"))
    # One feed per document; its entries are bounded by the document.
    feeds = f.select("doc_id", item.alias("item")).groupBy("doc_id").agg(F.concat(
        F.lit("<rss><channel><title>A feed</title>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("xml"))
    return readers.feed_entries(feeds.withColumnRenamed("doc_id", "feed")).select(
        "link", "title", "summary", F.col("published_on").cast("string"))


@query("g7_first_entries_per_feed", "SELECT doc_id, link FROM feed_xml QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 5")
def _(t):
    return readers.first_entries(t.feed_xml, 5, order="pos", key="doc_id").select("doc_id", "link")


_TERMS = "[" + ", ".join("'%s'" % x for x in REGIONAL_TERMS) + "]"
STIX = """SELECT p_partkey AS id, p_name AS name, concat('Group ', p_name, CASE p_size % 5 WHEN 0 THEN ' hits the Gulf and Oman' WHEN 1 THEN ' seen in IRAN' ELSE ' at home' END) AS description,
 CASE WHEN p_size % 7 = 0 THEN 'malware' ELSE 'intrusion-set' END AS type, p_size % 11 = 0 AS revoked, p_size % 13 = 0 AS old, p_size % 3 > 0 AS with_ref, p_brand AS bundle FROM part"""


@query("a4_stix_groups", f"""
SELECT CASE WHEN with_ref THEN 'G' || id END AS attack_id, name, array_to_string(list_filter({_TERMS}, lambda x: contains(lower(description), x)), ',') AS terms,
 len(list_filter({_TERMS}, lambda x: contains(lower(description), x))) > 0 AS regional FROM ({STIX}) WHERE type = 'intrusion-set' AND NOT revoked AND NOT old""")
def _(t):
    rows = t.sql(STIX)
    refs = F.when(F.col("with_ref"), F.array(
        F.struct(F.lit("other").alias("source_name"), F.lit("X").alias("external_id")),
        F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("G"), F.col("id").cast("string")).alias("external_id"))))
    obj = F.to_json(F.struct(F.array(F.struct("type", F.col("id").cast("string").alias("id"), "name", "description",
                                              F.when(F.col("revoked"), True).alias("revoked"), F.col("old").alias("x_mitre_deprecated"),
                                              refs.alias("external_references"))).alias("objects")))
    bundles = rows.select(F.from_json(obj, readers.STIX_SCHEMA).alias("b")).select("b.objects")
    return readers.stix_groups(bundles).select("attack_id", "name", F.array_join("matched_terms", ",").alias("terms"), "regional")


CVES = """SELECT l_partkey AS part, l_suppkey AS k, l_orderkey AS o, l_linenumber AS ln, l_quantity AS q, l_shipdate AS ts FROM lineitem"""


@query("a5_cve_records", f"""
WITH r AS (SELECT 'CVE-' || part AS cve_id, k, o, ln, CASE WHEN q < 10 THEN q / 10 WHEN q < 30 THEN q / 5 WHEN q < 45 THEN q / 8 END AS score,
  CASE WHEN ln % 3 = 0 THEN '' ELSE 'Flaw in part ' || part END AS description FROM ({CVES}) WHERE ts BETWEEN TIMESTAMP '1998-06-30 00:00:00' - INTERVAL 400 DAY AND TIMESTAMP '1998-06-30 00:00:00')
SELECT cve_id, arg_min('k' || k, k * 100000000 + o * 10 + ln) AS keyword, arg_min(description, k * 100000000 + o * 10 + ln) AS description, round(min_by_score, 4) AS score FROM (
  SELECT *, first_value(score) OVER (PARTITION BY cve_id ORDER BY k * 100000000 + o * 10 + ln) AS min_by_score FROM r) GROUP BY cve_id, min_by_score""")
def _(t):
    c = t.sql(CVES).withColumn("ts", F.col("ts").cast("timestamp"))
    metric = lambda test, value: F.when(test, F.array(F.struct(F.struct(value.alias("baseScore")).alias("cvssData"))))
    q = F.col("q")
    metrics = F.struct(metric(q < 10, q / 10).alias("cvssMetricV31"), metric(q < 30, q / 5).alias("cvssMetricV30"),
                       metric(q < 45, q / 8).alias("cvssMetricV2"))
    texts = F.when(F.col("ln") % 3 == 0, F.array(F.struct(F.lit("es").alias("lang"), F.lit("Fallo").alias("value")))).otherwise(F.array(
        F.struct(F.lit("es").alias("lang"), F.lit("Fallo").alias("value")),
        F.struct(F.lit("en").alias("lang"), F.concat(F.lit("Flaw in part "), F.col("part").cast("string")).alias("value"))))
    cve = F.struct(F.concat(F.lit("CVE-"), F.col("part").cast("string")).alias("id"), F.col("ts").alias("published"),
                   texts.alias("descriptions"), metrics.alias("metrics"))
    payloads = c.select(F.concat(F.lit("k"), F.col("k").cast("string")).alias("keyword"), (F.col("k") * 100000000 + F.col("o") * 10 + F.col("ln")).alias("keyword_pos"),
                        F.array(F.struct(cve.alias("cve"))).alias("vulnerabilities"))
    out = readers.cve_records(payloads, F.lit("1998-06-30").cast("timestamp"), 400)
    return out.select("cve_id", "keyword", "description", F.round("score", 4).alias("score"))


@query("a6_review_round_trip", f"""WITH {PLAN} SELECT evidence_id, action, old_topic, new_topic, reason FROM (SELECT CAST(evidence_id AS VARCHAR) AS evidence_id, action, old_topic, nullif(new_topic, '') AS new_topic, reason FROM pn)""")
def _(t):
    plan = refile_plan(t.sql(FILED), t.sql(PLACED), t.sql(LIVE_TOPICS))
    sheet = plan.select("evidence_id", "action", "old_pillar", "old_topic", "new_pillar", "new_topic", F.lit("").alias("new_topic_name"),
                        "reason", F.lit("").alias("ew_hook"), F.lit("a, \"quoted\" claim").alias("claim"))
    path = S.work_dir(t.spark, "review")
    sinks.write_review(sheet, path)
    return readers.read_review(t.spark, path).select("evidence_id", "action", "old_topic", F.nullif("new_topic", F.lit("")).alias("new_topic"), "reason")


SEED = """SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN '# ' WHEN 1 THEN '  ' ELSE '' END, url, '   # ', CAST(1 + page_id % 4 AS STRING), ' · Site ', CAST(page_id AS STRING), ' · A title', CASE WHEN page_id % 3 = 0 THEN '' ELSE ' · EW-T10, EW-T11' END) AS value FROM pages"""


@query("a7_seed_list", """
SELECT url, CAST(1 + page_id % 4 AS VARCHAR) AS tier, 'Site ' || page_id AS publisher, 'A title' AS title, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'EW-T10, EW-T11' END AS topics FROM pages WHERE page_id % 5 > 0""")
def _(t):
    return readers.seed_lines(t.sql(SEED).select("value"))


@query("b4_review_summary", f"WITH {PLAN} SELECT action, count(*) AS n FROM pn GROUP BY 1")
def _(t):
    plan = refile_plan(t.sql(FILED), t.sql(PLACED), t.sql(LIVE_TOPICS))
    path = S.work_dir(t.spark, "sheet")
    sinks.write_review(plan, path)
    return t.spark.read.option("header", "true").option("escape", '"').csv(path).groupBy("action").agg(F.count("*").alias("n"))


# --- scalar functions -----------------------------------------------------------------------------------
_STOP = "[" + ", ".join("'%s'" % w for w in QUESTION_STOPWORDS) + "]"


@query("i_search_query", rf"""
WITH q AS (SELECT conv_id, turn, lower(text) || CASE conv_id % 4 WHEN 0 THEN ' drone jamming' ELSE '' END AS x FROM (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'How will drone counter-uas jamming ' ELSE '' END || text AS text FROM conversations)),
w AS (SELECT conv_id, turn, regexp_extract_all(x, '[a-z][a-z0-9-]+') AS w FROM q), e AS (SELECT conv_id, turn, unnest(w) AS w, unnest(range(len(w))) AS k FROM w),
f AS (SELECT conv_id, turn, w, min(k) AS k FROM e WHERE length(w) >= 3 AND NOT list_contains({_STOP}, w) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS rn FROM f),
p AS (SELECT conv_id, turn, rn, CASE w WHEN 'drone' THEN '("drone" OR "drones" OR "UAS" OR "UAV")' WHEN 'jamming' THEN '("jamming" OR "jammer" OR "electronic warfare")'
   WHEN 'counter-uas' THEN '("counter-UAS" OR "counter-drone" OR "C-UAS")' ELSE CASE WHEN contains(w, '-') THEN '"' || w || '"' ELSE w END END AS part FROM r WHERE rn <= 4),
a AS (SELECT conv_id, turn, string_agg(part, ' ' ORDER BY rn) AS query FROM p GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(query, '') AS query FROM conversations LEFT JOIN a USING (conv_id, turn)""")
def _(t):
    text = F.concat(F.when(F.col("conv_id") % 4 == 0, "How will drone counter-uas jamming ").otherwise(""), F.col("text"),
                    F.when(F.col("conv_id") % 4 == 0, " drone jamming").otherwise(""))
    return t.conversations.select("conv_id", "turn", T.search_query(text).alias("query"))


@query("i_labels", """
SELECT signal_id, CASE strength WHEN 'STRONG' THEN 'Strong' WHEN 'STRONG_EMERGING' THEN 'Strong-Emerging' WHEN 'EMERGING' THEN 'Emerging' ELSE 'Weak' END AS strength,
 CASE direction WHEN 'STRENGTHENING' THEN 'Strengthening' WHEN 'UNCERTAIN' THEN 'Uncertain' ELSE 'Weakening' END AS direction, pillar FROM signals""")
def _(t):
    return t.signals.select("signal_id", rules.label(F.col("strength")).alias("strength"),
                            rules.label(F.col("direction")).alias("direction"), rules.label(F.col("pillar")).alias("pillar"))


_NAMED = "CASE {0} WHEN 'STRONG' THEN 'Strong' WHEN 'STRONG_EMERGING' THEN 'Strong-Emerging' WHEN 'EMERGING' THEN 'Emerging' WHEN 'WEAK' THEN 'Weak' WHEN 'STRENGTHENING' THEN 'Strengthening' WHEN 'UNCERTAIN' THEN 'Uncertain' WHEN 'WEAKENING' THEN 'Weakening' ELSE {0} END"


@query("i_labels_nested", f"""
SELECT signal_id, {_NAMED.format('strength')} AS top, direction AS other_name, {_NAMED.format('direction')} AS in_struct, {_NAMED.format('strength')} || '|WEAKER|' || {_NAMED.format('direction')} AS in_array,
  {_NAMED.format('strength')} || '/' || strength AS in_map, {_NAMED.format('direction')} AS in_list_of_structs, 'Open,kept' AS in_map_of_lists FROM signals""")
def _(t):
    deep = F.struct(F.col("direction"), F.col("direction").alias("said"), F.array("strength", F.lit("WEAKER"), "direction").alias("status"))
    rows = t.signals.select("signal_id", "strength", deep.alias("deep"),
                            F.create_map(F.lit("horizon"), "strength", F.lit("note"), "strength").alias("m"),
                            F.array(F.struct(F.struct(F.col("direction").alias("gate")).alias("inner"))).alias("l"),
                            F.create_map(F.lit("pillar"), F.array(F.lit("OPEN"), F.lit("kept"))).alias("ml"))
    out = rules.humanised(rows)
    return out.select("signal_id", F.col("strength").alias("top"), F.col("deep.said").alias("other_name"), F.col("deep.direction").alias("in_struct"),
                      F.array_join("deep.status", "|").alias("in_array"), F.concat(F.col("m")["horizon"], F.lit("/"), F.col("m")["note"]).alias("in_map"),
                      F.col("l")[0]["inner"]["gate"].alias("in_list_of_structs"), F.array_join(F.col("ml")["pillar"], ",").alias("in_map_of_lists"))


@query("i_payload_size", """
WITH j AS (SELECT pillar, length('{"id":' || evidence_id || ',"class":"' || class || '","topic":"' || topic_id || '"}') AS n FROM live_evidence),
s AS (SELECT pillar, 1 + sum(n + 1) AS chars FROM j GROUP BY 1) SELECT pillar, chars, chars > 260000 AS over_budget FROM s""", longs=('chars',))
def _(t):
    # Length of the JSON array from the lengths of its rows: nothing is collected.
    row = F.to_json(F.struct(F.col("evidence_id").alias("id"), "class", F.col("topic_id").alias("topic")))
    out = t.live_evidence.groupBy("pillar").agg((F.sum(F.length(row) + 1) + 1).alias("chars"))
    return out.withColumn("over_budget", F.col("chars") > 260000)


@query("i_lead_snippet", r"""
WITH l AS (SELECT report_id, trim(regexp_replace(regexp_replace(regexp_replace(body_md, '\[[^\]]*\]', '', 'g'), '\s+', ' ', 'g'), '\s+([.,;:])', '\1', 'g')) AS x FROM reports)
SELECT report_id, CASE WHEN length(x) > 220 THEN regexp_replace(left(x, 220), '\s\S*$', '') || '…' ELSE x END AS lead FROM l""")
def _(t):
    return t.reports.select("report_id", T.lead_snippet(F.col("body_md")).alias("lead"))


@query("i_digest_keys", "SELECT doc_id, left(sha256(text), 16) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", F.left(F.sha2("text", 256), F.lit(16)).alias("digest"))


@query("i_compact_dates", """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE event_id % 10 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 10 = 3""")
def _(t):
    seen = F.when(F.col("event_id") % 10 == 3, "unknown").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    return t.events.select("event_id", T.compact_date(seen).cast("string").alias("day"))


@query("m_sql_functions", f"WITH {CLASSES} SELECT evidence_id, publishers, class, confidence FROM classes")
def _(t):
    SQLF.register_functions(t.spark)
    return t.sql("""SELECT evidence_id, coalesce(publishers, 0) AS publishers, evidence_class(best_tier, publishers) AS class,
      evidence_confidence(best_tier, publishers) AS confidence FROM live_evidence LEFT JOIN (
        SELECT evidence_id, count(registry_id) AS publishers, min(tier) AS best_tier FROM (
          SELECT evidence_id, registry_id, min(tier) AS tier FROM evidence_sources LEFT JOIN graph_docs USING (document_id) LEFT JOIN registry USING (registry_id)
          GROUP BY evidence_id, registry_id) x GROUP BY evidence_id) p USING (evidence_id)""")


# Inputs of every band, from customers.
BANDS = """SELECT c_custkey AS k, CAST(c_custkey % 5 AS BIGINT) AS base, CAST(c_nationkey % 5 AS BIGINT) AS pubs, CAST(1 + c_nationkey % 4 AS INT) AS tier, CAST(c_custkey % 4 AS BIGINT) AS unc,
 CASE c_custkey % 6 WHEN 0 THEN 'H0_3' WHEN 1 THEN 'H3_5' WHEN 2 THEN 'H5_10' WHEN 3 THEN 'H7_PLUS' WHEN 4 THEN 'soon' END AS horizon,
 CASE c_nationkey % 5 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'STRONG_EMERGING' WHEN 2 THEN 'EMERGING' WHEN 3 THEN 'WEAK' END AS sa,
 CASE c_custkey % 5 WHEN 0 THEN 'WEAK' WHEN 1 THEN 'STRONG' WHEN 2 THEN 'none' WHEN 3 THEN 'EMERGING' END AS sb FROM customer"""


@query("m_sql_calibrate", f"""
WITH s AS (SELECT *, base + CASE WHEN pubs >= 3 THEN 2 WHEN pubs = 2 THEN 1 ELSE 0 END + CASE horizon WHEN 'H0_3' THEN 0 WHEN 'H3_5' THEN -1 WHEN 'H5_10' THEN -2 WHEN 'H7_PLUS' THEN -3 ELSE -2 END
  - least(unc, 2) AS score FROM ({BANDS}))
SELECT k, CASE WHEN score >= 4 THEN 'LIKELY' WHEN score >= 2 THEN 'POSSIBLE' WHEN score >= 1 THEN 'UNCERTAIN' ELSE 'SPECULATIVE' END AS plausibility,
 CASE WHEN score >= 4 AND pubs >= 3 AND base >= 3 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM_HIGH' WHEN score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, CAST(score AS INT) AS score FROM s""")
def _(t):
    SQLF.register_functions(t.spark)
    return t.sql(f"SELECT k, f.plausibility, f.confidence, f.score FROM (SELECT k, calibrate(base, pubs, horizon, unc) AS f FROM ({BANDS}))")


@query("m_sql_bands", f"""
WITH r AS (SELECT *, CASE sa WHEN 'STRONG' THEN 3 WHEN 'STRONG_EMERGING' THEN 2 WHEN 'EMERGING' THEN 2 ELSE 1 END + CASE sb WHEN 'STRONG' THEN 3 WHEN 'STRONG_EMERGING' THEN 2 WHEN 'EMERGING' THEN 2 ELSE 1 END AS total FROM ({BANDS}))
SELECT k, CASE WHEN pubs >= 3 THEN 'STRONG' WHEN pubs = 2 AND tier = 1 THEN 'STRONG_EMERGING' WHEN pubs = 2 THEN 'EMERGING' ELSE 'WEAK' END AS strength,
 CASE WHEN pubs <= 1 AND tier >= 4 THEN 'UNCERTAIN' END AS direction, base >= 2 AND pubs >= 2 AS gate, CASE WHEN base >= 3 THEN 3 WHEN base >= 1 THEN 2 ELSE 1 END AS band,
 greatest(1, least(3, total // 2)) AS severity, CASE WHEN base = 0 THEN 'Empty' WHEN pubs >= 3 AND unc >= 1 THEN 'Ready' ELSE 'Thin' END AS ready,
 CASE WHEN NOT (base >= 2 AND pubs >= 2) THEN 'OPEN' WHEN horizon = 'soon' THEN horizon END AS state FROM r""")
def _(t):
    SQLF.register_functions(t.spark)
    return t.sql(f"""SELECT k, signal_strength(pubs, tier) AS strength, forced_direction(pubs, tier) AS direction, gate_satisfied(base, pubs) AS gate, risk_band(base, 1, 3) AS band,
      cross_impact_severity(sa, sb) AS severity, readiness(base, pubs, unc) AS ready,
      gate_state(gate_satisfied(base, pubs), CASE WHEN horizon = 'soon' THEN horizon END) AS state FROM ({BANDS})""")


def tree_functions(t):
    assert t.nodes.columns and t.topics.columns         # reading a view creates it
    return SQLF.register_tree_functions(t.spark, f"{t._tag}nodes", f"{t._tag}topics")


@query("m_subtree_function", f"WITH RECURSIVE {CLOSURE} SELECT root_id, node_id, kind, depth FROM closure")
def _(t):
    tree_functions(t)
    return t.sql("SELECT r.node_id AS root_id, s.node_id, s.kind, s.depth FROM nodes r, LATERAL subtree(r.node_id) s")


@query("m_path_function", f"WITH RECURSIVE {CLOSURE} SELECT node_id, root_id AS above, depth AS distance FROM closure")
def _(t):
    tree_functions(t)
    return t.sql("SELECT n.node_id, p.node_id AS above, p.distance FROM nodes n, LATERAL path_to_root(n.node_id) p")


@query("m_node_topics_function", f"WITH RECURSIVE {REACH} SELECT node_id, topic_id, via FROM reach")
def _(t):
    tree_functions(t)
    return t.sql("SELECT n.node_id, x.topic_id, x.via FROM nodes n, LATERAL node_topics(n.node_id) x")


@query("i_ordered_insert", """
WITH c AS (SELECT signal_id, list_sort(list_distinct([direction, strength, pillar])) AS l FROM signals)
SELECT signal_id, array_to_string(l[1:1] || ['forecast'] || l[2:], '>') AS sections FROM c""")
def _(t):
    parts = F.array_sort(F.array_distinct(F.array("direction", "strength", "pillar")))
    return t.signals.withColumn("l", parts).select("signal_id", F.array_join(F.array_insert("l", 2, F.lit("forecast")), ">").alias("sections"))


@query("i_merge_counts", """
SELECT custkey AS scope, array_to_string(list_sort(list_transform(map_entries(m), lambda e: e.key || '=' || e.value)), ',') AS counts FROM (
  SELECT c_custkey AS custkey, map_concat(MAP {'rules': c_nationkey, 'extract': 1}, MAP {'rules': c_nationkey + 1, lower(c_mktsegment): 2}) AS m FROM customer)""")
def _(t):
    from corrobora.functions.text import merge_counts
    c = t.customer
    old = F.create_map(F.lit("rules"), F.col("c_nationkey"), F.lit("extract"), F.lit(1))
    new = F.create_map(F.lit("rules"), F.col("c_nationkey") + 1, F.lower("c_mktsegment"), F.lit(2))
    entries = F.transform(F.map_entries(merge_counts(old, new)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return c.select(F.col("c_custkey").alias("scope"), F.array_join(F.array_sort(entries), ",").alias("counts"))


@query("g1_first_mention", """
SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2""")
def _(t):
    from corrobora.functions.text import first_mention
    return first_mention(t.events.select("event_type", "user_id", "event_id"), ["event_type", "user_id"], "event_id")
