"""Queries on pages, domains, evidence validation and collection."""

from pyspark.sql import functions as F

from corrobora.functions import text as T
from corrobora.operators import intake as I, provenance as P
from corrobora.plans.registry import query
from corrobora.plans.views import view

_ENT = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape_sql(c: str) -> str:
    for entity, char in _ENT:
        c = f"replace({c}, '{entity}', '{char}')"
    return c


def text_sql(c: str) -> str:
    out = f"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav", "footer", "header", "form", "aside", "noscript"):
        out = rf"regexp_replace({out}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    out = unescape_sql(f"regexp_replace({out}, '(?s)<[^>]+>', ' ', 'g')")
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def title_sql(html: str, url: str) -> str:
    raw = unescape_sql(f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)")
    return rf"coalesce(nullif(regexp_replace({raw}, '^\s+|\s+$', '', 'g'), ''), {url})"


HOST = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '')"
BLOCK = ("access denied", "you don''t have permission", "403 forbidden", "are you a robot", "enable javascript",
         "checking your browser", "request unsuccessful", "captcha")
LOST = ("404", "page not found", "page cannot be found", "page doesn''t exist", "page does not exist", "no longer available")


def blocked_sql(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower(left({text}, 600)), '{m}')" for m in BLOCK) + ")"


def lost_sql(text: str, title: str) -> str:
    probe = f"(lower(coalesce({title}, '')) || ' ' || left(lower(left({text}, 600)), 180))"
    return "(" + " OR ".join(f"contains({probe}, '{m}')" for m in LOST) + ")"


PAGES = f"""pg AS (SELECT page_id, url, html, {title_sql('html', 'url')} AS title, {text_sql('html')} AS text FROM pages)"""


@query("a2_html_text", f"WITH {PAGES} SELECT page_id, title, text, {HOST.format('url')} AS host FROM pg")
def _(t):
    return I.page_documents(t.pages).select("page_id", "title", "text", "host")


# Texts behind openings that servers give for refused or lost pages.
view("served", """
SELECT page_id, url, concat(CASE page_id % 11 WHEN 4 THEN 'Page Not Found ' WHEN 8 THEN 'Error 404 ' ELSE 'Index ' END, url) AS title,
       CASE WHEN page_id % 13 = 5 THEN 'Short stub'
            ELSE concat(CASE page_id % 9 WHEN 0 THEN 'Access Denied. ' WHEN 1 THEN 'You need to ENABLE JavaScript. '
                          WHEN 2 THEN 'This item is no longer available. ' ELSE '' END, html) END AS text
FROM pages
""")


@query("c4_page_status", f"""
SELECT page_id, CASE WHEN {blocked_sql('text')} THEN 'BLOCKED' WHEN {lost_sql('text', 'title')} THEN 'NOT_FOUND'
  WHEN length(text) < 300 THEN 'STUB' ELSE 'OK' END AS status FROM served""")
def _(t):
    return t.served.select("page_id", T.page_status(F.col("text"), F.col("title")).alias("status"))


@query("c3_length_floor", "SELECT doc_id FROM documents WHERE length(text) >= 300")
def _(t):
    return I.long_enough(t.documents).select("doc_id")


view("feed_items", """
SELECT p.url AS link, CASE WHEN p.page_id % 17 = 3 THEN NULL ELSE p.title END AS item_title,
       CASE WHEN p.page_id % 5 = 0 THEN NULL WHEN p.page_id % 5 = 1 THEN concat('<p>', c.text, '</p> ') ELSE c.text END AS summary,
       p.title AS page_title, CASE WHEN p.page_id % 7 = 6 THEN NULL ELSE p.text END AS page_text
FROM served p LEFT JOIN (SELECT * FROM conversations WHERE turn = 0) c ON c.conv_id = p.page_id
""")


@query("c5_text_fallback", rf"""
WITH f AS (SELECT *, coalesce(trim(regexp_replace({unescape_sql("regexp_replace(summary, '<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g')), '') AS s,
   page_text IS NULL AS missing, {blocked_sql("coalesce(page_text, '')")} OR {lost_sql("coalesce(page_text, '')", 'page_title')} AS blocked FROM feed_items),
u AS (SELECT *, (missing OR blocked OR length(page_text) < 300) AND s <> '' AS by_summary FROM f),
k AS (SELECT link, coalesce(item_title, page_title, link) AS title,
   CASE WHEN by_summary THEN coalesce(item_title, '') || '. ' || s ELSE page_text END AS text,
   CASE WHEN NOT by_summary THEN 'page' WHEN missing THEN 'unreachable' WHEN blocked THEN 'blocked' ELSE 'stub page' END AS origin,
   CASE WHEN by_summary THEN 150 ELSE 300 END AS floor FROM u)
SELECT link, title, text, origin FROM k WHERE length(coalesce(text, '')) >= floor""")
def _(t):
    return I.feed_documents(t.feed_items)


# Page-relative, root-relative and absolute links, as a browser would read them.
@query("c16_child_links", rf"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS tag FROM pages),
n AS (SELECT *, row_number() OVER () AS rn FROM a),
p AS (SELECT page_id, url, rn, {unescape_sql("regexp_replace(tag, '(?s)<[^>]+>', ' ', 'g')")} AS label,
  string_split({unescape_sql("regexp_extract(tag, '(?is)^<a\\s[^>]*?href\\s*=\\s*[\"'''']([^\"'''']*)[\"'''']', 1)")}, '#')[1] AS h,
  regexp_replace(url, '[?#].*$', '') AS page FROM n),
l AS (SELECT *, CASE WHEN regexp_matches(h, '^(?i)https?://') THEN h WHEN h LIKE '//%' THEN string_split(url, ':')[1] || ':' || h
   WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
   WHEN h LIKE '/%' THEN regexp_extract(page, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1) || h WHEN h = '' THEN page
   WHEN regexp_matches(page, '^[^:]+://[^/]*/') THEN regexp_replace(page, '[^/]*$', '') || h ELSE page || '/' || h END AS link FROM p),
k AS (SELECT page_id, link, min(rn) AS rn FROM l WHERE link LIKE 'http%' AND {HOST.format('link')} = {HOST.format('url')}
   AND (lower(link) LIKE '%.pdf' OR {" OR ".join(f"contains(lower(link || ' ' || label), '{w}')" for w in
        ("cyber", "security", "strategy", "policy", "framework", "advisory", "alert", "guideline", "regulation", "defence", "defense", "digital", "ai", "report"))}) GROUP BY 1, 2)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY rn) - 1 AS pos FROM k""".replace("''''", "''"))
def _(t):
    return I.child_links(t.pages)


# Pages with figures built around their own words and numbers.
view("figure_pages", """
SELECT page_id, url, concat(html, '<nav><img src="/nav.png"></nav><figure><img src="/fig/', CAST(page_id AS STRING),
  '.png" width="', CAST(100 + page_id % 7 * 60 AS STRING), '" alt="Trend by year"><figcaption>Figure ', CAST(page_id % 9 AS STRING),
  '. Distribution <b>by</b> site</figcaption></figure><img srcset="a', CAST(page_id AS STRING), '.jpg 300w, b', CAST(page_id AS STRING),
  '.jpg ', CAST(page_id % 5 * 200 AS STRING), 'w"><img src="/logo.svg"><img src="data:xx"><img src="/fig/', CAST(page_id AS STRING),
  '.png"><meta property="og:image" content="https://cdn.example.com/hero', CAST(page_id % 3 AS STRING), '.jpg">') AS html FROM pages
""")


@query("c15_figure_candidates", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u, 100 + page_id % 7 * 60 AS w, page_id % 5 * 200 AS bw FROM figure_pages),
b AS (SELECT *, regexp_extract(u, '^(.*?://[^/]*)', 1) AS o, regexp_replace(u, '[^/]*$', '') AS f FROM p),
c AS (SELECT page_id, 1 AS k, o || '/fig/' || page_id || '.png' AS image_url, 'Trend by year' AS alt, 'Figure ' || page_id % 9 || '. Distribution by site' AS caption, w AS width FROM b WHERE w >= 220
  UNION ALL SELECT page_id, 2, f || CASE WHEN bw > 300 THEN 'b' ELSE 'a' END || page_id || '.jpg', '', '', NULL FROM b
  UNION ALL SELECT page_id, 3, o || '/fig/' || page_id || '.png', '', '', NULL FROM b WHERE w < 220
  UNION ALL SELECT page_id, 4, 'https://cdn.example.com/hero' || page_id % 3 || '.jpg', 'social card image', '', NULL FROM b)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, image_url, alt, caption, width, CAST(NULL AS INT) AS height FROM c""")
def _(t):
    return I.figure_candidates(t.figure_pages)


# Figures proposed from the sentences of the documents.
view("figure_proposals", """
SELECT proposal_id, CASE pos % 7 WHEN 0 THEN 'chart' WHEN 1 THEN 'MAP' WHEN 2 THEN 'PHOTO' WHEN 3 THEN NULL ELSE 'TIMELINE' END AS kind,
       CASE doc_id % 5 WHEN 0 THEN concat('Figure ', CAST(pos AS STRING), '. ', substr(statement, 1, 30)) WHEN 1 THEN concat(' An illustration of ', substr(statement, 1, 20))
            WHEN 2 THEN substr(statement, 1, 25) WHEN 3 THEN ' ' ELSE NULL END AS caption,
       CASE pos % 4 WHEN 0 THEN substr(statement, 1, 60) WHEN 1 THEN concat('Glowing ', substr(statement, 1, 40)) WHEN 2 THEN substr(statement, 1, 12) ELSE NULL END AS alt
FROM statements
""")


@query("c14_figure_admission", r"""
WITH f AS (SELECT proposal_id, upper(coalesce(kind, '')) AS k, regexp_replace(coalesce(caption, ''), '^\s+|\s+$', '', 'g') AS c,
   regexp_replace(coalesce(alt, ''), '^\s+|\s+$', '', 'g') AS a FROM figure_proposals),
g AS (SELECT *, k IN ('CHART', 'DIAGRAM', 'MAP', 'TABLE_IMAGE', 'TIMELINE', 'SCREENSHOT') AS inf,
   regexp_matches(c || ' # ' || a, '(?i)\b(illustration|illustrative|graphic of|pictorial|conceptual|abstract|stock (photo|image)|symbol|symbolic|artwork|artist|rendering|render of|depict(ed|ion) as|glowing|silhouette|decorative|banner|hero image|representation of a|imagery)\b') AS art FROM f)
SELECT proposal_id, inf AND NOT art AND (c <> '' OR length(a) >= 40) AS admit,
  inf AND NOT (NOT art AND (c <> '' OR length(a) >= 40)) AS near_miss,
  CASE WHEN NOT inf THEN 'kind ' || coalesce(nullif(k, ''), 'UNKNOWN') || ' is decoration, not information'
       WHEN art THEN 'described as artwork by the publisher'
       WHEN regexp_matches(c, '(?i)^\s*(fig(?:ure)?|table|chart|exhibit)\s*\.?\s*\d+') THEN 'publisher numbered it as a figure'
       WHEN c <> '' THEN 'carries a publisher caption' WHEN length(a) >= 40 THEN 'substantive alt text, no caption'
       ELSE 'no caption and only ' || length(a) || ' chars of alt text — cannot tell what it shows' END AS reason FROM g""")
def _(t):
    return t.figure_proposals.select("proposal_id", T.figure_admission(F.col("kind"), F.col("caption"), F.col("alt")).alias("v")) \
        .select("proposal_id", "v.*")


# --- environment layer -------------------------------------------------------------------
NAT = (r"(?:\bU\.?A\.?E\.?\b|\bunited arab emirates\b|\bemirati\b|\bemirates\b|\babu dhabi\b|\bdubai\b|\bsharjah\b|\bajman\b|\bfujairah\b|"
       r"\bras al[- ]khaimah\b|\bumm al[- ]quwain\b|\btawazun\b|\baecert\b|\btdra\b|\bedge group\b|\bcyber security council\b)")
REG = r"(?:\bmiddle east\b|\bgulf\b|\bgcc\b|\bregion(?:al)?\b|\barab world\b)"
GAP = r"[\s,;/&]{0,28}(?:or|and|the|as well as)?[\s,;/&]{0,28}"


@query("c6_env_layer", rf"""
WITH q AS (SELECT *, upper(proposed) AS p, regexp_matches(quote, '(?i){NAT}') AS nat, regexp_matches(quote, '(?i){REG}') AS reg,
  list_bool_or(list_transform(regexp_extract_all(quote, '(?i){NAT}({GAP}){REG}', 1) || regexp_extract_all(quote, '(?i){REG}({GAP}){NAT}', 1), lambda g: length(g) <= 28)) AS l FROM quotes),
r AS (SELECT *, CASE WHEN p <> 'UAE' OR (nat AND NOT coalesce(l, false)) THEN '' WHEN coalesce(l, false) THEN 'UAE named only within a regional list'
  WHEN reg THEN 'quote names a region, not the UAE' ELSE 'quote does not name the UAE or an Emirate' END AS reason FROM q)
SELECT doc_id, pos, CASE WHEN reason = '' THEN p ELSE 'REGIONAL' END AS layer, reason <> '' AS changed, reason FROM r""")
def _(t):
    return t.quotes.select("doc_id", "pos", T.env_layer(F.col("quote"), F.col("proposed")).alias("v")).select("doc_id", "pos", "v.*")


# --- evidence candidates --------------------------------------------------------------------
view("candidates", """
SELECT concat(CAST(doc_id AS STRING), '-', CAST(pos AS STRING)) AS candidate_id, doc_id,
       CASE (doc_id + pos) % 9 WHEN 0 THEN 'AFRICA' ELSE 'ASIA' END AS pillar, 'ASIA' AS reader_pillar,
       concat('T', CAST(CASE WHEN pos % 8 = 1 THEN 4 ELSE 2 + 5 * (doc_id % 5) END AS STRING), '-', CAST(1 + pos % 5 AS STRING)) AS topic_id,
       CASE WHEN pos % 19 = 0 THEN 'Too short' ELSE concat('The paper states: ', substr(sentence, 1, 300)) END AS claim,
       CASE pos % 7 WHEN 3 THEN concat('“', lower(substr(sentence, 1, 200)), '” — ') WHEN 5 THEN concat('made up words ', substr(sentence, 1, 60)) ELSE substr(sentence, 1, 250) END AS quote,
       CASE pos % 5 WHEN 0 THEN 'radar' WHEN 1 THEN '' ELSE substr(sentence, 3, 9) END AS hook
FROM doc_sentences
""")
LETTERS = "regexp_replace(translate(lower(coalesce({0}, '')), '‘’“”–—', ''), '[^a-z0-9]', '', 'g')"


@query("c7_evidence_validation", f"""
WITH d AS (SELECT doc_id, {LETTERS.format('text')} AS whole FROM documents),
j AS (SELECT c.*, whole, {LETTERS.format('quote')} AS q, {LETTERS.format('hook')} AS h, tp.pillar AS tp
      FROM candidates c LEFT JOIN d USING (doc_id) LEFT JOIN (SELECT * FROM topics WHERE NOT retired) tp USING (topic_id))
SELECT candidate_id, CASE WHEN length(claim) NOT BETWEEN 20 AND 500 OR length(quote) NOT BETWEEN 10 AND 400 OR length(hook) > 200 THEN 'schema'
   WHEN pillar <> reader_pillar OR tp IS NULL OR tp <> reader_pillar THEN 'pillar_topic'
   WHEN length(q) < 3 OR NOT contains(whole, q) THEN 'quote_not_in_document'
   WHEN length(h) < 3 OR NOT contains(q, h) THEN 'no_hook_in_quote' END AS reason FROM j""")
def _(t):
    return I.validate_evidence(t.candidates, t.documents, t.topics).select("candidate_id", "reason")


@query("c8_verbatim_containment", f"""
SELECT candidate_id, length({LETTERS.format('hook')}) >= 3 AND contains({LETTERS.format('quote')}, {LETTERS.format('hook')}) AS inside FROM candidates""")
def _(t):
    return t.candidates.select("candidate_id", T.within(T.letters(F.col("hook")), T.letters(F.col("quote"))).alias("inside"))


@query("c9_hook_in_claim", r"""
WITH n AS (SELECT candidate_id, trim(regexp_replace(translate(lower(hook), '’', ''''), '\s+', ' ', 'g')) AS h0,
   trim(regexp_replace(translate(lower(claim), '’', ''''), '\s+', ' ', 'g')) AS c FROM candidates),
m AS (SELECT *, trim(h0, ' .,''"') AS h FROM n)
SELECT candidate_id, length(h) >= 3 AND contains(c, h) AS inside FROM m""")
def _(t):
    return t.candidates.select("candidate_id", T.hook_in_claim(F.col("hook"), F.col("claim")).alias("inside"))


ENTITIES = """SELECT p_partkey AS entity_id, CASE p_size % 4 WHEN 0 THEN 'CYBERSECURITY' WHEN 1 THEN 'AI' WHEN 2 THEN 'ELECTRONIC_WARFARE' ELSE 'PROCUREMENT' END AS pillar,
 CASE p_partkey % 7 WHEN 0 THEN 'threat_actor' WHEN 1 THEN 'ai_model' WHEN 2 THEN 'spectrum_band' WHEN 3 THEN 'refresh_cycle' WHEN 4 THEN 'control' WHEN 5 THEN 'pnt_mode' ELSE 'widget' END AS entity_type FROM part"""


@query("c10_entity_types", f"""
SELECT entity_id, pillar, entity_type FROM ({ENTITIES}) WHERE pillar <> 'CYBERSECURITY' OR entity_type NOT IN ('threat_actor', 'control')""")
def _(t):
    return I.entity_violations(t.sql(ENTITIES), F.lit("CYBERSECURITY")).select("entity_id", "pillar", "entity_type")


@query("c17_topic_completeness", """
SELECT topic_id, 'no_impact' AS problem FROM topics WHERE NOT retired AND pillar <> 'ASIA' AND trim(coalesce(impact, '')) = ''
UNION ALL SELECT topic_id, 'no_function' FROM topics WHERE NOT retired AND len(functions) = 0
UNION ALL SELECT topic_id, 'short_name' FROM topics WHERE NOT retired AND length(name) < 4""")
def _(t):
    return I.topic_violations(t.topics, "ASIA")


@query("d17_array_foreign_keys", """
SELECT DISTINCT topic_id, f AS value FROM (SELECT topic_id, unnest(functions) AS f FROM topics) WHERE f NOT IN (SELECT node_id FROM nodes)""")
def _(t):
    return I.array_key_violations(t.topics, "topic_id", "functions", t.nodes.select("node_id"))


NEW_TOPICS = """SELECT topic_id, pillar, functions, CASE WHEN nation_key % 4 = 0 THEN 'R1' END AS branch_id FROM topics"""
LENS = "SELECT r_name AS pillar, concat('R', CAST(r_regionkey AS STRING)) AS lens_id FROM region WHERE r_regionkey > 1"


@query("d18_topic_home", f"""
SELECT topic_id, coalesce(branch_id, lens_id, parent_id) AS home_id FROM ({NEW_TOPICS}) n LEFT JOIN ({LENS}) l USING (pillar)
LEFT JOIN nodes ON node_id = functions[1]""")
def _(t):
    return I.topic_home(t.sql(NEW_TOPICS), t.sql(LENS), t.nodes)


QUESTION = "What is the erintion, and how does heronen target the oneater?"


@query("c18_ask", """
SELECT proposal_id AS evidence_id, statement AS claim FROM statements
WHERE contains(lower(statement), 'erintion') OR contains(lower(statement), 'heronen') OR contains(lower(statement), 'oneater') ORDER BY proposal_id LIMIT 6""")
def _(t):
    claims = t.statements.select(F.col("proposal_id").alias("evidence_id"), F.col("statement").alias("claim"))
    return I.ask(claims, QUESTION)


SHOW = """SELECT concat(CAST(doc_id AS STRING), '-', CAST(pos AS STRING)) AS evidence_id, CASE WHEN pos % 3 = 0 THEN 'A' ELSE 'C' END AS class, sentence AS quote,
 CASE WHEN doc_id % 3 = 0 THEN concat(sentence, ' ') ELSE concat('It says ', sentence) END AS claim, doc_id % 400 AS created_on FROM doc_sentences"""


@query("c19_showcase_row", rf"""
SELECT evidence_id, length(quote) BETWEEN 90 AND 240 AND regexp_replace(lower(claim), '[^a-z0-9]+', ' ', 'g') <> regexp_replace(lower(quote), '[^a-z0-9]+', ' ', 'g') AS fits
FROM ({SHOW}) WHERE class = 'A' ORDER BY fits DESC, created_on DESC, evidence_id DESC LIMIT 1""")
def _(t):
    return I.showcase(t.sql(SHOW)).select("evidence_id", "fits")


# --- sources ----------------------------------------------------------------------------------
view("domains", """
SELECT concat(regexp_extract(url, '://([^/]+)', 1), CASE WHEN page_id % 4 = 0 THEN '' ELSE '.invalid' END) AS domain, min(page_id) AS registry_id, min(page_id) AS pos FROM pages GROUP BY 1
UNION ALL SELECT concat('example.', CASE s_suppkey % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'net' ELSE 'edu' END), 100000 + s_suppkey, 100000 + s_suppkey FROM supplier
UNION ALL SELECT 'therha.example.com', 5, 1 FROM region
""")


@query("d3_domain_match", f"""
WITH u AS (SELECT page_id, {HOST.format('url')} AS host FROM pages),
m AS (SELECT page_id, arg_max(registry_id, length(domain) * 1000000000 - pos) AS r
      FROM u JOIN domains d ON u.host = d.domain OR ends_with(u.host, '.' || d.domain) WHERE domain <> '' GROUP BY 1)
SELECT page_id AS url_id, host, coalesce(r, -1) AS registry_id, r IS NOT NULL AS matched FROM u LEFT JOIN m USING (page_id)""")
def _(t):
    urls = t.pages.select(F.col("page_id").alias("url_id"), "url")
    return I.map_domains(urls, t.domains, -1).select("url_id", "host", "registry_id", "matched")


@query("d3_domain_match_counts", f"""
WITH u AS (SELECT page_id, {HOST.format('url')} AS host FROM pages),
m AS (SELECT DISTINCT page_id FROM u JOIN domains d ON u.host = d.domain OR ends_with(u.host, '.' || d.domain))
SELECT count(m.page_id) AS matched, count(*) - count(m.page_id) AS fell_back FROM u LEFT JOIN m USING (page_id)""")
def _(t):
    out = I.map_domains(t.pages.select(F.col("page_id").alias("url_id"), "url"), t.domains, -1)
    return out.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("fell_back"))


@query("d4_bound_sources", """
SELECT registry_id FROM registry WHERE registry_id IN (SELECT registry_id FROM topic_sources JOIN topics USING (topic_id) WHERE NOT retired AND pillar = 'ASIA')""")
def _(t):
    return I.bound_sources(t.registry, t.topic_sources, t.topics.where("pillar = 'ASIA'")).select("registry_id")


READ_LOG = """SELECT DISTINCT document_id FROM evidence_sources JOIN evidence USING (evidence_id) WHERE pillar = 'EUROPE'"""


@query("d5_unread_documents", f"""
SELECT document_id, registry_id FROM graph_docs WHERE registry_id IN (SELECT registry_id FROM registry WHERE NOT archived AND pillar = 'EUROPE')
AND document_id NOT IN ({READ_LOG})""")
def _(t):
    sources = t.registry.where("NOT archived AND pillar = 'EUROPE'")
    return I.unread_documents(t.graph_docs, sources, t.sql(READ_LOG)).select("document_id", "registry_id")


@query("d5_unread_newest", f"""
SELECT document_id FROM graph_docs WHERE registry_id IN (SELECT registry_id FROM registry WHERE NOT archived AND pillar = 'EUROPE')
AND document_id NOT IN ({READ_LOG}) ORDER BY retrieved_on DESC, document_id LIMIT 25""")
def _(t):
    sources = t.registry.where("NOT archived AND pillar = 'EUROPE'")
    return I.unread_documents(t.graph_docs, sources, t.sql(READ_LOG), 25).select("document_id")


@query("d6_documents_behind_pillar", """
SELECT document_id, url FROM graph_docs WHERE document_id IN (SELECT document_id FROM evidence_sources JOIN live_evidence USING (evidence_id) WHERE pillar = 'AFRICA')""")
def _(t):
    return I.documents_behind(t.graph_docs, t.evidence_sources, t.live_evidence.where("pillar = 'AFRICA'")).select("document_id", "url")


@query("c2_array_membership", """
WITH p AS (SELECT document_id, list(DISTINCT pillar) AS pillars FROM evidence_sources JOIN evidence USING (evidence_id) GROUP BY 1)
SELECT document_id, list_contains(pillars, 'ASIA') AS by_asia FROM p WHERE NOT list_contains(pillars, 'EUROPE')""")
def _(t):
    read = I.backfill_read_pillars(t.evidence, t.evidence_sources)
    return read.where(~F.array_contains("pillars", "EUROPE")).select("document_id", F.array_contains("pillars", "ASIA").alias("by_asia"))


@query("e38_read_pillar_backfill", """
SELECT document_id, array_to_string(list_sort(list(DISTINCT pillar)), ',') AS pillars FROM evidence_sources JOIN evidence USING (evidence_id) GROUP BY 1""")
def _(t):
    return I.backfill_read_pillars(t.evidence, t.evidence_sources).withColumn("pillars", F.array_join("pillars", ","))


@query("d16_first_source", """
SELECT evidence_id, min(document_id) AS document_id FROM evidence_sources GROUP BY 1""")
def _(t):
    return t.evidence_sources.groupBy("evidence_id").agg(F.min("document_id").alias("document_id"))


MAPPING = "SELECT topic_id AS old_topic, concat('T', CAST((nation_key + 1) % 25 AS STRING), '-1') AS new_topic FROM topics WHERE retired"


@query("d21_repoint_topics", f"""
SELECT evidence_id, coalesce(new_topic, topic_id) AS topic_id FROM evidence LEFT JOIN ({MAPPING}) ON old_topic = topic_id""")
def _(t):
    return I.repoint_topics(t.evidence, t.sql(MAPPING)).select("evidence_id", "topic_id")


@query("d21_bind_live_sources", """
SELECT topic_id, registry_id FROM topic_sources WHERE registry_id IN (SELECT registry_id FROM registry WHERE NOT archived)""")
def _(t):
    return I.bind_sources(t.topic_sources, t.registry).select("topic_id", "registry_id")


@query("e43_dataset_row", """
WITH c AS (SELECT count(*) AS active, count(*) FILTER (p_size <= 5) AS matching FROM part),
q AS (SELECT string_agg(n, '; ' ORDER BY n) AS q FROM (SELECT concat(p_name, ' ', p_partkey) AS n FROM part WHERE p_size <= 5 ORDER BY n LIMIT 12))
SELECT active, matching, format('The list holds {} active sets, of which {} match.', active, matching) AS claim, coalesce(q, 'no records') AS quote FROM c, q""")
def _(t):
    parts = t.part.withColumn("name", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    return I.dataset_row(parts, F.col("p_size") <= 5, "name", "The list holds %d active sets, of which %d match.", 12)
