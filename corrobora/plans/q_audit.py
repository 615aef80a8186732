"""Queries on report audits."""

from pyspark.sql import functions as F

from corrobora import vocab
from corrobora.functions import audit as A
from corrobora.operators import audit as U
from corrobora.plans.registry import query
from corrobora.plans.views import view
from corrobora.session import written

# --- the same split in SQL: lines, running headings, marker split ----------------------------
W = r"'^\s+|\s+$', '', 'g'"
SENT = rf"""ln AS (SELECT report_id, pillar, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT report_id, pillar, string_split(body_md, chr(10)) AS x FROM reports)),
l2 AS (SELECT *, regexp_replace(line, {W}) AS s, starts_with(line, '## ') AS is_sec FROM ln),
l3 AS (SELECT *, count(*) FILTER (is_sec) OVER (PARTITION BY report_id ORDER BY n) AS sec,
   max(CASE WHEN starts_with(s, '#') THEN n END) OVER (PARTITION BY report_id ORDER BY n) AS last_head FROM l2),
hd AS (SELECT report_id, n AS last_head, contains(lower(s), 'reference') AS ref, is_sec AS head_is_sec FROM l2 WHERE starts_with(s, '#')),
sec0 AS (SELECT report_id, sec, count(*) FILTER (NOT is_sec) AS body_lines, any_value(CASE WHEN is_sec THEN trim(substr(line, 4)) END) AS title,
   string_agg(CASE WHEN NOT is_sec THEN line END, chr(10) ORDER BY n) AS text FROM l3 GROUP BY 1, 2),
secs AS (SELECT report_id, sec, row_number() OVER (PARTITION BY report_id ORDER BY sec) - 1 AS section_no, x.title, text, section_key
   FROM sec0 x LEFT JOIN template_sections t ON lower(t.title) = lower(x.title) WHERE body_lines > 0 AND text <> ''),
l4 AS (SELECT l3.*, coalesce(ref, false) AS in_references, coalesce(ref AND NOT head_is_sec, false) AS inner_references FROM l3 LEFT JOIN hd USING (report_id, last_head)),
l5 AS (SELECT *, regexp_replace(regexp_replace(s, '^[-*+]\s+', ''), '^\d+[.)]\s+', '') AS u FROM l4
   WHERE s <> '' AND NOT is_sec AND NOT regexp_matches(s, '^(#|\||---|>|\*Status|Customer Validation)') AND NOT contains(s, 'http://') AND NOT contains(s, 'https://')),
l6 AS (SELECT *, unnest(range(len(p))) AS k, unnest(p) AS part0 FROM (SELECT *, string_split(regexp_replace(u, '([.!?])\s+([A-Z\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM l5
   WHERE NOT regexp_matches(u, '^\*\*[^*]+\*\*:?$'))),
l7 AS (SELECT *, regexp_replace(part0, {W}) AS part FROM l6),
l8 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(part, '^\*\*[^*]{{1,60}}\*\*\s*:\s*', ''),
   '(?i)^\*{{0,2}}(so what|trigger|implication|implications|action|owner|why|bottom line|recommendation|watch|horizon|confidence|falsifier|what would refute this|next step)\*{{0,2}}\s*[:—-]\s*', ''), {W}) AS sentence
   FROM l7 WHERE NOT regexp_matches(part, '(?i)^\*{{0,2}}(trigger|watch|falsifier|indicator|threshold|what would refute this)\*{{0,2}}\s*[:—-]')),
sent AS (SELECT report_id, pillar, section_no, section_key, row_number() OVER (PARTITION BY report_id, section_no ORDER BY n, k) - 1 AS pos, in_references, inner_references, sentence
   FROM l8 JOIN secs USING (report_id, sec) WHERE length(sentence) > 25)"""

CITE = r"\[(EV-[A-Z0-9-]+|SIG-[A-Z0-9-]+|R-[A-Z0-9-]+|F-[A-Z0-9-]+|FIG-[A-Z0-9-]+)\]"
OBJ = (r"\b(EV-[A-Z0-9-]+|SIG-[A-Z]{2}-\d+|F-[A-Z]{2}-\d+|R-[A-Z]{2}-\d+|TR-[A-Z]{2}-\d+|CU-[A-Z]{2}-\d+|FC-[A-Z]{2}-\d+|FIG-\d+"
       r"|S\d{1,2}|OPT-[A-Z]|IMP-[A-Z]{3}-\d+|DRV-\d+|CI-\d+|INIT-\d+|ACT-\d+|PDC-\d+|IND-[A-Z]{2}-\d+|O\d{1,2}|VG-[A-Z]{2}-\d{2}|[A-Z]{2}-T\d+|[A-Z]{2}-\d{2})\b")
# Word boundaries are ASCII in both engines' patterns here.
ASSERT_ = vocab.ASSERTIVE
VERBS = ", ".join("'%s'" % w for w in vocab.IMPERATIVES)


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


FLAGS = SENT + rf""", fl0 AS (SELECT *, list_distinct(regexp_extract_all(sentence, '{CITE}', 1) || regexp_extract_all(sentence, '{OBJ}', 1)) AS cites,
  list_distinct(regexp_extract_all(sentence, '{CITE}', 1)) AS bracketed, regexp_matches(sentence, '{ASSERT_}') AS assertive, {any_of('lower(sentence)', vocab.HEDGES)} AS hedged,
  trim(regexp_split_to_array(lower(regexp_replace(sentence, '^(\d+[\.\)]\s*|[-*+]\s*)?(\*\*)?\s*', '')), '[\s,:]+')[1], '*_') IN ({VERBS})
     OR regexp_matches(sentence, '{vocab.MODAL_RECOMMENDATION}') AS recommendation,
  regexp_matches(sentence, '{vocab.META_SUBJECT}') AND regexp_matches(sentence, '{vocab.META_PREDICATE}') AS meta,
  regexp_matches(sentence, '{vocab.CONDITIONAL_OPENER}') OR regexp_matches(sentence, '{vocab.FALSIFIER_CLAUSE}') AS condition,
  {any_of('lower(sentence)', vocab.CONSTRUCT_MARKERS)} AS construct,
  regexp_matches(sentence, '{vocab.GAP_LANGUAGE}') AND NOT (contains(lower(sentence), 'customer validation') OR contains(lower(sentence), 'validation required')
     OR (regexp_matches(lower(sentence), '{vocab.GATE_WORD}') AND (regexp_matches(lower(sentence), '{vocab.GATE_VALIDATES}') OR regexp_matches(lower(sentence), '{vocab.GATE_STATE}'))
         AND NOT regexp_matches(lower(sentence), '{vocab.DEFICIT_WORD}'))) AS gap_claim FROM sent),
fl1 AS (SELECT *, len(cites) > 0 AS cited, assertive AND len(cites) = 0 AND NOT hedged AND NOT recommendation AND NOT meta AND NOT condition AND NOT inner_references AS raw FROM fl0),
fl AS (SELECT *, raw AND coalesce(section_key NOT IN ('limits', 'scenarios'), true) AS unsourced, raw AND coalesce(section_key IN ('limits', 'scenarios'), false) AS exempt FROM fl1)"""


def secs(t):
    return U.sections(t.reports, t.template_sections)


def flags(t):
    return U.flagged(U.sentences(secs(t)))


@query("h1_sections", f"WITH {SENT} SELECT report_id, section_no, title, section_key, length(text) AS chars FROM secs")
def _(t):
    # The line break before the next heading is no part of the section.
    text = F.regexp_replace("text", r"\n\z", "")
    return secs(t).select("report_id", "section_no", "title", "section_key", F.length(text).alias("chars"))


@query("h2_sentences", f"WITH {SENT} SELECT report_id, section_no, pos, in_references, inner_references, sentence FROM sent")
def _(t):
    return U.sentences(secs(t)).select("report_id", "section_no", "pos", "in_references", "inner_references", "sentence")


@query("h3_citations", f"WITH {FLAGS} SELECT report_id, section_no, pos, unnest(cites) AS cited_id FROM fl")
def _(t):
    return flags(t).select("report_id", "section_no", "pos", F.explode("cites").alias("cited_id"))


BAD_CITES = """bad AS (SELECT report_id, section_no, pos, cited_id FROM (SELECT report_id, section_no, pos, unnest(cites) AS cited_id FROM fl WHERE NOT in_references)
  WHERE cited_id NOT IN (SELECT cited_id FROM graph_objects))"""


@query("h4_unresolved_citations", f"WITH {FLAGS}, {BAD_CITES} SELECT * FROM bad")
def _(t):
    return U.citation_violations(flags(t), t.graph_objects)


@query("d9_citation_resolution", f"""WITH {FLAGS}, c AS (SELECT unnest(cites) AS cited_id FROM fl WHERE NOT in_references)
SELECT coalesce(kind, 'unknown') AS kind, count(*) AS citations FROM c LEFT JOIN graph_objects USING (cited_id) GROUP BY 1""")
def _(t):
    g = t.graph_objects
    ids = U.graph_ids({k: g.where(F.col("kind") == k) for k in ("evidence", "finding", "figure", "gate")})
    cites = flags(t).where(~F.col("in_references")).select(F.explode("cites").alias("cited_id"))
    return (cites.join(ids, "cited_id", "left").groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind"))
            .agg(F.count("*").alias("citations")))


@query("j4_cited_and_known", f"""WITH {FLAGS} SELECT DISTINCT cited_id FROM (SELECT unnest(bracketed) AS cited_id FROM fl) WHERE cited_id IN (SELECT cited_id FROM graph_objects)""")
def _(t):
    return (flags(t).select(F.explode("bracketed").alias("cited_id")).distinct()
            .join(t.graph_objects.select("cited_id"), "cited_id", "left_semi"))


@query("h5_exemptions", f"WITH {FLAGS} SELECT report_id, section_no, pos, hedged, recommendation, meta, condition, construct FROM fl")
def _(t):
    return flags(t).select("report_id", "section_no", "pos", "hedged", "recommendation", "meta", "condition", "construct")


@query("h6_unsourced", f"WITH {FLAGS} SELECT report_id, section_no, pos, unsourced, exempt FROM fl WHERE raw")
def _(t):
    return flags(t).where("unsourced_raw").select("report_id", "section_no", "pos", "unsourced", "exempt")


CLASSV = """cl AS (SELECT report_id, section_no, pos, bool_and(class = 'C') AS only_c, bool_or(class = 'D') AS any_d, any_value(hedged) AS hedged, any_value(construct) AS construct
  FROM (SELECT report_id, section_no, pos, hedged, construct, unnest(bracketed) AS cited_id FROM fl WHERE NOT in_references) JOIN graph_objects USING (cited_id) WHERE kind = 'evidence' GROUP BY 1, 2, 3),
cv AS (SELECT report_id, section_no, pos, 'CLASS_C' AS "check", 'BLOCKER' AS severity FROM cl WHERE only_c AND NOT hedged
  UNION ALL SELECT report_id, section_no, pos, 'CLASS_D', 'WARNING' FROM cl WHERE any_d AND NOT construct)"""


def graph(t):
    return t.graph_objects


@query("h7_class_discipline", f"""WITH {FLAGS}, {CLASSV} SELECT * FROM cv""")
def _(t):
    return U.class_violations(flags(t), graph(t).where("kind = 'evidence'"))


GATEV = """og AS (SELECT pillar, min(gate_id) AS gate_id FROM (SELECT DISTINCT f.pillar, gate_id FROM (SELECT DISTINCT pillar FROM reports) f JOIN gates g
   ON status = 'OPEN' AND (contains(blocks, f.pillar) OR starts_with(gate_id, 'VG-' || left(f.pillar, 2) || '-'))) GROUP BY 1),
gv AS (SELECT report_id, section_no, pos, gate_id FROM fl JOIN og USING (pillar) WHERE gap_claim AND NOT in_references)"""


@query("h8_gate_claims", f"WITH {FLAGS}, {GATEV} SELECT * FROM gv")
def _(t):
    return U.gate_violations(flags(t), t.gates)


QUOTES = """SELECT concat('EV-', CAST(doc_id * 7 + pos * 13 AS STRING)) AS cited_id, min(sentence) AS quote FROM doc_sentences GROUP BY 1"""
WORDS = r"list_distinct(list_filter(string_split(regexp_replace(lower(regexp_replace({0}, '\[[^\]]*\]', ' ', 'g')), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) >= 4))"


@query("h9_entailment_overlap", f"""WITH {FLAGS}, q AS ({QUOTES}),
c AS (SELECT report_id, section_no, pos, any_value({WORDS.format('sentence')}) AS w, flatten(list({WORDS.format('quote')})) AS qw
  FROM (SELECT report_id, section_no, pos, sentence, unnest(bracketed) AS cited_id FROM fl WHERE NOT in_references) JOIN q USING (cited_id) GROUP BY 1, 2, 3)
SELECT report_id, section_no, pos, len(w) AS words, len(list_intersect(w, qw)) AS found, len(list_intersect(w, qw)) >= len(w) * 0.5 AS supported FROM c""")
def _(t):
    return U.entailment(flags(t), t.sql(QUOTES))


VERDICTS = """SELECT doc_id AS report_id, CAST(pos % 6 AS INT) AS section_no, CAST(pos % 5 AS INT) AS pos, min(pos) % 3 > 0 AS supported, min(source) AS reason FROM doc_sentences GROUP BY 1, 2, 3"""


@query("h9_verdict_violations", f"""WITH {FLAGS}, v AS ({VERDICTS.replace('GROUP BY 1, 2, 3', 'GROUP BY doc_id, doc_sentences.pos % 6, doc_sentences.pos % 5').replace('min(pos)', 'min(doc_sentences.pos)')})
SELECT report_id, section_no, pos, reason FROM v JOIN (SELECT report_id, section_no, pos FROM fl WHERE len(bracketed) > 0 AND NOT in_references) USING (report_id, section_no, pos) WHERE NOT supported""")
def _(t):
    v = VERDICTS.replace("GROUP BY 1, 2, 3", "GROUP BY doc_id, pos % 6, pos % 5")
    checked = flags(t).where((F.size("bracketed") > 0) & ~F.col("in_references")).select("report_id", "section_no", "pos")
    return U.verdict_violations(checked, t.sql(v))


@query("e42_faithfulness", f"""WITH {FLAGS}, q AS ({QUOTES}),
c AS (SELECT report_id, section_no, pos, any_value({WORDS.format('sentence')}) AS w, flatten(list({WORDS.format('quote')})) AS qw
  FROM (SELECT report_id, section_no, pos, sentence, unnest(bracketed) AS cited_id FROM fl WHERE NOT in_references) JOIN q USING (cited_id) GROUP BY 1, 2, 3)
SELECT report_id, count(*) AS checked, count(*) FILTER (len(list_intersect(w, qw)) >= len(w) * 0.5) AS supported FROM c GROUP BY 1""")
def _(t):
    return U.entailment(flags(t), t.sql(QUOTES)).groupBy("report_id").agg(
        F.count("*").alias("checked"), F.count_if("supported").alias("supported"))


@query("h10_unknown_openers", rf"""WITH {FLAGS}, o AS (SELECT trim(regexp_split_to_array(lower(regexp_replace(sentence, '^(\d+[\.\)]\s*|[-*+]\s*)?(\*\*)?\s*', '')), '[\s,:;]+')[1], '*_.()"''') AS opener FROM fl WHERE unsourced)
SELECT DISTINCT opener FROM o WHERE regexp_matches(opener, '^\p{{L}}+$') AND opener NOT IN ({VERBS})""")
def _(t):
    return U.unknown_openers(flags(t))


ALLV = f"""{BAD_CITES}, {CLASSV}, {GATEV}, av AS (SELECT report_id, section_no, pos, 'CITATION' AS "check", 'BLOCKER' AS severity FROM bad
  UNION ALL SELECT report_id, section_no, pos, 'UNSOURCED', 'BLOCKER' FROM fl WHERE unsourced UNION ALL SELECT * FROM cv
  UNION ALL SELECT report_id, section_no, pos, 'GATE', 'BLOCKER' FROM gv)"""


@query("e42_violations_per_check", f"""WITH {FLAGS}, {ALLV} SELECT "check", severity, count(*) AS n FROM av GROUP BY ALL""")
def _(t):
    return U.violations(flags(t), graph(t), t.gates).groupBy("check", "severity").agg(F.count("*").alias("n"))


@query("h17_report_release", f"""WITH {FLAGS}, {ALLV},
c AS (SELECT report_id, count(*) FILTER (severity = 'BLOCKER') AS b, count(*) FILTER (severity = 'WARNING') AS w FROM av GROUP BY 1)
SELECT report_id, coalesce(b, 0) AS blockers, coalesce(w, 0) AS warnings, coalesce(b, 0) = 0 AS released FROM reports LEFT JOIN c USING (report_id)""")
def _(t):
    return U.report_verdicts(t.reports, U.violations(flags(t), graph(t), t.gates))


OPEN_LINE = rf"""op AS (SELECT report_id, section_no, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, {W})),
   lambda l: l <> '' AND NOT regexp_matches(l, '^[#|\-*>]'))[1] AS first FROM secs WHERE section_key = 'exec_summary'),
ov AS (SELECT report_id, section_no, {" OR ".join(f"starts_with(lower(first), '{b}') OR contains(left(lower(first), 60), '{b}')" for b in vocab.BANNED_OPENERS)} AS generic,
   NOT regexp_matches(first, '{vocab.OPENER_FACT}') AS no_fact FROM op WHERE first IS NOT NULL)"""
EVIDENCE_SECTIONS = ["findings", "exec_summary", "outlook"]
DENSE = r"""de AS (SELECT report_id, section_no, count(*) FILTER (assertive) AS assertive, count(*) FILTER (regexp_matches(sentence, '\b(EV-[A-Z0-9-]+)\b')) AS with_evidence
  FROM fl WHERE section_key IN ('findings', 'exec_summary', 'outlook') AND NOT inner_references GROUP BY 1, 2),
dv AS (SELECT *, CASE WHEN assertive < 3 THEN 0 ELSE greatest(1, assertive // 3) END AS need FROM de)"""
STRUCT_ = rf"""sv AS (SELECT report_id, section_no, len(regexp_extract_all(text, '{vocab.BOLD_TITLE}')) AS titles, regexp_matches(text, '{vocab.NAMES_A_GAP}') AS gap FROM secs WHERE section_key IN ('findings', 'actions'))"""


@query("h13_opener_check", f"WITH {SENT}, {OPEN_LINE} SELECT * FROM ov")
def _(t):
    return U.opener_failures(secs(t))


@query("h14_density_check", f"WITH {FLAGS}, {DENSE} SELECT *, with_evidence < need AS thin FROM dv")
def _(t):
    return U.density(flags(t), EVIDENCE_SECTIONS)


@query("h15_structure_check", f"WITH {SENT}, {STRUCT_} SELECT report_id, section_no, titles, titles < 3 AND NOT gap AS failed FROM sv")
def _(t):
    return U.structure(secs(t), ["findings", "actions"])


@query("h16_figure_citations", rf"""WITH {SENT}, g AS (SELECT report_id, section_no, flatten(list_transform(regexp_extract_all(text, '{vocab.FIGURE_GROUP}', 1), lambda x: regexp_split_to_array(x, '\s*,\s*'))) AS f FROM secs),
p AS (SELECT report_id, section_no, unnest(f) AS id, unnest(range(len(f))) AS k FROM g), m AS (SELECT report_id, section_no, id, min(k) AS k FROM p GROUP BY 1, 2, 3),
j AS (SELECT report_id, section_no, string_agg(id, ',' ORDER BY k) AS figures FROM m GROUP BY 1, 2)
SELECT report_id, section_no, coalesce(figures, '') AS figures, figures IS NULL AS idle FROM secs LEFT JOIN j USING (report_id, section_no)""")
def _(t):
    return U.figure_notes(secs(t), F.lit(1))


@query("h17_section_verdicts", f"""WITH {FLAGS}, {ALLV}, {OPEN_LINE}, {DENSE}, {STRUCT_},
x AS (SELECT report_id, section_no, "check" FROM av WHERE "check" IN ('CITATION', 'UNSOURCED') UNION SELECT report_id, section_no, 'OPENER' FROM ov WHERE generic OR no_fact
  UNION SELECT report_id, section_no, 'DENSITY' FROM dv WHERE with_evidence < need UNION SELECT report_id, section_no, 'STRUCTURE' FROM sv WHERE titles < 3 AND NOT gap),
a AS (SELECT report_id, section_no, string_agg("check", ',' ORDER BY "check") AS failures FROM x GROUP BY 1, 2)
SELECT report_id, section_no, coalesce(failures, '') AS failures, CASE WHEN failures IS NULL THEN 'PASS' ELSE 'WITHHELD' END AS verdict FROM secs LEFT JOIN a USING (report_id, section_no)""")
def _(t):
    # Both are read by several checks: split and flagged once.
    s = written(secs(t))
    # A flag that no section check reads is not worked out.
    f = written(U.flagged(U.sentences(s)).drop("title", "cited", "recommendation", "meta", "condition", "unsourced_raw", "exempt"))
    return U.section_verdicts(s, U.violations(f, graph(t), t.gates), U.opener_failures(s),
                              U.density(f, EVIDENCE_SECTIONS), U.structure(s, ["findings", "actions"]))


def _without_orphans(body: str) -> str:
    """A body whose reference lines that nothing in the prose cites are gone."""
    return rf"""(SELECT CASE WHEN contains({body}, chr(10) || '## References') THEN prose || chr(10) || '## References' || array_to_string(list_filter(string_split(refs, chr(10)),
   lambda l: NOT regexp_matches(trim(l), '^\[[^\]]+\]') OR list_has_any(regexp_split_to_array(regexp_extract(trim(l), '^\[([^\]]+)\]', 1), '\s*[;,]\s*'), cited)), chr(10)) ELSE {body} END
 FROM (SELECT p[1] AS prose, p[2] AS refs, list_distinct(regexp_extract_all(p[1], '{CITE}', 1) || regexp_extract_all(p[1], '{OBJ}', 1)
   || flatten(list_transform(regexp_extract_all(p[1], '\[([^\]]+)\]', 1), lambda g: regexp_split_to_array(g, '\s*[;,]\s*')))) AS cited
   FROM (SELECT string_split({body}, chr(10) || '## References') AS p)))"""


@query("h12_orphan_references", f"SELECT report_id, {_without_orphans('body_md')} AS body_md FROM reports")
def _(t):
    return t.reports.select("report_id", U.drop_orphan_references(F.col("body_md")).alias("body_md"))


def _cut(body: str, bad: str) -> str:
    """A body without the listed sentences: one pattern of all, longest first, then the lines tidied."""
    pattern = f"array_to_string(list_transform(list_reverse_sort(list_transform({bad}, lambda s: {{'n': length(s), 's': s}})), lambda p: regexp_escape(p.s)), '|')"
    lines = f"string_split(regexp_replace({body}, {pattern}, '', 'g'), chr(10))"
    tidy = (r"list_transform({0}, lambda l: regexp_replace(regexp_replace(l, '[ \t]{{2,}}', ' ', 'g'), '\s+$', ''))",
            r"list_transform({0}, lambda l: CASE WHEN regexp_matches(l, '^\s+([-*+]|\d+[.)])\s') THEN l ELSE regexp_replace(l, '^\s+', '') END)",
            r"list_transform({0}, lambda l: regexp_replace(l, '\s+([.,;:])', '\1', 'g'))",
            r"list_filter({0}, lambda l: NOT regexp_matches(l, '^\s*([-*+]|\d+[.)])\s*$'))")
    for step in tidy:
        lines = step.format(lines)
    return rf"regexp_replace(regexp_replace(array_to_string({lines}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), {W})"


def _blocking(bodies: str) -> str:
    """Blocking sentences of each body: the whole audit over another table of bodies."""
    audit = f"{FLAGS}, {ALLV}".replace("AS x FROM reports)", f"AS x FROM {bodies})")
    return f"""(WITH {audit} SELECT report_id, list_sort(list(DISTINCT sentence)) AS bad FROM av JOIN fl USING (report_id, section_no, pos)
   WHERE severity = 'BLOCKER' GROUP BY 1)"""


def _round(bodies: str) -> str:
    """One round: what blocks, what of it stands in the body, and the body without it."""
    return f"""(SELECT report_id, pillar, original, removed + len(here) AS removed, missed + len(bad) - len(here) AS missed,
   CASE WHEN len(here) > 0 THEN {_without_orphans("cut")} ELSE body_md END AS body_md
   FROM (SELECT *, CASE WHEN len(here) > 0 THEN {_cut("body_md", "here")} END AS cut
     FROM (SELECT r.*, coalesce(bad, []) AS bad, list_filter(coalesce(bad, []), lambda s: contains(body_md, s)) AS here
       FROM {bodies} r LEFT JOIN {_blocking(bodies)} b USING (report_id))))"""


def _sentence_count(bodies: str, column: str) -> str:
    """Sentences of each body outside its reference list."""
    split = SENT[:SENT.index(",\nsent AS")].replace("SELECT report_id, pillar, string_split(body_md, chr(10)) AS x FROM reports)", f"SELECT report_id, pillar, string_split({column}, chr(10)) AS x FROM {bodies})")
    return f"(WITH {split} SELECT report_id, count(*) AS n FROM l8 WHERE length(sentence) > 25 AND NOT in_references GROUP BY 1)"


@query("h11_prune", f"""WITH r0 AS MATERIALIZED (SELECT report_id, pillar, body_md, body_md AS original, 0 AS removed, 0 AS missed FROM reports),
r1 AS MATERIALIZED {_round("r0")}, r2 AS MATERIALIZED {_round("r1")},
j AS (SELECT r2.*, bad IS NOT NULL AS blocked, coalesce(nb.n, 0) AS n_before, coalesce(na.n, 0) AS n_after FROM r2 LEFT JOIN {_blocking("r2")} b USING (report_id)
  LEFT JOIN {_sentence_count("r2", "original")} nb USING (report_id) LEFT JOIN {_sentence_count("r2", "body_md")} na USING (report_id)),
k AS (SELECT *, CASE WHEN missed > 0 THEN 'not verbatim' WHEN blocked THEN 'failures left'
  WHEN n_after < greatest(3, CAST(round_even(n_before * 0.6, 0) AS INT)) THEN 'too little left' END AS reason FROM j)
SELECT report_id, removed, n_before, n_after, reason IS NULL AS kept, reason, CASE WHEN reason IS NULL THEN body_md ELSE original END AS body_md FROM k""")
def _(t):
    return U.prune(t.reports.select("report_id", "pillar", "body_md"), t.template_sections, graph(t), t.gates) \
        .select("report_id", "removed", "n_before", "n_after", "kept", "reason", "body_md")


view("edits", """
SELECT concat(CAST(doc_id AS STRING), '-', CAST(pos AS STRING)) AS edit_id, doc_id AS report_id, pillar,
       CASE WHEN pos % 4 = 0 THEN substr(sentence, 1, 40) WHEN pos % 4 = 1 THEN 'no such passage' ELSE substr(sentence, 2, 12) END AS original_text,
       concat(CASE pos % 6 WHEN 0 THEN 'It may hold that ' WHEN 1 THEN 'The UAE lacks depth here, as [EV-33] says of ' WHEN 2 THEN 'We ensure it is ' ELSE 'Ensure that ' END,
              lower(sentence), CASE doc_id % 3 WHEN 0 THEN ' [EV-1]' WHEN 1 THEN ' [EV-17]' ELSE '' END, '.') AS proposed_text
FROM doc_sentences JOIN (SELECT report_id, pillar FROM reports) r ON r.report_id = doc_id
""")


def _edit_sentences() -> str:
    """The sentence split of SENT, run over single passages."""
    body = SENT.replace("FROM reports)", "FROM (SELECT edit_id AS report_id, pillar, proposed_text AS body_md FROM edits))")
    return FLAGS.replace(SENT, body)


@query("h18_edit_check", rf"""WITH {_edit_sentences()},
un AS (SELECT DISTINCT edit_id FROM (SELECT edit_id, unnest(regexp_extract_all(proposed_text, '{OBJ}', 1)) AS c FROM edits) WHERE c NOT IN (SELECT cited_id FROM graph_objects)),
og AS (SELECT DISTINCT r_name AS pillar FROM region JOIN gates g ON g.status = 'OPEN' AND g.pillar = r_name),
pr AS (SELECT edit_id, 'unresolved' AS why FROM un UNION SELECT report_id, 'unsourced' FROM fl WHERE raw
   UNION SELECT report_id, 'gate' FROM fl JOIN og USING (pillar) WHERE regexp_matches(sentence, '{vocab.GAP_LANGUAGE}') AND NOT contains(lower(sentence), 'customer validation') AND NOT contains(lower(sentence), 'validation required')),
pp AS (SELECT edit_id, string_agg(why, ',' ORDER BY why) AS problems FROM pr GROUP BY 1),
j AS (SELECT e.edit_id, e.report_id, coalesce(problems, '') AS problems, instr(r.body_md, e.original_text) AS spot, e.original_text, e.proposed_text, r.body_md FROM edits e JOIN reports r USING (report_id) LEFT JOIN pp USING (edit_id)),
s AS (SELECT *, CASE WHEN problems <> '' THEN 'REJECTED' WHEN original_text = '' OR spot = 0 THEN 'SUPERSEDED' ELSE 'APPLIED' END AS status FROM j)
SELECT edit_id, report_id, problems, status, md5(CASE WHEN status = 'APPLIED' THEN left(body_md, spot - 1) || proposed_text || substr(body_md, spot + length(original_text)) END) AS body_hash FROM s""")
def _(t):
    out = U.check_edits(t.edits, t.reports, graph(t), t.gates)
    return out.withColumn("body_hash", F.md5("new_body")).drop("new_body")


FIGS = """SELECT concat('FIG-', CAST(p_size AS STRING)) AS cited_id, concat('https://img.example.com/', CAST(p_size AS STRING), '.png') AS url,
 'A chart [of] parts' AS describes, CASE WHEN p_size % 2 = 0 THEN 'Figure of size. ' ELSE '' END AS caption, 'Parts Ltd' AS credit_line,
 'https://example.com/d' AS doc_url, p_size <> 3 AS admitted, p_size <> 5 AS reachable FROM (SELECT DISTINCT p_size FROM part) p"""


@query("h19_embed_figures", rf"""
WITH fg AS ({FIGS}), pa AS (SELECT report_id, unnest(range(len(x))) AS pos, unnest(x) AS para FROM (SELECT report_id, string_split(body_md, chr(10) || chr(10)) AS x FROM reports)),
c AS (SELECT report_id, pos, flatten(list_transform(regexp_extract_all(para, '{vocab.FIGURE_GROUP}', 1), lambda x: regexp_split_to_array(x, '\s*,\s*'))) AS f FROM pa),
p AS (SELECT report_id, pos, id, min(k) AS k FROM (SELECT report_id, pos, unnest(f) AS id, unnest(range(len(f))) AS k FROM c) GROUP BY 1, 2, 3),
d AS (SELECT report_id, pos, k, '![A chart [of) parts](' || url || ')' || chr(10) || chr(10) || '*' || id || ' — ' || CASE WHEN caption = '' THEN 'A chart [of] parts' ELSE 'Figure of size' END || '. Parts Ltd* <https://example.com/d>' AS para
   FROM p JOIN fg ON id = cited_id WHERE admitted AND reachable),
u AS (SELECT report_id, pos, -1 AS k, para FROM pa UNION ALL SELECT * FROM d)
SELECT report_id, count(*) FILTER (k >= 0) AS figures, string_agg(para, chr(10) || chr(10) ORDER BY pos, k) AS body_md FROM u GROUP BY 1""")
def _(t):
    return U.embed_figures(t.reports, t.sql(FIGS))
