"""Text rules and the report audit on labelled sentences."""

from pyspark.sql import functions as F

from corrobora import vocab
from corrobora.functions import audit as AF, text as T
from corrobora.operators import audit as U, evaluate as E, intake as I

# Sentences are put together from the branches of each rule: a claim (subject x verb)
# that must name a source, and the same claim with one exemption at a time.
VERBS = ("is", "was", "has", "shows", "grew", "fell", "reached", "remains", "holds", "required", "operates", "accounts for")
CLAIMS = [f"Depot {n} of the northern line {verb} well below the yearly plan." for n, verb in enumerate(VERBS)]
PLAIN = "depot nine of the line was late on most days"
CLAIMS += [f"{label}: Depot nine of the line was late on most days." for label in ("So what", "**Owner**", "4. **Context**", "- **Bold mark**")]
CLAIMS += ["This section says that depot nine was late on most days."]        # about the document, but nothing is withheld
EXEMPT = [f"Depot nine of the line was late on most days [{cited}]." for cited in ("EV-001", "F-CS-02", "SIG-EW-11")]
EXEMPT += [f"Depot nine was late, and {hedge} that more depots were." for hedge in ("it may be", "a forecast", "one source suggests", "it is possible")]
EXEMPT += [f"{opener} each depot that was late on most days." for opener in ("Inspect", "1. **Standardize", "standardise", "Reassess,")]
EXEMPT += [f"Each depot that was late {modal} be moved to the coast." for modal in ("should", "must", "ought to")]
EXEMPT += [f"{subject} {said}, so it was left out." for subject in ("This report", "An open gate", "The evidence") for said in
           ("was excluded", "does not establish that it was late")]
EXEMPT += [f"{opener} {PLAIN}, the plan was too tight." for opener in ("If", "However, if", "Unless", "Yet should", "By contrast, so long as")]
EXEMPT += [f"{clause} {PLAIN} for a whole year." for clause in ("The falsifier is that", "What would refute it:", "A count would disconfirm this:")]
EXEMPT += [f"{label} {PLAIN} in two years of three." for label in ("Trigger:", "Falsifier:", "**Indicator** —", "What would refute this:")]
EXEMPT += [f"**{PLAIN}**", f"# {PLAIN}", f"| {PLAIN} |", f"{PLAIN} https://example.com", "It was late."]


def unsourced(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    s = df.select("i", F.explode(AF.sentences_of(F.col("t"))).alias("s"))
    return {r.i for r in s.where(AF.is_unsourced(F.col("s"))).select("i").collect()}


def test_claims_need_a_source(spark):
    assert unsourced(spark, CLAIMS) == set(range(len(CLAIMS)))


def test_structure_and_proposals_do_not(spark):
    assert unsourced(spark, EXEMPT) == set()


def test_openers_in_both_spellings():
    words = vocab.IMPERATIVES
    assert len(words) == len(set(words)) == 212
    assert {"standardise", "standardize", "prioritise", "prioritize", "exercise", "revise"} <= set(words)
    assert not {"exercize", "revize", "raize"} & set(words)


def test_gate_disclosures_and_gap_claims(spark):
    deficits = ("lacks spare depots", "has a shortfall of depots", "is behind on depots", "is unable to run depots")
    bad = [f"{who} {deficit} this year." for who in ("The UAE", "Tawazun", "An Emirati unit") for deficit in deficits]
    bad += [f"The UAE {deficits[0]}, {gate}." for gate in ("while the gate stays open", "although the gate requires it to be validated")]
    fine = [f"Gap claims on the UAE {state}." for state in ("stay withheld while a gate is open", "wait for customer validation", "are marked validation required")]
    fine += [f"A neighbour {deficit} this year." for deficit in deficits] + ["The UAE runs forty depots on the coast."]
    df = spark.createDataFrame([(s, False) for s in fine] + [(s, True) for s in bad], "s STRING, want BOOLEAN")
    assert all(r.want == r.got for r in df.select("want", AF.is_gap_claim(F.col("s")).alias("got")).collect())


BODY = """# Title

## Findings
Masts fell across the coast in spring [EV-1]. Hostile crews were seen at a rate of 85 percent last year. Ranges grew on all masts [EV-2].

- Wired drones are beyond every jammer made so far [EV-9].
- Layered cover is made of sensors and effectors [EV-1].

## References
[EV-1] One — https://example.com/1
[EV-9] Nine
[EV-2; EV-7] Two
"""


def audit_tables(spark):
    reports = spark.createDataFrame([(1, "ELECTRONIC_WARFARE", BODY)], "report_id INT, pillar STRING, body_md STRING")
    templates = spark.createDataFrame([("Findings", "findings"), ("Limits", "limits")], "title STRING, section_key STRING")
    graph = spark.createDataFrame([("EV-1", "evidence", "A"), ("EV-2", "evidence", "C")], "cited_id STRING, kind STRING, class STRING")
    gates = spark.createDataFrame([("VG-EL-01", "OPEN", "Claims for the Electronic Warfare pillar")], "gate_id STRING, status STRING, blocks STRING")
    return reports, templates, graph, gates


def test_violations_and_separate_checks_agree(spark):
    reports, templates, graph, gates = audit_tables(spark)
    flags = U.flagged(U.sentences(U.sections(reports, templates)))
    got = sorted((r.check, r.severity) for r in U.violations(flags, graph, gates).collect())
    assert got == [("CITATION", "BLOCKER"), ("CLASS_C", "BLOCKER"), ("UNSOURCED", "BLOCKER")]
    assert [r.cited_id for r in U.citation_violations(flags, graph).collect()] == ["EV-9"]
    assert [r.check for r in U.class_violations(flags, graph).collect()] == ["CLASS_C"]
    gap = reports.withColumn("body_md", F.lit("## Limits\nThe UAE lacks all cover [EV-1] on that coast."))
    flags = U.flagged(U.sentences(U.sections(gap, templates)))
    assert [r.check for r in U.violations(flags, graph, gates).collect()] == ["GATE"]
    assert [r.gate_id for r in U.gate_violations(flags, gates).collect()] == ["VG-EL-01"]


def test_prune_leaves_clean_markdown(spark):
    reports, templates, graph, gates = audit_tables(spark)
    graph = graph.withColumn("class", F.lit("A"))
    more = reports.withColumn("body_md", F.replace("body_md", F.lit("- Layered"), F.lit("Sound masts were kept by all crews [EV-1].\n- Layered")))
    out = U.prune(more, templates, graph, gates).first()
    assert out.kept and out.removed == 2 and (out.n_before, out.n_after) == (6, 4)
    body = out.body_md
    assert "85 percent" not in body and "EV-9" not in body and "Layered cover" in body
    assert "  " not in body and " ." not in body and not any(line.strip() in ("-", "*") for line in body.splitlines())
    assert "[EV-2; EV-7] Two" in body
    # Too little would remain of the shorter body, so it stays as it was.
    kept = U.prune(reports.withColumn("body_md", F.lit("## Findings\nHostile crews were seen at every mast last year.")), templates, graph, gates).first()
    assert not kept.kept and kept.reason == "too little left" and "Hostile crews" in kept.body_md
    # One round leaves what the cut brings to light; then nothing is issued half mended.
    once = {r.reason for r in U.prune(more, templates, graph, gates, rounds=0).collect()}
    assert once == {"failures left"}


def test_env_layers(spark):
    cases = [("Abu Dhabi signed it.", "UAE", "UAE", ""), ("Middle East, Gulf or UAE targeting", "UAE", "REGIONAL", "UAE named only within a regional list"),
             ("across the Gulf", "uae", "REGIONAL", "quote names a region, not the UAE"), ("nothing here", "UAE", "REGIONAL", "quote does not name the UAE or an Emirate"),
             ("Gulf", "GLOBAL", "GLOBAL", ""), (None, None, "GLOBAL", ""), (None, "UAE", "REGIONAL", "quote does not name the UAE or an Emirate"),
             ("UAE and the region", "UAE", "UAE", ""), ("Gulf" + ", " * 15 + "Dubai", "UAE", "UAE", ""), ("Gulf" + ", " * 14 + "Dubai", "UAE", "REGIONAL", "UAE named only within a regional list")]
    df = spark.createDataFrame(cases, "q STRING, p STRING, layer STRING, why STRING")
    for r in df.select("*", T.env_layer(F.col("q"), F.col("p")).alias("v")).collect():
        assert (r.v.layer, r.v.reason, r.v.changed) == (r.layer, r.why, r.why != ""), r


def test_figure_admission_branches(spark):
    cases = [("photo", "Figure 1. x", "", False), ("CHART", "", "A glowing map of the whole coast with every mast in place", False), ("chart", "Fig. 3 Losses", "", True),
             ("MAP", "Losses by year", "", True), ("MAP", " ", "Losses of masts by year and by district of the coast", True), ("MAP", None, "Losses", False), (None, None, None, False)]
    df = spark.createDataFrame(cases, "k STRING, c STRING, a STRING, want BOOLEAN")
    got = df.select("want", T.figure_admission(F.col("k"), F.col("c"), F.col("a")).alias("v")).collect()
    assert all(r.v.admit == r.want for r in got) and sum(r.v.near_miss for r in got) == 2


def test_domains_pick_the_most_specific(spark):
    urls = spark.createDataFrame([(1, "https://www.a.b.org/x"), (2, "http://b.org:8080/"), (3, "https://notb.org"), (4, "nonsense"), (5, "https://x.dup.net")], "url_id INT, url STRING")
    domains = spark.createDataFrame([("b.org", "B", 0), ("a.b.org", "AB", 1), ("dup.net", "first", 2), ("dup.net", "second", 3), ("x.dup.net", "skip", 4)], "domain STRING, registry_id STRING, pos INT")
    got = {r.url_id: r.registry_id for r in I.map_domains(urls, domains, "AGG", ignore=("x.dup.net",)).collect()}
    assert got == {1: "AB", 2: "B", 3: "AGG", 4: "AGG", 5: "first"}


def test_text_metrics_and_registers(spark):
    s = spark.createDataFrame([(1, "The masts were lost in the night of June."), (1, "Masts fell [EV-1] to the crews."), (1, "Ensure that masts are kept.")], "k INT, sentence STRING")
    r = E.text_metrics(s, "k").first()
    assert (r.sentences, r.words, r.cited, r.unsourced, r.cites_per_10k, r.unsourced_milli) == (3, 20, 1, 1, 500, 333)
    lines = ["SIG-01 | Masts fall | x", "SIG-01 | again | x", "Finding F-02:  Crews rise", "R7 — Loss of masts — Score 6", "CU-03 — What next?"]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)] + [("short", 0, lines[0])], "source STRING, line_no INT, line STRING")
    got = {(r.kind, r.id, r.text) for r in E.pattern_registers(df).collect()}
    assert got == {("signals", "SIG-01", "Masts fall"), ("findings", "F-02", "Crews rise"), ("risks", "R7", "Loss of masts"), ("uncertainties", "CU-03", "What next?")}


def _cut_plainly(body, bad):
    """All occurrences of all texts in one walk from the left, at each place the longest."""
    out, i, bad = [], 0, sorted((b for b in bad if b), key=len, reverse=True)
    while i < len(body):
        hit = next((b for b in bad if body.startswith(b, i)), None)
        out.append("" if hit else body[i])
        i += len(hit) if hit else 1
    return "".join(out)


def test_removal_is_one_pass(spark):
    """Texts inside each other, overlapping, made by the removal itself, with signs of patterns, repeated in the references."""
    cases = [("Masts fell. Masts fell. Crews rose.", ["Masts fell.", "Masts fell. Masts fell."]), ("abcabc", ["abc", "bca"]), ("abXcd", ["X", "abcd"]),
             ("Cost (a|b)* of $5 \\E+ [x] rose", ["(a|b)*", "\\E", "$5"]), ("a^b-c]d[e&&f", ["^b", "-c", "]d", "[e", "&&"]), ("x\\y", ["\\y"]),
             ("One fact.\n## References\n[EV-1] One fact. Again", ["One fact."]), ("keep", ["lost"]), ("é ü ñ", ["ü"]), ("same", []), ("a", ["", "a"])]
    df = spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate(cases)], "i INT, body STRING, bad ARRAY<STRING>")
    got = {r.i: r.out for r in df.select("i", U.remove_sentences(F.col("body"), F.col("bad")).alias("out")).collect()}
    tidy = lambda s: "\n".join(" ".join(line.split()) for line in s.split("\n")).strip()
    for i, (body, bad) in enumerate(cases):
        assert tidy(got[i]) == tidy(_cut_plainly(body, bad)), (body, bad, got[i])


def test_removal_grows_with_the_body(spark):
    """A thousand sentences leave a body of thousands in one pass."""
    body = "\n".join(f"Sentence number {i} says that depot {i * 7} was late on most days." for i in range(6_000))
    bad = [f"Sentence number {i} says that depot {i * 7} was late on most days." for i in range(0, 6_000, 6)]
    df = spark.createDataFrame([(body, bad)], "body STRING, bad ARRAY<STRING>")
    out = df.select(U.remove_sentences(F.col("body"), F.col("bad")).alias("out")).first().out
    assert len([line for line in out.split("\n") if line]) == 5_000


def test_nested_elements_and_references(spark):
    """Equal tags inside each other, scripts with signs of tags, tags that never end, numeric references."""
    pages = [("<body><nav>a<nav>b</nav>c</nav>keep<NAV>x</NAV> on</body>", "keep on"), ("<aside><div><aside>in</aside></div>still in</aside>out", "out"),
             ("<script>if (a<b) { x = '</nav>' }</script>text<style>p>q{}</style> end", "text end"), ("a < b and <nav>lost</nav> c", "a < b and c"),
             ("<nav>never ends <p>so it stays", "never ends so it stays"), ("</nav>stray<nav/>tag", "stray tag"), ("x<!-- <nav> -->y<nav>z</nav>", "x y"),
             ("caf&#233; &#xE9;&#x1F600; &#0; &#99999999999; &amp;#65; &#38;lt;", "café é😀 � � &#65; <"), ("", ""), (None, None)]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(pages)], "i INT, html STRING")
    got = {r.i: r.t for r in df.select("i", T.html_text(F.col("html")).alias("t")).collect()}
    for i, (html, want) in enumerate(pages):
        assert got[i] == want, (html, got[i])


def test_nested_figures(spark):
    html = ('<figure class="g"><figure><img src="/a.png"><figcaption>Inner</figcaption></figure><figcaption>Outer</figcaption></figure>'
            '<figure><img src="b.png"/><figcaption>Fig &#8470; 2</figcaption></figure><header><figure><img src="c.png"></figure></header>')
    df = spark.createDataFrame([(1, "https://x.org/p/q", html)], "page_id INT, url STRING, html STRING")
    got = [(r.image_url, r.caption) for r in I.figure_candidates(df).orderBy("pos").collect()]
    assert got[0][0] == "https://x.org/a.png" and got[1] == ("https://x.org/p/b.png", "Fig № 2") and len(got) == 2
    deep = "<div>" * 3_000 + "<nav>" * 500 + "lost" + "</nav>" * 500 + "kept" + "</div>" * 3_000
    row = spark.createDataFrame([(deep,)], "html STRING").select(T.html_text(F.col("html")).alias("t")).first()
    assert row.t == "kept"
