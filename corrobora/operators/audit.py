"""The report audit: bodies to sentences, sentences to flags, flags to verdicts.

    reports(report_id, pillar, body_md)     templates(title, section_key)
    graph(cited_id, kind, class)            gates(gate_id, status, blocks)

Splitting is array work inside the report row, so it needs no shuffle and no
window; every rule is a flag of one projection over the exploded sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrobora import vocab
from corrobora.functions import audit as A, text
from corrobora.session import written


# --- splitting ---------------------------------------------------------------------

def sections(reports: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per section with the template key of its title, null if unlisted."""
    keys = templates.select(F.lower(text.strip(F.col("title"))).alias("low"), "section_key")
    raw = F.filter(A.section_blocks(F.col("body_md")), lambda s: s["text"] != "")
    out = reports.select(*[c for c in reports.columns if c in ("report_id", "pillar")],
                         F.posexplode(raw).alias("section_no", "s"))
    out = out.select("*", F.col("s.title").alias("title"), F.col("s.text").alias("text")).drop("s")
    return out.withColumn("low", F.lower("title")).join(keys, "low", "left").drop("low")


def sentences(sections_df: DataFrame) -> DataFrame:
    """One row per sentence, with two reference-list flags.

    ``in_references`` looks at every heading of the body; ``inner_references``
    only at headings inside the section, which is what a section audited on its
    own can see.
    """
    blocks = A.heading_blocks(F.col("text"), F.col("title"))
    parts = F.flatten(F.transform(blocks, lambda b, i: F.transform(
        A.sentences_of(b["text"]), lambda s: F.struct(
            b["in_references"].alias("in_references"),
            (b["in_references"] & ((i > 0) | F.rlike(b["text"], F.lit(r"^\s*#")))).alias("inner_references"),
            s.alias("sentence")))))
    keep = [c for c in ("edit_id", "report_id", "pillar", "section_no", "section_key", "title") if c in sections_df.columns]
    return sections_df.select(*keep, F.posexplode(parts).alias("pos", "p")).select(*keep, "pos", "p.*")


def flagged(sentences_df: DataFrame) -> DataFrame:
    """Every sentence-level rule as one column each, in one pass."""
    s = F.col("sentence")
    epistemic = F.coalesce(F.col("section_key").isin(*vocab.EPISTEMIC_SECTIONS), F.lit(False))
    # The lower-case form and the ids are columns of their own, computed once.
    # ``unsourced_raw`` repeats the predicates instead of naming their columns:
    # flags nobody asks for are pruned, and a cited sentence skips the regexes.
    staged = (sentences_df.withColumn("low", F.lower(s)).withColumn("cites", A.citations(s)))
    hedged = text.contains_any(F.col("low"), vocab.HEDGES)
    bare = ((F.size("cites") == 0) & ~F.col("inner_references") & A.is_assertive(s) & ~hedged
            & ~A.is_recommendation(s) & ~A.is_meta(s) & ~A.is_condition(s))
    flags = {
        "bracketed": A.bracketed(s), "cited": F.size("cites") > 0, "assertive": A.is_assertive(s), "hedged": hedged,
        "recommendation": A.is_recommendation(s), "meta": A.is_meta(s), "condition": A.is_condition(s),
        "construct": text.contains_any(F.col("low"), vocab.CONSTRUCT_MARKERS),
        "gap_claim": text.contains_any(F.col("low"), vocab.NATIONAL_SUBJECTS) & A.is_gap_claim(s),
        "unsourced_raw": bare}
    out = staged.withColumns(flags)
    return out.withColumns({"unsourced": F.col("unsourced_raw") & ~epistemic,
                            "exempt": F.col("unsourced_raw") & epistemic}).drop("low")


KEY = ("report_id", "section_no", "pos")


# --- checks --------------------------------------------------------------------------

def graph_ids(tables: dict) -> DataFrame:
    """(cited_id, kind) of every object that may be cited: ``{kind: df(cited_id)}``."""
    parts = [df.select("cited_id", F.lit(kind).alias("kind")) for kind, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def citation_violations(flags: DataFrame, graph: DataFrame) -> DataFrame:
    """Cited ids that no object of the graph carries."""
    cites = flags.where(~F.col("in_references")).select(*KEY, F.explode("cites").alias("cited_id"))
    return cites.join(graph.select("cited_id"), "cited_id", "left_anti")


def class_violations(flags: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sentences resting on class C alone without a hedge, or citing D unmarked.

    ``evidence(cited_id, class)``; unknown ids do not count.
    """
    body = flags.where(~F.col("in_references"))
    cites = body.select(*KEY, "hedged", "construct", F.explode("bracketed").alias("cited_id"))
    per = (cites.join(evidence.select("cited_id", "class"), "cited_id")
           .groupBy(*KEY).agg(F.bool_and(F.col("class") == "C").alias("only_c"),
                              F.bool_or(F.col("class") == "D").alias("any_d"),
                              F.first("hedged").alias("hedged"), F.first("construct").alias("construct")))
    found = F.array_compact(F.array(
        F.when(F.col("only_c") & ~F.col("hedged"), F.struct(F.lit("CLASS_C").alias("check"), F.lit("BLOCKER").alias("severity"))),
        F.when(F.col("any_d") & ~F.col("construct"), F.struct(F.lit("CLASS_D").alias("check"), F.lit("WARNING").alias("severity")))))
    return per.select(*KEY, F.inline(found))


def with_first_gate(claims: DataFrame, gates: DataFrame) -> DataFrame:
    """Claims (with a ``pillar``) and the first open gate that binds them, null if none does.

    A gate binds by the two letters in its id, or by naming the pillar among
    the words of what it blocks.  Both lookups hold one row per code or word.
    """
    live = gates.where(F.col("status") == "OPEN")
    by_code = (live.groupBy(F.regexp_extract("gate_id", "^VG-(..)-", 1).alias("code"))
               .agg(F.min("gate_id").alias("g1")))
    by_word = (live.select("gate_id", F.explode(F.split("blocks", r"[^A-Za-z0-9_]+")).alias("pillar"))
               .groupBy("pillar").agg(F.min("gate_id").alias("g2")))
    out = (claims.withColumn("code", F.left("pillar", F.lit(2))).join(by_code, "code", "left")
           .join(by_word, "pillar", "left"))
    return out.withColumn("gate_id", F.least("g1", "g2")).drop("code", "g1", "g2")


def gate_violations(flags: DataFrame, gates: DataFrame) -> DataFrame:
    """National gap claims made while a gate of the report's pillar is open."""
    claims = flags.where(F.col("gap_claim") & ~F.col("in_references")).select(*KEY, "pillar")
    return with_first_gate(claims, gates).where("gate_id IS NOT NULL").select(*KEY, "gate_id")


def content_words(sentence: Column) -> Column:
    """Distinct words of four or more letters, without citations."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(sentence, r"\[[^\]]*\]", " ")), "[^a-z]+", " ")
    return F.array_distinct(F.filter(F.split(plain, " "), lambda w: F.length(w) >= 4))


def entailment(flags: DataFrame, quotes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Share of a sentence's content words found in the quotes it cites.

    ``quotes(cited_id, quote)``.  A lexical stand-in for a judge: sentences
    below the threshold count as unsupported.
    """
    body = flags.where(~F.col("in_references")).select(*KEY, "sentence", F.explode("bracketed").alias("cited_id"))
    per = (body.join(quotes.select("cited_id", content_words(F.col("quote")).alias("qw")), "cited_id")
           .groupBy(*KEY).agg(F.first("sentence").alias("sentence"), F.flatten(F.collect_list("qw")).alias("qw")))
    words = content_words(F.col("sentence"))
    out = per.withColumn("words", F.size(words)).withColumn("found", F.size(F.array_intersect(words, F.col("qw"))))
    return out.select(*KEY, "words", "found",
                      (F.col("found") >= F.col("words") * threshold).alias("supported"))


def verdict_violations(checked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sentences an external judge found unsupported: ``verdicts(KEY, supported, reason)``."""
    return checked.join(verdicts.where(~F.col("supported")), list(KEY)).select(*KEY, "reason")


def sentence_findings(flags: DataFrame, graph: DataFrame, gates: DataFrame) -> DataFrame:
    """One row per offending sentence: ``bad_ids`` and ``found(check, severity)``.

    All checks share one pass.  Each sentence travels once per cited id, with its
    flags but without its text, and with its pillar only if a gate may bind it; one that
    cites nothing gets a key of its own, so uncited sentences do not pile up on a null key.
    The regexes run once.
    """
    body_cites = F.when(F.col("in_references"), F.array().cast("array<string>")).otherwise(F.col("cites"))
    # The generator is a fence: a filter behind it is not pushed into the flags,
    # which would evaluate every regex twice.
    # Hedges and construct marks matter only to a sentence with a bracketed id.
    boxed = lambda c: F.when(F.size("bracketed") > 0, F.col(c)).alias(c)
    gap = F.col("gap_claim") & ~F.col("in_references")
    needed = F.struct(boxed("hedged"), boxed("construct"), "unsourced", "bracketed", gap.alias("gap"), body_cites.alias("ids"))
    slim = (flags.select(*KEY, "pillar", F.inline(F.array(needed))).withColumn("pillar", F.when(F.col("gap"), F.col("pillar")))
            .where((F.size("ids") > 0) | F.col("unsourced") | F.col("gap")))
    rows = slim.select("*", F.explode_outer("ids").alias("id")).drop("ids")
    alone = F.concat_ws("~", F.lit(""), *KEY)
    rows = (rows.withColumn("cited_id", F.coalesce("id", alone)).withColumn("cites", F.col("id").isNotNull())
            .withColumn("boxed", F.array_contains("bracketed", F.col("cited_id"))).drop("bracketed", "id"))
    known = graph.select("cited_id", "kind", "class")
    rows = rows.join(known, "cited_id", "left")
    ev = F.col("boxed") & (F.col("kind") == "evidence")
    carried = ["pillar", "hedged", "construct", "unsourced", "gap"]
    per = rows.groupBy(*KEY).agg(
        *[F.first(c).alias(c) for c in carried],
        F.collect_list(F.when(F.col("kind").isNull() & F.col("cites"), F.col("cited_id"))).alias("bad_ids"),
        F.bool_and(F.when(ev, F.col("class") == "C")).alias("only_c"),
        F.bool_or(F.when(ev, F.col("class") == "D")).alias("any_d"))
    live = gates.where(F.col("status") == "OPEN")
    listed = live.select(F.explode(F.split("blocks", r"[^A-Za-z0-9_]+")).alias("pillar")).distinct() \
        .withColumn("gated", F.lit(True))
    by_code = live.select(F.regexp_extract("gate_id", "^VG-(..)-", 1).alias("code")).distinct() \
        .withColumn("coded", F.lit(True))
    per = (per.withColumn("code", F.left("pillar", F.lit(2)))
           .join(listed, "pillar", "left").join(by_code, "code", "left"))
    gated = F.col("gap") & (F.col("gated").isNotNull() | F.col("coded").isNotNull())

    def finding(test: Column, check: str, severity: str = "BLOCKER") -> Column:
        return F.when(test, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity")))

    found = F.array_compact(F.array(
        finding(F.size("bad_ids") > 0, "CITATION"), finding(F.col("unsourced"), "UNSOURCED"),
        finding(F.col("only_c") & ~F.col("hedged"), "CLASS_C"),
        finding(F.col("any_d") & ~F.col("construct"), "CLASS_D", "WARNING"), finding(gated, "GATE")))
    return per.select(*KEY, "bad_ids", found.alias("found")).where(F.size("found") > 0)


def violations(flags: DataFrame, graph: DataFrame, gates: DataFrame) -> DataFrame:
    """One row per violation; an unresolved citation counts once per id."""
    per = sentence_findings(flags, graph, gates)
    times = lambda f: F.when(f["check"] == "CITATION", F.size("bad_ids")).otherwise(1)
    each = F.flatten(F.transform("found", lambda f: F.array_repeat(f, times(f))))
    return per.select(*KEY, F.inline(each))


def report_verdicts(reports: DataFrame, found: DataFrame) -> DataFrame:
    """Blockers, warnings and the release flag of every report."""
    counts = found.groupBy("report_id").agg(
        F.count_if(F.col("severity") == "BLOCKER").alias("blockers"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    return (reports.select("report_id").join(counts, "report_id", "left").na.fill(0, ["blockers", "warnings"])
            .withColumn("released", F.col("blockers") == 0))


def unknown_openers(flags: DataFrame) -> DataFrame:
    """First words of unsourced sentences that the verb list lacks."""
    return (flags.where("unsourced").select(A.unknown_opener(F.col("sentence")).alias("opener"))
            .where("opener IS NOT NULL").distinct())


# --- section floors --------------------------------------------------------------------

def opener_failures(sections_df: DataFrame) -> DataFrame:
    """Executive summaries that open on a platitude or without a fact."""
    lines = F.filter(F.transform(F.split("text", "\n"), text.strip),
                     lambda l: (l != "") & ~F.rlike(l, F.lit(r"^[#|\-*>]")))
    first = F.try_element_at(lines, F.lit(1))
    low = F.lower("first")
    banned = F.lit(False)
    for opener in vocab.BANNED_OPENERS:
        banned = banned | F.startswith(low, F.lit(opener)) | F.contains(F.left(low, F.lit(60)), F.lit(opener))
    out = sections_df.where("section_key = 'exec_summary'").withColumn("first", first).where("first IS NOT NULL")
    return out.select("report_id", "section_no", banned.alias("generic"),
                      (~F.rlike("first", F.lit(vocab.OPENER_FACT))).alias("no_fact"))


def density(flags: DataFrame, evidence_sections: list[str]) -> DataFrame:
    """Assertive and evidence-citing sentences of sections that were given evidence."""
    per = (flags.where(F.col("section_key").isin(*evidence_sections) & ~F.col("inner_references"))
           .groupBy("report_id", "section_no").agg(
               F.count_if("assertive").alias("assertive"),
               F.count_if(F.rlike("sentence", F.lit(r"\b(EV-[A-Z0-9-]+)\b"))).alias("with_evidence")))
    need = F.greatest(F.lit(1), F.floor(F.col("assertive") / 3)).cast("long")
    return per.withColumn("need", F.when(F.col("assertive") < 3, 0).otherwise(need)) \
        .withColumn("thin", F.col("with_evidence") < F.col("need"))


def structure(sections_df: DataFrame, titled_sections: list[str], minimum: int = 3) -> DataFrame:
    """Bold action titles of sections that ask for them; naming a gap excuses."""
    titles = F.size(F.regexp_extract_all("text", F.lit(vocab.BOLD_TITLE), F.lit(0)))
    gap = F.rlike("text", F.lit(vocab.NAMES_A_GAP))
    return (sections_df.where(F.col("section_key").isin(*titled_sections))
            .select("report_id", "section_no", titles.alias("titles"), ((titles < minimum) & ~gap).alias("failed")))


def figure_notes(sections_df: DataFrame, available: Column) -> DataFrame:
    """Figures each section cites; ``idle`` when some were available and none cited."""
    ids = A.cited_figures(F.col("text"))
    return sections_df.select("report_id", "section_no", F.array_join(ids, ",").alias("figures"),
                              ((available > 0) & (F.size(ids) == 0)).alias("idle"))


def section_verdicts(sections_df: DataFrame, found: DataFrame, openers: DataFrame, dense: DataFrame,
                     shape: DataFrame) -> DataFrame:
    """PASS or WITHHELD per section, with the checks that failed."""
    key = ["report_id", "section_no"]
    hard = (found.where("severity = 'BLOCKER' AND check IN ('CITATION', 'UNSOURCED')")
            .select(*key, "check").distinct())
    soft = (openers.where("generic OR no_fact").select(*key, F.lit("OPENER").alias("check"))
            .unionByName(dense.where("thin").select(*key, F.lit("DENSITY").alias("check")))
            .unionByName(shape.where("failed").select(*key, F.lit("STRUCTURE").alias("check"))))
    # At most five distinct checks per section, so the set is bounded.
    failed = hard.unionByName(soft).groupBy(*key).agg(F.array_sort(F.collect_set("check")).alias("failures"))
    out = sections_df.select(*key).join(failed, key, "left")
    return out.select(*key, F.coalesce(F.array_join("failures", ","), F.lit("")).alias("failures"),
                      F.when(F.col("failures").isNull(), "PASS").otherwise("WITHHELD").alias("verdict"))


# --- repair --------------------------------------------------------------------------------

def any_of_literals(words: Column) -> Column:
    """Pattern that matches any of the given texts as they stand, the first listed first.

    Positions that begin none of them are passed by after one look at the letter.
    """
    quoted = lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    begins = F.array_distinct(F.transform(words, lambda w: F.left(w, F.lit(1))))
    return F.concat(F.lit("(?=[\\Q"), F.array_join(F.filter(begins, lambda c: c != "\\"), ""), F.lit("\\E\\\\])(?:"),
                    F.array_join(F.transform(words, quoted), "|"), F.lit(")"))


def remove_sentences(body: Column, bad: Column) -> Column:
    """Body without the given sentences, tidied of what they leave behind.

    All occurrences of all sentences go in one pass, the leftmost first and at one place the
    longest, so a sentence is never cut inside a longer one and no text that only the
    removal brought together is taken for one.  Sentences also go from the reference list.
    """
    ranked = F.array_sort(F.transform(F.filter(bad, lambda s: s != ""), lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s"))))
    cut = F.when(F.size(bad) > 0, F.regexp_replace(body, any_of_literals(F.transform(ranked, lambda p: p["s"])), F.lit(""))).otherwise(body)
    steps = (
        lambda l: F.regexp_replace(F.regexp_replace(l, r"[ \t]{2,}", " "), r"\s+$", ""),
        lambda l: F.when(F.rlike(l, F.lit(r"^\s+([-*+]|\d+[.)])\s")), l).otherwise(F.regexp_replace(l, r"^\s+", "")),
        lambda l: F.regexp_replace(l, r"\s+([.,;:])", "$1"))
    lines = F.split(cut, "\n")
    for step in steps:
        lines = F.transform(lines, step)
    lines = F.filter(lines, lambda l: ~F.rlike(l, F.lit(r"^\s*([-*+]|\d+[.)])\s*$")))
    return text.strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def drop_orphan_references(body: Column) -> Column:
    """Body without reference lines none of whose ids the prose still cites."""
    prose = F.substring_index(body, "\n## References", 1)
    refs = F.substring(body, F.length(prose) + F.length(F.lit("\n## References")) + 1, F.length(body))
    groups = F.flatten(F.transform(F.regexp_extract_all(prose, F.lit(r"\[([^\]]+)\]"), F.lit(1)),
                                   lambda g: F.split(g, r"\s*[;,]\s*")))
    cited = F.array_union(A.citations(prose), groups)
    ids = lambda l: F.split(F.regexp_extract(text.strip(l), r"^\[([^\]]+)\]", 1), r"\s*[;,]\s*")
    # The ids of the prose are an element of their own: named inside the filter they would be found again for every line.
    keep = F.flatten(F.transform(F.array(cited), lambda c: F.filter(
        F.split(refs, "\n"), lambda l: ~F.rlike(text.strip(l), F.lit(r"^\[[^\]]+\]")) | F.arrays_overlap(ids(l), c))))
    return F.when(F.contains(body, F.lit("\n## References")),
                  F.concat(prose, F.lit("\n## References"), F.array_join(keep, "\n"))).otherwise(body)


def sentence_keys(body: Column) -> Column:
    """All that a verdict on a sentence rests on, one text a sentence of the body; row-local.

    Two reference flags, ``T`` and the section title in small letters or ``N`` for none, a line break, the
    sentence.  Neither a title nor a sentence holds a line break.
    """
    bit = lambda c: F.when(c, "1").otherwise("0")

    def of_section(s: Column) -> Column:
        head = F.coalesce(F.concat(F.lit("T"), F.lower(s["title"])), F.lit("N"))
        return F.flatten(F.transform(A.heading_blocks(s["text"], s["title"]), lambda b, i: F.transform(
            A.sentences_of(b["text"]), lambda x: F.concat(
                bit(b["in_references"]), bit(b["in_references"] & ((i > 0) | F.rlike(b["text"], F.lit(r"^\s*#")))),
                head, F.lit("\n"), x))))

    return F.flatten(F.transform(F.filter(A.section_blocks(body), lambda s: s["text"] != ""), of_section))


def prune(reports: DataFrame, templates: DataFrame, graph: DataFrame, gates: DataFrame,
          rounds: int = 2) -> DataFrame:
    """Cut the sentences that block a report, drop orphaned references, audit again.

    A report keeps its pruned body only if no sentence blocks it any more and at
    least max(3, 60 %) of its sentences remain; else the original comes back with
    the ``reason``: 'not verbatim' (a blocking sentence is not in the body as it
    stands), 'failures left' (the audit after the last round) or 'too little
    left'.  ``removed`` counts the sentences cut.  A sentence is judged once: a later round
    asks only for those that the cut before it made.

    Sentences travel without their text, as places in their report, and a body moves once, to
    meet those that block it; there it is split again.  A round writes one body a report.  Only
    reports that the cut left open, with new sentences or with some that still block, go on.
    """
    none = F.array().cast("array<string>")
    listed = templates.select(F.lower(text.strip(F.col("title"))).alias("low"), "section_key")
    outside = F.size(F.filter("keys", lambda k: F.startswith(k, F.lit("0"))))

    def opened(body: DataFrame) -> DataFrame:
        """Whole reports before the first round: every sentence is asked for."""
        return body.withColumn("keys", sentence_keys(F.col("body_md"))).withColumns({
            "original": F.col("body_md"), "removed": F.lit(0), "missed": F.lit(0), "n_before": outside,
            "fresh": F.array_distinct("keys"), "blocked": none})

    def blocking(body: DataFrame) -> DataFrame:
        """(report_id, at): places in ``fresh`` of what blocks."""
        key, head = F.col("key"), F.substring_index("key", "\n", 1)
        rows = (body.select("report_id", "pillar", F.lit(0).alias("section_no"), F.posexplode("fresh").alias("pos", "key"))
                .select("*", F.when(F.substring(head, 3, 1) == "T", F.substring(head, F.lit(4), F.length(head))).alias("low"),
                        F.startswith(key, F.lit("1")).alias("in_references"), (F.substring(key, 2, 1) == "1").alias("inner_references"),
                        F.substring(key, F.length(head) + 2, F.length(key)).alias("sentence"))
                .join(listed, "low", "left").drop("low"))
        hard = F.exists("found", lambda f: f["severity"] == "BLOCKER")
        return (sentence_findings(flagged(rows), graph, gates).where(hard)
                .groupBy("report_id").agg(F.collect_set("pos").alias("at")))

    def decided(body: DataFrame, held: Column) -> DataFrame:
        """The reason of each report, and the body that it comes back with."""
        enough = F.col("n_after") >= F.greatest(F.lit(3), F.bround(F.col("n_before") * 0.6).cast("int"))
        reason = F.when(F.col("missed") > 0, "not verbatim").when(held, "failures left").when(~enough, "too little left")
        return body.withColumn("n_after", outside).withColumn("reason", reason).withColumn(
            "body_md", F.when(F.col("reason").isNull(), F.col("body_md")).otherwise(F.col("original")))

    body, split, results = reports.select("report_id", "pillar", "body_md"), opened, []
    for later in range(rounds, -1, -1):
        # Split on both sides of the join: the sentences are not shuffled with their body.
        body = split(body.join(blocking(split(body)), "report_id", "left"))
        # Bound once: named inside the lambda, the sentences would be made distinct again for every place.
        found = text.let(F.col("fresh"), lambda fresh: F.transform("at", lambda i: F.get(fresh, i)))
        body = body.withColumn("blocked", F.concat("blocked", F.coalesce(found, none))).drop("at", "fresh")
        if not later:
            results.append(decided(body, F.size("blocked") > 0))
            break
        # Staged columns: each is computed once, however often the next one uses it.
        body = body.withColumn("bad", F.array_distinct(F.transform("blocked", lambda k: F.substring_index(k, "\n", -1))))
        body = body.withColumn("here", F.filter("bad", lambda s: F.contains(F.col("body_md"), s)))
        body = body.withColumns({"n": F.size("here"), "lost": F.size("bad") - F.size("here")})
        body = body.withColumn("cut", F.when(F.col("n") > 0, remove_sentences(F.col("body_md"), F.col("here"))))
        body = body.withColumn("cut", F.when(F.col("n") > 0, drop_orphan_references(F.col("cut"))))
        body = body.withColumn("left", F.when(F.col("n") > 0, sentence_keys(F.col("cut"))))
        body = body.select(
            "report_id", "pillar", "original", "n_before", F.coalesce("cut", "body_md").alias("body_md"), (F.col("removed") + F.col("n")).alias("removed"),
            (F.col("missed") + F.col("lost")).alias("missed"), F.coalesce("left", "keys").alias("keys"),
            F.coalesce(F.array_except("left", "keys"), none).alias("fresh"), F.coalesce(F.array_intersect("left", "blocked"), "blocked").alias("blocked"))
        body = body.withColumn("open", (F.size("fresh") > 0) | (F.size("blocked") > 0))
        done = decided(body.withColumn("cut", F.col("body_md")), F.lit(False))
        # A report that is done leaves one text behind.
        kept = F.col("open")
        table = written(done.select(
            "report_id", "pillar", "open", "removed", "missed", "n_before", "n_after", "reason", F.when(kept, F.col("cut")).otherwise(F.col("body_md")).alias("body_md"),
            *[F.when(kept, F.col(c)).alias(c) for c in ("original", "keys", "fresh", "blocked")]), compression="zstd")
        results.append(table.where("NOT open"))
        body, split = table.where("open"), lambda df: df
    columns = ["report_id", "pillar", "removed", "n_before", "n_after", "reason", "body_md"]
    out = results[0].select(*columns)
    for result in results[1:]:
        out = out.unionByName(result.select(*columns))
    return out.withColumn("kept", F.col("reason").isNull())


def check_edits(edits: DataFrame, reports: DataFrame, graph: DataFrame, gates: DataFrame) -> DataFrame:
    """Judge proposed passages and apply the good ones.

    ``edits(edit_id, report_id, original_text, proposed_text)``.  A passage that
    cites an unknown id, asserts without a source or breaks an open gate is
    REJECTED; one whose original text is gone is SUPERSEDED; else APPLIED, with
    its first occurrence replaced.
    """
    passage = edits.select("edit_id", "report_id", F.lit(0).alias("section_no"),
                           F.lit(None).cast("string").alias("section_key"), F.lit("").alias("title"),
                           F.col("proposed_text").alias("text"))
    flags = flagged(sentences(passage))
    whole = edits.select("edit_id", F.explode(F.array_distinct(A.object_refs(F.col("proposed_text")))).alias("cited_id"))
    unresolved = whole.join(graph.select("cited_id"), "cited_id", "left_anti") \
        .select("edit_id", F.lit("unresolved").alias("why")).distinct()
    # The passage check exempts only sentences that say validation is required.
    low = F.lower("sentence")
    gap = (text.contains_any(low, vocab.NATIONAL_SUBJECTS) & F.rlike("sentence", F.lit(vocab.GAP_LANGUAGE))
           & ~F.contains(low, F.lit("customer validation")) & ~F.contains(low, F.lit("validation required")))
    whys = F.array_compact(F.array(F.when(F.col("unsourced"), "unsourced"), F.when(gap, "gate")))
    # One pass over the sentences: what may break a gate goes on with the rest and meets the gates there.
    raised = flags.select("edit_id", "report_id", F.explode(whys).alias("why")).distinct()
    raised = with_first_gate(raised.join(reports.select("report_id", "pillar"), "report_id", "left"), gates) \
        .where("why <> 'gate' OR gate_id IS NOT NULL").select("edit_id", "why")
    bad = (unresolved.unionByName(raised)
           .groupBy("edit_id").agg(F.array_sort(F.collect_set("why")).alias("problems")))
    # Bodies go to the edits that are left; a rejected edit stays with its report, so that no key gathers all of them.
    judged = edits.join(bad, "edit_id", "left").withColumnRenamed("report_id", "of")
    out = judged.join(reports.select("report_id", "body_md"), (F.col("of") == F.col("report_id")) & F.col("problems").isNull(), "left")
    # One search a body: what stands before the passage, and by its bytes what stands behind.
    out = out.withColumn("head", F.call_function("substring_index", F.col("body_md"), F.col("original_text"), F.lit(1)))
    present = (F.col("original_text") != "") & (F.octet_length("head") < F.octet_length("body_md"))
    out = out.withColumn("status", F.when(F.col("problems").isNotNull(), "REJECTED")
                         .when(F.coalesce(present, F.lit(False)), "APPLIED").otherwise("SUPERSEDED"))
    raw = F.col("body_md").cast("binary")
    tail = F.substring(raw, F.octet_length("head") + F.octet_length("original_text") + 1, F.octet_length("body_md"))
    body = F.concat("head", "proposed_text", tail.cast("string"))
    return out.select("edit_id", F.col("of").alias("report_id"), "status",
                      F.coalesce(F.array_join("problems", ","), F.lit("")).alias("problems"),
                      F.when(F.col("status") == "APPLIED", body).alias("new_body"))


def embed_figures(reports: DataFrame, figures: DataFrame) -> DataFrame:
    """Bodies with each cited figure placed behind the paragraph that cites it.

    ``figures(cited_id, url, describes, caption, credit_line, doc_url, admitted,
    reachable)``.  Paragraphs are rejoined by position; they are bounded by their
    report.
    """
    paras = reports.select("report_id", F.posexplode(F.split("body_md", "\n\n")).alias("pos", "para"))
    cites = paras.select("report_id", "pos", F.posexplode(A.cited_figures(F.col("para"))).alias("k", "cited_id"))
    good = figures.where("admitted AND reachable")
    caption = F.regexp_replace(text.strip(F.coalesce(F.nullif("caption", F.lit("")), F.col("describes"), F.lit(""))), r"\.+$", "")
    alt = F.replace(F.coalesce(F.nullif("describes", F.lit("")), F.nullif(caption, F.lit("")), F.col("cited_id")), F.lit("]"), F.lit(")"))
    drawn = F.concat(F.lit("!["), alt, F.lit("]("), F.col("url"), F.lit(")\n\n*"), F.col("cited_id"),
                     F.lit(" — "), caption, F.lit(". "), F.coalesce("credit_line", F.lit("")), F.lit("* <"),
                     F.coalesce("doc_url", F.lit("")), F.lit(">"))
    placed = (cites.join(good, "cited_id").select("report_id", "pos", "k", drawn.alias("para")))
    parts = paras.select("report_id", "pos", F.lit(-1).alias("k"), "para").unionByName(placed)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "k", "para")))
    return (parts.groupBy("report_id").agg(ordered.alias("p"), F.count_if(F.col("k") >= 0).alias("figures"))
            .select("report_id", "figures", F.array_join(F.transform("p", lambda x: x["para"]), "\n\n").alias("body_md")))
