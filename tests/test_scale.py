"""Steps whose work must follow the input, and tables as they lie on a cluster."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corrobora import session
from corrobora.operators import audit as U, distinct as D, matching as M, readiness as R
from corrobora.plans import q_audit
from corrobora.plans.views import Tables
from corrobora.sources import sinks

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["l1_incremental_intake", "l1_compacted_batches"])
def test_stream_of_a_table_that_is_a_folder(spark, tmp_path, name):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    documents.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got, want = (sorted(map(tuple, entry.queries()[name](spark, d).collect()), key=repr) for d in (str(tmp_path), SMALL))
    assert len(os.listdir(tmp_path / "documents.parquet")) > 3 and got == want


def test_topics_meet_sources_once(spark):
    """The evidence of a nation is folded to its topics before it meets the nation's sources."""
    plan = Tables(spark, SMALL).topic_sources._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner, (nation_key")
    assert "Aggregate [topic_id" in plan[:join] and "Aggregate [topic_id" in plan[join:], plan


def test_exploded_names_are_not_broadcast(spark):
    """Estimates do not see an explosion: what was exploded goes to the driver only if an aggregate follows."""
    plan = entry.queries()["d8_scenario_name_match"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    lines = [(len(line) - len(line.lstrip(" :+-|*")), line) for line in plan.split("== Initial Plan ==")[-1].splitlines()]
    for at, (depth, line) in enumerate(lines):
        if "BroadcastExchange" in line:
            for deeper, inside in lines[at + 1:]:
                if deeper <= depth or "Aggregate" in inside:
                    break
                assert "Generate" not in inside, plan


@pytest.mark.parametrize("name", ["e21_same_fact_components", "e21_merged_sources", "e21_merged_signal_links"])
def test_merge_takes_two_verdicts_in_three(spark, name):
    """The merge queries work on the pairs they worked on first, not on the third of them with the surest verdicts."""
    assert "AS DOUBLE) / 20 AS probability" in entry.oracle_sql()[name] and "probability >= 0.25)" in entry.oracle_sql()[name]
    evidence = Tables(spark, SMALL).evidence.count()
    if name == "e21_same_fact_components":
        assert entry.queries()[name](spark, SMALL).count() > evidence * 0.6
    else:
        assert entry.queries()[name](spark, SMALL).select("evidence_id").distinct().count() < evidence * 0.6


def test_sets_are_put_in_order_once(spark):
    """Both sides of the pairs read a written order of the words; before, each side and the crowds made it anew."""
    plan = entry.queries()["k4_same_fact_pairs"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan and "regexp_extract_all" not in plan


def test_only_texts_of_pairs_are_written(spark, monkeypatch):
    """A digest and hashes stand for the words until pairs are found, and candidates are shuffled once; before, the words
    of all sets were written twice, and each side of the pairs was shuffled by itself."""
    tables, plans, written = [], [], M.written
    monkeypatch.setattr(M, "written", lambda df, **o: (plans.append(df), tables.append(written(df, **o)), tables[-1])[2])
    rows = spark.createDataFrame([(d, 10 * d + i, c) for d in range(40) for i, c in enumerate([f"only {d} masts", f"of {d} crews and 5 ships"])]
                                 + [(1, 1000, "x y z a b c d e f g"), (1, 1001, "x y z a b c d e f g h"), (2, 1002, "x y z a b c d e f g")], "doc int, id int, c string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = M.same_fact_pairs(rows, ["doc"], "id", "c").collect()
        joined = next(p for p in plans if p.columns == ["a_id", "b_id", "n"])
        joined.collect()
        assert "ReusedExchange" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [tuple(r) for r in got] == [(1000, 1001, 10, 11)]
    texts = [t for t in tables if "string" in dict(t.dtypes).values()]
    assert [sorted(r["id"] for r in t.collect()) for t in texts] == [[1000, 1001]]


def test_written_tables_leave_no_shuffle(spark):
    """Before, what was shuffled for a table stayed on disk until the driver happened to collect its garbage."""
    shuffled = spark.range(1000).groupBy(F.pmod("id", F.lit(7)).alias("k")).agg(F.count("*").alias("n"))
    setting = spark.conf.get(session.SHUFFLE_CLEANUP, "false")
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {b for b in str(manager.getAllBlocks().mkString(" ")).split() if b.startswith("shuffle_")}
    before = kept()
    table = session.written(shuffled)
    for _ in range(50):
        if not kept() - before:
            break
        time.sleep(0.1)
    assert not kept() - before
    assert table.count() == 7 and spark.conf.get(session.SHUFFLE_CLEANUP, "false") == setting


def test_only_recent_documents_meet_the_nodes(spark):
    """Documents out of the month are folded to one row of a topic before nodes multiply them."""
    plan = entry.queries()["l3_new_per_branch"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 30) THEN document_id" in plan or "<= 30)) THEN document_id" in plan or "isnotnull(age" in plan, plan


def test_edits_are_judged_in_one_pass_and_searched_once(spark):
    """Before, each kind of problem flagged all sentences anew, and a body was searched for every use of the place."""
    plan = entry.queries()["h18_edit_check"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ought to") == 1 and "instr(" not in plan and plan.count("substring_index(body_md") == 1, plan


def test_edit_replaces_the_first_of_its_passages(spark):
    reports = spark.createDataFrame([(1, "ASIA", "é über a — a.")], "report_id int, pillar string, body_md string")
    edits = spark.createDataFrame([("x", 1, "a", "ö"), ("y", 1, "ü", "u"), ("z", 1, "zz", "u"), ("e", 1, "", "u"), ("n", 1, None, "u"), ("o", 2, "a", "u")],
                                  "edit_id string, report_id int, original_text string, proposed_text string")
    graph = spark.createDataFrame([], "cited_id string, kind string, class string")
    gates = spark.createDataFrame([], "gate_id string, status string, blocks string")
    got = {r["edit_id"]: (r["status"], r["new_body"]) for r in U.check_edits(edits, reports, graph, gates).collect()}
    gone = ("SUPERSEDED", None)
    assert got == {"x": ("APPLIED", "é über ö — a."), "y": ("APPLIED", "é uber a — a."), "z": gone, "e": gone, "n": gone, "o": gone}


def test_a_pruned_report_is_judged_by_its_new_sentences(spark, monkeypatch):
    """A later round asks only for sentences that the cut made; before, every round flagged all of them."""
    judged, flagged = [], U.flagged
    monkeypatch.setattr(U, "flagged", lambda rows: (judged.append(rows.count()), flagged(rows))[1])
    assert entry.queries()["h11_prune"](spark, SMALL).where("removed > 0").count() > 0
    assert len(judged) == 3 and judged[1] * 10 < judged[0] and judged[2] * 10 < judged[0], judged


def test_a_pruned_report_leaves_one_text_a_round(spark, monkeypatch):
    """What the cut settles is written once, as one body, and goes no further; before, each round wrote and
    shuffled every original, body and sentence."""
    tables, written = [], U.written
    monkeypatch.setattr(U, "written", lambda df, **o: (tables.append(written(df, **o)), tables[-1])[1])
    entry.queries()["h11_prune"](spark, SMALL)
    first, second = tables
    assert first.where("NOT open AND (original IS NOT NULL OR keys IS NOT NULL)").count() == 0
    assert second.count() == first.where("open").count() < first.count() / 10
    plan = entry.queries()["h11_prune"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "key" not in plan[plan.index("collect_set("):].splitlines()[0]


def test_what_a_cut_brings_to_light_is_judged_in_the_next_round(spark):
    """The first cut closes a reference that nothing carries; the second takes it out, or the report comes back."""
    loose = "hostile crews were seen at every mast last year"
    sound = "\n".join(f"- Masts of the {k} were kept by all of the crews [EV-1]." for k in ("north", "south", "east", "west"))
    body = f"## Findings\n{sound}\n- It may hold that masts fall on the coast [EV-{loose}77].\n- {loose}\n"
    reports = spark.createDataFrame([(1, "ASIA", body), (2, "ASIA", f"## Findings\n{sound}")], "report_id int, pillar string, body_md string")
    templates = spark.createDataFrame([("Findings", "findings")], "title string, section_key string")
    graph = spark.createDataFrame([("EV-1", "evidence", "A")], "cited_id string, kind string, class string")
    gates = spark.createDataFrame([], "gate_id string, status string, blocks string")
    got = {n: {r["report_id"]: r for r in U.prune(reports, templates, graph, gates, rounds=n).collect()} for n in (0, 1, 2)}
    assert [got[n][1]["reason"] for n in (0, 1, 2)] == ["failures left", "failures left", None]
    assert [got[n][1]["removed"] for n in (0, 1, 2)] == [0, 1, 2] and got[0][1]["body_md"] == got[1][1]["body_md"] == body
    assert got[2][1]["body_md"] == f"## Findings\n{sound}" and (got[2][1]["n_before"], got[2][1]["n_after"]) == (6, 4)
    assert all(got[n][2]["kept"] and got[n][2]["removed"] == 0 for n in (0, 1, 2))


def test_prose_ids_are_found_once_for_all_reference_lines(spark):
    body = "Text [EV-1].\n\n## References\n\n[EV-1] a\n[EV-2] b\n[EV-3; EV-1] c"
    row = spark.createDataFrame([(body,)], "b string").select(U.drop_orphan_references(F.col("b")).alias("b"))
    assert row.first()["b"] == body.replace("[EV-2] b\n", "")
    plan = row._jdf.queryExecution().optimizedPlan().toString()
    inner = plan[plan.index("filter(split("):]
    assert "OPT-[A-Z]" not in inner[:inner.index("arrays_overlap")], plan


def test_counts_by_sets_are_the_counts_of_bitmaps(spark):
    pairs = spark.createDataFrame([("a", "g1", True), ("a", "g2", True), ("b", "g1", False), ("b", "g1", False), ("c", "g2", True), (None, "g1", True), ("d", None, True)],
                                  "item string, g string, even boolean")
    members = spark.createDataFrame([("k", "g1"), ("k", "g2"), ("l", "g2"), ("m", "g3")], "k string, g string")
    for key, above in (("k", members), ("g", members.select("g"))):
        ours = D.counts_by_sets(above, key, "g", pairs, "item", ("even",), "n").collect()
        theirs = D.counts_above(above, key, "g", D.bitmaps(pairs, "g", "item", ("even",)), "n").collect()
        assert sorted(map(tuple, (r.asDict().values() for r in ours))) == sorted((r[key], r["n"], r["even"]) for r in theirs) != []


@pytest.mark.parametrize("name", ["e25_branch_readiness", "e26_topic_readiness"])
def test_readiness_puts_no_item_in_order(spark, name):
    """Before, documents and signals were numbered over a range, which computes them twice, and old documents met the evidence."""
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "monotonically_increasing_id" not in plan, plan


@pytest.mark.parametrize("name", ["e25_branch_readiness", "e26_topic_readiness"])
def test_readiness_meets_the_sources_in_one_pass(spark, name):
    """Lines are read for the documents and for the sources; before, both once for publishers and once more for recent documents, with repeats dropped first."""
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2, plan


def test_a_topic_counts_its_sources_and_signals_once(spark):
    """Against counts by hand; before, a topic was joined to itself as its only member, and signals met their evidence by its id."""
    day = datetime.date(2020, 1, 31)
    evidence = spark.createDataFrame([(1, "t", "A", "UAE", "s1"), (2, "t", "B", None, "s1"), (3, "t", "C", "UAE", "s2"), (4, "u", "C", "X", "s2"), (5, "v", "A", "X", None)],
                                     "evidence_id int, topic_id string, class string, env_layer string, signal_id string")
    sources = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "lost"), (4, "c"), (4, "d"), (4, "e"), (4, "f"), (9, "g")], "evidence_id int, document_id string")
    documents = spark.createDataFrame([("a", 1, day), ("b", 1, day - datetime.timedelta(31)), ("c", None, day - datetime.timedelta(8)), ("d", 7, day - datetime.timedelta(30)),
                                       ("e", 7, None), ("f", 2, day + datetime.timedelta(1)), ("g", 3, day)], "document_id string, registry_id int, retrieved_on date")
    signals = spark.createDataFrame([("s1", "STRONG", "WEAKENING"), ("s2", "WEAK", "STRENGTHENING")], "signal_id string, strength string, direction string")
    spine = spark.createDataFrame([("t",), ("u",), ("v",), ("w",)], "topic_id string")
    above = spark.createDataFrame([("n", "t"), ("n", "u"), ("m", "u"), ("m", "u")], "node_id string, topic_id string")
    wanted = ("evidence", "class_a", "national", "publishers", "docs_7d", "docs_30d", "signals", "live_signals", "up", "down")
    links = evidence.select("signal_id", "evidence_id")
    for member, key, rows in ((None, "topic_id", spine), (above, "node_id", above.select("node_id").distinct())):
        for signal_evidence in (None, links):
            parts = R.readiness_measures(member, key, evidence, sources, documents, signal_evidence, signals, F.lit(day), 7)
            got = {r[key]: tuple(r[c] for c in wanted) for r in R.readiness(rows, key, parts).collect()}
            assert got == ({"t": (3, 1, 2, 1, 1, 2, 2, 1, 1, 1), "u": (1, 0, 0, 1, 0, 2, 1, 0, 1, 0), "v": (1, 1, 0, 0, 0, 0, 0, 0, 0, 0), "w": (0,) * 10}
                           if member is None else {"n": (4, 1, 2, 2, 1, 3, 2, 1, 1, 1), "m": (1, 0, 0, 1, 0, 2, 1, 0, 1, 0)}), (key, got)


def test_a_page_is_cut_into_tags_once(spark):
    """Once for its furniture and once for its figures; before, anew for every use of what was found, and for every image of a page."""
    plan = entry.queries()["c15_figure_candidates"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|<[a-z/!?][^>]*>|") == 2, plan.count("|<[a-z/!?][^>]*>|")


def test_citations_are_worked_out_once(spark, tmp_path):
    """A frame merged into folders that are there is read once; before, also for its folders, its reports and the checkpoint."""
    made = spark.sparkContext.accumulator(0)

    def text(n: int) -> str:
        made.add(1)
        return f"text {n}"

    rows = spark.range(1, 21, 1, 1).select(F.col("id").alias("report_id"), F.lit("EV-1").alias("cited_id"), F.udf(text, "string")("id").alias("text"))
    for times in (1, 2):
        sinks.write_citations(rows, f"{tmp_path}/frozen", buckets=4)
        assert made.value == 20 * times
    assert spark.read.parquet(f"{tmp_path}/frozen").count() == 20


def test_only_flags_that_are_read_are_written(spark, monkeypatch):
    """The table of flags under the section checks; before, it held those of other checks too."""
    tables, keep = [], q_audit.written
    monkeypatch.setattr(q_audit, "written", lambda df: (tables.append(df.columns), keep(df))[1])
    entry.queries()["h17_section_verdicts"](spark, SMALL)
    assert len(tables) == 2 and {"unsourced", "gap_claim", "assertive"} <= set(tables[1])
    assert not {"recommendation", "meta", "condition", "exempt", "cited"} & set(tables[1])
