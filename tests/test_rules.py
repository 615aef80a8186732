"""Rule contracts on small tables: bands, independence, gates, forecasts, severity."""

import itertools

from pyspark.sql import functions as F

from corrobora.functions import rules
from corrobora.operators import provenance as P


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_class_and_confidence_bands(spark):
    cases = [(1, 1, "A", "HIGH"), (1, 2, "A", "HIGH"), (2, 2, "B", "MEDIUM_HIGH"), (4, 2, "B", "MEDIUM_HIGH"),
             (2, 1, "C", "MEDIUM"), (3, 1, "C", "MEDIUM"), (4, 1, "C", "LOW"), (None, 0, "C", "LOW"),
             (None, 2, "B", "MEDIUM_HIGH")]
    df = spark.createDataFrame(cases, "tier INT, n INT, cls STRING, conf STRING")
    out = df.select("cls", rules.evidence_class(F.col("tier"), F.col("n")), "conf",
                    rules.evidence_confidence(F.col("tier"), F.col("n")))
    assert all(a == b and c == d for a, b, c, d in rows_of(out))


def test_strength_direction_and_gate(spark):
    strength = [(0, None, "WEAK"), (1, 2, "WEAK"), (1, 1, "WEAK"), (2, 3, "EMERGING"), (2, 1, "STRONG_EMERGING"),
                (3, 4, "STRONG"), (7, 1, "STRONG")]
    df = spark.createDataFrame(strength, "n INT, tier INT, want STRING")
    assert all(a == b for a, b in rows_of(df.select("want", rules.signal_strength(F.col("n"), F.col("tier")))))
    forced = [(1, 4, "UNCERTAIN"), (1, 3, None), (2, 4, None), (0, None, None)]
    df = spark.createDataFrame(forced, "n INT, tier INT, want STRING")
    assert all(a == b for a, b in rows_of(df.select("want", rules.forced_direction(F.col("n"), F.col("tier")))))
    gates = [(0, 0, False), (1, 1, False), (9, 1, False), (2, 2, True), (5, 4, True)]
    df = spark.createDataFrame(gates, "r INT, p INT, want BOOLEAN")
    assert all(a == b for a, b in rows_of(df.select("want", rules.gate_satisfied(F.col("r"), F.col("p")))))


def provenance_tables(spark):
    registry = spark.createDataFrame([("T1", 1), ("T2", 2), ("T4a", 4), ("T4b", 4)], "registry_id STRING, tier INT")
    docs = spark.createDataFrame([("d1", "T2"), ("d2", "T2"), ("d3", "T1"), ("d4", None), ("d5", "T4a"), ("d6", "T4b")],
                                 "document_id STRING, registry_id STRING")
    es = spark.createDataFrame([("live1", "d1"), ("live2", "d2"), ("old", "d3"), ("agg", "d4"), ("two", "d5"), ("two", "d6")],
                               "evidence_id STRING, document_id STRING")
    return P.provenance_rows(es, docs, registry)


def test_archived_evidence_never_strengthens(spark):
    rows = provenance_tables(spark)
    signals = spark.createDataFrame([("s", "STRENGTHENING"), ("none", "WEAKENING")], "signal_id STRING, direction STRING")
    se = spark.createDataFrame([("s", "live1"), ("s", "old")], "signal_id STRING, evidence_id STRING")
    live = spark.createDataFrame([("live1",)], "evidence_id STRING")
    both = spark.createDataFrame([("live1",), ("old",)], "evidence_id STRING")
    got = {r.signal_id: r.strength for r in P.score_signals(signals, se, live, rows).collect()}
    assert got == {"s": "WEAK", "none": "WEAK"}
    assert {r.signal_id: r.strength for r in P.score_signals(signals, se, both, rows).collect()}["s"] == "STRONG_EMERGING"


def test_publishers_are_counted_not_documents(spark):
    rows = provenance_tables(spark)
    detail = {r.evidence_id: r for r in P.provenance_detail(rows, "evidence_id").collect()}
    assert (detail["agg"].documents, detail["agg"].publishers) == (1, 0)
    assert (detail["two"].documents, detail["two"].publishers, detail["two"].tiers) == (2, 2, [4])
    ev = spark.createDataFrame([("live1",), ("agg",), ("two",), ("bare",)], "evidence_id STRING")
    got = {r.evidence_id: (r["class"], r.confidence) for r in P.classify_evidence(ev, rows).collect()}
    assert got == {"live1": ("C", "MEDIUM"), "agg": ("C", "LOW"), "two": ("B", "MEDIUM_HIGH"), "bare": ("C", "LOW")}


def test_one_publisher_never_corroborates(spark):
    """However many rows and documents one publisher has, nothing rises."""
    grid = list(itertools.product((1, 2, 5, 50), (2, 3, 4)))
    es = [(f"e{t}-{n}-{i}", f"d{t}-{n}-{i}") for n, t in grid for i in range(n)]
    docs = [(d, f"pub{d.split('-')[0]}-{d.split('-')[1]}") for _, d in es]
    reg = {(p, int(p[4])) for _, p in docs}
    rows = P.provenance_rows(spark.createDataFrame(es, "evidence_id STRING, document_id STRING"),
                             spark.createDataFrame(docs, "document_id STRING, registry_id STRING"),
                             spark.createDataFrame(sorted(reg), "registry_id STRING, tier INT"))
    se = spark.createDataFrame([(e.rsplit("-", 1)[0], e) for e, _ in es], "signal_id STRING, evidence_id STRING")
    sig = se.select("signal_id", F.lit("UNCERTAIN").alias("direction")).distinct()
    ev = se.select("evidence_id")
    assert {r.strength for r in P.score_signals(sig, se, ev, rows).collect()} == {"WEAK"}
    classes = P.classify_evidence(ev, rows)
    assert {r["class"] for r in classes.collect()} == {"C"}
    strong = classes.withColumn("class", F.lit("A"))
    national = ev.withColumn("env_layer", F.lit("UAE")).withColumn("pillar", F.regexp_extract("evidence_id", "^(.*)-", 1))
    spine = national.select("pillar").distinct()
    none = spark.createDataFrame([], "pillar STRING, status STRING")
    gates = P.inference_gates(national, strong, rows, spine, none)
    assert {r.status for r in gates.collect()} == {"OPEN"} and gates.count() == len(grid)


def test_gate_opens_again_and_passes_only_from_open(spark):
    cases = [(True, None, None), (True, "OPEN", "PASSED"), (True, "PASSED", "PASSED"), (False, None, "OPEN"), (False, "PASSED", "OPEN")]
    df = spark.createDataFrame(cases, "ok BOOLEAN, was STRING, want STRING")
    assert all(a == b for a, b in rows_of(df.select("want", rules.gate_state(F.col("ok"), F.col("was")))))


def test_forecast_calibration(spark):
    cases = [(3, 3, "H0_3", 0, "LIKELY", "HIGH", 5), (2, 3, "H0_3", 0, "LIKELY", "MEDIUM_HIGH", 4), (3, 2, "H5_10", 0, "POSSIBLE", "MEDIUM", 2),
             (3, 1, "H3_5", 1, "UNCERTAIN", "LOW", 1), (0, 0, "H7_PLUS", 9, "SPECULATIVE", "LOW", -5), (3, 3, "SOON", 0, "POSSIBLE", "MEDIUM", 3)]
    df = spark.createDataFrame(cases, "b INT, p INT, h STRING, u INT, band STRING, conf STRING, score INT")
    out = df.select("band", "conf", "score", rules.calibrate(F.col("b"), F.col("p"), F.col("h"), F.col("u")).alias("c")).select("*", "c.*")
    assert all((r.band, r.conf, r[2]) == (r.plausibility, r.confidence, r["c"].score) for r in out.collect())


def test_bands_severity_and_exact_ratio(spark):
    r = spark.range(1).select(
        *[rules.likelihood(F.lit(n)) for n in (0, 1, 2, 9)], *[rules.impact(F.lit(n)) for n in (0, 1, 2, 3)],
        rules.cross_impact_severity(F.lit("STRONG"), F.lit("STRONG")), rules.cross_impact_severity(F.lit("STRONG"), F.lit("WEAK")),
        rules.cross_impact_severity(F.lit(None).cast("string"), F.lit("WEAK")),
        *[rules.ratio(F.lit(a), F.lit(b), 1000) for a, b in ((1, 16), (3, 16), (2, 3), (0, 0))]).first()
    assert list(r) == [1, 2, 3, 3, 1, 1, 2, 3, 3, 2, 1, 62, 188, 667, 0]


def test_sql_functions_are_the_rules(spark):
    """Each SQL function gives what its Column gives, nulls included."""
    from corrobora.functions import sql as SQLF
    names = SQLF.register_functions(spark)
    values = {"INT": (None, 0, 1, 2, 4), "BIGINT": (None, 0, 2, 3), "STRING": (None, "STRONG", "WEAK", "OPEN", "H3_5", "x"), "BOOLEAN": (None, True, False)}
    for name, parameters, rule in SQLF._RULES:
        pairs = [p.split() for p in parameters.split(", ")]
        rows = list(itertools.product(*[values[k] for _, k in pairs]))
        df = spark.createDataFrame(rows, parameters)
        df.createOrReplaceTempView("rule_inputs")
        got = spark.sql(f"SELECT {name}({', '.join(p for p, _ in pairs)}) AS v FROM rule_inputs").collect()
        want = df.select(rule(*[F.col(p) for p, _ in pairs]).alias("v")).collect()
        plain = lambda r: tuple(r.v) if isinstance(r.v, tuple) else r.v
        assert sorted(map(repr, map(plain, got))) == sorted(map(repr, map(plain, want))), name
    assert len(names) == len(set(names)) == len(SQLF._RULES)


def test_labels_at_any_depth(spark):
    kind = ("id INT, status STRING, a STRUCT<gate: STRING, other: STRING, l: ARRAY<STRUCT<horizon: STRING, status: ARRAY<STRING>>>>, m MAP<STRING, STRING>, "
            "d MAP<STRING, STRUCT<strength: STRING>>, n ARRAY<ARRAY<STRUCT<pillar: STRING, k: INT>>>, plain ARRAY<INT>, q MAP<INT, STRING>, `dot.ted` STRUCT<status: INT>")
    row = (1, "OPEN", ("FIRED", "OPEN", [("H0_3", ["LOW", None, "odd"]), None]), {"status": "HIGH", "x": "HIGH", "gate": None}, {"OPEN": ("WEAK",), "n": None},
           [[("AI", 3)], None, []], [1], {1: "OPEN"}, (5,))
    df = spark.createDataFrame([row, (2, None, None, None, None, None, None, None, None)], kind)
    out = rules.humanised(df)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in df.schema]
    got, empty = out.orderBy("id").collect()
    assert got.status == "Open" and got.a.gate == "Fired" and got.a.other == "OPEN" and got.a.l[0].horizon == "0–3 years" and got.a.l[0].status == ["Low", None, "odd"] and got.a.l[1] is None
    assert got.m == {"status": "High", "x": "HIGH", "gate": None} and got.d["OPEN"].strength == "Weak" and got.d["n"] is None
    assert got.n[0][0].pillar == "Artificial Intelligence" and got.n[1] is None and got.plain == [1] and got.q == {1: "OPEN"} and got["dot.ted"].status == 5
    assert tuple(empty) == (2,) + (None,) * 8


def test_sections_are_blocked_only_without_any_row(spark):
    from corrobora.operators import matching as M
    rows = spark.createDataFrame([("s1", "a", "mast"), ("s1", "a", "no"), ("s1", "b", "no"), ("s2", "a", "no"), ("s2", "b", "no"), ("s3", "a", "mast")], "section STRING, source STRING, claim STRING")
    ledger = M.input_ledger(rows, "section", "source", F.contains("claim", F.lit("mast")))
    assert {(r.section, r.input): (r.available, r.passed, r.withheld, r.off_topic) for r in ledger.collect()}["s1", "b"] == (1, 0, 1, True)
    plan = spark.createDataFrame([(s, i) for s in ("s1", "s2", "s3", "s4") for i in ("a", "b")], "section STRING, input STRING")
    got = {r.section: (r.blocked, r.absent) for r in M.section_states(plan, ledger).collect()}
    assert got == {"s1": (False, "b"), "s2": (True, ""), "s3": (False, ""), "s4": (False, "")}
