"""Matching against brute force, sinks, readers, and stream == batch."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corrobora.operators import matching as M
from corrobora.sources import readers, sinks
from corrobora.streaming import intake as S


def test_same_fact_pairs_match_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" + "x" * (i % 5) for i in range(14)]
    rows = []
    for doc in range(6):
        base = [" ".join(rng.sample(words, 9)) for _ in range(5)]
        for i in range(40):
            t = rng.choice(base).split()
            if rng.random() < .5:
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((doc, doc * 100 + i, " ".join(t)))
    sets = {}
    for d, i, t in rows:
        sets.setdefault((d, frozenset(re.findall("[a-z0-9]+", t))), []).append(i)
    want = {(min(v), i) for v in sets.values() for i in v if i != min(v)}
    reps = [(d, s, min(v)) for (d, s), v in sets.items()]
    for (d1, s1, a), (d2, s2, b) in itertools.combinations(reps, 2):
        if d1 == d2 and len(s1 & s2) / len(s1 | s2) >= .85:
            want.add((min(a, b), max(a, b)))
    df = spark.createDataFrame(rows, "doc INT, id INT, claim STRING")
    assert {(r.a_id, r.b_id) for r in M.same_fact_pairs(df, ["doc"], "id", "claim").collect()} == want
    r = M.pair_space(df, ["doc"], "claim").agg(F.sum("copies"), F.sum("rows")).first()
    assert r[0] == sum(len(v) - 1 for v in sets.values()) and r[1] == len(rows)


def test_many_copies_give_a_star(spark):
    df = spark.range(3000).select(F.lit(1).alias("doc"), F.col("id"), F.lit("the same fact about masts").alias("claim"))
    out = M.same_fact_pairs(df, ["doc"], "id", "claim")
    assert out.count() == 2999 and out.select("a_id").distinct().count() == 1


def test_relevance_refuses_pads_or_filters(spark):
    def run(hits):
        rows = spark.createDataFrame([(i, "jammer mast" if i < min(hits, 1) else "jammer" if i < hits else "none") for i in range(20)], "pos INT, claim STRING")
        return [(r.pos, r.score) for r in M.relevant(rows, ["jammer-mast", "the risk"], ["claim"], "pos").orderBy("pos").collect()]
    assert run(2) == []
    assert run(4) == [(0, 2), (1, 1), (2, 1), (3, 1), (4, 0), (5, 0)]
    assert [p for p, _ in run(9)] == list(range(9))


def test_upsert_keeps_what_is_absent(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k INT, v STRING, d INT")
    delta = spark.createDataFrame([(1, "x", None, 1), (1, "y", None, 2), (3, "z", 5, 1)], "k INT, v STRING, d INT, seq INT")
    out = sinks.upsert(base, delta, ["k"], "seq", keep=("d",))
    want = {(1, "y", 10), (2, "b", 20), (3, "z", 5)}
    assert {tuple(r) for r in out.collect()} == want
    again = sinks.upsert(out, delta, ["k"], "seq", keep=("d",))
    assert {tuple(r) for r in again.collect()} == want


def test_snapshots_ledgers_and_citations(spark, tmp_path):
    a, b = spark.range(3), spark.range(5)
    sinks.write_snapshot(a, str(tmp_path / "t"), 1)
    sinks.write_snapshot(b, str(tmp_path / "t"), 2)
    assert sinks.read_latest(spark, str(tmp_path / "t")).count() == 5
    gaps = spark.createDataFrame([("AI", "no source", "rule_a")], "pillar STRING, gap STRING, raised_by STRING")
    for batch in (1, 2, 2):                                                   # the second batch is retried
        sinks.append_gaps(gaps, str(tmp_path / "gaps"), batch)
    assert spark.read.parquet(str(tmp_path / "gaps")).where("raised_by = 'rule_a'").count() == 2
    frozen = spark.createDataFrame([(r, f"EV-{i}", "old") for r in range(6) for i in range(2)], "report_id LONG, cited_id STRING, text STRING")
    path = str(tmp_path / "cites")
    sinks.write_citations(frozen, path, buckets=4)
    fresh = spark.createDataFrame([(3, "EV-7", "new")], "report_id LONG, cited_id STRING, text STRING")
    merged = sinks.bucketed_merge(spark.read.parquet(path), fresh)
    assert merged.count() == 11 and [r.cited_id for r in merged.where("report_id = 3").collect()] == ["EV-7"]
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    sinks.write_citations(fresh, path, buckets=4)                              # keeps the reports it does not hold
    again = spark.read.parquet(path)
    assert again.count() == 11 and {r.report_id for r in again.collect()} == set(range(6))
    assert [r.text for r in again.where("report_id = 3").collect()] == ["new"]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_feed_reader_takes_rss_and_atom(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>One</title><link>http://x/1</link><description>&lt;b&gt;Hi&lt;/b&gt; there</description>"
                                    "<pubDate>Mon, 05 Feb 2024 10:00:00 GMT</pubDate></item><item><title>Two</title><link>http://x/2</link></item></channel></rss>")
    (tmp_path / "b.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Three</title><link href="http://x/3"/><summary>S</summary>'
                                    "<updated>2024-03-01T00:00:00Z</updated></entry></feed>")
    got = {(r.title, r.link, r.summary, str(r.published_on)) for r in readers.read_feed(spark, str(tmp_path)).collect()}
    assert got == {("One", "http://x/1", "Hi there", "2024-02-05"), ("Two", "http://x/2", "", "None"), ("Three", "http://x/3", "S", "2024-03-01")}


def test_seed_and_stix_files(spark, tmp_path):
    (tmp_path / "seed.txt").write_text("# 1 · not a url\nhttps://a.org/x   # 2 · Pub · Title · T1, T2\n#https://off.org\nhttps://b.org\n")
    got = [(r.url, r.tier, r.publisher, r.topics) for r in readers.read_seed(spark, str(tmp_path / "seed.txt")).orderBy("url").collect()]
    assert got == [("https://a.org/x", "2", "Pub", "T1, T2"), ("https://b.org", None, None, None)]
    (tmp_path / "s.json").write_text('{"objects": [{"type": "intrusion-set", "name": "G", "description": "In the Gulf", "external_references": '
                                     '[{"source_name": "mitre-attack", "external_id": "G1"}]}, {"type": "intrusion-set", "name": "R", "revoked": true}]}')
    r = readers.read_stix(spark, str(tmp_path / "s.json")).collect()
    assert len(r) == 1 and (r[0].attack_id, r[0].matched_terms, r[0].regional) == ("G1", ["gulf"], True)


def test_stream_equals_batch_over_many_files(spark, tmp_path):
    events = spark.range(400).select("id", (F.col("id") % 37).alias("url"), F.timestamp_seconds(F.col("id") * 4000).alias("ts"),
                                     F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"))
    events.repartitionByRange(5, "id").write.parquet(str(tmp_path / "in"))
    stream = S.read_table_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    S.upsert_batches(stream.select("url", "id"), ["url"], "id", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = {tuple(r) for r in S.current_rows(spark, str(tmp_path / "t"), ["url"], "id").collect()}
    seen = {}
    for r in spark.read.parquet(str(tmp_path / "in")).withColumn("f", F.input_file_name()).orderBy("f", "id").collect():
        seen[r.url] = max(seen.get(r.url, -1), r.id)
    assert {u for u, _ in got} == set(seen) and len(got) == 37
    daily = S.daily_counts(stream, "400 days")
    S.upsert_batches(daily, ["day", "event_type"], "n", str(tmp_path / "d"), str(tmp_path / "dc"), "update").awaitTermination()
    got = {(str(r.day)[:10], r.event_type, r.n) for r in S.current_rows(spark, str(tmp_path / "d"), ["day", "event_type"], "n").collect()}
    want = {(str(r.day), r.event_type, r["count"]) for r in events.groupBy(F.to_date("ts").alias("day"), "event_type").count().collect()}
    assert got == want


def test_late_older_row_does_not_replace_a_newer_one(spark, tmp_path):
    for seq, text in ((10, "new"), (5, "old")):
        spark.createDataFrame([("k", seq, text)], "k STRING, seq INT, v STRING").write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.read_table_stream(spark, str(tmp_path / "in"))
        S.upsert_batches(stream, ["k"], "seq", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert [tuple(r) for r in S.current_rows(spark, str(tmp_path / "t"), ["k"], "seq").collect()] == [("k", 10, "new")]
    S.compact(spark, str(tmp_path / "t"), str(tmp_path / "u"), ["k"], "seq")
    assert [tuple(r) for r in S.current_rows(spark, str(tmp_path / "u"), ["k"], "seq").collect()] == [("k", 10, "new")]


def _append(spark, folder, rows):
    df = spark.createDataFrame(rows, "request_id LONG, m INT, kind STRING").withColumn("ts", F.timestamp_seconds(F.col("m") * 60 + 86400))
    df.coalesce(1).drop("m").write.mode("append").parquet(folder)


def _stale(spark, folder, delay="10 minutes", **options):
    rows = S.read_table_stream(spark, folder, **options)
    return S.stale_requests(rows.where("kind = 'queued'").select("request_id", F.col("ts").alias("queued_at")),
                            rows.where("kind = 'started'").select("request_id", F.col("ts").alias("started_at")), minutes=120, delay=delay)


def test_start_may_arrive_before_its_queue_row(spark, tmp_path):
    """Arrival order is not event order: 1 starts in time, 2 starts before it queues, 3 both, 9 moves the clock."""
    arrivals = [[(1, 20, "started"), (2, 5, "started"), (3, 4, "started"), (3, 30, "started")],
                [(1, 10, "queued"), (2, 10, "queued"), (3, 10, "queued")], [(9, 900, "queued")], [(9, 901, "started"), (8, 902, "queued")]]
    for rows in arrivals:
        _append(spark, str(tmp_path / "in"), rows)
        stream = _stale(spark, str(tmp_path / "in"), delay="30 minutes")
        S.upsert_batches(stream, ["request_id"], "queued_at", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {r.request_id for r in S.current_rows(spark, str(tmp_path / "t"), ["request_id"], "queued_at").collect()} == {2}


def test_stale_request_stream(spark, tmp_path):
    rows = [(1, 0, "queued"), (2, 0, "queued"), (2, 60, "started"), (3, 50, "queued"), (3, 300, "started"), (9, 900, "queued"), (9, 900, "started")]
    for m in (0, 50, 60, 300, 900):
        _append(spark, str(tmp_path / "in"), [r for r in rows if r[1] == m])
    S.upsert_batches(_stale(spark, str(tmp_path / "in"), files_per_trigger=1), ["request_id"], "queued_at", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert {r.request_id for r in S.current_rows(spark, str(tmp_path / "t"), ["request_id"], "queued_at").collect()} == {1, 3}


def test_items_are_handed_out_once(spark, tmp_path):
    """Repeats a hundred days late drop out; what failed comes again; a batch that runs again hands out the same."""
    got, fail = [], [True]

    def process(items, batch_id):
        rows = [(r.who, r.item) for r in items.collect()]
        if ("a", 3) in rows and fail:
            fail.clear()
            raise ValueError("the reader broke")
        got.append(rows)

    def arrive(rows):
        spark.createDataFrame(rows, "who STRING, item INT, day INT").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = S.read_table_stream(spark, str(tmp_path / "in"))
        S.mark_read(stream, ["who", "item"], str(tmp_path / "log"), str(tmp_path / "c"), process).awaitTermination()

    arrive([("a", 1, 0), ("a", 1, 0), ("b", 1, 1), (None, 2, 1)])
    arrive([("a", 1, 100), ("a", 2, 100), (None, 2, 100)])
    with pytest.raises(Exception, match="the reader broke"):
        arrive([("a", 3, 101), ("b", 1, 101)])
    assert [len(rows) for rows in got] == [3, 1]
    arrive([("a", 1, 102)])
    flat = [x for rows in got for x in rows]
    assert sorted(flat, key=repr) == sorted([("a", 1), ("b", 1), (None, 2), ("a", 2), ("a", 3)], key=repr)
    S.fold_log(spark, str(tmp_path / "log"), str(tmp_path / "log2"), ["who", "item"])
    assert S.logged(spark, str(tmp_path / "log2")).count() == 5 and S.logged(spark, str(tmp_path / "none")) is None


def test_request_status_batch(spark):
    at = lambda m: F.timestamp_seconds(F.lit(1_700_000_000 // 7200 * 7200) + F.col("m") * 60)
    req = spark.createDataFrame([(1, "u", 0), (2, "u", 110), (3, "v", 10), (4, "v", 800), (5, "w", 115)], "request_id INT, user_id STRING, m INT").withColumn("ts", at(1))
    st = spark.createDataFrame([("u", 119), ("w", 236), ("v", 5)], "user_id STRING, m INT").withColumn("ts", at(1))
    as_of = spark.range(1).select(F.date_format(F.timestamp_seconds(F.lit(1_700_000_000 // 7200 * 7200 + 805 * 60)), "yyyy-MM-dd HH:mm:ss")).first()[0]
    status = S.request_status(req, st, as_of)
    assert {r.request_id: r.status for r in status.collect()} == {1: "STARTED", 2: "STARTED", 3: "FAILED", 4: "QUEUED", 5: "FAILED"}
    assert [r.request_id for r in S.next_waiting(status, as_of).collect()] == [4]


def test_same_fact_pairs_with_a_hot_token(spark):
    """One token in a third of all rows, which a crowd of four splits; lengths of every band."""
    rng = random.Random(4)
    rows = []
    for i in range(240):
        n = rng.choice([1, 2, 3, 5, 8, 13, 20, 21, 22, 23, 24])
        words = [f"w{rng.randrange(30)}" for _ in range(n)]
        rows.append((rng.randrange(2), i, " ".join(["hot", *words] if i % 3 == 0 else words)))
    rows += [(d, 1_000 + i, t + rng.choice(["", " hot", " more"])) for i, (d, _, t) in enumerate(rows[:120])]
    sets = [(d, i, set(t.split())) for d, i, t in rows]
    first = {}
    for d, i, s in sorted(sets, key=lambda x: x[1]):
        first.setdefault((d, frozenset(s)), i)
    df = spark.createDataFrame(rows, "doc INT, id INT, claim STRING")
    for threshold in (0.5, 0.85, 1.0):
        want = {(first[d, frozenset(s)], i) for d, i, s in sets if first[d, frozenset(s)] != i}
        for ((d, s), a), ((e, t), b) in itertools.combinations(first.items(), 2):
            if d == e and len(s & t) >= threshold * len(s | t):
                want.add((min(a, b), max(a, b)))
        got = [(r.a_id, r.b_id) for r in M.same_fact_pairs(df, ["doc"], "id", "claim", threshold, crowd=4).collect()]
        assert len(got) == len(set(got)) and set(got) == want, threshold


def test_register_matches_brute_force(spark):
    """Items inside, half inside and around documents; a passage in a third of all; documents without any leave early."""
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 6, 12, 30])))) for i in range(30)] + [(90, None), (91, "")]
    docs = []
    for i in range(150):
        text = [word() for _ in range(rng.randrange(60))]
        if i % 3 == 0:
            text += items[4][1].split()
        if i % 4 == 0:
            part = items[rng.randrange(30)][1].split()
            text += part[rng.randrange(len(part)):] + part[:rng.randrange(len(part))]
        docs.append((i, " ".join(text)))
    docs += [(500, None), (501, docs[0][1])]
    shingle = lambda t: {tuple(w[i:i + 5]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for i in range(len(w) - 4)}
    for threshold in (0.5, 0.2, 1.0):
        want = {}
        for (i, a), (d, b) in itertools.product(items, docs):
            x = shingle(a)
            shared = len(x & shingle(b))
            if x and shared and shared >= threshold * len(x):
                want[i, d] = (shared, len(x))
        got = M.shingle_matches(spark.createDataFrame(items, "item_id INT, text STRING"), spark.createDataFrame(docs, "doc_id INT, text STRING"), threshold=threshold)
        assert {(r.item_id, r.doc_id): (r.shared, r.total) for r in got.collect()} == want


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(3_000).select(F.xxhash64("id").alias("h"))
    bits = M.bloom(keys, "h", 16)
    assert keys.where(M.in_bloom(F.col("h"), bits, 16)).count() == 3_000
    others = spark.range(10_000, 20_000).select(F.xxhash64("id").alias("h"))
    assert others.where(M.in_bloom(F.col("h"), bits, 16)).count() < 500
    empty = M.bloom(keys.limit(0), "h", 16)
    assert others.where(M.in_bloom(F.col("h"), empty, 16)).count() == 0
