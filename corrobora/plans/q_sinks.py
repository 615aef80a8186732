"""Sinks as queries: what was written, read back, a retried batch included."""

from pyspark.sql import functions as F

from corrobora.operators import lineage as L
from corrobora.plans.q_admission import FINDINGS, GAPS, gap_ledger
from corrobora.plans.q_matching import CITED, FRESH, FROZEN, OBJECTS, STORED, UPSERTED, objects
from corrobora.plans.registry import query
from corrobora.session import written
from corrobora.sources import sinks
from corrobora.streaming import intake as S


@query("b1_snapshot_round_trip", UPSERTED)
def _(t):
    """The base as one snapshot, then the upsert on what is read from it as the next."""
    root = S.work_dir(t.spark, "snapshots")
    base = t.sql(STORED).groupBy("url").agg(F.max_by("title", "seq").alias("title"), F.max_by("score", "seq").alias("score"),
                                           F.max_by("published", F.when(F.col("published").isNotNull(), F.col("seq"))).alias("published"))
    sinks.write_snapshot(base, root, 9)
    merged = sinks.upsert(sinks.read_latest(t.spark, root), t.sql(FRESH), ["url"], "seq", keep=("published",))
    sinks.write_snapshot(merged, root, 10)
    return sinks.read_latest(t.spark, root)


@query("b3_gap_ledger_round_trip", f"""WITH {FINDINGS}, {GAPS}
SELECT n AS batch, pillar, gap, raised_by FROM gaps, (VALUES (1), (2)) v(n)""")
def _(t):
    """Two batches of refusals, the first of them written again by a retry."""
    path = f"{S.work_dir(t.spark, 'ledger')}/gaps"
    gaps = written(gap_ledger(t))
    for batch in (1, 2, 1):
        sinks.append_gaps(gaps, path, batch)
    return t.spark.read.parquet(path).select(F.col("batch").cast("int").alias("batch"), "pillar", "gap", "raised_by")


@query("b5_citation_round_trip", f"""WITH {OBJECTS}, {CITED}, fz AS (SELECT report_id, cited_id, text FROM ({FROZEN})), nw AS (SELECT report_id, cited_id, text FROM ci JOIN ob USING (cited_id))
SELECT * FROM nw UNION ALL SELECT * FROM fz WHERE report_id NOT IN (SELECT report_id FROM nw)""")
def _(t):
    """Citations frozen earlier, then those of the reports at hand, written twice."""
    path = f"{S.work_dir(t.spark, 'citations')}/frozen"
    fresh = written(L.freeze(t.reports, objects(t)).select("report_id", "cited_id", "text"))
    for rows in (t.sql(FROZEN), fresh, fresh):
        sinks.write_citations(rows, path, buckets=16)
    return t.spark.read.parquet(path).select("report_id", "cited_id", "text")


@query("l1_compacted_batches", "SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1")
def _(t):
    """The batches of an incremental intake, folded into one."""
    root = S.work_dir(t.spark, "compacted")
    stream = S.read_table_stream(t.spark, t.sf_dir, "documents.parquet").select("source", "doc_id", "n_chars")
    S.upsert_batches(stream, ["source"], "doc_id", f"{root}/table", f"{root}/log").awaitTermination()
    S.compact(t.spark, f"{root}/table", f"{root}/folded", ["source"], "doc_id")
    return t.spark.read.parquet(f"{root}/folded").select("source", "doc_id", "n_chars")
