"""The pipeline stage by stage against brute force, and the registered queries against their oracles."""

import brute
import corpus_pipeline
import pytest
from conftest import SCHEMA, edge_rows
from oracle import compare, connect

from corrobora.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    verdict, _ = compare(spark, connect(SMALL), SMALL, QUERIES[name], ORACLES[name])
    assert verdict is None, verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    key = "page_id" if name.startswith("op2_") else "doc_id"
    ids = sorted(r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect())
    assert sorted(r[key] for r in QUERIES[name](spark, SMALL).select(key).collect()) == ids


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    stage = {name: f for name, f in corpus_pipeline.STAGES}
    good = stage["quality classifier"](spark, docs, SMALL)
    assert good.columns == columns and 0.7 * docs.count() < good.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    kept = {i for i, (_, _, k) in brute.near_duplicates(rows, words=5).items() if k}
    deduped = stage["MinHash near-dedup"](spark, good, SMALL)
    assert deduped.columns == columns and {r.doc_id for r in deduped.collect()} == kept
    left = {i for i, v in brute.contamination([r for r in rows if r[0] in kept], items).items() if not v[4]}
    clean = stage["benchmark decontamination"](spark, deduped, SMALL)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == left
    mixed = stage["source mixing"](spark, clean, SMALL)
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= left
    final = stage["sharding"](spark, mixed, SMALL)
    assert final.count() == mixed.count()


def test_run_on_awkward_rows(spark, tmp_path):
    rows = [r for r in edge_rows()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
