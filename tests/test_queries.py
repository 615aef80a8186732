"""Every registered query against its DuckDB oracle, and the shape of its plan."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
# Queries of the corpus subpackage are tested beside it.
QUERIES = {k: v for k, v in entry.queries().items() if k in entry.catalogue.QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}
# The root of the fixture tree is a constant, so its branch of a union meets one row.
ONE_ROW = ("e25_branch_readiness",)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    verdict, _ = compare(spark, con, SMALL, QUERIES[name], ORACLES[name])
    assert verdict is None, verdict


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(spark, name):
    """All columns are computed, named once, and two runs agree."""
    first, again = (sorted(repr(tuple(r)) for r in QUERIES[name](spark, SMALL).collect()) for _ in range(2))
    columns = QUERIES[name](spark, SMALL).columns
    assert first and first == again and len(columns) == len(set(columns))


def test_entry(spark):
    assert entry.entry(spark).columns == ["evidence_id", "publishers", "class", "confidence"]


# The streams end in a table of their own; the timer of one of them is Python per key.
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if "stream" not in n))
def test_no_nested_loops_or_row_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for shape in ("CartesianProduct", "BatchEvalPython"):
        assert shape not in plan, shape
    assert plan.count("BroadcastNestedLoopJoin") == 0 or name in ONE_ROW, "BroadcastNestedLoopJoin"
