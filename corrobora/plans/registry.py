"""Registry of named queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corrobora.plans.views import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, longs: tuple = ()):
    """Register ``fn(tables) -> DataFrame`` under a name, with its DuckDB text.

    ``longs`` are sums, which DuckDB widens to 128 bits; they are cast back.
    """
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            casts = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in longs)
            ORACLES[name] = oracle(f"SELECT * REPLACE ({casts}) FROM ({sql}) x" if longs else sql)
        return fn
    return add
