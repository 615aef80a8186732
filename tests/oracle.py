"""Compare registered queries with their DuckDB oracle.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corrobora.plans.views import BASE  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short account of the difference."""
    df = fn(spark, sf_dir)
    ours = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = canon(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(ours)
    if len(ours) != len(theirs):
        missing = [r for r in theirs if r not in ours][:3] if len(theirs) < 3000 else theirs[:2]
        extra = [r for r in ours if r not in theirs][:3] if len(ours) < 3000 else ours[:2]
        return f"rows {len(ours)} != {len(theirs)}\n   missing {missing}\n   extra {extra}", len(ours)
    diff = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if diff:
        return f"{len(diff)} rows differ, e.g.\n   spark  {diff[0][0]}\n   duckdb {diff[0][1]}", len(ours)
    return None, len(ours)


def session(shuffles: int = 8):
    from pyspark.sql import SparkSession
    from corrobora.session import configure
    spark = (configure(SparkSession.builder.master("local[8]").appName("checks"))
             .config("spark.sql.shuffle.partitions", str(shuffles))
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.local.dir", os.environ.get("SPARK_SCRATCH", "/tmp"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(p) for p in argv)]
    spark, con, bad = session(), connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                verdict, n = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                verdict, n = None, queries[name](spark, sf_dir).count()
                name += " (rows only)"
        except Exception as exc:  # noqa: BLE001 - reported per query
            verdict, n = f"{type(exc).__name__}: {str(exc)[:900]}", -1
        bad += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '} {name:45s} rows={n:<8d} {time.time() - start:5.1f}s {verdict or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main(sys.argv[1:]) else 0)
