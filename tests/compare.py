"""Run registered queries in Spark and their SQL in DuckDB and compare rows.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


_KIND = {
    "bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean",
    "float": "float", "timestamp": "timestamp",
}


def compare(spark, con, plan, sql, folder, need_rows=False) -> list[str]:
    """Problems found; empty when both sides agree. On tiny tables both sides may be empty."""
    df = plan(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if not got and (need_rows or sql is None):
        return ["no rows"]
    if sql is None:
        return []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]).lower() for d in cur.description}
    want = cur.fetchall()
    bad = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in _KIND and _KIND[kind] != kinds[f.name]:
            bad.append(f"type of {f.name}: {kind} against {kinds[f.name]}")
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        bad.append(f"rows {len(got)} against {len(want)}; {sum((a - b).values())} differ")
        bad += [f"  + {sorted(df.columns)} {r}" for r in list(a - b)[:3]]
        bad += [f"  - {r}" for r in list(b - a)[:3]]
    return bad


def test_session():
    from windowlark.session import get_spark

    spark = get_spark(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import os

    from windowlark import catalog

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    catalog.load()
    spark, con = test_session(), connect(folder)
    failed = 0
    for name in args or list(catalog.PLANS):
        start = time.time()
        try:
            bad = compare(spark, con, catalog.PLANS[name], catalog.CHECKS.get(name), folder, need_rows=True)
        except Exception as e:  # report and go on with the next query
            bad = [f"{type(e).__name__}: {str(e)[:600]}"]
        failed += bool(bad)
        mark = "FAIL" if bad else ("ok" if name in catalog.CHECKS else "ok (no sql)")
        print(f"{mark:12} {name:28} {time.time() - start:6.2f}s", flush=True)
        for line in bad:
            print("    ", line)
    print(f"{failed} failed")
    sys.exit(bool(failed))
