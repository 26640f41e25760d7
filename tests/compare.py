"""Run a query and its SQL counterpart, and compare names, types and values.

``python tests/compare.py [folder] [query ...]`` checks all or the named ones.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def second_engine(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(spark, con, folder, name) -> str | None:
    found = entry.queries()[name](spark, folder)
    rows = [tuple(r) for r in found.collect()]
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} != {sorted(names)}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    mine, theirs = _sorted(rows, found.columns), _sorted(expected, names)
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first: {wrong[0][0]} != {wrong[0][1]}"
    kinds = [{type(r[i]) for r in rows if r[i] is not None} for i in range(len(found.columns))]
    by_name = dict(zip(found.columns, kinds))
    for i, n in enumerate(names):
        theirs_kinds = {type(r[i]) for r in expected if r[i] is not None}
        if theirs_kinds != by_name[n]:
            return f"type of {n}: {by_name[n]} != {theirs_kinds}"
    return None


if __name__ == "__main__":
    from plumbline.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), second_engine(folder)
    bad = 0
    for name in sys.argv[2:] or entry.oracle_sql():
        start = time.time()
        try:
            problem = differences(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name:32s} {time.time() - start:6.1f}s  {problem or ''}", flush=True)
    print(f"{bad} of {len(sys.argv[2:] or entry.oracle_sql())} differ")
