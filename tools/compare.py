"""Run registered queries and their SQL on the same tables and compare the rows.

    python tools/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tarn.plans.oracle import ORACLE  # noqa: E402
from tarn.plans.queries import QUERIES  # noqa: E402
from tarn.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(made, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    columns, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return len(ours) > 0, f"{len(ours)} rows, no SQL"
    result = con.execute(ORACLE[name])
    other_columns, theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if columns != other_columns:
        return False, f"columns {columns} != {other_columns}"
    if ours != theirs:
        bad = next(((a, b) for a, b in zip(ours, theirs) if a != b), None)
        return False, f"{len(ours)} rows against {len(theirs)}; first difference {bad}"
    kinds = {type(x) for r in ours for x in r}, {type(x) for r in theirs for x in r}
    note = "" if kinds[0] == kinds[1] else f" types {kinds}"
    return True, f"{len(ours)} rows{note}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session(4), connect(sf_dir), []
    for name in names:
        start = time.time()
        try:
            good, text = compare(spark, con, sf_dir, name)
        except Exception as error:
            good, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if not good:
            failed.append(name)
        print(f"{'ok  ' if good else 'FAIL'} {name:22s} {time.time() - start:6.2f}s {text}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
