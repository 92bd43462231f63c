"""Runs a registered query on Spark and its SQL on DuckDB and compares names, types and values.

As a program: ``python -m tests.compare [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):  # noqa: D103
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6f}" if v else "0.000000"
    return str(v)


def _rows(arrow):
    names = sorted(arrow.column_names)
    cols = [arrow.column(n).to_pylist() for n in names]
    return names, sorted(tuple(_norm(v) for v in row) for row in zip(*cols)) if cols else []


def _types(arrow):
    return {f.name: str(f.type).replace("large_string", "string") for f in arrow.schema}


def compare(spark, con, query, sf_dir):
    """Empty string when equal, otherwise what differs."""
    ours = query.run(spark, sf_dir).toArrow()
    theirs = con.execute(query.sql).to_arrow_table()
    names, rows = _rows(ours)
    their_names, their_rows = _rows(theirs)
    if names != their_names:
        return f"columns {names} != {their_names}"
    if _types(ours) != _types(theirs):
        bad = {k: (v, _types(theirs)[k]) for k, v in _types(ours).items() if v != _types(theirs)[k]}
        return f"types {bad}"
    if len(rows) != len(their_rows):
        only = sorted(set(rows) - set(their_rows))[:3]
        return f"rows {len(rows)} != {len(their_rows)}; only ours {only}; only theirs {sorted(set(their_rows) - set(rows))[:3]}"
    diff = [(a, b) for a, b in zip(rows, their_rows) if a != b]
    if diff:
        return f"{len(diff)} of {len(rows)} rows differ, {names}: {diff[:2]}"
    if not rows:
        return "no rows"
    return ""


def main(argv):
    from stockcount.plans import QUERIES
    from stockcount.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = 0
    for name in names:
        q = QUERIES[name]
        start = time.time()
        try:
            if q.sql is None:
                problem, n = "", q.run(spark, sf).count()
                note = f"rows-only {n}"
                problem = "" if n else "no rows"
            else:
                problem, note = compare(spark, con, q, sf), "ok"
        except Exception as e:  # noqa: BLE001
            problem, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'pass'} {name} {time.time() - start:.2f}s {problem or note}", flush=True)
    print(f"{len(names) - failed} of {len(names)} pass")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
