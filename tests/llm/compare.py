"""Runs queries of the package on Spark and on DuckDB: ``python -m tests.llm.compare [sf_dir] [name ...]``."""

import sys
import time
from types import SimpleNamespace

from llm.queries import QUERIES
from stockcount.session import local_session
from tests.compare import compare, duck


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(sf), 0
    for name in argv[1:] or QUERIES:
        run, sql = QUERIES[name]
        start = time.time()
        said = compare(spark, con, SimpleNamespace(run=run, sql=sql), sf) if sql else f"no SQL, {run(spark, sf).count()} rows"
        bad += bool(sql and said)
        print(name, f"{time.time() - start:.1f} s", said or "equal", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
