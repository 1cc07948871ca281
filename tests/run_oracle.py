"""Run queries against their SQL: python tests/run_oracle.py FOLDER [name ...]."""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from evenkeel.session import local_session  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = local_session(int(os.environ.get("CORES", "8"))), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            found = differences(df, con, oracles[name]) if name in oracles else (
                [] if (n := len(df.collect())) >= 0 else [str(n)])
        except Exception as e:
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
            if os.environ.get("TRACE"):
                traceback.print_exc()
        spark.catalog.clearCache()
        bad += bool(found)
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if found else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {found or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
