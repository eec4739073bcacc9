"""Run every registered query against its DuckDB oracle (like the driver's gate).

    python tests/run_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hortus.session import local_session  # noqa: E402
from tests.oracle_check import RAW, compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = local_session(8, 8)
    con = duck(sf_dir, (*RAW, "documents", "pages", "benchmark", "labels", "conversations", "embeddings"))
    qs, oracles = E.queries(), E.oracle_sql()
    bad = ok_count = rows_only = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        if name not in oracles:
            n = df.count()
            rows_only += 1
            print(f"{name:40s} rows-only {n} rows ({time.time() - t0:.1f}s)")
            continue
        ok, msg = compare(df, con, oracles[name])
        bad += not ok
        ok_count += ok
        print(f"{name:40s} {'OK ' if ok else 'BAD'} {msg} ({time.time() - t0:.1f}s)")
    print(f"{ok_count} match, {bad} differ, {rows_only} without oracle")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
