"""Run registered queries against their DuckDB oracle and print one line each.

usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from marketlens.session import local_session  # noqa: E402
from tests.oracle_compare import compare, duck_connection  # noqa: E402


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session(8)
    con = duck_connection(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        if name not in sqls:
            n = df.count()
            print(f"{name:32s} rows={n} (no oracle) {time.time() - t0:.1f}s", flush=True)
            continue
        try:
            res = compare(df, sqls[name], con)
        except Exception as e:  # report and continue
            bad += 1
            print(f"{name:32s} ERROR {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        bad += not res["ok"]
        print(f"{name:32s} {'OK ' if res['ok'] else 'BAD'} {time.time() - t0:.1f}s {res}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
