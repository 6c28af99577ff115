"""Command line: one request in, the report written out (or printed as JSON).

    python -m marketlens --tables /data/sf1 --question "competitor prices" --limit 50 --json
    python -m marketlens --tables /data/sf1 --query-type campaign_analysis --out /data/reports/cp

The request fields are the reference's (question, query_type, limit), plus the
date window.  Runs on whatever master spark-submit gives it.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from marketlens.api import analyze
from marketlens.config import REFERENCE_WINDOW, DateWindow
from marketlens.sources.tables import Tables


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="marketlens")
    ap.add_argument("--tables", required=True, help="folder of <table>.parquet, or catalog database with --catalog")
    ap.add_argument("--catalog", action="store_true", help="read tables from the catalog database named by --tables")
    ap.add_argument("--question")
    ap.add_argument("--query-type")
    ap.add_argument("--limit", type=int)
    ap.add_argument("--start", default=REFERENCE_WINDOW.start.isoformat())
    ap.add_argument("--end", default=REFERENCE_WINDOW.end.isoformat())
    ap.add_argument("--scope", default="top_n", choices=["top_n", "full"])
    ap.add_argument("--language", default="en", choices=["en", "tr"])
    ap.add_argument("--out", help="write rows/summary/insights as parquet under this folder")
    ap.add_argument("--json", action="store_true", help="print the response as JSON")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("marketlens").getOrCreate()
    tables = Tables.catalog(spark, args.tables) if args.catalog else Tables.parquet(spark, args.tables)
    report = analyze(tables, question=args.question, query_type=args.query_type, limit=args.limit,
                     window=DateWindow.of(args.start, args.end), scope=args.scope, language=args.language)
    if args.out:
        report.write(path=args.out)
    if args.json or not args.out:
        print(json.dumps(report.response(), ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
