"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and fully executed into the no-op sink (every output row
computed, nothing collected); one warm-up pass, then the median of
$BENCH_REPEATS timed passes.  Prints one JSON line; ``tier_b`` holds further
queries that are not in ``value``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens.plans.registry import QUERIES  # noqa: E402
from marketlens.session import local_session  # noqa: E402

HEADLINE = [
    "competitor_report", "campaign_report", "elasticity_report", "promo_report",
    "competitor_summary", "campaign_insights", "elasticity_segments", "promo_labels",
    "intent_routing", "request_mix",
]
TIER_B = ["tb_supplier_scorecard", "tb_price_monitor", "tb_market_entries", "tb_market_forecast", "tb_elasticity_curves", "tb_brand_share"]


def run_once(spark, name, sf_dir):
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE + TIER_B)).split(",") if n in QUERIES]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    times = {}
    for name in names:
        run_once(spark, name, sf_dir)  # warm-up
        times[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(repeats)), 3)
    tier_b = {n: times.pop(n) for n in TIER_B if n in times}  # timed beside the headline total, which keeps its queries
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "repeats": repeats, "tier_b": tier_b}))


if __name__ == "__main__":
    main()
