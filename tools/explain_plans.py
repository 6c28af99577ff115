"""Write the formatted physical plans of the headline queries to docs/plans/.

usage: python tools/explain_plans.py [sf_dir]   (plans after execution, AQE final)
Both rank paths are written: the size-checked single window (small inputs) and
the distributed path taken above spark.marketlens.rank.windowMaxRows.
"""

from __future__ import annotations

import contextlib
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from marketlens import session  # noqa: E402
from marketlens.plans.registry import QUERIES  # noqa: E402
from marketlens.session import local_session  # noqa: E402

HEADLINE = ["competitor_report", "campaign_report", "elasticity_report", "promo_report",
            "competitor_insights", "intent_routing", "tb_supplier_scorecard", "tb_delivery_performance"]


@contextlib.contextmanager
def watching(see):
    """Calls ``see`` with every frame that is materialised inside the block."""
    from marketlens.operators import ranking
    from marketlens.plans import base, pricing_ext, supply
    modules, plain = (ranking, base, pricing_ext, supply), session.materialize

    def seen(df, label, count=False):
        see(df)
        return plain(df, label, count)

    for m in modules:
        m.materialize = seen
    try:
        yield
    finally:
        for m in modules:
            m.materialize = plain


def main(sf_dir: str) -> None:
    spark = local_session(8)
    out_dir = os.path.join(ROOT, "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    for name in HEADLINE:
        plans: list[str] = []

        def keep(df):
            df.write.format("noop").mode("overwrite").save()
            plans.append(df._jdf.queryExecution().explainString(mode))

        # the intermediate tables the query writes (detail, rank keys, ...) come before its own plan
        with watching(keep):
            keep(QUERIES[name](spark, sf_dir))
        with open(os.path.join(out_dir, f"{name}.txt"), "w") as f:
            f.write("\n\n".join(plans))
        print(name, len(plans), "plans written", flush=True)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
