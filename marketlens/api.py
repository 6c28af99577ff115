"""One-call API: a question or a report name in, a ``Report`` of DataFrames out.

    report = analyze(Tables.parquet(spark, path), question="competitor prices")
    report.rows.show(); report.summary.show(); report.insights.show()

Resolution follows the reference (explicit type wins, else keyword routing),
with its alias and unknown-type defects fixed: aliases are resolved before the
subject is chosen, so they get insights too, and an unknown type raises unless
``strict=False`` (then competitor tracking, as the reference silently does).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.config import DEFAULT_THRESHOLDS, REFERENCE_WINDOW, DateWindow, Thresholds, resolve_limit
from marketlens.plans import campaign, competitor, elasticity, promo
from marketlens.plans.insights import insight_rows, insights
from marketlens.plans.intent import route
from marketlens.plans.messages import messages
from marketlens.plans.summary import summarize
from marketlens.session import delete_folders, recording
from marketlens.sources import committed, derived
from marketlens.sources.schemas import SCHEMAS, check_columns

SUBJECT_MODULES = {
    "competitor_tracking": (competitor, derived.competitor_tracking),
    "campaign_performance": (campaign, derived.campaign_performance),
    "price_elasticity": (elasticity, derived.price_elasticity),
    "promotional_calendar": (promo, derived.promotional_calendar),
}
SCOPES = ("top_n", "full")


@dataclass
class Report:
    query_type: str
    limit: int
    scope: str
    rows: DataFrame
    summary: DataFrame
    insights: DataFrame
    folders: tuple[str, ...] = ()  # intermediate tables this report wrote and still reads

    def close(self) -> None:
        """Delete the report's intermediate tables; its DataFrames cannot be read afterwards."""
        delete_folders(self.rows.sparkSession, self.folders)

    def __enter__(self) -> Report:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def response(self) -> dict:
        """The reference's response shape as a dict (rows at most the limit, so at most 500).

        ``summary`` holds the one summary row; insights, recommendations and
        alerts hold message texts in emission order.
        """
        rows = [r.asDict() for r in self.rows.collect()]
        summary_row = self.summary.collect()[0].asDict()
        summary = {k: v for k, v in summary_row.items() if v is not None}
        by_kind: dict[str, list[str]] = {"insight": [], "recommendation": [], "alert": []}
        for r in sorted(self.insights.collect(), key=lambda r: (r.kind, r.seq)):
            by_kind[r.kind].append(r.message)
        return {
            "success": True,
            "query_type": self.query_type,
            "parameters": {"limit": self.limit, "scope": self.scope},
            "summary": summary,
            "insights": by_kind["insight"],
            "recommendations": by_kind["recommendation"],
            "alerts": by_kind["alert"],
            "row_count": len(rows),
            "rows": rows,
        }

    def write(self, path: str | None = None, table_prefix: str | None = None, mode: str = "errorifexists") -> None:
        """Write rows, summary and insights from the executors.

        Under ``path`` the three appear together or not at all (``sources.committed``; ``mode``
        'overwrite' replaces an earlier result in one step; ``read_report`` reads a part).  With
        ``table_prefix`` they are catalog tables ``<table_prefix>_rows`` etc., one job each."""
        if (path is None) == (table_prefix is None):
            raise ValueError("give exactly one of path or table_prefix")
        parts = {"rows": self.rows, "summary": self.summary, "insights": self.insights}
        if path is not None:
            committed.write(parts, path, mode)
            return
        for part, df in parts.items():
            df.write.mode(mode).saveAsTable(f"{table_prefix}_{part}")


def read_report(spark: SparkSession, path: str, part: str = "rows") -> DataFrame:
    """``rows``, ``summary`` or ``insights`` of the report last committed under ``path``."""
    return committed.read(spark, path, part)


def analyze(
    tables: Mapping[str, DataFrame] | None = None,
    *,
    question: str | None = None,
    query_type: str | None = None,
    limit: int | None = None,
    window: DateWindow = REFERENCE_WINDOW,
    scope: str = "top_n",
    strict: bool = True,
    facts: DataFrame | None = None,
    thresholds: Thresholds = DEFAULT_THRESHOLDS,
    rank_mode: str = "two_pass",
    language: str = "en",
    options: Mapping[str, object] | None = None,
) -> Report:
    """Build the report for one request.

    ``tables`` are base tables (the report table is derived from them); pass
    ``facts`` instead to use an existing report table with the declared schema.
    ``scope='top_n'`` summarises the returned rows (the reference's behaviour)
    from the same local table;
    ``scope='full'`` summarises every labelled row, lazily.  ``options`` go to
    the subject's ``build`` (``cut_detail``; ``iso_dates`` for the promo calendar).
    """
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    subject = route(question, query_type, strict=strict)
    n = resolve_limit(limit)
    module, builder = SUBJECT_MODULES[subject]
    if facts is None:
        if tables is None:
            raise ValueError("pass tables or facts")
        facts = builder(tables)
    else:
        facts = check_columns(facts, SCHEMAS[subject], subject)
    with recording() as folders:
        plan = module.build(facts, window=window, thresholds=thresholds, rank_mode=rank_mode,
                            **dict(options or {}))  # e.g. cut_detail, or iso_dates for the promo calendar
        top = plan.report(n)
    # The report is a local table of at most 500 rows, so the three outputs share it without running it again.
    shown = (top, top) if scope == "top_n" else (plan.alone, insight_rows(plan))
    summary = summarize(shown[0], subject, thresholds).withColumn(  # SU-0: when the report was made (UTC)
        "timestamp", F.when(F.col("total_records") > 0, F.current_timestamp()))
    return Report(subject, n, scope, top, summary, messages(insights(shown[1], subject, thresholds), language), tuple(folders))


def handle(body: Mapping[str, object] | None, tables: Mapping[str, DataFrame], *,
           window: DateWindow = REFERENCE_WINDOW, strict: bool = True) -> dict:
    """One request body in the reference's fields (question, query_type, limit) to a
    response dict; a failure gives ``{"success": False, "error", "error_type", ...}``
    instead of raising, as the reference's handler does (without the HTTP layer)."""
    body = body or {}
    query_type = body.get("query_type") or None
    try:
        report = analyze(tables, question=body.get("question") or "", query_type=query_type,
                         limit=body.get("limit"), window=window, strict=strict)
        return report.response()
    except Exception as e:  # noqa: BLE001 - reported to the caller, as the reference does
        return {"success": False, "error": str(e), "error_type": type(e).__name__,
                "query_type": query_type or "unknown"}
