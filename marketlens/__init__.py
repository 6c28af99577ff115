"""marketlens: retail pricing and promotion analytics as Spark DataFrame plans.

    from marketlens import Tables, analyze
    report = analyze(Tables.parquet(spark, "/data/tpch"), question="competitor prices")
"""

__version__ = "0.1.0"

from marketlens.api import Report, analyze, handle  # noqa: E402
from marketlens.config import REFERENCE_WINDOW, STUDY_WINDOW, DateWindow, Thresholds  # noqa: E402
from marketlens.sources.tables import Tables  # noqa: E402

__all__ = ["Report", "analyze", "handle", "Tables", "DateWindow", "Thresholds", "REFERENCE_WINDOW",
           "STUDY_WINDOW"]
