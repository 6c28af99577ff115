"""Column-expression helpers (all JVM-side built-ins; no UDFs)."""

from marketlens.functions.labels import code_of, labels, ladder
from marketlens.functions.numeric import count_if, exact_avg, exact_sum, ratio, shown

__all__ = ["ladder", "labels", "code_of", "count_if", "exact_avg", "exact_sum", "ratio", "shown"]
