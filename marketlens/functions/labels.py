"""Label ladders: ordered CASE chains where the first true branch wins.

A branch whose condition is NULL (a NULL input compared with a number) is not
taken, so NULL inputs fall through to the default, as in SQL CASE.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(branches: Sequence[tuple[Column, str]], default: str) -> Column:
    if not branches:
        return F.lit(default)
    (cond, label), *rest = branches
    out = F.when(cond, F.lit(label))
    for cond, label in rest:
        out = out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def code_of(text: str) -> str:
    """Plain code of a label text: its words in lower case, without the leading symbol."""
    return "_".join(re.findall(r"[a-z]+", text.lower()))


def labels(name: str, branches: Sequence[tuple[Column, str]], default: str) -> list[Column]:
    """The ladder's text as column ``name`` and its plain code as ``<name>_code``."""
    codes = [(cond, code_of(text)) for cond, text in branches]
    return [ladder(branches, default).alias(name), ladder(codes, code_of(default)).alias(f"{name}_code")]
