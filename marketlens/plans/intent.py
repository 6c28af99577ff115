"""Intent routing: free-text questions and named report types to a subject.

The reference routes one request at a time in Python.  Here routing is a column
expression, so a table of requests (or every user turn of a conversation log)
is classified on the executors in one projection, with no shuffle; ``route()``
is the same rule for a single request on the driver.

Rule (``mode="first_match"``, the reference's): lower-case the question (NULL
as ''), then the first intent in the fixed order below that has any keyword as
a plain substring wins; no hit gives ``competitor_tracking``.  Many keywords
can never win because an earlier intent's keyword is a substring of them
("marketing" contains "market"); that is kept.  ``mode="score"`` instead picks
the intent with the most distinct keyword hits (ties by the same order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_INTENT = "competitor_tracking"

# Intents in evaluation order, each with its keywords in order
# (English and Turkish pairs as in the reference).
KEYWORDS: dict[str, tuple[str, ...]] = {
    "competitor_tracking": (
        "competitor", "rakip", "competition", "price", "fiyat", "pricing", "market", "pazar",
        "positioning", "konum", "comparison", "karşılaştırma", "advantage", "avantaj"),
    "campaign_performance": (
        "campaign", "kampanya", "promotion", "roi", "kar", "return", "marketing", "pazarlama",
        "discount", "indirim", "performance", "başarı", "effectiveness", "etkinlik"),
    "price_elasticity": (
        "elasticity", "elastikiyet", "optimization", "optimal", "optimum", "demand", "talep",
        "sensitivity", "hassasiyet", "revenue", "gelir", "margin", "kar"),
    "promotional_calendar": (
        "calendar", "takvim", "schedule", "planning", "planlama", "future", "gelecek", "budget",
        "bütçe", "timeline", "zaman", "seasonal", "mevsimsel"),
}

# Accepted report names -> subject.
ALIASES: dict[str, str] = {
    "competitor_tracking": "competitor_tracking",
    "competitor_analysis": "competitor_tracking",
    "campaign_performance": "campaign_performance",
    "campaign_analysis": "campaign_performance",
    "price_elasticity": "price_elasticity",
    "price_optimization": "price_elasticity",
    "promotional_calendar": "promotional_calendar",
    "promotional_planning": "promotional_calendar",
}

MODES = ("first_match", "score")


# ---- single request (driver-side helper) -------------------------------------

def detect(question: str | None, mode: str = "first_match") -> str:
    """Intent of one text: the most hits, or any hit, ties in table order; none is the default."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    text = (question or "").lower()
    hits = {intent: len({w for w in words if w in text}) for intent, words in KEYWORDS.items()}
    weight = {"first_match": bool, "score": int}[mode]
    best = max(hits, key=lambda intent: weight(hits[intent]))
    return best if hits[best] else DEFAULT_INTENT


def route(question: str | None = None, query_type: str | None = None, strict: bool = True,
          mode: str = "first_match") -> str:
    """Subject for one request: an explicit type wins (aliases resolved), else the question."""
    if query_type:
        if query_type in ALIASES:
            return ALIASES[query_type]
        if strict:
            raise ValueError(f"unknown query_type {query_type!r}; expected one of {sorted(ALIASES)}")
        return DEFAULT_INTENT
    return detect(question, mode)


# ---- column expressions over a table of requests ------------------------------

def normalized(question: Column) -> Column:
    return F.lower(F.coalesce(question, F.lit("")))


def _any_keyword(text: Column, words: tuple[str, ...]) -> Column:
    cond = None
    for w in words:
        term = text.contains(w)
        cond = term if cond is None else cond | term
    return cond


def intent_of(question: Column, mode: str = "first_match") -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    text = normalized(question)
    if mode == "first_match":
        out = None
        for intent, words in KEYWORDS.items():
            cond = _any_keyword(text, words)
            out = F.when(cond, F.lit(intent)) if out is None else out.when(cond, F.lit(intent))
        return out.otherwise(F.lit(DEFAULT_INTENT))
    scores = [
        sum((F.when(text.contains(w), 1).otherwise(0) for w in sorted(set(words))), F.lit(0))
        for words in KEYWORDS.values()]
    best = F.greatest(*scores)
    out = F.when(best == 0, F.lit(DEFAULT_INTENT))
    for intent, score in zip(KEYWORDS, scores):
        out = out.when(score == best, F.lit(intent))
    return out


def resolved_type(query_type: Column, question: Column, strict: bool = True,
                  mode: str = "first_match") -> Column:
    """Explicit type (alias-resolved) if non-empty, else the detected intent."""
    explicit = F.nullif(query_type, F.lit(""))
    alias = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    mapped = F.try_element_at(alias, explicit)
    unknown = explicit.isNotNull() & mapped.isNull()
    fallback = (F.raise_error(F.concat(F.lit("unknown query_type "), explicit)) if strict
                else F.lit(DEFAULT_INTENT)).cast("string")
    return (F.when(unknown, fallback).when(explicit.isNotNull(), mapped)
            .otherwise(intent_of(question, mode)))


def route_requests(requests: DataFrame, strict: bool = True, mode: str = "first_match") -> DataFrame:
    """Add ``intent`` and ``row_limit`` to a table (question, query_type, limit)."""
    cols = set(requests.columns)
    qt = F.col("query_type") if "query_type" in cols else F.lit(None).cast("string")
    lim = F.coalesce(F.col("limit").cast("int"), F.lit(100)) if "limit" in cols else F.lit(100)
    checked = F.when(lim < 0, F.raise_error(F.lit("limit must be >= 0")).cast("int")).otherwise(
        F.least(lim, F.lit(500))) if strict else F.least(F.greatest(lim, F.lit(0)), F.lit(500))
    return requests.withColumns({
        "intent": resolved_type(qt, F.col("question"), strict, mode),
        "row_limit": checked,
    })


def request_mix(routed: DataFrame) -> DataFrame:
    """Requests per resolved intent (partial aggregation; four groups at most)."""
    return routed.groupBy("intent").agg(F.count(F.lit(1)).alias("requests"))


def conversation_questions(conversations: DataFrame) -> DataFrame:
    """User turns of a conversation log as routing requests (whole texts)."""
    return conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"))


def varied_requests(conversations: DataFrame) -> DataFrame:
    """User turns as full requests (question, query_type, limit) that reach every routing rule.

    The request kind follows from (conv_id + turn) mod 12: each accepted name, an unknown
    name, an empty name, and questions for the intents that the turns' own texts never reach.
    """
    kind = (F.col("conv_id") + F.col("turn")) % 12
    names = F.array(*[F.lit(a) for a in ALIASES], F.lit("no_such_report"), F.lit(""))
    limits = F.array(F.lit(-5), F.lit(0), F.lit(250), F.lit(9999))
    question = F.when(kind == 9, "Kampanya ROI").when(kind == 10, "demand sensitivity?").when(
        kind == 11, "SEASONAL calendar").otherwise(F.col("text"))
    at = (kind + 1).cast("int")
    return conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", question.alias("question"), F.try_element_at(names, at).alias("query_type"),
        F.try_element_at(limits, at).alias("limit"))
