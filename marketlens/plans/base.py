"""Shared shape of the four subject reports.

Every report is the same plan: filter the fact table to a date window, roll it
up by segment keys, join the rollup back to each detail row, add ranks, project
rounded values and label ladders, then keep the top n.  Subjects differ only in
columns, so each subject module supplies expressions and this module wires the
stages.  Stages are built when asked for: segments, summaries and insights never
touch the ranks, and a report chooses its rows first and ranks only those.
"""

from __future__ import annotations

import contextvars
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.config import DEFAULT_THRESHOLDS, Thresholds, resolve_limit
from marketlens.operators.interval_rank import Intervals, as_text, counts, partition_start, sort_key, with_ranks
from marketlens.operators.ranking import OrderKey, rank_columns
from marketlens.operators.ranking import RankSpec as Rank
from marketlens.operators.segments import drop_null_keys, join_back, rollup
from marketlens.operators.topn import full_order, top_n
from marketlens.session import materialize


@dataclass(frozen=True)
class RankSpec:
    name: str
    order: Sequence[OrderKey]
    partition_by: Sequence[str] = ()
    on_segments: bool = False  # rank the rollup, each segment weighted by its rows


@dataclass
class SubjectPlan:
    """Stages of one report, each built at its first use."""

    subject: str
    source: DataFrame  # detail rows with non-NULL keys: the rows the inner join-back keeps
    keys: Sequence[str]
    aggregate: Callable[[DataFrame], DataFrame] = field(repr=False)
    specs: Sequence[RankSpec] = ()
    projection: Callable[..., DataFrame] = field(default=None, repr=False)
    report_order: Callable[[DataFrame], list[Column]] = field(default=None, repr=False)
    segment_weight: str | None = None
    rank_mode: str = "two_pass"
    cut_detail: bool = True

    @cached_property
    def segments(self) -> DataFrame:
        """The rollup, straight from the source (one scan, nothing written)."""
        return self.aggregate(self.source)

    @cached_property
    def detail(self) -> DataFrame:
        """The detail rows; written once, as the rollup, the ranks and the join all read them."""
        if self.cut_detail and self.rank_mode != "window":
            return materialize(self.source, f"{self.subject}-detail")
        return self.source

    @cached_property
    def _ranked_segments(self) -> DataFrame:
        segs = self.aggregate(self.detail)
        if self.rank_mode == "two_pass" and any(s.on_segments for s in self.specs):
            return materialize(segs, f"{self.subject}-segments")
        return segs

    def _ranks(self, on_segments: bool) -> list[Rank]:
        weight = self.segment_weight if on_segments else None
        return [Rank(s.name, s.order, s.partition_by, weight) for s in self.specs if s.on_segments == on_segments]

    @cached_property
    def ranked(self) -> DataFrame:
        """Every detail row with its segment's values and all ranks."""
        segs, rows = self._ranked_segments, self.detail
        if self._ranks(True):
            segs = rank_columns(segs, self._ranks(True), self.rank_mode)
        if self._ranks(False):
            rows = rank_columns(rows, self._ranks(False), self.rank_mode)
        return join_back(rows, segs, self.keys)

    @cached_property
    def rows(self) -> DataFrame:
        """The labelled result before LIMIT, with all ranks."""
        return self.projection(self.ranked)

    @cached_property
    def labelled(self) -> DataFrame:
        """The labelled result before LIMIT, without the rank columns."""
        blank = {s.name: F.lit(None).cast("bigint") for s in self.specs}
        return self.projection(join_back(self.source, self.segments, self.keys).withColumns(blank)).drop(*blank)

    @cached_property
    def alone(self) -> DataFrame:
        """``labelled`` without the rollup: its columns are NULL, so are labels that need them.  For
        outputs that read the detail only: one pass over the source and no join."""
        return self.projection(self._blank(self.source)).drop(*[s.name for s in self.specs])

    def _blank(self, detail: DataFrame) -> DataFrame:
        """Detail rows with NULL for the rollup's columns, and the sort keys of the ranks for the ranks."""
        columns = {f.name: F.lit(None).cast(f.dataType) for f in self.segments.schema if f.name not in self.keys}
        keys = {s.name: F.lit(None).cast("bigint") if s.on_segments else sort_key(Rank(s.name, s.order, s.partition_by))
                for s in self.specs}
        return detail.withColumns(columns).withColumns(keys)

    def _choose(self, n: int) -> DataFrame:
        """The n detail rows of the report, as they are in the source.

        The order ends with all output columns as tie-break.  Those of the rollup depend on the keys,
        which stand before them among the output columns, so they break no tie and the rows can be chosen before
        the join; a rank orders as its sort key does.
        """
        keyed = self.projection(self._blank(self.source), F.struct(*self.source.columns).alias("_row"))
        order = full_order(keyed.drop("_row"), self.report_order(keyed))
        return keyed.orderBy(*order).limit(n).select("_row.*")

    def top(self, limit: int | None = None) -> DataFrame:
        """The rows of the report without rank columns: nothing is ranked, the join sees n rows."""
        chosen = self._choose(resolve_limit(limit))
        blank = {s.name: F.lit(None).cast("bigint") for s in self.specs}
        return self.projection(join_back(chosen, self.segments, self.keys).withColumns(blank)).drop(*blank)

    def report(self, limit: int | None = None) -> DataFrame:
        """The top rows with their ranks.

        The n rows (n is at most ``MAX_LIMIT``) are chosen and fetched while the rollup is computed; then one
        pass counts the rows between their keys, which gives the ranks.  Nothing is written.  The
        result is a local table of n rows: reading it again runs nothing.
        """
        n = resolve_limit(limit)
        if self.rank_mode == "window":
            return top_n(self.rows, self.report_order(self.rows), n)
        spark = self.source.sparkSession
        segments = self.segments.persist()  # read up to twice below; spills to disk, computed again where lost
        try:
            with ThreadPoolExecutor(2) as pool:
                run = lambda f: pool.submit(contextvars.copy_context().run, f)
                rolled = run(segments.count)
                chosen = spark.createDataFrame(self._choose(n).toArrow(), self.source.schema)
                ranked = run(lambda: self._with_ranks(chosen, self.source, False))
                rolled.result()
                keys = F.broadcast(chosen.select(*self.keys).distinct())  # at most n rows
                kept = segments.join(keys, list(self.keys), "left_semi").select(*segments.columns)
                kept = spark.createDataFrame(kept.toArrow(), segments.schema)
                kept = self._with_ranks(kept, segments, True)
                out = self.projection(join_back(ranked.result(), kept, self.keys))
        finally:
            segments.unpersist()
        return top_n(out, self.report_order(out), n)

    def _with_ranks(self, chosen: DataFrame, ranked: DataFrame, on_segments: bool) -> DataFrame:
        """``chosen`` (a few rows of ``ranked``) with the ranks that they have in ``ranked``."""
        specs = self._ranks(on_segments)
        if not specs:
            return chosen
        intervals = []
        texts = {}
        for i, s in enumerate(specs):
            key = sort_key(s)
            schema = chosen.select(key.alias("k")).schema["k"].dataType
            intervals.append((s, schema))
            texts[f"k{i}"] = as_text(key)
            if s.partition_by:
                texts[f"s{i}"] = as_text(partition_start(key, schema))
        rows = chosen.select(*[c.alias(name) for name, c in texts.items()]).collect()
        intervals = [Intervals(s, schema, [r[name] for r in rows for name in (f"k{i}", f"s{i}") if name in texts]) for i, (s, schema) in enumerate(intervals)]
        return with_ranks(chosen, intervals, counts(ranked, intervals))


def build_plan(
    subject: str,
    detail: DataFrame,
    keys: Sequence[str],
    segment_aggs: Callable[[Thresholds], list[Column]] | None,
    ranks: Sequence[RankSpec],
    project: Callable[[DataFrame, Thresholds], DataFrame],
    report_order: Callable[[DataFrame], list[Column]],
    segment_weight: str | None = None,
    thresholds: Thresholds = DEFAULT_THRESHOLDS,
    rank_mode: str = "two_pass",
    cut_detail: bool = True,
    aggregate: Callable[[DataFrame], DataFrame] | None = None,
) -> SubjectPlan:
    # Only rows with non-NULL keys survive the inner join-back; ranks are taken
    # over exactly those rows, as the reference ranks after its join.
    if rank_mode not in ("two_pass", "window"):
        raise ValueError(f"rank_mode must be two_pass or window, got {rank_mode!r}")
    return SubjectPlan(
        subject, drop_null_keys(detail, keys), keys,
        aggregate or (lambda rows: rollup(rows, keys, segment_aggs(thresholds))),
        ranks, lambda joined, *more: project(joined, thresholds, *more), report_order, segment_weight, rank_mode, cut_detail)
