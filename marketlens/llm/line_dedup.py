"""Line deduplication by winnowing over line hashes (DataFrame operations only).

A line is a run between line feeds; its text is trimmed of spaces, tabs and carriage
returns, and blank lines are kept but take no part.  A window is ``WINDOW`` lines in a row,
or one or two lines that hold ``LONG_WORDS`` words or more.  A window is repeated if the
same lines stand earlier, in the order (id, text hash, position), and a run of lines is
deleted where repeated windows cover it: every later run of three lines, or of fifty words,
that occurred before goes, and the first occurrence stays.  A repeated passage that begins or
ends inside a line is outside this rule (the README has a measured figure).

Method: the smallest line hash of each window is its fingerprint, so equal windows always
select equal fingerprints.  Fingerprint positions are counted by hash with a partial
aggregate, and only those whose hash occurs at two positions or more are joined on; the rest
(most text) drops out there.  Around each joined fingerprint the windows that selected it are
compared with the first occurrence of the same lines (one minimum per window hash, never
pairs of positions), and overlapping repeated windows extend the run both ways.

Lines and windows are compared by 64-bit hashes.  Defined cases: null text stays null with
no lines; an empty text has no lines; rows with equal id and equal text are one document
and are treated alike; null ids come first; a run may overlap its own earlier copy, so one of
n equal runs in a row stays; an empty table gives no rows; a document whose lines are all
repeated keeps its blank lines only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 3
LONG_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def doc_key(doc_id: Column, text: Column) -> Column:
    """Key of a row: rows with the same id and text are the same document."""
    return F.struct(doc_id.alias("doc"), F.xxhash64(text).alias("t"))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """``key`` (see ``doc_key``) and ``gone``: the numbers, from 0 among non-blank lines, of the lines to delete."""
    text = F.col(text_col)
    used = docs.filter(text.isNotNull()).select(doc_key(F.col(id_col), text).alias("key"), F.filter(
        F.transform(_lines(text), _trimmed), lambda x: F.length(x) > 0).alias("lines"))
    used = used.select("key", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("w"))
    n = F.size("h")

    def windows(size: int, least: int) -> Column:
        """Windows of ``size`` lines with ``least`` words: start, size, window hash, fingerprint."""
        at = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        if least:
            at = F.filter(at, lambda i: F.aggregate(F.slice("w", i + 1, size), F.lit(0), lambda a, x: a + x) >= least)
        return F.transform(at, lambda i: F.struct(
            i.alias("start"), F.lit(size).alias("size"), F.xxhash64(F.lit(size), F.slice("h", i + 1, size)).alias("lines"),
            F.array_min(F.slice("h", i + 1, size)).alias("mark")))

    kinds = [windows(window, 0)] + [windows(size, long_words) for size in range(1, window)]
    every = used.select("key", F.explode(F.concat(*kinds)).alias("x")).select("key", "x.*")
    # One row a document and fingerprint, with the windows that selected it.
    anchored = every.groupBy("key", "mark").agg(F.collect_list(F.struct("start", "size", "lines")).alias("around"))
    # Two documents, or two windows of one document, share a fingerprint: a join position.
    shared = anchored.groupBy("mark").agg(F.sum(F.size("around")).alias("n")).filter("n > 1").select(F.col("mark").alias("shared_mark"))
    hits = anchored.join(shared, anchored["mark"] == shared["shared_mark"]).select("key", F.explode("around").alias("x")).select("key", "x.*")
    first = hits.groupBy(F.col("lines").alias("same")).agg(F.min(F.struct("key", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = hits.join(first, hits["lines"] == first["same"]).filter(F.struct("key", "start") > F.col("first"))
    return later.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1))))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, long_words: int = LONG_WORDS,
                kept: str = "clean_text", removed: str = "n_removed", total: str = "n_lines") -> DataFrame:
    """``docs`` with the cleaned text, the number of deleted lines and of non-blank lines added.

    Columns of ``docs`` with those three names are replaced.
    """
    text = F.col(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_key(F.col(id_col), text).alias("key"))
    gone = repeated_lines(docs, id_col, text_col, window, long_words).withColumnRenamed("key", "gone_key").distinct()
    found = rows.join(gone, rows["key"].eqNullSafe(gone["gone_key"]), "left")
    text = F.col(f"row.`{text_col}`")  # the row holds the text, so that it moves once
    # Lines with their place; the non-blank ones meet a flag each, in order, and all are put back by place.
    placed = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), (F.length(_trimmed(x)) == 0).alias("blank"), x.alias("x")))
    blank, full = F.filter(placed, lambda p: p["blank"]), F.filter(placed, lambda p: ~p["blank"])
    n_lines = F.coalesce(F.size(full), F.lit(0))
    numbers = F.when(n_lines > 0, F.sequence(F.lit(0), n_lines - 1)).otherwise(F.array().cast("array<int>"))
    flag = lambda at, keep: F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(keep).alias("keep")))
    flags = F.sort_array(F.concat(flag(F.array_except(numbers, F.col("gone")), True), flag(F.col("gone"), False)))
    keep = F.filter(F.zip_with(full, flags, lambda p, f: F.when(f["keep"], p)), lambda p: p.isNotNull())
    kept_lines = F.transform(F.sort_array(F.concat(keep, blank)), lambda p: p["x"])
    clean = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept_lines, "\n"))
    done = found.select("row", clean.alias("clean"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("removed"), F.when(
        text.isNull(), 0).otherwise(n_lines).cast("bigint").alias("total"))
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in (kept, removed, total)]
    return done.select(*others, F.col("clean").alias(kept), F.col("removed").alias(removed), F.col("total").alias(total))
