"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Sources in the order of their code points (null last) take the weights in turn.  Each
source's target is its share, by weight, of the total size of all documents, but at most
``MAX_COPIES`` times the source's own size; what a source cannot take is shared among the
others by weight until none is above.  In closed form: sources sorted by (cap / weight)
are full up to a water level, and the rest take the level times their weight.

Every document of a source expects ``target / source size`` copies.  The documents stand in
the order (size, id), so that the sizes taken spread evenly; the prefix sum of the expected
copies, plus one offset per source drawn from the seed, crosses some integers at each
document, and the document is emitted once for each.  Expected copies are whole millionths,
at most 3,000,000, so sums are exact and no document can be taken four times.

The prefix sum is two-step: row counts per (source, size, id range) are summed in a window
over that small table, and positions inside one such cell are numbered in a window of their
own, so a hot source is spread over its cells.  Only the table of distinct sizes sees a window
over a whole source.

Defined cases: a null text has size 0; null source is a source of its own; rows with equal
ids count as documents of their own and share the draw between them (which one of two equal
rows is taken is not told apart); null ids come first; a source of size 0 has target 0 and
takes nothing; ids may be of any type that can be ordered; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
UNIT = 1_000_000
SEED = 42
ID_RANGES = 64
BORDER_SAMPLE = 4096  # ids that reach the driver
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source``, ``source_size`` -> the same with ``target``; one row per source in, one out."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("cap", F.lit(max_copies) * F.col("source_size"))
    # Sorted by cap / weight; the sources before this one are full, this and the later ones share what is left.
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumns({"left": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(rest)})
    rows = rows.withColumn("full", F.col("cap") * F.col("open") <= F.col("left") * F.col("weight"))
    # Full sources stand first; the first one that is not fixes the level of all from it on.
    level = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("c"), "left", "open"))).over(Window.partitionBy())
    rows = rows.withColumn("level", level)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level.left").cast("double") * F.col("weight") / F.col("level.open"))
    return rows.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, UNIT), from the first 32 bits of an MD5."""
    text = F.concat(F.coalesce(source, F.lit("")), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") * F.lit(UNIT) / F.lit(1 << 32)


def id_borders(docs: DataFrame, id_col: str) -> list:
    """At most ``ID_RANGES`` - 1 ids that part the rows evenly, from the ``BORDER_SAMPLE`` ids of least hash.

    Borders only spread the work: the result is the same for any.
    """
    ids = docs.select(F.col(id_col).alias("id")).filter("id IS NOT NULL")
    sample = ids.orderBy(F.xxhash64("id"), "id").limit(BORDER_SAMPLE)
    found = [r["id"] for r in sample.orderBy("id").collect()]
    return list(dict.fromkeys(found[k * len(found) // ID_RANGES] for k in range(1, ID_RANGES))) if found else []


def id_range(doc_id: Column, borders: list) -> Column:
    """Number of borders up to the id, by bisection; null ids stand before all others."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(doc_id < F.lit(borders[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(between(0, len(borders)))


def mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """One row per document: ``row`` (its columns), ``doc_id``, ``size``, ``source_size``, ``target``, ``copies``."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # A cell is (source, size, range of ids).
    ranged = rows.withColumn("cell", id_range(F.col("doc_id"), id_borders(docs, id_col)))
    cells = ranged.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    sized = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = source_targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, max_copies)
    per_doc = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * UNIT), F.lit(max_copies * UNIT))).otherwise(0).cast("bigint")
    sources = sources.withColumns({"per_doc": per_doc, "offset": F.floor(offset(F.col("source"), seed)).cast("bigint")})
    # Rows before a cell: those of smaller sizes of the source, and those of the same size in earlier ranges.
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.withColumn("smaller", F.coalesce(F.sum("n").over(smaller), F.lit(0))).drop("n")
    before = before.join(sources, before["source"].eqNullSafe(sources["source"])).select(
        before["source"].alias("b"), F.col("size").alias("y"), "smaller", "source_size", "target", "per_doc", "offset")
    earlier = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    cells = cells.join(before, cells["source"].eqNullSafe(before["b"]) & (cells["size"] == before["y"])).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("cell").alias("c"), (F.col("smaller") + F.col("earlier")).alias("ahead"),
        "source_size", "target", "per_doc", "offset")
    inside = Window.partitionBy("source", "size", "cell").orderBy(F.col("doc_id").asc_nulls_first())
    placed = ranged.withColumn("at", F.row_number().over(inside))
    placed = placed.join(cells, placed["source"].eqNullSafe(F.col("s")) & (placed["size"] == F.col("z")) & (placed["cell"] == F.col("c")))
    copies = F.expr(f"(((ahead + at) * per_doc + offset) div {UNIT}) - (((ahead + at - 1) * per_doc + offset) div {UNIT})")
    return placed.select("row", "doc_id", "size", "source_size", "target", copies.alias("copies"))
