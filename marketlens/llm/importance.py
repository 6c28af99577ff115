"""Importance resampling towards a target text set, with lines counted once (DataFrame functions only).

Features are all runs of one to three words, hashed into buckets.  A bucket's gain is the log
ratio of its smoothed frequency in the target texts and in the documents; a document's weight
is the sum of the gains of its features, and Gumbel noise from its id turns the weights into a draw
without replacement.

A line break separates words, so every feature lies either inside a line or across line ends.
Equal lines meet in one row: the buckets of a line's features are computed once and written; corpus counts
multiply them by the line's occurrences, and a document's weight sums its lines' weights.
Features across line ends are added from the document itself: of every line only the first
two and the last two words (its one word, if it has one) can belong to them, so those words stand in
a short sequence, in which runs that begin and end in different lines are the features.

Arrays are exploded with ``explode_outer``: an inner explode would have Spark test their size first, in a
filter that repeats all that builds them.

Nothing but the gains (one number a bucket) reaches the driver.  A line or a text that a third
of all rows hold is counted before it is shuffled; joins meet on (text, line) pairs that are
distinct.  Ranks come from a range partition, numbered inside each range and moved on by the rows
of the ranges before it.

Defined cases: a null or empty text has no words, no features and weight 0; null ids hash as
the empty string and stand first among ties; rows of equal id and score take the next ranks
in any order; repeated rows count each; an empty table gives no rows, empty targets count as no
features; other columns are not read, so their names may clash.  Texts and lines are
identified by their 128-bit MD5.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import cut

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"  # in folded text
LETTER, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # before folding
EDGE = f"({LETTER}+(?:{GAP}+{LETTER}+)?)"  # the first word, and the second if there is one
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, "42"


def fold(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does just that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % F.lit(buckets)).cast("int")


def _from(items: Column, first: int) -> Column:
    return F.slice(items, F.lit(first), F.greatest(F.size(items), F.lit(1)))


def _join(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def with_features(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: all runs of one to three of the array ``words``.  Each step is a column, so none is computed twice."""
    rows = rows.withColumn("pairs", F.zip_with("words", _from(F.col("words"), 2), _join))  # the last one is null, as one part is missing
    return rows.withColumn(name, F.array_compact(F.concat("words", "pairs", F.zip_with("pairs", _from(F.col("words"), 3), _join)))).drop("pairs")


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def with_across(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds ``name``: all runs of two or three words of ``text`` that do not lie within one line."""
    rows = rows.withColumn("_lines", _lines(text))
    first = lambda line: F.split(_ascii_lower(F.regexp_extract(line, EDGE, 1)), f"{GAP}+")
    last = lambda line: F.split(_ascii_lower(F.reverse(F.regexp_extract(F.reverse(line), EDGE, 1))), f"{GAP}+")
    rows = rows.withColumn("_edges", F.transform("_lines", lambda line: F.struct(first(line).alias("a"), last(line).alias("b"))))
    one = F.lit(1)
    words = lambda e: F.when(F.element_at(e["a"], 1) == "", F.slice(e["a"], one, F.lit(0))).when(F.size(e["a"]) == 1, e["a"]).otherwise(
        F.concat(e["a"], e["b"]))
    rows = rows.withColumn("_edges", F.flatten(F.transform("_edges", lambda e, i: F.transform(words(e), lambda w: F.struct(w.alias("w"), i.alias("i"))))))
    pair = lambda a, b: F.struct(_join(a["w"], b["w"]).alias("w"), a["i"].alias("i"), b["i"].alias("j"))
    rows = rows.withColumn("_pairs", F.zip_with("_edges", _from(F.col("_edges"), 2), pair))
    triples = F.zip_with("_pairs", _from(F.col("_edges"), 3), lambda p, c: F.when(p["i"] != c["i"], _join(p["w"], c["w"])))
    found = F.concat(F.transform("_pairs", lambda p: F.when(p["i"] != p["j"], p["w"])), triples)
    return rows.withColumn(name, F.array_compact(found)).drop("_lines", "_edges", "_pairs")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_table(texts: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Every distinct line with a word: ``line_key``, occurrences ``n``, number of words, buckets of its features."""
    lines = texts.select(F.explode_outer(_lines(F.col(text_col))).alias("line")).filter(F.col("line").rlike(LETTER))
    rows = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select(_key(F.col("line")).alias("line_key"), "n", F.regexp_extract_all(fold(F.col("line")), F.lit(f"({WORD}+)"), 1).alias("words"))
    rows = with_features(rows, "features")
    return cut(rows.select("line_key", "n", F.size("words").alias("words"), F.transform("features", lambda f: _bucket(f, buckets)).alias("buckets")), "importance-lines")


def bucket_counts(texts: DataFrame, text_col: str, lines: DataFrame, buckets: int) -> DataFrame:
    """``bucket``, ``n``: features of all texts, those of a line multiplied by its occurrences."""
    inside = lines.select("n", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("n").alias("n"))
    between = with_across(texts.select(F.col(text_col).alias("t")), F.col("t"), "found").select(F.explode_outer("found").alias("f"))
    between = between.filter(F.col("f").isNotNull()).groupBy(_bucket(F.col("f"), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return inside.unionByName(between).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(ours: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket; ``buckets`` numbers reach the driver."""
    spark = ours.sparkSession
    rows = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for name, counts in (("s", ours), ("t", target)):
        rows = rows.join(counts.select("bucket", F.col("n").alias(name)), "bucket", "left")
    rows = cut(rows.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")]), "importance-buckets")
    total = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    ratio = (F.col("t") + 1) * F.lit(total["all_s"] + buckets) / ((F.col("s") + 1) * F.lit(total["all_t"] + buckets))
    return [r["gain"] for r in rows.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).orderBy("bucket").collect()]


def weigh(docs: DataFrame, id_col: str, text_col: str, lines: DataFrame, gain: list[int]) -> DataFrame:
    """``doc_id``, ``words``, ``n_features`` and ``weight`` of every row of ``docs``."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    buckets = len(gain)
    worth = lambda found: F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, b: acc + F.get(table, b))
    per_line = lines.select("line_key", "words", F.size("buckets").alias("n"), worth(F.col("buckets")).alias("weight"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # One row a line, and one with a null line for the text itself, which counts its copies.
    held = docs.select(_key(text).alias("text_key"), F.explode_outer(F.concat(_lines(text), F.array(F.lit(None).cast("string")))).alias("line"))
    held = held.filter(F.col("line").isNull() | F.col("line").rlike(LETTER)).groupBy("text_key", _key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("times"))
    joined = held.join(per_line, F.col("key") == F.col("line_key"), "left")
    copies = F.max(F.when(F.col("key").isNull(), F.col("times")))
    total = lambda c: F.expr(f"coalesce(sum(times * {c}), 0) div max(if(key is null, times, null))").alias(f"in_{c}")
    sums = joined.groupBy("text_key").agg(copies.alias("copies"), total("words"), total("n"), total("weight"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    rows = with_across(rows.withColumn("row_key", _key(F.col("t"))), F.col("t"), "found")
    rows = rows.select("doc_id", "row_key", F.transform("found", lambda f: _bucket(f, buckets)).alias("between"))
    rows = rows.select("doc_id", "row_key", F.size("between").alias("n_between"), worth(F.col("between")).alias("weight_between"))
    out = rows.join(sums, F.col("row_key") == F.col("text_key"))
    return out.select("doc_id", F.col("in_words").alias("words"), (F.col("in_n") + F.col("n_between")).alias("n_features"),
                      (F.col("in_weight") + F.col("weight_between")).alias("weight"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Standard Gumbel noise in thousandths, from the id."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(name, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` to the rows drawn: ``percent`` % of those with ``least_words`` words, by falling score."""
    rows = cut(scored, "importance-scored")
    able = rows.filter(F.col("words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    turn = F.monotonically_increasing_id()  # parts rows of equal id and score
    placed = able.withColumn("turn", turn).repartitionByRange(*order, F.col("turn")).withColumn("range", F.spark_partition_id())
    placed = cut(placed, "importance-ranges")
    ranges = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("able"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order, "turn"))
    ranked = placed.withColumn("inside", inside).join(F.broadcast(ranges), "range")
    rank = (F.col("ahead") + F.col("inside")).cast("bigint")
    ranked = ranked.withColumn("rank", F.when(rank <= F.expr(f"able * {int(percent)} div 100"), rank))
    short = rows.filter(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.select(*rows.columns, "rank").unionByName(short)


def resample(docs: DataFrame, id_col: str, text_col: str, target: DataFrame, target_col: str, buckets: int = BUCKETS, seed: str = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of every row of ``docs``."""
    lines = line_table(docs, text_col, buckets)
    wanted = bucket_counts(target, target_col, line_table(target, target_col, buckets), buckets)
    gain = gains(bucket_counts(docs, text_col, lines, buckets), wanted, buckets)
    scored = weigh(docs, id_col, text_col, lines, gain)
    return draw(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), least_words, percent)
