"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``.  All stages but the last return the columns of
``docs``.  A null or empty text, a null id and repeated rows are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import decontamination, language_id, line_dedup, mixing, simhash
from marketlens.llm.shared import cut, text_crc_mod

ID, TEXT, LANG, SOURCE, CHARS = "doc_id", "text", "lang", "source", "n_chars"


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents the language classifier rejects (no letter, or no clear language)."""
    dictionaries = language_id.train_dictionaries(docs, ID, TEXT, LANG, text_crc_mod(F.col(ID), 4) != 2)
    name = _free(docs, "predicted")
    marked = docs.withColumn(name, language_id.identify(F.col(TEXT), dictionaries))
    return marked.filter(~F.col(f"{name}.rejected")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; a document that loses all its lines goes."""
    kept, removed, total = (_free(docs, x) for x in ("clean_text", "n_removed", "n_lines"))
    clean = line_dedup.dedup_lines(docs, ID, TEXT, kept=kept, removed=removed, total=total)
    changed = F.col(removed) > 0
    out = {TEXT: F.col(kept)}
    if CHARS in docs.columns:
        out[CHARS] = F.when(changed, F.length(kept).cast(dict(docs.dtypes)[CHARS])).otherwise(F.col(CHARS))
    return clean.filter(~changed | (F.col(removed) < F.col(total))).select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each near-duplicate group; a group
    whose ids are all null keeps one row.  Among rows that share the smallest id the one with the least MD5 stays."""
    # Only keys pass through Python, joins and aggregates; the rows themselves move once, in the last join.
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = docs.select(F.col(ID).alias("id"), F.md5(whole.cast("binary")).alias("row"), simhash.fingerprints(F.col(TEXT)).alias("fp"))
    rows = cut(rows.groupBy("id", "row", "fp").agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    groups = simhash.components(rows, "id", "fp").select(F.col("fp").alias("group_fp"), "root", "component_id")
    first = rows.join(groups, F.col("fp") == F.col("group_fp")).filter(F.col("id").eqNullSafe(F.col("component_id")))
    # Of several equal rows one stays.
    kept = first.groupBy("root").agg(F.min(F.struct("row", "n")).alias("kept")).select("kept.*")
    key, kept_row, kept_n = (_free(docs, x) for x in ("row_key", "kept_row", "kept_n"))
    kept = kept.select(F.col("row").alias(kept_row), F.col("n").alias(kept_n))
    found = docs.withColumn(key, F.md5(whole.cast("binary"))).join(kept, F.col(key) == F.col(kept_row))
    alone = found.filter(F.col(kept_n) == 1).select(*docs.columns)
    several = found.filter(F.col(kept_n) > 1).dropDuplicates([key]).select(*docs.columns)
    return alone.unionByName(several)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontamination.contaminated(docs, ID, TEXT, items, "item_id", "text")
    doc, t = decontamination.row_key(F.col(ID), F.col(TEXT))
    hits = hits.select(F.col("doc").alias(_free(docs, "hit_doc")), F.col("t").alias(_free(docs, "hit_text")))
    return docs.join(hits, doc.eqNullSafe(F.col(hits.columns[0])) & t.eqNullSafe(F.col(hits.columns[1])), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document once per copy that the mix takes; ``copy`` numbers them from 1."""
    mixed = mixing.mix(docs, ID, TEXT, SOURCE).filter("copies > 0")
    return mixed.select("row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(_free(docs, "copy")))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # compression, fingerprints of XXH64 and spaced seeds are not SQL; tests/llm compare with brute force
