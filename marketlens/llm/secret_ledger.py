"""Secret scan over an incremental ledger of content-addressed blobs.

Every version of every path is reduced to the SHA-256 of its UTF-8 content.  The ledger, a
folder of Parquet tables, remembers which (blob, rule, rule version) triples were scanned
and what was found; a scan reads the text of one representative per blob, and only of blobs
with a rule version not in the ledger, then joins the findings back to all paths.  A new
rule version therefore rescans every blob for that rule alone, and a copied file costs a
hash.  The ledger adds no span of its own: with the base rules, all spans are the base spans.

Ledger tables: ``scans`` (blob, rules) and ``findings`` (blob, rule, version, start, end).
Both are appended in the order findings, scans; a run that dies in between is repeated by
the next scan, and findings are made distinct when read.

Defined cases: null content is the empty text; equal rows and equal contents share one
blob; an empty table leaves the ledger as it is and gives no rows; null paths are kept
as paths; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count when group ``group`` has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order that breaks ties between spans.  A maximal run
# of at least 24 hex digits is the same as a run of any length that is dropped below 24.
BASE_RULES = (
    Rule("assign", 1, r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)

FINDINGS = "blob binary, rule string, version int, start int, `end` int"


def spans(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that pass the rule's length; code points, end exclusive."""
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, re.compile(r.pattern)) for r in rules]
        for batch in batches:
            out = {"blob": [], "rule": [], "version": [], "start": [], "end": []}
            for blob, text, due in zip(*(batch[c].to_pylist() for c in ("blob", "content", "due")), strict=True):
                for rule, pattern in compiled:
                    if rule.key in due:
                        for start, end in spans(text or "", rule, pattern):
                            for k, v in zip(out, (blob, rule.kind, rule.version, start, end), strict=True):
                                out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("blob", pa.binary()), ("rule", pa.string()), ("version", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    return run


class Ledger:
    """The scans and findings under ``folder`` (a shared path Spark can write)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return self.spark.createDataFrame([], schema)

    def scans(self) -> DataFrame:
        return self._read("scans", "blob binary, rules array<string>")

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        wanted = reduce(lambda a, b: a | b, ((F.col("rule") == r.kind) & (F.col("version") == r.version) for r in rules), F.lit(False))
        return self._read("findings", FINDINGS).filter(wanted).distinct()

    def scan(self, versions: DataFrame, content: str, rules: tuple[Rule, ...] = BASE_RULES) -> None:
        """Scan the contents of ``versions`` that are not in the ledger under these rule versions."""
        if len({r.key for r in rules}) < len(rules):
            raise ValueError("two rules share a kind and a version")
        keys = F.array(*[F.lit(r.key) for r in rules])
        rows = versions.select(blob_id(F.col(content)).alias("blob"), F.col(content).alias("content"))
        # One text a blob: copies collapse in the partial aggregate, before the exchange.
        unique = rows.groupBy("blob").agg(F.first("content").alias("content"))
        done = self.scans().groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
        due = unique.join(done, "blob", "left").select(
            "blob", "content", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))).alias("due")).filter(F.size("due") > 0)
        due.mapInArrow(_scan(tuple(rules)), FINDINGS).write.mode("append").parquet(f"{self.folder}/findings")
        hashes = versions.select(blob_id(F.col(content)).alias("blob")).distinct()
        new = hashes.join(done, "blob", "left").select(
            "blob", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))).alias("rules")).filter(F.size("rules") > 0)
        new.write.mode("append").parquet(f"{self.folder}/scans")

    def report(self, versions: DataFrame, path: str, content: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
        """``path``, ``blob`` and ``spans`` (array of (start, rank, kind, end), sorted; empty if none) of every row of ``versions``."""
        rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
        by_blob = self.findings(rules).groupBy(F.col("blob").alias("found_blob")).agg(F.sort_array(F.collect_set(F.struct(
            "start", rank[F.col("rule")].alias("rank"), F.col("rule").alias("kind"), "end"))).alias("spans"))
        paths = versions.select(F.col(path).alias("path"), blob_id(F.col(content)).alias("blob"))
        none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
        return paths.join(by_blob, paths["blob"] == by_blob["found_blob"], "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def blob_id(content: Column) -> Column:
    """SHA-256 of the UTF-8 content (null: of the empty text), 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
