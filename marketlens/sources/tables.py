"""Access to the base tables (parquet folder or catalog)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables(Mapping):
    """Lazily opened base tables.

    ``Tables.parquet(spark, dir)`` reads ``{dir}/{name}.parquet``;
    ``Tables.catalog(spark, db)`` reads ``{db}.{name}`` from the metastore;
    ``Tables(spark, {name: df})`` wraps DataFrames (tests).  Reads are lazy:
    Catalyst prunes columns and pushes filters into each scan.
    """

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame] | None = None,
                 opener=None):
        self.spark = spark
        self._frames = dict(frames or {})
        self._opener = opener

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str) -> "Tables":
        folder = folder.rstrip("/")
        return cls(spark, opener=lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    @classmethod
    def catalog(cls, spark: SparkSession, database: str) -> "Tables":
        return cls(spark, opener=lambda name: spark.table(f"{database}.{name}"))

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if self._opener is None:
                raise KeyError(name)
            self._frames[name] = self._opener(name)
        return self._frames[name]

    def __iter__(self):
        return iter(self._frames if self._opener is None else BASE_TABLES)

    def __len__(self):
        return len(list(iter(self)))
