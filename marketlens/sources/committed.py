"""Committed writes: several DataFrames of one result appear together or not at all.

Each write goes to a folder of its own, ``<path>/runs/<id>/<part>``; the file
``<path>/manifest.json`` names the folder that counts.  The manifest is replaced by one
atomic rename after the last part is written, so a write that dies between two parts leaves
the earlier result in force, and a reader never sees parts of two runs.  The rename goes
through Hadoop's FileContext (HDFS and local folders rename atomically).

Defined cases: a part without rows keeps its columns; no manifest means no result; folders of
failed or replaced runs stay until ``prune`` (a reader may still use them).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _files(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What the manifest of ``path`` says, or None if nothing has been committed there."""
    p, fs = _files(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def write(parts: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> str:
    """Write all ``parts`` and commit them; returns the run's id.

    ``mode``: 'errorifexists' refuses a path that holds a result, 'overwrite' replaces it.
    """
    if mode not in ("errorifexists", "error", "overwrite"):
        raise ValueError(f"a committed write cannot {mode}")
    spark = next(iter(parts.values())).sparkSession
    path = path.rstrip("/")
    if mode != "overwrite" and manifest(spark, path) is not None:
        raise FileExistsError(f"{path} holds a committed result")
    run = uuid.uuid4().hex
    for name, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{path}/runs/{run}/{name}")
    _commit(spark, path, {"run": run, "parts": list(parts)})
    return run


def _commit(spark: SparkSession, path: str, content: dict) -> None:
    jvm = spark.sparkContext._jvm
    staged, fs = _files(spark, f"{path}/runs/{content['run']}/{MANIFEST}")
    out = fs.create(staged, False)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    final, _ = _files(spark, f"{path}/{MANIFEST}")
    renames = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(renames, 1)
    options[0] = renames.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    context.rename(fs.makeQualified(staged), fs.makeQualified(final), options)


def read(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of the committed result."""
    found = manifest(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} holds no committed result")
    return spark.read.parquet(f"{path.rstrip('/')}/runs/{found['run']}/{part}")


def prune(spark: SparkSession, path: str) -> int:
    """Delete the folders of all runs but the committed one; returns how many."""
    found = manifest(spark, path)
    root, fs = _files(spark, f"{path.rstrip('/')}/runs")
    if found is None or not fs.exists(root):
        return 0
    stale = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() != found["run"]]
    for folder in stale:
        fs.delete(folder, True)
    return len(stale)
