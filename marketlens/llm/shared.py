"""Helpers that several operators share: shared-folder files, packed arrays, row keys."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import checkpoint_root, materialize


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back (lineage ends there)."""
    return materialize(df, f"llm-{label}").select(*df.columns) if df.columns else df


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder, as a URI that tasks can open."""
    root = checkpoint_root(spark)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root
    return f"{root}/llm-{label}-{uuid.uuid4().hex}"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs); used inside tasks."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def text_crc_mod(doc_id: Column, mod: int) -> Column:
    """``crc32(doc_id as text) mod``; a null id counts as the empty text (crc 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(mod)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string, each byte plane compressed apart (small for sorted or skewed ints)."""
    out, comp = io.BytesIO(), zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        body = comp.compress(planes)
        head = f"{a.dtype.str},{len(a)},{len(body)}".encode().ljust(40)
        out.write(head + body)
    return out.getvalue()


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    out, at, dec = [], 0, zstandard.ZstdDecompressor()
    while at < len(data):
        kind, n, size = data[at : at + 40].decode().strip().split(",")
        n, size, dtype = int(n), int(size), np.dtype(kind)
        body = data[at + 40 : at + 40 + size]
        at += 40 + size
        if n:
            planes = np.frombuffer(dec.decompress(body, max_output_size=n * dtype.itemsize), dtype=np.uint8)
            out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        else:
            out.append(np.zeros(0, dtype))
    return out


def smallest_uint(a: np.ndarray) -> np.ndarray:
    """``a`` in the smallest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
