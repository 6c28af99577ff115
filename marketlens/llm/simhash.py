"""SimHash near-duplicates by tiled exact comparison.

A text's words (A-Z lower-cased, see ``tokens``) are joined by single spaces; its shingles of
``SHINGLE`` words, repeats included, are hashed with XXH64 (seed 42), and a bit of the
fingerprint is 1 if it is set in more than half of the hashes.  A shorter text is one
shingle; a text without words has fingerprint zero.  Fingerprints that differ in at most
``RADIUS`` bits are linked, exactly and all of them.

Equal fingerprints are one class from the start (a partial aggregate, so thousands of copies
collapse before the exchange).  Classes are dealt into tiles by the bit counts of their four
16-bit lanes, and a large tile is cut by hash.  Two tiles are compared only if their lane
counts differ by ``RADIUS`` in all at most, because each differing bit changes one count by
one; every other pair of tiles is skipped without loss.  A tile pair is one row with two
packed arrays, compared with numpy exclusive-or and bit counts in steps of bounded
memory.  It returns a spanning forest of its links, so a group of n close fingerprints
gives at most n links a pair of tiles; components are joined up afterwards.

Defined cases: null and empty texts have fingerprint zero and are linked with each other and
with any fingerprint of at most three bits; repeated rows come back each with their own row;
null ids never name a component unless all ids in it are null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.components import connected_components
from marketlens.llm.shared import cut
from marketlens.llm.tokens import fold

SHINGLE = 3
RADIUS = 3
LANES, LANE_BITS = 4, 16
TILE = 4096
STEP = 1 << 16  # hashes turned into bits at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = fold(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][: len(words) - shingle + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed long with the same bits."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x if isinstance(x, str) else None, shingle) for x in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def forest(a: np.ndarray, b: np.ndarray, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list, list]:
    """Links (values of ``a`` to values of ``b``) that keep the components of all ``links``, without cycles."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    left, right = [], []
    for i, j in links:
        for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                left.append(x)
                right.append(y)
    return left, right


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of two unsigned arrays that differ in at most ``radius`` bits, block by block."""
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        if len(i):
            yield i + at, j


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                found = forest(a, b, close_pairs(a, b, radius))
                left += found[0]
                right += found[1]
            yield pa.RecordBatch.from_pydict({"a": np.array(left, np.uint64).view(np.int64), "b": np.array(right, np.uint64).view(np.int64)})
    return run


def _pack_tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"sig": [key[0]], "part": [key[1]], "tile": [np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64)).tobytes()]})


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Lane count differences of total size ``radius`` at most, one of each pair of opposites."""
    grids = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * LANES, indexing="ij"), -1).reshape(-1, LANES)
    near = [tuple(map(int, g)) for g in grids[np.abs(grids).sum(1) <= radius]]
    return [g for g in near if g >= (0,) * LANES]


def link(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``, signed long) within ``radius`` bits.

    A spanning forest for each pair of tiles: components are those of all links.
    """
    lane = lambda k: F.bit_count(F.shiftrightunsigned(F.col("fp"), LANE_BITS * k).bitwiseAND(F.lit((1 << LANE_BITS) - 1)))
    sig = sum((lane(k) * F.lit(32**k) for k in range(LANES)), F.lit(0))
    rows = classes.select("fp", sig.cast("int").alias("sig"))
    # At most 17^4 signatures; each is cut by hash into parts of about TILE fingerprints.
    parts = rows.groupBy(F.col("sig").alias("s")).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("parts"))
    dealt = rows.join(parts, rows["sig"] == parts["s"]).select("fp", "sig", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    tiles = cut(dealt.groupBy("sig", "part").applyInPandas(_pack_tile, "sig int, part int, tile binary"), "simhash-tiles")
    shifts = F.array(*[F.array(*[F.lit(x) for x in g]) for g in _offsets(radius)])
    counts = [F.shiftright("sig", 5 * k).bitwiseAND(F.lit(31)) for k in range(LANES)]
    moved = tiles.select("sig", "part", F.col("tile").alias("x"), F.explode(shifts).alias("g")).select(
        "sig", "part", "x", *[(counts[k] + F.col("g")[k]).alias(f"n{k}") for k in range(LANES)])
    inside = " and ".join(f"n{k} between 0 and {LANE_BITS}" for k in range(LANES))
    other = sum((F.col(f"n{k}") * F.lit(32**k) for k in range(LANES)), F.lit(0))
    near = moved.filter(inside).select("sig", "part", "x", other.cast("int").alias("other"))
    second = tiles.select(F.col("sig").alias("sig2"), F.col("part").alias("part2"), F.col("tile").alias("y"))
    pairs = near.join(second, near["other"] == second["sig2"]).filter("sig <> sig2 or part <= part2").select("x", "y")
    return pairs.mapInArrow(_compare(radius), "a bigint, b bigint").filter("a <> b")


def components(rows: DataFrame, id_col: str, fp_col: str, radius: int = RADIUS) -> DataFrame:
    """Every distinct fingerprint: ``fp``, ``root`` (a fingerprint that names its component) and
    ``component_id`` (the smallest id whose fingerprint is reachable)."""
    classes = cut(rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least")), "simhash-classes")
    found = connected_components(link(classes, radius))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    return rooted.join(least, rooted["root"] == least["r"]).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id`` of every row."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("fp")), "simhash-fps")
    groups = components(rows, "doc_id", "fp", radius).withColumnRenamed("fp", "group_fp").drop("root")
    return rows.join(groups, rows["fp"] == groups["group_fp"]).select("doc_id", "fp", "component_id")
