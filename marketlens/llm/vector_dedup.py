"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A vector is scaled to length one, padded to a power of two and rotated three times by random
signs and a Hadamard transform; the axis with the largest absolute coordinate, with its sign,
is one hash.  ``HASHES`` of them make a bucket key, and there are ``TABLES`` independent keys.
Each vector is stored in its own bucket of every table and also looks into ``PROBES`` more
buckets a table, those where one hash takes its second, third ... largest coordinate.  Every
candidate pair is verified by cosine in double precision, so a link below the threshold
never appears; measured recall is in the README.

Equal vectors (same group, same components) are one class from the start, counted with a
partial aggregate.  A bucket is cut into parts of about ``PART`` members by hash, pairs of parts
are dealt in batches of bounded size, so a bucket that holds a third of all vectors is many small tasks.  A
pair that meets in several buckets counts once, in the first table (and probe) where it meets.
Parts return one row per member with its number of links, and a spanning forest of links;
pairs are never emitted.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components,
and rows with a null group, link with nothing; vectors of different lengths never link;
repeated rows link with each other and come back each; null ids get null components unless
linked to an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.components import connected_components
from marketlens.llm.shared import cut
from marketlens.llm.simhash import forest

THRESHOLD = 0.98
TABLES = 5
HASHES = 2
PROBES = 2
PART = 512
BATCH = 20_000
STEP = 1 << 16  # pairs compared at once
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (length a power of two), scaled to keep lengths."""
    n, width, h = x.shape[0], x.shape[1], 1
    while h < width:
        pairs = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transform."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def bucket_keys(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Keys of unit vectors, (n, tables, 1 + probes): the own bucket first, then the probed ones.

    A probe changes the one hash whose next best coordinate loses least against its best.
    """
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.concatenate([x, np.zeros((n, width - d))], axis=1)
    out = np.empty((n, tables, 1 + probes), np.int64)
    ranks = min(width, probes + 1)
    for t in range(tables):
        codes, loss = [], []
        for k in range(hashes):
            y = rotated(x, seed + t * 101 + k)
            size = np.abs(y)
            best = np.argsort(-size, axis=1, kind="stable")[:, :ranks]
            codes.append(best * 2 + (np.take_along_axis(y, best, 1) < 0))
            top = np.take_along_axis(size, best, 1)
            loss.append(top[:, :1] - top[:, 1:])
        radix = [(2 * width) ** k for k in range(hashes)]
        own = sum(c[:, 0] * r for c, r in zip(codes, radix, strict=True))
        out[:, t, 0] = own
        swapped = np.concatenate([own[:, None] + (c[:, 1:] - c[:, :1]) * r for c, r in zip(codes, radix, strict=True)], axis=1)
        order = np.argsort(np.concatenate(loss, axis=1), axis=1, kind="stable")[:, :probes]
        out[:, t, 1 : 1 + order.shape[1]] = np.take_along_axis(swapped, order, 1)
        out[:, t, 1 + order.shape[1] :] = own[:, None]
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class id, vector as doubles and its keys."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = [np.asarray(v, np.float64) for v in batch["vec"].to_pylist()]
        keys = [None] * len(raw)
        for d in {len(v) for v in raw}:
            at = [i for i, v in enumerate(raw) if len(v) == d]
            for i, k in zip(at, bucket_keys(unit(np.stack([raw[i] for i in at]))), strict=True):
                keys[i] = k.reshape(-1)
        yield pa.RecordBatch.from_pydict({"node": batch["node"], "grp": batch["grp"], "n": batch["n"], "dim": [len(v) for v in raw],
                                          "vec": [_bytes(v) for v in raw], "keys": [k.tobytes() for k in keys], "slots": [k.tolist() for k in keys]},
                                         schema=pa.schema([("node", pa.int64()), ("grp", pa.string()), ("n", pa.int64()), ("dim", pa.int32()),
                                                           ("vec", pa.binary()), ("keys", pa.binary()), ("slots", pa.list_(pa.int64()))]))


def _bytes(v: np.ndarray) -> bytes:
    """Single precision where that loses nothing (half the bytes to shuffle), else double."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return single.tobytes() if np.array_equal(single.astype(np.float64), v) else v.tobytes()


def _vectors(column, dim: int) -> np.ndarray:
    return unit(np.stack([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64).astype(np.float64) for v in column]))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaling by the largest component first keeps extreme values finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pairs(looking: np.ndarray, stored: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with looking[i] == stored[j], for sorted bucket numbers, about STEP at a time."""
    lo, hi = np.searchsorted(stored, looking, "left"), np.searchsorted(stored, looking, "right")
    total = np.cumsum(hi - lo)
    at = 0
    while at < len(looking):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        n = (hi - lo)[at:end]
        i = np.repeat(np.arange(at, end), n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:end], n)
        at = end


def _compare(threshold: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Verified links of a batch of buckets: per node their number, and a spanning forest."""
        pdf = pdf.assign(home=pdf.groupby(["grp", "tab", "bucket", "lpart", "rpart"], sort=False).ngroup()).sort_values("home", kind="stable")
        left, right = pdf[~pdf["stored"]], pdf[pdf["stored"]]
        xs, ys = (_vectors(x["vec"], int(key[0])) if len(x) else np.zeros((0, 1)) for x in (left, right))
        kx, ky = (np.stack([np.frombuffer(v, np.int64).reshape(TABLES, 1 + PROBES) for v in x["keys"]]) if len(x) else None for x in (left, right))
        (nx, cx), (ny, cy) = ((x["node"].to_numpy(np.int64), x["n"].to_numpy(np.int64)) for x in (left, right))
        slot, table = left["slot"].to_numpy(), left["tab"].to_numpy()
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in _pairs(left["home"].to_numpy(), right["home"].to_numpy()):
            # Left members look (own bucket or probe), right members are stored.  Where both own buckets
            # are equal the pair is met from both sides; the side with the smaller node counts.
            some = (nx[i] != ny[j]) & ((slot[i] > 0) | (nx[i] < ny[j]))
            i, j = i[some], j[some]
            near = np.einsum("ij,ij->i", xs[i], ys[j]) >= threshold
            i, j = i[near], j[near]
            fresh = np.ones(len(i), bool)
            for t in range(TABLES):  # met in an earlier table
                a, b = kx[i, t], ky[j, t]
                fresh &= ~((t < table[i]) & ((a == b[:, :1]).any(1) | (a[:, :1] == b).any(1)))
            a, b = kx[i, table[i]], ky[j, table[i]]
            # In this table: equal own buckets come first, then the probe from the smaller node, then its first such probe.
            probing = slot[i] > 0
            fresh &= ~(probing & ((a[:, 0] == b[:, 0]) | ((nx[i] > ny[j]) & (b == a[:, :1]).any(1))))
            fresh &= ~probing | (np.argmax(a == b[:, :1], axis=1) == slot[i])
            ends.append((i[fresh], j[fresh]))
        i, j = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.zeros(0, np.int64),) * 2
        nodes, at = np.unique(np.concatenate([nx[i], ny[j]]), return_inverse=True)
        links = np.bincount(at, weights=np.concatenate([cy[j], cx[i]]), minlength=len(nodes)).astype(np.int64)
        a, b = forest(nx, ny, iter([(i, j)]))
        return pd.DataFrame({"node": np.concatenate([nodes, np.full(len(a), -1)]), "links": np.concatenate([links, np.zeros(len(a), np.int64)]),
                             "a": np.concatenate([np.full(len(nodes), -1), a]), "b": np.concatenate([np.full(len(nodes), -1), b])}).astype("int64")
    return run


def near_duplicates(vectors: DataFrame, id_col: str, vector_col: str, group_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row, comparing within equal groups."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(group_col).cast("string").alias("grp"), doubles.alias("vec"))
    finite = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)), F.lit(False))
    usable = F.col("grp").isNotNull() & finite & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one component value
    same = F.transform("vec", lambda x: x + F.lit(0.0))
    rows = rows.select("vec_id", F.when(usable, F.col("grp")).alias("grp"), F.when(usable, same).alias("vec"))
    named = rows.withColumn("v", F.when(F.col("vec").isNotNull(), F.sha2(F.array_join(F.transform("vec", lambda x: x.cast("string")), ",").cast("binary"), 256)))
    classes = named.filter("v is not null").groupBy("grp", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "vec-classes")
    units = cut(classes.select("node", "grp", "n", "vec").mapInArrow(
        _units, "node bigint, grp string, n bigint, dim int, vec binary, keys binary, slots array<bigint>"), "vec-keys")
    slots = 1 + PROBES
    looks = units.select("node", "grp", "dim", F.posexplode("slots").alias("at", "bucket")).withColumns(
        {"tab": F.floor(F.col("at") / slots).cast("int"), "slot": F.pmod("at", F.lit(slots)).cast("int")})
    home = ["grp", "dim", "tab", "bucket"]
    stored = F.count(F.when(F.col("slot") == 0, 1))
    # Only buckets that somebody is stored in and somebody else looks into go on.
    sizes = looks.groupBy(*home).agg(stored.alias("n_stored"), F.count(F.lit(1)).alias("n_looks")).filter("n_stored > 0 and n_looks > 1")
    sizes = cut(sizes.withColumns({"lparts": F.ceil(F.col("n_looks") / F.lit(PART)).cast("int"), "rparts": F.ceil(F.col("n_stored") / F.lit(PART)).cast("int")}), "vec-buckets")
    alive = looks.join(sizes.drop("n_stored", "n_looks"), home).join(units.select("node", "n", "vec", "keys"), "node")
    part = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    # A bucket is compared as lparts x rparts pairs of parts; each side is sent once per part of the other.
    left = alive.withColumn("lpart", part("lparts")).withColumn("rpart", every("rparts"))
    right = alive.filter("slot = 0").withColumn("rpart", part("rparts")).withColumn("lpart", every("lparts"))
    by = [*home, "lpart", "rpart"]
    cols = ["node", "n", "vec", "keys", "slot", *by]
    both = left.select(*cols, F.lit(False).alias("stored")).unionByName(right.select(*cols, F.lit(True).alias("stored")))
    # Buckets are small: many of them, by hash, make one batch of about BATCH rows.
    rows = sizes.agg(F.coalesce(F.sum(F.col("n_looks") * F.col("rparts") + F.col("n_stored") * F.col("lparts")), F.lit(0))).first()[0]
    batch = F.pmod(F.xxhash64(*by), F.lit(max(1, rows // BATCH))).alias("batch")
    met = both.withColumn("batch", batch).groupBy("dim", "batch").applyInPandas(_compare(threshold), "node bigint, links bigint, a bigint, b bigint")
    met = cut(met, "vec-links")
    counted = met.filter("node >= 0").groupBy(F.col("node").alias("c_node")).agg(F.sum("links").alias("links"))
    found = connected_components(met.filter("a >= 0").select("a", "b"))
    rooted = classes.select("node", "grp", "v", "least", "n").join(found.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node"), "left")
    rooted = rooted.select("node", F.col("grp").alias("k_grp"), F.col("v").alias("k_v"), "least", "n", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    whole = rooted.join(least, rooted["root"] == least["r"]).join(counted, rooted["node"] == counted["c_node"], "left").select(
        "k_grp", "k_v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    joined = named.select("vec_id", "grp", "v").join(whole, (F.col("grp") == F.col("k_grp")) & (F.col("v") == F.col("k_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                         (F.col("vec_id") == component).alias("kept"))
