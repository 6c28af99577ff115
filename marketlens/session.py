"""Session helpers: a local session for tests and benches, and lineage cuts.

Library code never creates a session; it takes the caller's.  Lineage is cut by
writing a parquet table under the cluster's ``spark.checkpoint.dir`` and reading
it back, so a lost executor recomputes from that table instead of re-running the
upstream plan (and, for range partitioning, instead of re-sampling borders).
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
ROWS_A_TASK = 250_000  # rows of a task that holds them, or their groups, in memory


def local_session(
    cpus: int | str = "*",
    shuffle_partitions: int = 8,
    app: str = "marketlens",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A ``local[cpus]`` session configured the way the tests and bench expect.

    A private checkpoint folder is made only here (local mode, where one machine
    is the whole cluster); cluster jobs must bring their own shared folder.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, read from the session.

    Order: ``spark.checkpoint.dir`` conf, then the context's checkpoint dir.  Only
    a local master may fall back to a fresh temporary folder (as in tests); on a
    cluster a machine-local folder would be invisible to other executors, so we
    refuse instead.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    try:
        context = spark.sparkContext  # not available on a Spark Connect session
    except Exception:  # noqa: BLE001
        context = None
    if not root and context is not None:
        root = context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = (context.master if context is not None else "") or ""
    if not master.startswith("local"):
        raise RuntimeError(
            f"set {CHECKPOINT_CONF} to a folder shared by all executors "
            "(e.g. on HDFS/S3) before running ranked reports on a cluster"
        )
    root = tempfile.mkdtemp(prefix="marketlens-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, root)
    context.setCheckpointDir(root)
    return root


# Folders lists of the scratch blocks in effect; a ContextVar, so work submitted
# to helper threads with the caller's context is recorded too.
_SCRATCH: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("marketlens_scratch", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete the folders materialised inside the block when it ends.

    DataFrames built inside read those folders lazily: write or collect what you
    need before leaving the block.  Without this context the folders stay (the
    caller's storage lifecycle removes them).
    """
    written: list[str] = []
    token = _SCRATCH.set(_SCRATCH.get() + (written,))
    try:
        yield written
    finally:
        _SCRATCH.reset(token)
        delete_folders(spark, written)


@contextlib.contextmanager
def recording():
    """The list of folders materialised inside the block; nothing is deleted."""
    written: list[str] = []
    token = _SCRATCH.set(_SCRATCH.get() + (written,))
    try:
        yield written
    finally:
        _SCRATCH.reset(token)


def delete_folders(spark: SparkSession, folders) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in folders:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def remember(path: str) -> None:
    """Have the scratch blocks in effect delete ``path`` when they end."""
    for written in _SCRATCH.get():
        written.append(path)


def materialize(df: DataFrame, label: str, count: bool = False) -> DataFrame | tuple[DataFrame, int]:
    """Write ``df`` once as parquet under the checkpoint root and read it back.

    One computation (unlike ``checkpoint()`` without a cache), survives executor
    loss, and freezes any non-deterministic partition assignment such as the
    borders sampled by ``repartitionByRange``.  With ``count=True`` the row count
    is observed during the same write (no second job) and returned as well.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    remember(path)
    if count:
        obs = Observation(f"rows-{uuid.uuid4().hex}")
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path), int(obs.get["rows"])
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def tasks_for(rows: int) -> int:
    """So many tasks that each gets about ``ROWS_A_TASK`` of the rows."""
    return max(1, -(-rows // ROWS_A_TASK))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over tasks whose number grows with its ``rows``, so that the memory of one task does not.

    The number is given outright: neither the files' splits nor AQE, which merges partitions by
    their compressed bytes, bound the rows of a task.  Rows are dealt before they are aggregated or multiplied.
    """
    return df.repartition(tasks_for(rows), *keys)
