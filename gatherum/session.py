"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "gatherum", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and Arrow on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session.

    The cluster's own ``spark.checkpoint.dir`` wins. A folder is invented only for a local
    master, where driver and executors share one disk; elsewhere a machine-local folder
    would lose the data with the executor, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="gatherum-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    own = os.path.join(folder, "checkpoints")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it was made.

    Used wherever a table is read more than once or a loop would grow the plan; survives the
    loss of executors because the rows are on shared storage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scopes = threading.local()


@contextmanager
def scratch():
    """Frees, on leaving, every table that :func:`keep` cached inside. Cut the result first."""
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for df in reversed(stack.pop()):
            df.unpersist()


def keep(df: DataFrame) -> DataFrame:
    """Cache a table that is read more than once, filled by the first action that reads it.

    Costs no job of its own, and a lost executor's part is computed again from the lineage.
    Loops must :func:`cut` every few rounds, or that lineage grows without end.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    stack = _scopes.__dict__.get("stack")
    if stack:
        stack[-1].append(df)
    return df


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """Stored, and dealt over all cores when the source came in fewer pieces than there are cores."""
    return cut(fan_out(df, key))


def fan_out(df: DataFrame, key: str = "id") -> DataFrame:
    """Dealt over all cores if the source is too small to be read in as many pieces.

    Goes by the planner's estimate of the source, so nothing runs to find out.
    """
    spark = df.sparkSession
    cores = parallelism(spark)
    piece = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b") or 1 << 27)
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < cores * piece else df


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
