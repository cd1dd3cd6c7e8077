"""Session helpers: local sessions for tests/bench and the checkpoint folder.

On a cluster the session is created by the platform; the library only reads
its settings.  ``checkpoint_dir`` honours ``spark.checkpoint.dir`` and only
falls back to a fresh temporary folder when nothing is configured (local
tests), as a machine-local folder is not shared between executors.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a stored table of known size that a task writes at least.
ROWS_PER_TASK = 50_000
#: Paths of the tables that were stored in the open :func:`temporary_tables` blocks, the innermost last.
_open_blocks: list[list[str]] = []


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "wordloom", extra: dict | None = None) -> SparkSession:
    from .functions.blas import pin_environment
    pin_environment()
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Runtime (measured-size) broadcast limit for a single 32 GB node.
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold",
                os.environ.get("WORDLOOM_BROADCAST_LIMIT", "64MB"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WORDLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring it only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="wordloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def tasks_for(rows: int, per_task: int = ROWS_PER_TASK) -> int:
    """Tasks for so many rows: one that holds few rows costs more than its work."""
    return max(1, -(-rows // per_task))


@contextmanager
def temporary_tables(spark: SparkSession):
    """Tables that :func:`materialize` stores within the block are deleted at its end, but those it is told to keep."""
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield
    finally:
        _open_blocks.remove(made)
        for path in made:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, *, rows: int | None = None, keep: bool = False) -> DataFrame:
    """Cut lineage by writing a Parquet table into the shared checkpoint folder.

    Used where a plan must be read twice with identical values (dense ids),
    so a lost executor cannot make the two reads disagree.  One write job
    computes the plan once (``Dataset.checkpoint`` without a cache would run
    it twice); the read-back is a plain file scan.  With ``rows`` (their number
    or a bound of it) a small table is written by few tasks.  ``keep``: the
    table outlives the :func:`temporary_tables` block it is stored in.
    """
    base = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/wordloom-{uuid.uuid4().hex}"
    for block in _open_blocks[:-1][-1:] if keep else _open_blocks[-1:]:
        block.append(path)
    if rows is not None:
        df = df.coalesce(tasks_for(rows))
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)
