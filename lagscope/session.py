"""Session defaults and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
ROWS_PER_TASK = 500_000


def build_session(app: str = "lagscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` out and set the number of shuffle partitions there;
    adaptive execution coalesces small ones and splits skewed join partitions.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int | None:
    """Tasks for a shuffle of so many rows, where the session's shuffle partitions would get more than
    ``rows_per_task`` each; else none. What a task sorts then stays the same size when the input
    grows and the setting does not."""
    tasks = -(-rows // rows_per_task)
    return tasks if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def working_dir(spark: SparkSession, purpose: str) -> str:
    """A new path below the folder the cluster shares between its machines.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (local
    runs and tests) a temporary folder is made and set as the checkpoint folder.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="lagscope-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex}")


def store(df: DataFrame, purpose: str) -> DataFrame:
    """Write a result that several branches read to the shared folder, and read it from there.

    The branches then read only the columns they need, and a lost executor costs no more than
    re-reading a file.
    """
    path = working_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
