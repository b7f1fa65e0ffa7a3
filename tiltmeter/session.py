"""Session factory and the few session-level helpers the operators share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app_name: str = "tiltmeter", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the operators are tuned for.

    ``master`` is left to spark-submit on a cluster; tests pass ``local[n]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.bindAddress", "127.0.0.1")
        builder = builder.config("spark.driver.host", "127.0.0.1")
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Long expressions are built from Python; recording a call site for each part doubles the time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where none is named (tests)."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(named)
    return named


def spread(df, *keys):
    """Repartition a source read as fewer splits than there are cores; larger sources stay as they are.

    Meant for narrow rows right before they are multiplied. Looks at the plan only and runs no job.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)


def settle(df):
    """Compute a table once and keep it in the shared checkpoint folder, where a lost executor cannot take it.

    For results that are much smaller than what they were computed from and are read more than once.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
