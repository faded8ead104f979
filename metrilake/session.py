"""Session helpers: the settings every job of this library relies on."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a job of this library expects.  They are all runtime SQL confs, so
# they can be applied to a session someone else built (``ensure_conf``).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a shuffle is cut finely and joined again to tasks of a few MB, so that a task's sorts, windows and
    # hash tables stay as large as they are however much data there is
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "960",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


def build_session(master: str | None = None, partitions: int = 8, app: str = "metrilake") -> SparkSession:
    """Local/test session. On a cluster the submitter's session is used instead."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.shuffle.partitions", str(partitions))
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          # a plan of many columns is built several times faster without a stack trace for each expression
          .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession, sub: str = "") -> str:
    """Folder shared by all executors for checkpoints and written tables.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (local tests) a fresh folder under the system temp dir is created and
    registered as the checkpoint dir.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # set by this function before
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jdir.get() if jdir.isDefined() else None
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="metrilake-")
        spark.sparkContext.setCheckpointDir(base)
    if sub:
        base = base.rstrip("/") + "/" + sub
    if base.startswith("/") or base.startswith("file:"):
        os.makedirs(base.replace("file:", ""), exist_ok=True)
    return base
