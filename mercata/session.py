"""Spark session defaults for the marketplace reports.

Library code never builds a session itself: every report takes DataFrames
from the caller.  ``get_session`` is a convenience for tests, the bench and
local runs; on a cluster the session (and its ``spark.checkpoint.dir``) comes
from the platform, and :func:`checkpoint_dir` only reads it.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every run of the reports relies on.  ANSI mode is on by default
# in Spark 4 and stays on: bad casts and division by zero must fail loudly.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Dimension joins are broadcast only when the *measured* runtime size is
    # below this bound (AQE re-plans sort-merge joins into broadcast joins);
    # anything larger keeps the shuffled join.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.ansi.enabled": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(
    app: str = "mercata",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    ``spark.checkpoint.dir`` is set to a fresh local folder only when the
    caller did not provide one, which is the local/test case.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark, create_if_unset=True)
    return spark


def checkpoint_dir(spark: SparkSession, create_if_unset: bool = False) -> str | None:
    """The reliable checkpoint folder the session names, if any.

    Reads ``SparkContext.getCheckpointDir()`` and ``spark.checkpoint.dir``.
    Only when both are unset, ``create_if_unset`` is true and the master is
    local (tests, local runs) a new temporary folder is created and
    registered -- never on a cluster, where a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if create_if_unset and sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mercata-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
        return sc.getCheckpointDir()
    return None
