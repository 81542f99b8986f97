"""Session settings the library relies on, and where jobs may keep shared files."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Settings that change results. They are runtime settings, so `configure` can
# apply them to a session somebody else built.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A journal record may repeat a field; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings that change speed only: re-planning by measured sizes, splitting of
# skewed join partitions, even where the split costs one more shuffle.
SPEED_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Windows and joins here turn few shuffled bytes into many rows; do not pack
    # small shuffles into fewer tasks than there are cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
    # A task keeps the rows of ORDER BY ... LIMIT n in memory only up to this n.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session.

    The library's functions are sent along with the jobs, so that executors
    need not have it installed.
    """
    cloudpickle.register_pickle_by_value(sys.modules["timelens"])
    for key, value in {**RESULT_SETTINGS, **SPEED_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "timelens", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, where one machine is the whole cluster, may go
    without the setting; it gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="timelens-")
