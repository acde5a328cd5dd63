"""SparkSession helpers.

The library never hard-codes a machine-local scratch folder: lineage is cut
with ``DataFrame.checkpoint()`` under the folder the cluster names in
``spark.checkpoint.dir``. Only when that setting is unset (local tests) do we
pick a fresh folder under the system temp dir.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # one diff is one row: keep scan splits small so a few huge diffs do not
    # land in the same task
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    # Broadcast only on measured sizes: the static planner's estimates come from
    # compressed parquet sizes and miss how much diff text a derived side holds,
    # so static broadcasting is off; AQE converts a join to broadcast when the
    # materialized shuffle side really is below the threshold.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(16 * 1024 * 1024),
}

LOCAL_CONF = {
    # local mode runs everything in the driver JVM
    "spark.driver.memory": "8g",
    # with no remote executors, a distributed file-listing job is pure overhead
    # (clusters keep the default and list large folders in parallel)
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "100000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "hunkline") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            for k, v in LOCAL_CONF.items():
                builder = builder.config(k, v)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder from ``spark.checkpoint.dir``.

    Only a ``local[...]`` session without that setting (tests) gets a fresh
    temporary folder; on a cluster the setting is required."""
    conf = spark.sparkContext.getConf()
    d = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():  # type: ignore[union-attr]
            spark.sparkContext.setCheckpointDir(d)
        return d
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()  # type: ignore[union-attr]
    if not existing.isEmpty():
        return existing.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                           "(a machine-local temporary folder does not survive a lost executor)")
    d = tempfile.mkdtemp(prefix="hunkline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(d)
    return d
