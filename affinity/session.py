"""Spark session helpers.

Cluster jobs get their session (and their shared checkpoint folder) from
the cluster. ``build_session`` is for tests, the bench and local runs: it
only fills in settings that are still unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Spark's setting that removes the shuffle files of a query when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: What a row of a compact Parquet file takes in a broadcast table, as a multiple of its bytes in the file. Without it a
#: file just below the broadcast threshold (a million keys and names in 6 MB) is built in the driver's memory, once a join.
FILE_FACTOR = ("spark.sql.sources.fileCompressionFactor", "16")


def size_files_as_rows(spark: SparkSession) -> None:
    """Let the planner size Parquet files by the rows they hold; a setting of the session's own stays."""
    key, factor = FILE_FACTOR
    if float(spark.conf.get(key)) == 1.0:
        spark.conf.set(key, factor)


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "affinity", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("AFFINITY_DRIVER_MEMORY", "12g"))
    if extra:
        conf.update(extra)
    if (master or "").startswith("local") and not master.startswith("local-cluster") \
            and "spark.checkpoint.dir" not in conf and not _active_conf("spark.checkpoint.dir"):
        # a local master by name only: a fresh scratch folder per session
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="affinity-ckpt-", dir="/tmp")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local master without it (tests,
    local runs) gets a scratch folder; on a cluster a driver-local folder would be
    invisible to the executors, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="affinity-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def _active_conf(key: str):
    active = SparkSession.getActiveSession()
    if active is None:
        return None
    return active.sparkContext.getConf().get(key, None)


def stage(df, name: str = "table"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the frame once (a reliable
    RDD checkpoint recomputes it for the write) and the files survive
    executor loss. Use for small-to-medium tables read many times. The shuffle
    files of the write go when it ends: nothing reads them any more.
    """
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def store_bucketed(df, name: str, by: str, buckets: int, sort_by: tuple[str, ...] = ()):
    """Write ``df`` as a table bucketed by ``by`` under the shared checkpoint folder.

    Readers that group, window or join on ``by`` (or on keys that include it)
    find the rows already hash-partitioned and skip the shuffle; the table has
    ``buckets`` parallel splits whatever the layout of its inputs.
    """
    import uuid

    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{table}"
    # rows meet their bucket before the write, so each bucket is one file
    writer = df.repartition(buckets, by).write.bucketBy(buckets, by)
    if sort_by:
        writer = writer.sortBy(*sort_by)
    writer.option("path", path).saveAsTable(table)
    return spark.table(table)
