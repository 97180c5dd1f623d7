"""Session helpers for tests, bench and scripts (library code never builds a session)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "dfprofile") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    (local tests) create a fresh scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="dfprofile-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


ROWS_PER_PARTITION = 1_000_000


def right_size(df: DataFrame, rows_hint: int | None) -> DataFrame:
    """Coalesce a small shuffle output before caching it: AQE does not
    re-coalesce a cached plan's output, so a tiny table would otherwise keep
    ``spark.sql.shuffle.partitions`` partitions and every later pass would run
    that many near-empty tasks.  Coalesce only ever reduces, so large inputs
    (hint above partitions x 1M rows) keep the configured parallelism."""
    if not rows_hint:
        return df
    spark = df.sparkSession
    try:
        configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # noqa: BLE001
        return df
    floor = spark.sparkContext.defaultParallelism
    target = max(floor, -(-rows_hint // ROWS_PER_PARTITION))
    return df.coalesce(target) if target < configured else df


def materialize(df: DataFrame, mode: str = "persist", rows_hint: int | None = None) -> DataFrame:
    """Reuse an intermediate across several jobs.

    ``persist``: memory+disk cache; lost blocks are recomputed from lineage.
    ``checkpoint``: written to the shared checkpoint dir, cutting lineage.
    ``rows_hint`` (an upper bound of the row count) right-sizes partitions.
    """
    df = right_size(df, rows_hint)
    if mode == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if mode == "persist":
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df
