"""Report sink (S9) and retention.

Reports are appended as Parquet partitioned by ``run_date`` and keyed by
``job_id``; reading one back is a partition-pruned, filter-pushed scan.
Retention splits a reports table into kept and expired rows by completion
time (re-aimed: Spark decides which rows expire; no file deletion here).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(report: DataFrame, path: str, job_id: str,
                 completed_at: dt.datetime | None = None) -> None:
    """Append a report (any DataFrame, typically the one-row nested report)."""
    ts = completed_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    (report.withColumn("job_id", F.lit(job_id))
     .withColumn("completed_at", F.lit(ts).cast("timestamp_ntz"))
     .withColumn("run_date", F.to_date(F.col("completed_at")))
     .write.mode("append").partitionBy("run_date").parquet(path))


def read_report(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """Fetch one job's stored report."""
    return spark.read.parquet(path).where(F.col("job_id") == job_id)


def retention(reports: DataFrame, days_to_keep: int = 7, now: dt.datetime | None = None,
              ts_col: str = "completed_at", day_col: str = "run_date") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(kept, expired, counts)`` where a row expires when its completion
    time is before ``now - days_to_keep``; ``counts`` is one row
    ``kept_count, expired_count``.

    Where the store is partitioned by ``day_col``, both sides also carry a filter on it: whole days
    are told by their folder, and only the day of the cutoff by its rows.  Rows without a time stay."""
    now = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    limit = now - dt.timedelta(days=days_to_keep)
    old = F.coalesce(F.col(ts_col).cast("timestamp_ntz") < F.lit(limit).cast("timestamp_ntz"), F.lit(False))
    kept, expired = reports.where(~old), reports.where(old)
    if day_col in reports.columns:
        day = F.lit(limit.date())
        kept = kept.where(F.col(day_col).isNull() | (F.col(day_col) >= day))
        expired = expired.where(F.col(day_col) <= day)
    counts = reports.agg(F.count(F.when(~old, 1)).cast("long").alias("kept_count"),
                         F.count(F.when(old, 1)).cast("long").alias("expired_count"))
    return kept, expired, counts


def store(rows: DataFrame, path: str, ts_col: str = "completed_at", day_col: str = "run_date") -> None:
    """Write rows to a store partitioned by the day of ``ts_col``; days that are written again are
    replaced, others stay (dynamic partition overwrite)."""
    (rows.withColumn(day_col, F.to_date(F.col(ts_col)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path))
