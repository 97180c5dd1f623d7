"""Trends over calendars with gaps, the trend section, and retention by partition."""

import datetime as dt

import numpy as np
import pytest

from dfprofile.operators.outliers import detect_outliers
from dfprofile.operators.trend import trend_acf, trend_series, trend_sweep
from dfprofile.plans.report import profile
from dfprofile.sources.sink import retention, store


def _weekly(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(day + dt.timedelta(days=i, hours=h), float(10 * (i % 7 == 2) + i * 0.01), float(-i), i) for i in range(140)
            if i % 11 for h in (1, 9)] + [(None, 5.0, 1.0, 1)]
    return spark.createDataFrame(rows, "at timestamp_ntz, v double, w double, k int")


def test_acf_finds_the_week_over_gaps(spark):
    got = {r.lag: r for r in trend_acf(_weekly(spark), "at", "v", 20).collect()}
    assert [k for k, r in got.items() if r.is_period] == [7]
    y = np.full(140, np.nan)
    for i in range(140):
        if i % 11:
            y[i] = 10 * (i % 7 == 2) + i * 0.01
    lo = 1
    y = y[lo:]
    y = np.where(np.isnan(y), np.nanmean(y), y) - np.nanmean(y)
    assert abs(got[3].acf - (y[:-3] * y[3:]).sum() / (y * y).sum()) < 1e-4
    assert trend_acf(_weekly(spark).where("false"), "at", "v").count() == 0


def test_units_and_sweep(spark):
    df = _weekly(spark)
    weeks = trend_series(df, "at", "v", unit="week").collect()
    assert len(weeks) == 20 and weeks[0].bucket == dt.date(2024, 1, 1)
    assert trend_series(df, "at", "v", unit="hour").count() == 254
    with pytest.raises(ValueError):
        trend_series(df, "at", "v", unit="fortnight")
    got = {r.column_name: r for r in trend_sweep(df, ["at"], ["v", "w"]).collect()}
    assert got["v"].period == 7 and got["w"].direction == "decreasing" and got["w"].slope == -1.0
    p = profile(df, analyses=["trend"])
    row = p.report("t").collect()[0]
    assert {r.column_name for r in row.trend_analysis} == {"v", "w", "k"} and "outlier_analysis" not in row.asDict()
    p.release()


def test_retention_reads_only_days_it_needs(spark, tmp_path):
    now = dt.datetime(2024, 3, 10, 12)
    rows = [(f"job{i}", now - dt.timedelta(hours=7 * i)) for i in range(60)] + [("open", None)]
    store(spark.createDataFrame(rows, "job_id string, completed_at timestamp_ntz"), str(tmp_path / "s"))
    again = spark.createDataFrame([("only", now)], "job_id string, completed_at timestamp_ntz")
    kept, expired, counts = retention(spark.read.parquet(str(tmp_path / "s")), now=now)
    c = counts.first()
    assert (kept.count(), expired.count()) == (c.kept_count, c.expired_count) == (26, 35)
    for side in (kept, expired):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "run_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    store(again, str(tmp_path / "s"))  # replaces that day alone
    left = spark.read.parquet(str(tmp_path / "s"))
    assert left.where("run_date = '2024-03-10'").count() == 1 and left.count() == 61 - 2 + 1


def test_isolation_forest_flags_rows_of_a_frequent_value(spark):
    rows = [(i, 1000.0 if i % 20 == 0 else float(i % 10)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, x double")
    r = detect_outliers(df, ["x"], "isolation_forest", row_key="id").first()
    # both ends of the range: 1000 and 0, a tenth of all rows
    assert r.outlier_count == 400 and r.outlier_keys == list(range(0, 1000, 10))
