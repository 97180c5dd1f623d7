"""Trend analysis (T1; advertised by the reference, implemented here with our
own semantics over a timestamp and a value column).

* ``trend_series``: per time bucket (``unit`` of ``date_trunc``, days by default), count and mean value,
  plus a moving average over the last ``window`` buckets.  The window runs over
  the aggregated bucket series (one row per bucket), never over data rows.
* ``trend_fit``: least-squares slope / intercept / r^2 of the bucket means on
  the bucket index (days since the first bucket) — one aggregate.
* ``trend_acf``: autocorrelation of the daily means over a calendar without gaps, and the
  lag at which they repeat best.
* ``trend_sweep``: fit and period of every numeric column against every time column.
* ``seasonality``: mean value by hour of day and by weekday (0 = Monday).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qcol, rnd


UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute")


def _bucket(ts: str, unit: str):
    """The time's bucket: a date for days and longer units, else a timestamp."""
    if unit not in UNITS:
        raise ValueError(f"Unknown time unit: {unit}")
    t = F.date_trunc(unit, qcol(ts).cast("timestamp"))
    return t if unit in ("hour", "minute") else t.cast("date")


def _buckets(df: DataFrame, ts: str, value: str, unit: str = "day") -> DataFrame:
    return (df.where(qcol(ts).isNotNull())
            .groupBy(_bucket(ts, unit).alias("bucket"))
            .agg(F.count(F.lit(1)).cast("long").alias("n"),
                 F.avg(F.nanvl(qcol(value).cast("double"), F.lit(None).cast("double")))
                 .alias("mean_value")))


def trend_series(df: DataFrame, ts: str, value: str, window: int = 7, d: int = 4,
                 unit: str = "day") -> DataFrame:
    """``bucket, n, mean_value, moving_avg`` per ``unit`` (a date; a timestamp below days)."""
    b = _buckets(df, ts, value, unit)
    w = Window.orderBy("bucket").rowsBetween(-(window - 1), Window.currentRow)
    return b.select("bucket", "n", rnd(F.col("mean_value"), d).alias("mean_value"),
                    rnd(F.avg("mean_value").over(w), d).alias("moving_avg"))


def trend_fit(df: DataFrame, ts: str, value: str, d: int = 6) -> DataFrame:
    """``buckets, slope, intercept, r2, direction`` of daily means vs day index."""
    b = _buckets(df, ts, value)
    x, y = F.unix_date("bucket").cast("double"), F.col("mean_value")
    # regression on the calendar day; the intercept then moves to the first day
    fit = b.agg(F.count(F.lit(1)).cast("long").alias("buckets"), F.min(F.unix_date("bucket")).alias("_first"),
                F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("_at0"),
                F.regr_r2(y, x).alias("r2"))
    fit = fit.withColumn("intercept", F.col("_at0") + F.col("slope") * F.col("_first"))
    return fit.select("buckets", rnd(F.col("slope"), d).alias("slope"),
                      rnd(F.col("intercept"), d).alias("intercept"), rnd(F.col("r2"), d).alias("r2"),
                      F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing")
                      .otherwise("flat").alias("direction"))


def seasonality(df: DataFrame, ts: str, value: str, d: int = 4) -> DataFrame:
    """``period ('hour' | 'weekday'), slot, n, mean_value`` in one grouping-sets
    aggregate (both periods from a single scan)."""
    v = F.nanvl(qcol(value).cast("double"), F.lit(None).cast("double"))
    base = df.where(qcol(ts).isNotNull()).select(
        F.hour(qcol(ts)).alias("hour"), F.weekday(qcol(ts)).alias("weekday"), v.alias("v"))
    g = base.cube("hour", "weekday").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                         F.avg("v").alias("mean_value"),
                                         F.grouping_id().alias("_g"))
    # grouping_id: 1 -> grouped by hour only, 2 -> by weekday only.
    g = g.where(F.col("_g").isin(1, 2))
    return g.select(F.when(F.col("_g") == 1, "hour").otherwise("weekday").alias("period"),
                    F.when(F.col("_g") == 1, F.col("hour")).otherwise(F.col("weekday")).alias("slot"),
                    "n", rnd(F.col("mean_value"), d).alias("mean_value"))


def _acf(daily: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """``keys, lag, n, acf`` of ``(keys, bucket DATE, mean_value)``: days without a value sit at the
    series' mean.  Windows run over calendar days, one row a day and series."""
    span = daily.groupBy(*keys).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"),
                                    F.avg("mean_value").alias("_mean"))
    spine = span.select(*keys, "_mean", F.explode(F.sequence("_lo", "_hi")).alias("bucket"))
    dev = spine.join(daily, [*keys, "bucket"], "left").select(
        *keys, "bucket", F.coalesce(F.col("mean_value") - F.col("_mean"), F.lit(0.0)).alias("y"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    lags = range(1, max_lag + 1)
    wide = dev.select(*keys, "y", *[F.lead("y", k).over(w).alias(f"_{k}") for k in lags])
    sums = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("ss"),
                                   *[F.sum(F.col("y") * F.col(f"_{k}")).alias(f"s{k}") for k in lags])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{k}").alias("s")) for k in lags]))
    return sums.where(F.col("ss") > 0).select(*keys, "n", "ss", rows.alias("r")).where(
        F.col("r.lag") < F.col("n")).select(*keys, F.col("r.lag").alias("lag"), "n", (F.col("r.s") / F.col("ss")).alias("acf"))


def _best_lag(acf: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, period``: the lag (2 or more) of the highest autocorrelation beyond 2 / sqrt(n), the
    shorter of equal ones; no row where none is."""
    strong = acf.where((F.col("lag") > 1) & (F.col("acf") > 2 / F.sqrt("n")))
    return strong.groupBy(*keys).agg(F.min_by("lag", F.struct(-F.col("acf"), F.col("lag"))).alias("period"))


def trend_acf(df: DataFrame, ts: str, value: str, max_lag: int = 30, d: int = 4) -> DataFrame:
    """``lag, acf, is_period`` of the daily means, days without rows filled in."""
    daily = _buckets(df, ts, value).where(F.col("mean_value").isNotNull()).withColumn("_one", F.lit(1))
    acf = _acf(daily.select("_one", "bucket", "mean_value"), ["_one"], max_lag)
    best = _best_lag(acf, ["_one"])
    return acf.join(F.broadcast(best), "_one", "left").select(
        "lag", rnd(F.col("acf"), d).alias("acf"), F.coalesce(F.col("lag") == F.col("period"), F.lit(False)).alias("is_period"))


def trend_sweep(df: DataFrame, times: list[str], values: list[str], max_lag: int = 30, d: int = 6) -> DataFrame:
    """``time_column, column_name, buckets, slope, r2, direction, period`` of the daily means of every
    numeric column by every time column; one scan, a row per day, time and value column."""
    number = [F.struct(F.lit(v).alias("column_name"), F.nanvl(qcol(v).cast("double"), F.lit(None).cast("double")).alias("v"))
              for v in values]
    when = [F.struct(F.lit(t).alias("time_column"), qcol(t).cast("date").alias("bucket")) for t in times]
    long = df.select(F.explode(F.array(*when)).alias("t"), F.array(*number).alias("vs")).where("t.bucket is not null")
    long = long.select("t.*", F.explode("vs").alias("x")).select("time_column", "bucket", "x.*").where("v is not null")
    keys = ["time_column", "column_name"]
    daily = long.groupBy(*keys, "bucket").agg(F.avg("v").alias("mean_value"))
    x, y = F.unix_date("bucket").cast("double"), F.col("mean_value")
    fit = daily.groupBy(*keys).agg(F.count(F.lit(1)).alias("buckets"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"))
    period = _best_lag(_acf(daily, keys, max_lag), keys)
    return fit.join(F.broadcast(period), keys, "left").select(
        *keys, "buckets", rnd(F.col("slope"), d).alias("slope"), rnd(F.col("r2"), d).alias("r2"),
        F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat").alias("direction"),
        "period")
