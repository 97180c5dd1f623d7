"""Outlier detection (O1-O3, O5, O6; O4 in ``iforest.py``).

Counts come from the persisted frequency table joined with k rows of fences
(broadcast, size = number of columns).  Outlier keys re-read the raw rows once,
keep flagged rows only and take the first ``max_outlier_keys`` per column with
``row_number() <= k`` (a bounded group limit before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import numeric_columns, qcol, rnd
from .freq import unpivot_pairs
from .numeric import NumericProfile

METHODS = ("iqr", "zscore", "isolation_forest")


def _bounds(p: NumericProfile, method: str, cfg: ProfileConfig) -> DataFrame:
    """``(column_name, n, mean, std_pop, lower, upper)`` per column."""
    s = p.summary()
    iqr = F.col("q3") - F.col("q1")
    t = F.lit(cfg.outlier_threshold)
    return s.select("column_name", "n", "mean", "std_pop",
                    (F.col("q1") - t * iqr).alias("lower"),
                    (F.col("q3") + t * iqr).alias("upper"))


def _flag(method: str, cfg: ProfileConfig, value: Column) -> Column:
    if method == "iqr":
        return (value < F.col("lower")) | (value > F.col("upper"))
    if method == "zscore":
        # Population standard deviation (ddof = 0); a zero spread flags nothing.
        z = F.abs(value - F.col("mean")) / F.col("std_pop")
        return (F.col("std_pop") > 0) & (z > F.lit(cfg.zscore_threshold))
    raise ValueError(f"outlier method {method!r} is none of {METHODS}")


def detect_outliers(df: DataFrame, columns: list[str] | None = None, method: str | None = None,
                    row_key: str | Column | None = None, config: ProfileConfig = DEFAULT,
                    profile: NumericProfile | None = None, with_keys: bool = True
                    ) -> DataFrame:
    """O1: ``column_name, method, outlier_count, outlier_percentage (2 dp of the
    non-null count), outlier_keys ARRAY<BIGINT>`` (first 100 keys in key order).

    ``row_key`` orders rows (Spark has no row order); without one the scan
    position (``monotonically_increasing_id``) stands in for the pandas index.
    """
    method = (method or config.outlier_method).lower()
    if method == "isolation_forest":
        from .iforest import isolation_forest_outliers
        return isolation_forest_outliers(df, columns, row_key, config, with_keys=with_keys)
    if method not in METHODS:
        raise ValueError(f"outlier method {method!r} is none of {METHODS}")
    cols = columns or numeric_columns(df)
    p = profile or NumericProfile(df, cols, config)
    b = F.broadcast(_bounds(p, method, config))
    counts = (p.freq().join(b, "column_name")
              .groupBy("column_name")
              .agg(F.sum(F.when(_flag(method, config, F.col("value")), F.col("cnt"))
                         .otherwise(0)).cast("long").alias("outlier_count")))
    base = (p.summary().select("column_name", "n")
            .join(counts, "column_name", "left")
            .select("column_name", F.lit(method).alias("method"),
                    F.coalesce("outlier_count", F.lit(0)).cast("long").alias("outlier_count"),
                    F.coalesce(rnd(F.try_divide(F.col("outlier_count") * 100.0, F.col("n")), 2),
                               F.lit(0.0)).alias("outlier_percentage")))
    if not with_keys:
        return base
    # Counts are k rows: keep them, and re-read raw rows only for columns that
    # actually have outliers.
    base = df.sparkSession.createDataFrame(base.collect(), base.schema)
    hit = [r["column_name"] for r in base.collect() if r["outlier_count"] > 0]
    if not hit:
        return base.withColumn("outlier_keys", F.array().cast("array<bigint>"))
    keys = outlier_keys(df, hit, method, row_key, config, p)  # <= k rows
    return (base.join(F.broadcast(keys), "column_name", "left")
            .withColumn("outlier_keys",
                        F.coalesce("outlier_keys", F.array().cast("array<bigint>"))))


def outlier_keys(df: DataFrame, cols: list[str], method: str, row_key, config: ProfileConfig,
                 p: NumericProfile) -> DataFrame:
    """``(column_name, outlier_keys)`` — first ``max_outlier_keys`` keys."""
    key = (qcol(row_key) if isinstance(row_key, str) else row_key) if row_key is not None \
        else F.monotonically_increasing_id()
    keyed = df.select(key.cast("long").alias("_key"),
                      *[F.nanvl(qcol(c).cast("double"), F.lit(None).cast("double")).alias(c)
                        for c in cols])
    long = unpivot_pairs(keyed, cols, {"value": lambda c: qcol(c), "_key": lambda c: F.col("_key")})
    b = F.broadcast(_bounds(p, method, config))
    flagged = long.where(F.col("value").isNotNull()).join(b, "column_name").where(
        _flag(method, config, F.col("value")))
    w = Window.partitionBy("column_name").orderBy("_key")
    first = flagged.withColumn("_rn", F.row_number().over(w)).where(
        F.col("_rn") <= config.max_outlier_keys)
    return first.groupBy("column_name").agg(
        F.sort_array(F.collect_list("_key")).alias("outlier_keys"))


def outlier_sweep(df: DataFrame, columns: list[str] | None = None,
                  row_key: str | Column | None = None, config: ProfileConfig = DEFAULT,
                  profile: NumericProfile | None = None) -> DataFrame:
    """Outliers of all numeric columns (or the first ``sweep_columns``) with the
    configured method; only columns with at least one outlier are kept."""
    cols = (columns or numeric_columns(df))[:config.sweep_columns]
    p = profile if profile is not None and set(cols) <= set(profile.cols) else None
    res = detect_outliers(df, cols, config.outlier_method, row_key, config, p)
    return res.where(F.col("outlier_count") > 0)
