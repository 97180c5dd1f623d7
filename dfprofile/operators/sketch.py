"""Approximate column statistics from mergeable sketches.

``column_sketches`` keeps one row a column (and group): counts, extremes, sum, a KLL quantile
sketch and a HyperLogLog sketch of the distinct values, as binary state of a few kilobytes
whatever the row count.  Sketches add up: ``merge_sketches`` of those of old files and of a
new one describes all, without a second look at the old.  ``approx_stats`` reads them.

Each task sketches its own rows; sketches first meet per (column, salt) and then per column,
so no task merges those of all tasks.  No value is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import FLOAT_TYPES, NUMERIC_TYPES, clean_double, fields_of, qcol
from .freq import unpivot_pairs

KLL_K = 800        # ranks within RANK_ERROR of the row count
HLL_LG = 14        # 2^14 registers: a standard error of 0.65 %
RANK_ERROR = 0.01
UNIQUE_ERROR = 0.03
SALTS = 64


def _state(by: list[str]) -> list:
    return [F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"),
            F.min("min").alias("min"), F.max("max").alias("max"),
            F.kll_merge_agg_double("quantiles").alias("quantiles"),
            F.hll_union_agg("uniques").alias("uniques")]


def column_sketches(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``column_name, <by>, rows, n, total, min, max, quantiles, uniques`` for every column, one row for
    each group of ``by`` (columns of ``df``, e.g. a load date).

    NULL and NaN count in ``rows`` alone.  Columns without an order as numbers have no total, extremes or
    quantiles.  ``quantiles`` and ``uniques`` are binary sketches.
    """
    by = by or []
    clash = {"column_name", "rows", "n", "total", "min", "max", "quantiles", "uniques"} & set(by)
    if clash:
        raise ValueError(f"grouping columns with names of results: {sorted(clash)}")
    cols = columns or [c for c in df.columns if c not in by]
    types = fields_of(df, cols)
    plain = {c: qcol(c) for c in cols}
    for c in cols:  # a float's -0.0 and NaN: the same value as 0.0, and none
        if isinstance(types[c], FLOAT_TYPES):
            plain[c] = clean_double(c, types[c]) + 0.0
    fields = {
        "value": lambda c: (clean_double(c, types[c]) if isinstance(types[c], NUMERIC_TYPES)
                            else F.lit(None).cast("double")),
        "hash": lambda c: F.when(plain[c].isNotNull(), F.xxhash64(plain[c])),
        **{f"by_{i}": lambda c, b=b: qcol(b) for i, b in enumerate(by)}}
    cells = unpivot_pairs(df, cols, fields)
    keys = ["column_name", *[f"by_{i}" for i in range(len(by))]]
    parts = (cells.withColumn("salt", F.spark_partition_id() % SALTS).groupBy(*keys, "salt").agg(
        F.count(F.lit(1)).alias("rows"), F.count("hash").alias("n"), F.sum("value").alias("total"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.kll_sketch_agg_double("value", F.lit(KLL_K)).alias("quantiles"),
        F.hll_sketch_agg("hash", F.lit(HLL_LG)).alias("uniques")))
    out = parts.groupBy(*keys).agg(*_state(by))
    return out.select("column_name", *[F.col(f"by_{i}").alias(b) for i, b in enumerate(by)],
                      "rows", "n", "total", "min", "max", "quantiles", "uniques")


def merge_sketches(*sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketches of all rows of the given ones, by column (and ``by``)."""
    every = reduce(DataFrame.unionByName, sketches)
    return every.groupBy("column_name", *(by or [])).agg(*_state(by or []))


def approx_stats(sketches: DataFrame, probs: dict[str, float] | None = None) -> DataFrame:
    """``column_name`` (and grouping columns), ``rows, n, mean, min, max``, a column for each of ``probs``
    (default q1, median, q3) and ``unique_count``.

    Quantiles are values of the column whose rank is within ``RANK_ERROR`` of the row count, with a failure
    rate far below 1 %; ``unique_count`` is within ``UNIQUE_ERROR`` at over four standard errors; the rest is
    exact.  Columns without numbers have NULL for what they lack."""
    probs = probs or {"q1": 0.25, "median": 0.5, "q3": 0.75}
    state = {"rows", "n", "total", "min", "max", "quantiles", "uniques"}
    keys = [c for c in sketches.columns if c not in state]
    some = F.col("min").isNotNull()
    return sketches.select(
        *[qcol(c) for c in keys], "rows", "n", (F.col("total") / F.col("n")).alias("mean"), "min", "max",
        *[F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))).alias(name)
          for name, p in probs.items()],
        F.hll_sketch_estimate("uniques").alias("unique_count"))
