"""Value-frequency tables and exact ranks: the core physical structure.

A frequency table is the long DataFrame ``(column_name, bucket, value, cnt)``:
one row per distinct non-null value of each profiled column.  It is built with a
map-side partial aggregate right after an ``Expand`` (unpivot), so a value held by
a third of all rows is a single row after the combine and never skews a task.

Exact cumulative counts (ranks, quantiles, ECDF) are computed without a window
over a whole column:

1. ``bucket`` orders values coarsely.  At scale it comes from a JVM ``Bucketizer``
   over approximate quantile splits of the raw column (O(log B) binary search per
   value); every bucket then holds at most about ``rank_bucket_rows`` raw rows.
   Small inputs use a single bucket and skip the extra pass.
2. Per-bucket totals (k x B rows) get prefix offsets with a window partitioned by
   column (B rows per task).
3. Inside ``(column_name, bucket)`` a running sum adds the local position.

Both windows see bounded partitions whatever the data size; the result is exact
because buckets only decide the parallel split, never the values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import clean_double, fields_of, qcol, residual

BUCKET_SUFFIX = "__bucket"
LOW_SUFFIX = "__low"


def bucket_count(n_max: int, cfg: ProfileConfig = DEFAULT) -> int:
    """Number of rank buckets for a column holding ``n_max`` non-null rows."""
    if n_max <= cfg.rank_bucket_rows:
        return 1
    return int(min(cfg.max_rank_buckets, math.ceil(n_max / cfg.rank_bucket_rows)))


def quantile_splits(df: DataFrame, cols: list[str], n_buckets: int,
                    cfg: ProfileConfig = DEFAULT) -> list[list[float]]:
    """Approximate quantile splits per column (one pass over ``df``); only
    ``len(cols) * n_buckets`` doubles reach the driver."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    rel = min(cfg.rank_relative_error, 0.25 / n_buckets)
    qs = df.stat.approxQuantile(cols, probs, rel)
    out = []
    for q in qs:
        inner = sorted({float(v) for v in q if v is not None and not math.isnan(v)}) or [0.0]
        out.append([-math.inf] + inner + [math.inf])
    return out


def with_buckets(clean: DataFrame, cols: list[str], n_buckets: int,
                 cfg: ProfileConfig = DEFAULT) -> DataFrame:
    """Add ``<col>__bucket`` for every column (literal 0 when one bucket)."""
    if n_buckets <= 1:
        return clean.select("*", *[F.lit(0.0).alias(c + BUCKET_SUFFIX) for c in cols])
    from pyspark.ml.feature import Bucketizer

    splits = quantile_splits(clean, cols, n_buckets, cfg)
    b = Bucketizer(splitsArray=splits, inputCols=cols,
                   outputCols=[c + BUCKET_SUFFIX for c in cols], handleInvalid="keep")
    return b.transform(clean)


def clean_numeric(df: DataFrame, cols: list[str], wide: list[str] | tuple = ()) -> DataFrame:
    """Project the numeric columns as doubles with NaN folded to NULL; ``wide`` columns
    (exact types with values that share a double) also as ``<col>__low``, the rest of the value."""
    types = fields_of(df, cols)
    return df.select(*[clean_double(c, types[c]).alias(c) for c in cols],
                     *[residual(c, types[c]).alias(c + LOW_SUFFIX) for c in wide])


def low_of(clean: DataFrame, cols: list[str]) -> dict[str, Column]:
    """The residual of each column, if any column of ``clean`` has one."""
    have = set(clean.columns)
    if not any(c + LOW_SUFFIX in have for c in cols):
        return {}
    return {c: qcol(c + LOW_SUFFIX) if c + LOW_SUFFIX in have else F.lit(0.0) for c in cols}


def value_key(freq: DataFrame) -> list[str]:
    """The columns that tell a frequency table's values apart, in their order."""
    return ["value", "low"] if "low" in freq.columns else ["value"]


def unpivot_pairs(df: DataFrame, cols: list[str], value_cols: dict[str, Column],
                  ) -> DataFrame:
    """Long form ``(column_name, <fields>)`` via one ``Expand``; ``value_cols`` maps
    an output field name to a template taking the column name."""
    if len(value_cols) == 1:
        # One field: a plain Expand of the column values, no per-row struct.
        (field, tmpl), = value_cols.items()
        wide = df.select(*[tmpl(c).alias(c) for c in cols])
        return wide.unpivot([], [qcol(c) for c in cols], "column_name", field)
    structs = [
        F.struct(*[tmpl(c).alias(field) for field, tmpl in value_cols.items()]).alias(c)
        for c in cols
    ]
    wide = df.select(*structs)
    long = wide.unpivot([], [qcol(c) for c in cols], "column_name", "_s")
    return long.select("column_name", *[F.col("_s." + f).alias(f) for f in value_cols])


LOG_BUCKETS_PER_DOUBLING = 64


def log_bucket(v: Column) -> Column:
    """A free, order-preserving bucket: about 64 buckets per doubling of |v|,
    negatives below zero below positives.  Used below the sketch threshold so
    the exact rank windows still run in parallel (no extra data pass)."""
    k = LOG_BUCKETS_PER_DOUBLING
    far = F.lit(float("inf"))
    return (F.when(v == far, F.lit(1_000_000)).when(v == -far, F.lit(-1_000_000))
            .when(v > 0, F.lit(100_000) + F.floor(F.log2(v) * k))
            .when(v < 0, F.lit(-100_000) - F.floor(F.log2(-v) * k))
            .otherwise(F.lit(0))).cast("int")


def numeric_frequencies(clean: DataFrame, cols: list[str], n_buckets: int = 1,
                        cfg: ProfileConfig = DEFAULT, given: list[str] | tuple = ()) -> DataFrame:
    """``(column_name, bucket, value[, low], cnt)`` over non-null values; ``low`` only where a
    column has values that share a double.

    ``given`` names columns: for the i-th, ``cnt_<i>`` counts the rows where it is present."""
    low = low_of(clean, cols)
    fields = {"value": lambda c: qcol(c)}
    if low:
        fields["low"] = lambda c: low[c]
    src = clean
    if n_buckets > 1:
        src = with_buckets(clean, cols, n_buckets, cfg)
        fields["bucket"] = lambda c: qcol(c + BUCKET_SUFFIX).cast("int")
    for i, g in enumerate(given):
        fields[f"in_{i}"] = lambda c, g=g: qcol(g).isNotNull()
    long = unpivot_pairs(src, cols, fields).where(F.col("value").isNotNull())
    keys = ["column_name", *(["bucket"] if n_buckets > 1 else []), "value", *(["low"] if low else [])]
    out = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"), *[
        F.count(F.when(F.col(f"in_{i}"), 1)).alias(f"cnt_{i}") for i in range(len(given))])
    return out if n_buckets > 1 else out.withColumn("bucket", log_bucket(F.col("value")))


def grouped_frequencies(clean: DataFrame, cols: list[str], n_rows: int, n_buckets: int = 1,
                        cfg: ProfileConfig = DEFAULT) -> DataFrame:
    """``numeric_frequencies`` of all columns, counted for as many at a time as make ``group_cells``
    cells, one at least: a task holds the values of those columns only, on both sides of the shuffle."""
    size = max(1, cfg.group_cells // max(n_rows, 1))
    parts = [numeric_frequencies(clean, cols[i:i + size], n_buckets, cfg) for i in range(0, len(cols), size)]
    if any("low" in p.columns for p in parts):
        parts = [p if "low" in p.columns else p.withColumn("low", F.lit(0.0)) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def string_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column_name, value, cnt)`` of non-null values cast to string."""
    long = unpivot_pairs(df.select(*[qcol(c) for c in cols]), cols,
                         {"value": lambda c: qcol(c).cast("string")})
    return (long.where(F.col("value").isNotNull())
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("cnt")))


def running_counts(freq: DataFrame, keys: list[str], order: str | list[str], bucket: str = "bucket",
                   weight: str = "cnt", broadcast_offsets: bool | int = True,
                   single_bucket: bool = False, totals_of: str | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Add ``cum_before`` (sum of ``weight`` over rows strictly earlier in ``order``
    within ``keys``) and ``distinct_before`` (number of such rows).

    ``order`` must be unique within ``keys``; ``bucket`` must be monotone in
    ``order`` within ``keys``.  Two bounded windows, see the module docstring.
    ``single_bucket`` (small inputs) skips the offsets: every offset is 0.
    ``totals_of`` names a value column: the group totals ``n_total`` (sum of
    weights) and ``value_total`` (sum of value x weight) ride along, computed in
    the same windows.
    ``broadcast_offsets``: True / False, or an int row limit — then the (small,
    cached) bucket-totals table is counted and broadcast only if it fits.
    ``partitions``: how many the inner window has (None: the session's).
    """
    if single_bucket:
        w = Window.partitionBy(*keys).orderBy(order)
        wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = (freq.withColumn("cum_before", (F.sum(weight).over(wr) - F.col(weight)).cast("long"))
               .withColumn("distinct_before", (F.row_number().over(w) - 1).cast("long")))
        if totals_of:
            wa = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            out = (out.withColumn("n_total", F.sum(weight).over(wa).cast("long"))
                   .withColumn("value_total", F.sum(F.col(totals_of) * F.col(weight)).over(wa)))
        return out
    aggs = [F.sum(weight).alias("_bt"), F.count(F.lit(1)).alias("_bd")]
    if totals_of:
        aggs.append(F.sum(F.col(totals_of) * F.col(weight)).alias("_bs"))
    totals = freq.groupBy(*keys, bucket).agg(*aggs)
    if not isinstance(broadcast_offsets, bool):
        from pyspark import StorageLevel

        totals = totals.persist(StorageLevel.MEMORY_AND_DISK)
        broadcast_offsets = totals.count() <= broadcast_offsets
    w1 = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1)
    sel = [*keys, bucket,
           F.coalesce(F.sum("_bt").over(w1), F.lit(0)).cast("long").alias("_off"),
           F.coalesce(F.sum("_bd").over(w1), F.lit(0)).cast("long").alias("_doff")]
    if totals_of:
        wa = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
        sel += [F.sum("_bt").over(wa).cast("long").alias("n_total"),
                F.sum("_bs").over(wa).alias("value_total")]
    offsets = totals.select(*sel)
    if broadcast_offsets:
        offsets = F.broadcast(offsets)
    if partitions:
        freq = freq.repartition(partitions, *keys, bucket)
    joined = freq.join(offsets, [*keys, bucket])
    w2 = Window.partitionBy(*keys, bucket).orderBy(order)
    w2r = w2.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (joined
            .withColumn("cum_before",
                        (F.col("_off") + F.sum(weight).over(w2r) - F.col(weight)).cast("long"))
            .withColumn("distinct_before",
                        (F.col("_doff") + F.row_number().over(w2) - 1).cast("long"))
            .drop("_off", "_doff"))


def running_sums(freq: DataFrame, keys: list[str], order: list[str], weights: list[str],
                 most_broadcast: int, bucket: str = "bucket") -> DataFrame:
    """``before_<w>`` for every weight: its sum over rows strictly earlier within ``keys``.
    The same two bounded windows as ``running_counts``, for several weights at once."""
    from pyspark import StorageLevel

    totals = freq.groupBy(*keys, bucket).agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    totals = totals.persist(StorageLevel.MEMORY_AND_DISK)
    w1 = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, bucket, *[
        F.coalesce(F.sum(f"_{w}").over(w1), F.lit(0)).cast("long").alias(f"_{w}") for w in weights])
    if totals.count() <= most_broadcast:
        offsets = F.broadcast(offsets)
    w2 = (Window.partitionBy(*keys, bucket).orderBy(*order)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return freq.join(offsets, [*keys, bucket]).withColumns({
        f"before_{w}": (F.col(f"_{w}") + F.sum(w).over(w2) - F.col(w)).cast("long") for w in weights
    }).drop(*[f"_{w}" for w in weights])


MAX_LOG_BUCKETS = 2 * LOG_BUCKETS_PER_DOUBLING * 1100 + 1  # all finite doubles


def ranked_frequencies(freq: DataFrame, n_columns: int, n_buckets: int,
                       cfg: ProfileConfig = DEFAULT, n_rows: int | None = None) -> DataFrame:
    """Frequency table with exact ``cum_before`` and average ``rank`` (1-based,
    ties averaged as in pandas ``rank(method='average')``)."""
    # Offsets hold one row per (column, bucket): k x B for quantile buckets,
    # k x min(n, all log buckets) below the sketch threshold.  Hint a broadcast
    # only under a proven bound; otherwise AQE broadcasts at runtime if the
    # measured size is small, or keeps the shuffle join.
    per_col = n_buckets if n_buckets > 1 else min(n_rows if n_rows is not None else MAX_LOG_BUCKETS,
                                                   MAX_LOG_BUCKETS)
    small = n_columns * per_col <= cfg.broadcast_row_limit
    # More partitions than the session's where those would hold too many rows.
    parts = math.ceil(n_columns * (n_rows or 0) / cfg.sorted_cells)
    parts = parts if parts > int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    # Proven small: hint directly; otherwise measure the totals table first.
    r = running_counts(freq, ["column_name"], value_key(freq),
                       broadcast_offsets=True if small else cfg.broadcast_row_limit,
                       totals_of="value", partitions=parts)
    return r.withColumn("rank", F.col("cum_before") + (F.col("cnt") + 1) / 2.0)


def quantiles_from_ranked(ranked: DataFrame, counts: DataFrame,
                          probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas / ``quantile_cont``).

    ``counts`` is ``(column_name, n)`` with a known small row count.  The value at
    0-based sorted position ``i`` is ``max(value)`` over rows with
    ``cum_before <= i``; one partial aggregate over the ranked table.
    """
    j = ranked.join(F.broadcast(counts), "column_name")
    aggs = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * F.lit(p)
        lo, hi = F.floor(h), F.ceil(h)
        aggs.append(F.max(F.when(F.col("cum_before") <= lo, F.col("value"))).alias(f"_{name}_lo"))
        aggs.append(F.max(F.when(F.col("cum_before") <= hi, F.col("value"))).alias(f"_{name}_hi"))
        aggs.append(F.first(h - lo).alias(f"_{name}_t"))
    agg = j.groupBy("column_name").agg(*aggs)
    outs = [F.col("column_name")]
    for name in probs:
        a, b, t = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}_t")
        outs.append((a + (b - a) * t).alias(name))
    return agg.select(*outs)
