"""Numeric column statistics (N1-N14) over any number of columns at once.

Plan shape per profile, independent of the number of columns:

* one frequency table (unpivot + map-side combine), persisted and reused for
  moments, mode, exact quantiles, fences, histograms and ranks;
* a small aggregate (n, mean, min, max) and one ranked pass (two bounded windows)
  giving two-pass central moments, quartiles and mode together -> k rows of
  metadata on the driver;
* one fence pass over the frequency table for IQR outliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import fields_of, numeric_columns, qcol, rnd, wide_bound
from ..session import materialize
from . import freq as fq

SUMMARY_SCHEMA = T.StructType([
    T.StructField("column_name", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("n_distinct", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("var", T.DoubleType()),
    T.StructField("std_pop", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("g1", T.DoubleType()),
    T.StructField("g2", T.DoubleType()),
    T.StructField("q1", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("q3", T.DoubleType()),
    T.StructField("mode", T.DoubleType()),
    T.StructField("n_float_exact", T.LongType()),
])

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _float_exact(freq: DataFrame):
    v = F.col("value")
    same = v.cast("float").cast("double") == v
    return same & (F.col("low") == 0) if "low" in freq.columns else same


class NumericProfile:
    """Shared, lazily built numeric intermediates for a set of columns.

    Raw data is scanned once (plus one metadata count, plus one sketch pass when
    the input is large enough to need rank buckets).  Everything else is computed
    from the persisted frequency table; per-column results (k rows) are collected
    as bounded metadata and re-enter Spark as a small local relation.
    """

    def __init__(self, df: DataFrame, columns: list[str] | None = None,
                 config: ProfileConfig = DEFAULT, reuse: str = "persist"):
        self.df = df
        self.cfg = config
        self.cols = list(columns) if columns is not None else numeric_columns(df)
        self.reuse = reuse
        self.spark = df.sparkSession
        self._clean = None
        self._n_rows = None
        self._wide = None
        self._freq = None
        self._ranked = None
        self._summary_rows = None
        self._summary = None
        self._n_buckets = None
        self._light = None
        self._raw = None
        self._basic_rows = None

    def n_rows(self) -> int:
        if self._n_rows is None:
            self._measure()
        return self._n_rows

    def _measure(self) -> None:
        """Row count, and which columns of exact types hold values beyond the doubles' precision."""
        types = fields_of(self.df, self.cols)
        bounds = {c: wide_bound(t) for c, t in types.items() if wide_bound(t)}
        big = {c: (qcol(c) > F.lit(b).cast(types[c])) | (qcol(c) < -F.lit(b).cast(types[c]))
               for c, b in bounds.items()}
        got = self.df.agg(F.count(F.lit(1)), *[F.max(x) for x in big.values()]).first()
        self._n_rows, self._wide = got[0], [c for c, x in zip(big, got[1:]) if x]

    @property
    def clean(self) -> DataFrame:
        """The columns as doubles; wide ones with the rest of their values."""
        if self._clean is None:
            if self._wide is None:
                self._measure()
            self._clean = fq.clean_numeric(self.df, self.cols, self._wide)
        return self._clean

    @property
    def n_buckets(self) -> int:
        if self._n_buckets is None:
            self._n_buckets = fq.bucket_count(self.n_rows(), self.cfg)
        return self._n_buckets

    def columns_df(self) -> DataFrame:
        return self.spark.createDataFrame([(c, i) for i, c in enumerate(self.cols)],
                                          "column_name string, ord int")

    # ---- frequency table ------------------------------------------------------
    def raw_freq(self) -> DataFrame:
        """Persisted ``(column_name, bucket, value, cnt)``; read by the light
        facts and twice by the rank build (bucket totals, then the join)."""
        if self._raw is None:
            f = fq.grouped_frequencies(self.clean, self.cols, self.n_rows(), self.n_buckets, self.cfg)
            bound = self.n_rows() * max(len(self.cols), 1)
            self._raw = materialize(f, self.reuse, bound)
        return self._raw

    def freq(self) -> DataFrame:
        """The frequency table; it is the persisted ranked table (a superset:
        ``cum_before``, ``distinct_before`` and ``rank`` ride along), so the
        rank windows run once per profile."""
        return self.ranked()

    def ranked(self) -> DataFrame:
        if self._ranked is None:
            bound = self.n_rows() * max(len(self.cols), 1)
            r = fq.ranked_frequencies(self.raw_freq(), len(self.cols), self.n_buckets, self.cfg,
                                      self.n_rows())
            self._ranked = materialize(r, self.reuse, bound)
            if self.reuse == "persist":
                self._ranked.count()
                self._raw.unpersist()  # the ranked table supersedes it
            self._freq = self._ranked
        return self._ranked

    def basic_rows(self) -> dict:
        """``column -> (n, n_distinct, min, max, n_float_exact)`` from one small
        aggregate over the frequency table (no rank windows needed)."""
        if self._summary_rows is not None:
            return {r[0]: (r[1], r[2], r[7], r[8], r[-1]) for r in self._summary_rows}
        if self._basic_rows is None:
            src = self._ranked if self._ranked is not None else self.raw_freq()
            v, w = F.col("value"), F.col("cnt")
            agg = src.groupBy("column_name").agg(
                F.sum(w).cast("long"), F.count(F.lit(1)).cast("long"), F.min(v), F.max(v),
                F.sum(F.when(_float_exact(src), w).otherwise(0)).cast("long"))
            got = {r[0]: tuple(r)[1:] for r in agg.collect()}
            self._basic_rows = {c: got.get(c, (0, 0, None, None, 0)) for c in self.cols}
        return self._basic_rows

    # ---- per-column summary (k rows) ------------------------------------------
    def summary_rows(self) -> list:
        """One aggregate over the persisted ranked table: each row already
        carries its column's ``n_total`` and ``value_total``, so central moments
        (two-pass, exact), quartile picks, mode and distinct count come out of
        a single pass; k rows reach the driver."""
        if self._summary_rows is None:
            if not self.cols:
                self._summary_rows = []
                return self._summary_rows
            n = F.col("n_total")
            j = self.ranked().withColumn("_mean", F.col("value_total") / n)
            dev = F.col("value") - F.col("_mean")
            w = F.col("cnt")
            aggs = [F.first("n_total").alias("n"), F.count(F.lit(1)).alias("n_distinct"),
                    F.first("_mean").alias("mean"), F.min("value").alias("min"),
                    F.max("value").alias("max"),
                    F.sum(w * dev * dev).alias("s2"), F.sum(w * dev * dev * dev).alias("s3"),
                    F.sum(w * dev * dev * dev * dev).alias("s4"),
                    F.min_by("value", F.struct(-w, *fq.value_key(j))).alias("mode"),
                    F.sum(F.when(_float_exact(j), w).otherwise(0)).cast("long").alias("n_float_exact")]
            for name, p in QUARTILES.items():
                h = (n - 1) * F.lit(p)
                aggs.append(F.max(F.when(F.col("cum_before") <= F.floor(h), F.col("value"))).alias(f"_{name}_lo"))
                aggs.append(F.max(F.when(F.col("cum_before") <= F.ceil(h), F.col("value"))).alias(f"_{name}_hi"))
            agg = j.groupBy("column_name").agg(*aggs)
            n = F.col("n").cast("double")
            m2, m3, m4 = F.col("s2") / n, F.col("s3") / n, F.col("s4") / n
            quart = []
            for name, p in QUARTILES.items():
                h = (n - 1) * F.lit(p)
                a, b = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
                quart.append((a + (b - a) * (h - F.floor(h))).alias(name))
            out = agg.select(
                "column_name", "n", "n_distinct", "mean",
                F.when(F.col("n") > 1, F.sqrt(F.col("s2") / (n - 1))).alias("std"),
                F.when(F.col("n") > 1, F.col("s2") / (n - 1)).alias("var"),
                F.sqrt(m2).alias("std_pop"), "min", "max",
                F.when(m2 > 0, m3 / F.pow(m2, 1.5)).alias("g1"),
                F.when(m2 > 0, m4 / (m2 * m2) - 3.0).alias("g2"),
                *quart, "mode", "n_float_exact")
            got = {r["column_name"]: tuple(r) for r in out.collect()}
            empty = (0, 0) + (None,) * (len(SUMMARY_SCHEMA.fields) - 3)
            self._summary_rows = [got.get(c, (c,) + empty) for c in self.cols]
        return self._summary_rows

    def summary(self) -> DataFrame:
        """``SUMMARY_SCHEMA``: one row per column, unrounded."""
        if self._summary is None:
            self._summary = self.spark.createDataFrame(self.summary_rows(), SUMMARY_SCHEMA)
        return self._summary

    def counts(self) -> dict[str, int]:
        return {r[0]: r[1] for r in self.light_rows()}

    def light_rows(self) -> list:
        """``(column_name, n, mean, std)`` per column from one small aggregate
        (or from the full summary when that already exists)."""
        if self._summary_rows is not None:
            return [(r[0], r[1], r[3], r[4]) for r in self._summary_rows]
        if self._light is None:
            if not self.cols:
                self._light = []
                return self._light
            long = fq.unpivot_pairs(self.clean, self.cols, {"value": lambda c: qcol(c)})
            got = {r[0]: tuple(r) for r in long.groupBy("column_name").agg(
                F.count("value"), F.avg("value"), F.stddev_samp("value")).collect()}
            self._light = [got.get(c, (c, 0, None, None)) for c in self.cols]
        return self._light

    def counts_df(self) -> DataFrame:
        return self.summary().select("column_name", "n")

    def quantiles(self, probs: dict[str, float]) -> DataFrame:
        return fq.quantiles_from_ranked(self.ranked(), self.counts_df(), probs)

    def fences(self, threshold: float | None = None) -> DataFrame:
        """``(column_name, q1, median, q3, iqr, lower, upper)`` IQR fences."""
        t = self.cfg.outlier_threshold if threshold is None else threshold
        iqr = F.col("q3") - F.col("q1")
        return self.summary().select(
            "column_name", "q1", "median", "q3", iqr.alias("iqr"),
            (F.col("q1") - F.lit(t) * iqr).alias("lower"),
            (F.col("q3") + F.lit(t) * iqr).alias("upper"))

    def iqr_outlier_counts(self, threshold: float | None = None) -> DataFrame:
        """``(column_name, outlier_count)`` with strict fences."""
        f = F.broadcast(self.fences(threshold).select("column_name", "lower", "upper"))
        j = self.freq().join(f, "column_name")
        out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
        return j.groupBy("column_name").agg(
            F.sum(F.when(out, F.col("cnt")).otherwise(F.lit(0))).cast("long").alias("outlier_count"))

    def shape(self) -> DataFrame:
        """Summary plus adjusted skewness / excess kurtosis as pandas computes
        them (N11, N12): NULL below 3 / 4 values, 0 for a constant column."""
        n = F.col("n").cast("double")
        const = F.col("min") == F.col("max")
        skew = (F.when(F.col("n") < 3, F.lit(None).cast("double"))
                .when(const, F.lit(0.0))
                .otherwise(F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)))
        kurt = (F.when(F.col("n") < 4, F.lit(None).cast("double"))
                .when(const, F.lit(0.0))
                .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)))
        return self.summary().select("*", skew.alias("skewness"), kurt.alias("kurtosis"))

    def release(self):
        if self.reuse == "persist":
            for t in (self._freq, self._raw):
                if t is not None:
                    t.unpersist()


def numeric_stats(df: DataFrame, columns: list[str] | None = None,
                  config: ProfileConfig = DEFAULT, profile: NumericProfile | None = None,
                  ) -> DataFrame:
    """One row per numeric column, long form, rounded to the precision.

    Columns: column_name, count, mean, median, mode, std_dev, variance, min, max,
    q1, q3, iqr, skewness, kurtosis, outlier_count.  An all-null column keeps its
    row with NULL statistics (N14).
    """
    p = profile or NumericProfile(df, columns, config)
    d = config.numeric_precision
    if not p.cols:
        return p.spark.createDataFrame([], _STATS_SCHEMA)
    base = p.shape()
    outl = p.iqr_outlier_counts()
    j = base.join(F.broadcast(outl), "column_name", "left")  # outl: k rows
    has = F.col("n") > 0
    return j.select(
        "column_name",
        F.col("n").alias("count"),
        rnd(F.col("mean"), d).alias("mean"),
        rnd(F.col("median"), d).alias("median"),
        rnd(F.col("mode"), d).alias("mode"),
        rnd(F.col("std"), d).alias("std_dev"),
        rnd(F.col("var"), d).alias("variance"),
        rnd(F.col("min"), d).alias("min"),
        rnd(F.col("max"), d).alias("max"),
        rnd(F.col("q1"), d).alias("q1"),
        rnd(F.col("q3"), d).alias("q3"),
        rnd(F.col("q3") - F.col("q1"), d).alias("iqr"),
        rnd(F.col("skewness"), d).alias("skewness"),
        rnd(F.col("kurtosis"), d).alias("kurtosis"),
        F.when(has, F.coalesce(F.col("outlier_count"), F.lit(0))).cast("long").alias("outlier_count"),
    )


_STATS_SCHEMA = T.StructType(
    [T.StructField("column_name", T.StringType()), T.StructField("count", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in
       ["mean", "median", "mode", "std_dev", "variance", "min", "max", "q1", "q3", "iqr",
        "skewness", "kurtosis"]]
    + [T.StructField("outlier_count", T.LongType())])

