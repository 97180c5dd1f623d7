"""The full analysis (I4-I7): ``profile(df)`` builds every analysis lazily over
shared intermediates, ``Profile.report()`` assembles the one-row nested report.

Shared physical structures: one schema-facts job (types, missing, uniques), one
numeric frequency table and one string frequency table, both persisted for the
life of the profile; every statistic, test and chart is derived from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ProfileConfig
from ..operators import categorical as C
from ..operators import correlation as R
from ..operators import distribution as D
from ..operators import outliers as O
from ..operators import quality as Q
from ..operators import schema as S
from ..operators import trend as TR
from ..functions.columns import DATETIME_TYPES
from ..operators.numeric import NumericProfile, numeric_stats
from .chart_plan import chart_plan_rows

# Analysis selectors.
ANALYSES = ("descriptive", "correlation", "distribution", "outlier", "trend", "all")


class Profile:
    """Every column analysed by its semantic type; ``analyses`` selects
    correlation / outlier / distribution / trend (descriptive always runs; ``all``
    leaves trends out, which need a time column)."""

    def __init__(self, df: DataFrame, config: ProfileConfig = DEFAULT,
                 analyses: tuple[str, ...] | list[str] = ("all",), row_key: str | Column | None = None,
                 visualizations: bool = True, reuse: str = "persist"):
        bad = [a for a in analyses if a not in ANALYSES]
        if bad:
            raise ValueError(f"Unknown analysis types: {bad}")
        self.df, self.cfg, self.row_key = df, config, row_key
        self.spark = df.sparkSession
        self.analyses = set(analyses)
        self.run_all = "all" in self.analyses
        self.visualizations = visualizations
        self.facts = S.SchemaFacts(df, config)
        types = self.facts.type_map()
        self.types = types
        self.numeric_cols = [c for c in df.columns if types[c] == S.NUMERIC]
        self.cat_cols = [c for c in df.columns if types[c] in C.CATEGORY_TYPES]
        self.time_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]
        # Share the schema job's frequency tables whenever they cover the columns.
        if self.numeric_cols == self.facts.numeric_typed:
            self.num = self.facts.numeric
        else:
            self.num = NumericProfile(df, self.numeric_cols, config, reuse)
        self.cat = C.CategoricalProfile(df, self.cat_cols, config, reuse,
                                        shared_freq=self.facts.string_freq(),
                                        shared_columns=self.facts.short_value_columns())
        self._order = self.spark.createDataFrame([(c, i) for i, c in enumerate(df.columns)],
                                                 "column_name string, ord int")
        self._cache: dict[str, DataFrame | None] = {}

    def _wants(self, name: str) -> bool:
        return self.run_all or name in self.analyses

    def _memo(self, key, fn):
        """Compute a section once.  Every section is bounded by the number of
        columns (k rows, k^2 for matrices, <= 100 keys per column), so it is
        collected and re-enters Spark as a small local relation: later uses
        (the report, the insight context) never re-run its jobs."""
        if key not in self._cache:
            df = fn()
            if df is not None:
                df = self.spark.createDataFrame(df.collect(), df.schema)
            self._cache[key] = df
        return self._cache[key]

    # ---- pieces ------------------------------------------------------------------
    def schema(self) -> DataFrame:
        return self._memo("schema", lambda: S.schema_profile(
            self.df, self.row_key if isinstance(self.row_key, str) else None, self.cfg, self.facts))

    def summary(self) -> DataFrame:
        return self._memo("summary", lambda: S.dataset_summary(self.df, self.cfg, self.facts))

    def numeric_stats(self) -> DataFrame:
        return self._memo("num", lambda: numeric_stats(self.df, self.numeric_cols, self.cfg, self.num))

    def categorical_stats(self) -> DataFrame | None:
        if not self.cat_cols:
            return None
        return self._memo("cat", lambda: self.cat.stats())

    def top_categories(self) -> DataFrame | None:
        if not self.cat_cols:
            return None
        return self._memo("top", lambda: self.cat.top())

    def correlation(self) -> DataFrame | None:
        if not self._wants("correlation") or len(self.numeric_cols) < 2:
            return None
        return self._memo("corr", lambda: R.correlation_matrix(
            self.df, self.numeric_cols, self.cfg.correlation_method, self.cfg, self.num))

    def strong_correlations(self) -> DataFrame | None:
        m = self.correlation()
        if m is None:
            return None
        return self._memo("strong", lambda: R.strong_correlations(m, self.numeric_cols, self.cfg))

    def outliers(self) -> DataFrame | None:
        if not self._wants("outlier") or not self.numeric_cols:
            return None
        return self._memo("outl", lambda: O.outlier_sweep(
            self.df, self.numeric_cols, self.row_key, self.cfg, self.num)
            .join(F.broadcast(self._order), "column_name"))

    def distributions(self) -> DataFrame | None:
        if not self._wants("distribution") or not self.numeric_cols:
            return None
        return self._memo("dist", lambda: D.distribution_sweep(
            self.df, self.numeric_cols, self.cfg, self.num)
            .join(F.broadcast(self._order), "column_name"))

    def trends(self) -> DataFrame | None:
        """Only when asked for by name, and with a time column to go by."""
        if "trend" not in self.analyses or not self.time_cols or not self.numeric_cols:
            return None
        return self._memo("trend", lambda: TR.trend_sweep(self.df, self.time_cols, self.numeric_cols))

    def chart_plan(self) -> DataFrame | None:
        if not self.visualizations:
            return None
        rows = chart_plan_rows(self.types, self.cfg)
        return self.spark.createDataFrame(
            rows, "plot_index int, viz_type string, title string, columns_used string")

    def quality(self) -> DataFrame:
        return self._memo("quality", lambda: Q.quality_score(self.df, self.cfg))

    def column_summaries(self) -> DataFrame:
        """``ord, name, type, stats`` for every column (numeric and categorical
        fields in one nullable struct)."""
        types = self.facts.facts().select("column_name", "ord", F.col("data_type").alias("type"))
        ns = self.numeric_stats().select(
            "column_name", "mean", "median", "std_dev", "min", "max",
            F.col("outlier_count").alias("outliers"), "skewness", "mode", "variance", "q1", "q3", "iqr", "kurtosis")
        j = types.join(F.broadcast(ns), "column_name", "left")
        cs = self.categorical_stats()
        if cs is not None:
            j = j.join(F.broadcast(cs.select("column_name", "unique_count", "most_frequent", "frequency")),
                       "column_name", "left")
        else:
            j = (j.withColumn("unique_count", F.lit(None).cast("bigint"))
                 .withColumn("most_frequent", F.lit(None).cast("string"))
                 .withColumn("frequency", F.lit(None).cast("bigint")))
        return j.select("ord", F.col("column_name").alias("name"), "type",
                        F.struct("mean", "median", "std_dev", "min", "max", "outliers", "skewness",
                                 "unique_count", "most_frequent", "mode", "variance", "q1", "q3", "iqr",
                                 "kurtosis", "frequency").alias("stats"))

    # ---- assembly ------------------------------------------------------------------
    def report(self, job_id: str | None = None) -> DataFrame:
        """I4: one row; every section an array of structs in column order."""
        key = F.lit(1).alias("_k")

        def arr(df: DataFrame | None, name: str, order: list[str], fields: list[str]):
            if df is None:
                return None
            st = F.struct(*[F.col(c) for c in order + fields])
            return (df.groupBy().agg(F.sort_array(F.collect_list(st)).alias("_a"))
                    .select(key, F.transform("_a", lambda x: x.dropFields(*order)).alias(name)))

        parts = [self.summary().select(key, "*")]
        sch = self.schema().join(F.broadcast(self._order), "column_name")
        parts.append(arr(sch, "columns", ["ord"], ["column_name", "data_type", "missing_count",
                                                   "missing_percentage", "unique_count",
                                                   "sample_values"]))
        parts.append(arr(self.column_summaries(), "column_statistics", ["ord"],
                         ["name", "type", "stats"]))
        m = self.correlation()
        if m is not None:
            mo = m.select(F.col("column1").alias("_a"), F.col("column2").alias("_b"), "*")
            parts.append(arr(mo, "correlation_matrix", ["_a", "_b"],
                             ["column1", "column2", "correlation"]))
            so = self.strong_correlations().select(
                (-F.abs(F.col("correlation"))).alias("_abs"), F.col("column1").alias("_a"),
                F.col("column2").alias("_b"), "*")
            parts.append(arr(so, "strong_correlations", ["_abs", "_a", "_b"],
                             ["column1", "column2", "correlation", "strength", "direction"]))
        o = self.outliers()
        if o is not None:
            parts.append(arr(o, "outlier_analysis", ["ord"],
                             ["column_name", "method", "outlier_count", "outlier_percentage",
                              "outlier_keys"]))
        d = self.distributions()
        if d is not None:
            parts.append(arr(d, "distribution_analysis", ["ord"],
                             ["column_name", "distribution_type", "is_normal",
                              "normality_test_statistic", "normality_p_value"]))
        t = self.trends()
        if t is not None:
            to = t.select(F.col("time_column").alias("_a"), F.col("column_name").alias("_b"), "*")
            parts.append(arr(to, "trend_analysis", ["_a", "_b"], t.columns))
        top = self.top_categories()
        if top is not None:
            to = top.join(F.broadcast(self._order), "column_name")
            parts.append(arr(to, "top_categories", ["ord", "rank"], ["column_name", "value", "count"]))
        parts.append(self.quality().select(key, F.struct(*self.quality().columns).alias("data_quality")))
        v = self.chart_plan()
        if v is not None:
            parts.append(arr(v, "visualizations", ["plot_index"], ["viz_type", "title", "columns_used"]))
        j = None
        for p in parts:
            if p is None:
                continue
            j = p if j is None else j.join(F.broadcast(p), "_k")
        return j.drop("_k").select(
            F.lit(job_id or uuid.uuid4().hex).alias("job_id"),
            F.lit(self.cfg.correlation_method).alias("correlation_method"), "*")

    def release(self):
        self.num.release()
        self.facts.release()
        if self.cat.owned is not None:
            self.cat.owned.unpersist()


def profile(df: DataFrame, config: ProfileConfig = DEFAULT, analyses=("all",),
            row_key: str | Column | None = None, visualizations: bool = True,
            overrides: dict | None = None) -> Profile:
    """Entry point; ``overrides`` (I7) replaces config fields per request, e.g.
    ``{"correlation_method": "spearman", "outlier_method": "zscore"}``."""
    cfg = config.with_(**overrides) if overrides else config
    return Profile(df, cfg, analyses, row_key, visualizations)
