"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
computed over the whole driver tables.  Oracles live in ``oracles.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..operators import categorical as C
from ..operators import distribution as D
from ..operators import correlation as R
from ..operators import outliers as OUT
from ..operators import quality as Q
from ..operators import schema as S
from ..operators.heavy import heavy_hitters
from ..operators.numeric import numeric_stats
from . import oracles as O
from .tables import load

LINEITEM_KEYS = ["l_partkey", "l_suppkey", "l_returnflag"]
LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def q_numeric_stats(spark: SparkSession, sf: str) -> DataFrame:
    return numeric_stats(load(spark, sf, "lineitem"))


ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
          ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
LINEITEM = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
            ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
            ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
            ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
NATION = [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")]
CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("c_mktsegment", "string")]
DOCUMENTS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
             ("n_chars", "bigint")]
EVENTS = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"),
          ("event_type", "string"), ("value", "double"), ("props", "string")]

# Lineitem with derived missing values (the driver tables hold no NULLs).
LINEITEM_NULLS_EXPRS = [
    "l_orderkey", "l_partkey", "NULLIF(l_quantity, 1.0) AS l_quantity", "l_extendedprice",
    "NULLIF(l_discount, 0.0) AS l_discount", "NULLIF(l_tax, 0.0) AS l_tax",
    "NULLIF(l_returnflag, 'R') AS l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NULLS = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_quantity", "double"),
                  ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                  ("l_returnflag", "string"), ("l_linestatus", "string"),
                  ("l_shipdate", "timestamp_ntz")]
LINEITEM_NULLS_SQL = "(SELECT " + ", ".join(LINEITEM_NULLS_EXPRS) + " FROM lineitem)"


def lineitem_nulls(spark, sf):
    return load(spark, sf, "lineitem").selectExpr(*LINEITEM_NULLS_EXPRS)


def customer_strings(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(*[F.col(n).cast("string").alias(n) for n in c.columns])


CUSTOMER_STRINGS_SQL = "(SELECT " + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" for c, _ in CUSTOMER) + " FROM customer)"


def q_schema_profile(spark, sf):
    df = load(spark, sf, "orders")
    return S.schema_profile(df, row_key="o_orderkey").withColumn(
        "sample_values", F.array_join("sample_values", ", "))


def q_dataset_summary(spark, sf):
    return S.dataset_summary(load(spark, sf, "orders"))


def q_type_inference(spark, sf):
    parts = [("documents", load(spark, sf, "documents")), ("events", load(spark, sf, "events")),
             ("customer", customer_strings(spark, sf))]
    out = None
    for name, df in parts:
        t = S.infer_types(df).select(F.lit(name).alias("table_name"), "column_name", "data_type")
        out = t if out is None else out.unionByName(t)
    return out


def q_missing_data(spark, sf):
    return S.missing_data(lineitem_nulls(spark, sf))


def q_type_narrowing(spark, sf):
    return S.type_narrowing(load(spark, sf, "lineitem"))


def q_sample_values(spark, sf):
    return S.sample_values(load(spark, sf, "nation"), row_key="n_nationkey").withColumn(
        "sample_values", F.array_join("sample_values", ", "))


ORDER_CATS = ["o_orderstatus", "o_orderpriority"]
PART_CATS = ["p_brand", "p_type", "p_name"]
PART_NUMERIC = ["p_partkey", "p_size", "p_retailprice"]
ORDERS_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
EVENTS_NUMERIC = ["event_id", "user_id", "value"]
LINEITEM_KEY = "l_orderkey * 10 + l_linenumber"

# Orders projected to few columns: duplicates, derived NULLs and a constant column.
ORDERS_QUALITY_EXPRS = ["o_orderstatus", "o_orderpriority",
                        "NULLIF(o_orderstatus, 'F') AS status_not_f", "CAST(1 AS INT) AS const_one"]
ORDERS_QUALITY = [("o_orderstatus", "string"), ("o_orderpriority", "string"),
                  ("status_not_f", "string"), ("const_one", "int")]
ORDERS_QUALITY_SQL = "(SELECT " + ", ".join(ORDERS_QUALITY_EXPRS) + " FROM orders)"
LINEITEM_CONST_EXPRS = ["l_quantity", "l_extendedprice", "l_discount", "CAST(1.0 AS DOUBLE) AS const_col"]
LINEITEM_CONST_SQL = "(SELECT " + ", ".join(LINEITEM_CONST_EXPRS) + " FROM lineitem)"


def _keys_str(df):
    return df.withColumn("outlier_keys", F.array_join(
        F.transform("outlier_keys", lambda x: x.cast("string")), ","))


def q_value_counts(spark, sf):
    return C.value_counts(load(spark, sf, "orders"), ORDER_CATS)


def q_top_categories(spark, sf):
    return C.top_categories(load(spark, sf, "part"), PART_CATS, 20)


def q_top_categories_text(spark, sf):
    return C.top_categories(load(spark, sf, "documents"), ["text", "lang"], 20)


def q_approx_top_values(spark, sf):
    return heavy_hitters(load(spark, sf, "lineitem"), LINEITEM_KEYS, 20).drop("unseen")


def q_approx_top_texts(spark, sf):
    return heavy_hitters(load(spark, sf, "documents"), ["text", "source"], 20).drop("unseen")


def q_categorical_stats(spark, sf):
    return C.categorical_stats(load(spark, sf, "orders"))


def q_bar_chart(spark, sf):
    from ..operators.charts import bar_chart_data
    return bar_chart_data(load(spark, sf, "part"), "p_brand")


def q_corr_pearson(spark, sf):
    return R.correlation_matrix(load(spark, sf, "lineitem"), LINEITEM_NUMERIC, "pearson")


def q_strong_correlations(spark, sf):
    df = load(spark, sf, "lineitem")
    return R.strong_correlations(R.pearson_matrix(df, LINEITEM_NUMERIC), LINEITEM_NUMERIC)


def q_corr_spearman(spark, sf):
    return R.correlation_matrix(load(spark, sf, "part"), PART_NUMERIC, "spearman")


def q_corr_constant(spark, sf):
    df = load(spark, sf, "lineitem").selectExpr(*LINEITEM_CONST_EXPRS)
    return R.correlation_matrix(df, None, "pearson")


def q_corr_heatmap(spark, sf):
    from ..operators.charts import heatmap_data
    return heatmap_data(load(spark, sf, "lineitem"), LINEITEM_NUMERIC)


def q_outliers_iqr(spark, sf):
    return _keys_str(OUT.detect_outliers(load(spark, sf, "orders"), ORDERS_NUMERIC, "iqr",
                                         row_key="o_orderkey"))


def q_outliers_zscore(spark, sf):
    return _keys_str(OUT.detect_outliers(load(spark, sf, "events"), EVENTS_NUMERIC, "zscore",
                                         row_key="event_id"))


def q_outlier_keys(spark, sf):
    return _keys_str(OUT.detect_outliers(load(spark, sf, "events"), ["value"], "iqr",
                                         row_key="event_id"))


def q_outlier_sweep(spark, sf):
    return _keys_str(OUT.outlier_sweep(load(spark, sf, "lineitem"), LINEITEM_NUMERIC,
                                       row_key=F.expr(LINEITEM_KEY)))


def q_quality_score(spark, sf):
    return Q.quality_score(load(spark, sf, "orders").selectExpr(*ORDERS_QUALITY_EXPRS))


def q_duplicate_rows(spark, sf):
    return Q.duplicate_rows(load(spark, sf, "orders").selectExpr(*ORDERS_QUALITY_EXPRS))


def q_constant_columns(spark, sf):
    return Q.constant_columns(load(spark, sf, "orders").selectExpr(*ORDERS_QUALITY_EXPRS))


CUSTOMER_CATS = ["c_name", "c_mktsegment"]
EVENTS_CATS = ["event_type", "props"]
CUSTOMER_NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal"]


def q_distribution_type(spark, sf):
    return D.distribution_types(load(spark, sf, "lineitem"), LINEITEM_NUMERIC)


def q_normality_ks(spark, sf):
    return D.distribution_analysis(load(spark, sf, "lineitem"), LINEITEM_NUMERIC)


def q_normality_shapiro(spark, sf):
    return D.distribution_analysis(load(spark, sf, "part"), PART_NUMERIC, test="shapiro")


def q_distribution_sweep(spark, sf):
    return D.distribution_sweep(load(spark, sf, "customer"))


def q_histogram(spark, sf):
    from ..operators.charts import histogram_data
    return histogram_data(load(spark, sf, "orders"), ORDERS_NUMERIC)


def q_kde_curve(spark, sf):
    from ..operators.charts import kde_curve
    return kde_curve(load(spark, sf, "part"), PART_NUMERIC)


def q_boxplot_stats(spark, sf):
    from ..operators.charts import boxplot_stats
    return boxplot_stats(load(spark, sf, "lineitem"), LINEITEM_NUMERIC)


def q_scatter_points(spark, sf):
    from ..operators.charts import scatter_points
    return scatter_points(load(spark, sf, "part"), "p_size", "p_retailprice", "p_brand")


def q_pairplot_sample(spark, sf):
    from ..operators.charts import pairplot_sample
    return pairplot_sample(load(spark, sf, "lineitem"), LINEITEM_NUMERIC,
                           row_key=F.expr(LINEITEM_KEY)).drop("_key")


# Documents with two more measures of length: both go with n_chars.
DOC_SIZES = ["n_chars", "len_text", "doc_id"]


def q_strong_correlations_documents(spark, sf):
    df = load(spark, sf, "documents").selectExpr("n_chars", "length(text) AS len_text", "doc_id")
    return R.strong_correlations(R.pearson_matrix(df, DOC_SIZES), DOC_SIZES)


def q_outlier_sweep_events(spark, sf):
    return _keys_str(OUT.outlier_sweep(load(spark, sf, "events"), EVENTS_NUMERIC, row_key="event_id"))


# Quantity is there only where tax is zero, and is constant on the rows with a discount of 4 %.
PAIR_CONSTANT_EXPRS = ["l_extendedprice", "l_tax",
                       "CASE WHEN l_discount = 0.04 THEN 0.1 WHEN l_tax = 0 THEN l_quantity END AS odd",
                       "CASE WHEN l_discount = 0.04 THEN l_quantity END AS some"]
PAIR_CONSTANT = ["l_extendedprice", "l_tax", "odd", "some"]
PAIR_CONSTANT_SQL = "(SELECT " + ", ".join(PAIR_CONSTANT_EXPRS) + " FROM lineitem)"


def q_corr_pearson_pair_constant(spark, sf):
    return R.correlation_matrix(load(spark, sf, "lineitem").selectExpr(*PAIR_CONSTANT_EXPRS), None, "pearson")


# More numeric columns than any sweep used to take, the outliers in the last one.
WIDE_EXPRS = [f"event_id + {i} AS c{i:02d}" for i in range(24)] + ["value"]
WIDE = [f"c{i:02d}" for i in range(24)] + ["value"]
WIDE_SQL = "(SELECT event_id, " + ", ".join(WIDE_EXPRS) + " FROM events)"


def q_outliers_wide(spark, sf):
    df = load(spark, sf, "events").selectExpr("event_id", *WIDE_EXPRS)
    return _keys_str(OUT.outlier_sweep(df, WIDE, row_key="event_id"))


def q_distribution_wide(spark, sf):
    return D.distribution_sweep(load(spark, sf, "events").selectExpr(*WIDE_EXPRS), WIDE)


# Keys beyond 2^53, where doubles no longer tell them apart.
BIGKEYS_EXPRS = ["o_orderkey + 1152921504606846976 AS big_key",
                 "CAST(1152921504606846977 AS BIGINT) AS same_key", "o_orderstatus"]
BIGKEYS_SQL = "(SELECT " + ", ".join(BIGKEYS_EXPRS) + " FROM orders)"


def q_constant_columns_bigkeys(spark, sf):
    return Q.constant_columns(load(spark, sf, "orders").selectExpr(*BIGKEYS_EXPRS))


# The same keys, read as a schema, and with nulls among them.
BIGKEY_COLS = [("big_key", "bigint"), ("some_key", "bigint"), ("big_dec", "decimal(28,4)"), ("same_key", "bigint"),
               ("o_orderstatus", "string"), ("o_orderkey", "bigint")]
BIGKEY_SCHEMA_EXPRS = [*BIGKEYS_EXPRS, "CASE WHEN o_orderkey % 3 <> 0 THEN -1152921504606846976 - o_orderkey END AS some_key",
                       "CAST(o_orderkey AS DECIMAL(28,4)) / 10000 + CAST('123456789012345678' AS DECIMAL(28,4)) AS big_dec",
                       "o_orderkey"]
BIGKEY_CASTS = ["o_orderkey", "big_key", "some_key", "same_key", "o_orderstatus", "CAST(big_dec AS DECIMAL(28,4)) AS big_dec"]


def _bigkeys(spark, sf):
    df = load(spark, sf, "orders").selectExpr(*BIGKEY_SCHEMA_EXPRS).selectExpr(*BIGKEY_CASTS)
    return df.select(*[c for c, _ in BIGKEY_COLS])


def q_schema_profile_bigkeys(spark, sf):
    s = S.schema_profile(_bigkeys(spark, sf), row_key="o_orderkey")
    return s.drop("sample_values")


def q_corr_spearman_bigkeys(spark, sf):
    return R.correlation_matrix(_bigkeys(spark, sf), ["big_key", "some_key", "big_dec", "o_orderkey"], "spearman")


def q_corr_kendall_bigkeys(spark, sf):
    return R.correlation_matrix(_bigkeys(spark, sf), ["big_key", "big_dec", "o_orderkey"], "kendall")


NULL_STATS_EXPRS = ["l_quantity", "NULLIF(l_discount, 0.0) AS l_discount", "CAST(NULL AS DOUBLE) AS nothing",
                    "CAST(7.5 AS DOUBLE) AS same"]
NULL_STATS = ["l_quantity", "l_discount", "nothing", "same"]
NULL_STATS_SQL = "(SELECT " + ", ".join(NULL_STATS_EXPRS) + " FROM lineitem)"


def q_numeric_stats_nulls(spark, sf):
    return numeric_stats(load(spark, sf, "lineitem").selectExpr(*NULL_STATS_EXPRS), NULL_STATS)


def q_chart_plan(spark, sf):
    from .chart_plan import chart_plan
    return chart_plan(load(spark, sf, "customer"))


def q_corr_kendall(spark, sf):
    return R.correlation_matrix(load(spark, sf, "part"), PART_NUMERIC, "kendall")


ORDERS_PAIR = ["o_custkey", "o_totalprice"]


def q_corr_kendall_orders(spark, sf):
    return R.correlation_matrix(load(spark, sf, "orders"), ORDERS_PAIR, "kendall")


SUPPLIER_NUMERIC = ["s_suppkey", "s_nationkey", "s_acctbal"]
SUPPLIER = [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
            ("s_acctbal", "double")]
PART = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
        ("p_size", "int"), ("p_retailprice", "double")]


def q_csv_roundtrip(spark, sf):
    """Write ``supplier`` as a folder of CSV files into the shared checkpoint
    folder, load it back through the validated, typed CSV path."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.csv import load_csv

    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/csv-roundtrip-{uuid.uuid4().hex}"
    load(spark, sf, "supplier").repartition(4).write.option("header", True).csv(path)
    return load_csv(spark, path)


def q_csv_mixed(spark, sf):
    """A folder of ``supplier`` files in two column orders, half of them with
    line breaks, quotes and commas inside fields; read back by name."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.csv import load_csv

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-mixed-{uuid.uuid4().hex}"
    t = load(spark, sf, "supplier")
    even, odd = t.where("s_suppkey % 2 = 0"), t.where("s_suppkey % 2 = 1")
    wide = F.concat("s_name", F.lit('\nsaid "'), F.col("s_nationkey").cast("string"), F.lit('", twice'))
    even.repartition(2).write.option("header", True).csv(path)
    (odd.withColumn("s_name", wide).select(*reversed(t.columns)).repartition(2)
     .write.option("header", True).option("escape", '"').mode("append").csv(path))
    return load_csv(spark, path).select(*t.columns)


def q_head_sample(spark, sf):
    from ..sources.csv import head_sample
    return head_sample(load(spark, sf, "orders"), 100, row_key="o_orderkey")


def q_validation_checks(spark, sf):
    from ..sources.csv import validation_checks
    return validation_checks(load(spark, sf, "part"))


def q_outliers_iforest(spark, sf):
    return _keys_str(OUT.detect_outliers(load(spark, sf, "events"), ["value", "user_id"],
                                         "isolation_forest", row_key="event_id"))


def q_trend_daily(spark, sf):
    from ..operators.trend import trend_series
    return trend_series(load(spark, sf, "events"), "ts", "value")


def q_trend_fit(spark, sf):
    from ..operators.trend import trend_fit
    return trend_fit(load(spark, sf, "events"), "ts", "value")


def q_trend_acf(spark, sf):
    from ..operators.trend import trend_acf
    return trend_acf(load(spark, sf, "events"), "ts", "value")


def q_trend_weekly(spark, sf):
    from ..operators.trend import trend_series
    return trend_series(load(spark, sf, "orders"), "o_orderdate", "o_custkey", window=4, unit="week")


def q_trend_report(spark, sf):
    """The trend section of ``profile()`` for ``orders``."""
    from .report import profile
    p = profile(load(spark, sf, "orders"), analyses=["trend"])
    out = p.trends()
    p.release()
    return out.select("time_column", "column_name", "buckets", F.round("slope", 4).alias("slope"), "direction")


def q_report_retention(spark, sf):
    """``events`` as finished jobs in a store by day; what a week's retention keeps, per day."""
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..sources.sink import retention, store

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/jobs-{uuid.uuid4().hex}"
    t = load(spark, sf, "events").select("event_id", F.col("ts").alias("completed_at"), "event_type")
    store(t, path)
    now = t.agg(F.max("completed_at")).first()[0]
    kept, expired, _ = retention(spark.read.parquet(path), now=now)
    both = kept.withColumn("state", F.lit("kept")).unionByName(expired.withColumn("state", F.lit("expired")))
    return both.groupBy("run_date", "state").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def q_trend_seasonality(spark, sf):
    from ..operators.trend import seasonality
    return seasonality(load(spark, sf, "events"), "ts", "value")


def q_full_report(spark, sf):
    from .report import profile
    return profile(load(spark, sf, "customer"), row_key="c_custkey").report(job_id="customer")


def q_insight_context(spark, sf):
    from .insights import insight_context
    from .report import profile
    return insight_context(profile(load(spark, sf, "orders"), row_key="o_orderkey"))


def q_insight_rows(spark, sf):
    """The context of ``events``, one row a fact."""
    from .insights import insight_context
    from .report import profile
    from .unfold import unfold_context
    p = profile(load(spark, sf, "events"), row_key="event_id")
    return unfold_context(insight_context(p))


def q_report_rows(spark, sf):
    """The whole report of ``customer``, one row a fact."""
    from .unfold import unfold
    return unfold(q_full_report(spark, sf))


def q_normality_ks_supplier(spark, sf):
    """D3s: the KS test where its p-value is neither 0 nor 1."""
    return D.distribution_analysis(load(spark, sf, "supplier"), SUPPLIER_NUMERIC, test="ks")


SKETCHED = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"]


def q_approx_stats(spark, sf):
    """Sketches of ``lineitem`` a ship year, merged; their errors against exact ranks and counts."""
    from ..operators.numeric import NumericProfile
    from ..operators.sketch import RANK_ERROR, UNIQUE_ERROR, approx_stats, column_sketches, merge_sketches
    df = load(spark, sf, "lineitem")
    yearly = column_sketches(df.withColumn("year", F.year("l_shipdate")), SKETCHED, by=["year"])
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    got = approx_stats(merge_sketches(yearly.drop("year")), probs)
    long = got.select("column_name", "n", "unique_count", F.explode(F.array(*[
        F.struct(F.lit(q).alias("p"), F.col(c).alias("value")) for c, q in probs.items()])).alias("at"))
    long = F.broadcast(long.select("column_name", "n", "unique_count", "at.p", "at.value"))  # 3 rows a column
    exact = NumericProfile(df, SKETCHED)
    ranks = exact.ranked().join(long, ["column_name", "value"])
    n, p, before = F.col("n"), F.col("p"), F.col("cum_before")
    near = (before / n - RANK_ERROR <= p) & ((before + F.col("cnt")) / n + RANK_ERROR >= p)
    ok = ranks.groupBy("column_name", "n", "unique_count").agg(
        (F.count(F.lit(1)) == len(probs)).alias("_all"), F.bool_and(near).alias("_near"))
    true = exact.ranked().groupBy("column_name").agg(F.count(F.lit(1)).alias("_distinct"))
    off = F.abs(F.col("unique_count") - F.col("_distinct")) <= UNIQUE_ERROR * F.col("_distinct")
    return ok.join(F.broadcast(true), "column_name").select(
        "column_name", "n", (F.col("_all") & F.col("_near")).alias("ranks_within"), off.alias("uniques_within"))


EMBEDDINGS = [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")]
DOC_CATS = ["lang", "source", "text"]


def q_schema_profile_text(spark, sf):
    return S.schema_profile(load(spark, sf, "documents"), row_key="doc_id").withColumn(
        "sample_values", F.array_join("sample_values", ", "))


def q_categorical_stats_text(spark, sf):
    return C.categorical_stats(load(spark, sf, "documents"), DOC_CATS)


def q_schema_profile_embeddings(spark, sf):
    return S.schema_profile(load(spark, sf, "embeddings"), row_key="vec_id").withColumn(
        "sample_values", F.array_join("sample_values", ", "))


PAGES = [("page_id", "bigint"), ("url", "string"), ("html", "string")]
LABELS_NUMERIC = ["doc_id", "quality", "toxic"]


def q_schema_profile_pages(spark, sf):
    return S.schema_profile(load(spark, sf, "pages"), row_key="page_id").withColumn(
        "sample_values", F.array_join("sample_values", ", "))


def q_numeric_stats_labels(spark, sf):
    return numeric_stats(load(spark, sf, "labels"))


def q_value_counts_roles(spark, sf):
    return C.value_counts(load(spark, sf, "conversations"), ["role"])


NULLS_NUMERIC = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_corr_pearson_nulls(spark, sf):
    return R.correlation_matrix(lineitem_nulls(spark, sf), NULLS_NUMERIC, "pearson")


def q_corr_spearman_nulls(spark, sf):
    return R.correlation_matrix(lineitem_nulls(spark, sf), NULLS_NUMERIC, "spearman")


QUERIES = {
    "numeric_stats": q_numeric_stats,
    "schema_profile": q_schema_profile,
    "dataset_summary": q_dataset_summary,
    "type_inference": q_type_inference,
    "missing_data": q_missing_data,
    "type_narrowing": q_type_narrowing,
    "sample_values": q_sample_values,
    "value_counts": q_value_counts,
    "top_categories": q_top_categories,
    "approx_top_values": q_approx_top_values,
    "approx_top_texts": q_approx_top_texts,
    "categorical_stats": q_categorical_stats,
    "bar_chart": q_bar_chart,
    "corr_pearson": q_corr_pearson,
    "strong_correlations": q_strong_correlations,
    "corr_spearman": q_corr_spearman,
    "corr_constant": q_corr_constant,
    "corr_pearson_nulls": q_corr_pearson_nulls,
    "corr_spearman_nulls": q_corr_spearman_nulls,
    "corr_heatmap": q_corr_heatmap,
    "outliers_iqr": q_outliers_iqr,
    "outliers_zscore": q_outliers_zscore,
    "outlier_keys": q_outlier_keys,
    "outlier_sweep": q_outlier_sweep,
    "quality_score": q_quality_score,
    "duplicate_rows": q_duplicate_rows,
    "constant_columns": q_constant_columns,
    "distribution_type": q_distribution_type,
    "normality_ks": q_normality_ks,
    "normality_shapiro": q_normality_shapiro,
    "distribution_sweep": q_distribution_sweep,
    "histogram": q_histogram,
    "kde_curve": q_kde_curve,
    "boxplot_stats": q_boxplot_stats,
    "scatter_points": q_scatter_points,
    "pairplot_sample": q_pairplot_sample,
    "chart_plan": q_chart_plan,
    "corr_kendall": q_corr_kendall,
    "corr_kendall_orders": q_corr_kendall_orders,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_mixed": q_csv_mixed,
    "head_sample": q_head_sample,
    "validation_checks": q_validation_checks,
    "outliers_iforest": q_outliers_iforest,
    "trend_daily": q_trend_daily,
    "trend_fit": q_trend_fit,
    "trend_seasonality": q_trend_seasonality,
    "trend_acf": q_trend_acf,
    "trend_weekly": q_trend_weekly,
    "trend_report": q_trend_report,
    "report_retention": q_report_retention,
    "schema_profile_text": q_schema_profile_text,
    "categorical_stats_text": q_categorical_stats_text,
    "schema_profile_embeddings": q_schema_profile_embeddings,
    "schema_profile_pages": q_schema_profile_pages,
    "numeric_stats_labels": q_numeric_stats_labels,
    "value_counts_roles": q_value_counts_roles,
    "full_report": q_full_report,
    "strong_correlations_documents": q_strong_correlations_documents,
    "outlier_sweep_events": q_outlier_sweep_events,
    "corr_pearson_pair_constant": q_corr_pearson_pair_constant,
    "outliers_wide": q_outliers_wide,
    "distribution_wide": q_distribution_wide,
    "constant_columns_bigkeys": q_constant_columns_bigkeys,
    "schema_profile_bigkeys": q_schema_profile_bigkeys,
    "corr_spearman_bigkeys": q_corr_spearman_bigkeys,
    "corr_kendall_bigkeys": q_corr_kendall_bigkeys,
    "numeric_stats_nulls": q_numeric_stats_nulls,
    "insight_context": q_insight_context,
    "insight_rows": q_insight_rows,
    "report_rows": q_report_rows,
    "normality_ks_supplier": q_normality_ks_supplier,
    "approx_stats": q_approx_stats,
    "top_categories_text": q_top_categories_text,
}

ORACLES = {
    "numeric_stats": O.numeric_stats_sql("lineitem", LINEITEM_NUMERIC),
    "schema_profile": O.schema_profile_sql("orders", ORDERS, "o_orderkey"),
    "dataset_summary": O.dataset_summary_sql("orders", ORDERS),
    "type_inference": O.type_inference_sql([
        ("documents", "documents", DOCUMENTS), ("events", "events", EVENTS),
        ("customer", CUSTOMER_STRINGS_SQL, [(c, "string") for c, _ in CUSTOMER])]),
    "missing_data": O.missing_data_sql(LINEITEM_NULLS_SQL, LINEITEM_NULLS),
    "type_narrowing": O.type_narrowing_sql("lineitem", LINEITEM),
    "sample_values": O.sample_values_sql("nation", NATION, "n_nationkey"),
    "value_counts": O.value_counts_sql("orders", ORDER_CATS),
    "top_categories": O.top_values_sql("part", PART_CATS, 20),
    "approx_top_values": O.proven_top_values_sql("lineitem", LINEITEM_KEYS, 20),
    "approx_top_texts": O.proven_top_values_sql("documents", ["text", "source"], 20),
    "categorical_stats": O.categorical_stats_sql("orders", ORDER_CATS),
    "bar_chart": O.top_values_sql("part", ["p_brand"], 15),
    "corr_pearson": O.pearson_sql("lineitem", LINEITEM_NUMERIC),
    "strong_correlations": O.strong_sql(O.pearson_raw_sql("lineitem", LINEITEM_NUMERIC),
                                        LINEITEM_NUMERIC),
    "corr_spearman": O.pearson_sql(O.rank_source_sql("part", PART_NUMERIC), PART_NUMERIC),
    "corr_constant": O.pearson_sql(LINEITEM_CONST_SQL,
                                   ["l_quantity", "l_extendedprice", "l_discount", "const_col"]),
    "corr_heatmap": O.pearson_sql("lineitem", LINEITEM_NUMERIC, 2),
    "corr_pearson_nulls": O.pearson_sql(LINEITEM_NULLS_SQL, NULLS_NUMERIC),
    "corr_spearman_nulls": O.spearman_pairwise_sql(LINEITEM_NULLS_SQL, NULLS_NUMERIC),
    "outliers_iqr": O.outliers_sql("orders", ORDERS_NUMERIC, "o_orderkey", "iqr"),
    "outliers_zscore": O.outliers_sql("events", EVENTS_NUMERIC, "event_id", "zscore"),
    "outlier_keys": O.outliers_sql("events", ["value"], "event_id", "iqr"),
    "outlier_sweep": O.outliers_sql("lineitem", LINEITEM_NUMERIC, LINEITEM_KEY, "iqr",
                                    keep_positive=True),
    "quality_score": O.quality_sql(ORDERS_QUALITY_SQL, ORDERS_QUALITY),
    "duplicate_rows": f"SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows, "
                      f"CAST(sum(c) AS BIGINT) AS row_count FROM (SELECT o_orderstatus, o_orderpriority, "
                      f"status_not_f, const_one, count(*) AS c "
                      f"FROM {ORDERS_QUALITY_SQL} q GROUP BY ALL) g",
    "constant_columns": "SELECT 'const_one' AS column_name FROM (SELECT count(DISTINCT const_one) AS d "
                        f"FROM {ORDERS_QUALITY_SQL} q) WHERE d = 1",
    "distribution_type": O.distribution_type_sql("lineitem", LINEITEM_NUMERIC),
    "normality_ks": O.distribution_sql("lineitem", LINEITEM_NUMERIC),
    "normality_shapiro": O.distribution_sql("part", PART_NUMERIC, sw_max=10 ** 12),
    "distribution_sweep": O.distribution_sql("customer", CUSTOMER_NUMERIC),
    "histogram": O.histogram_sql("orders", ORDERS_NUMERIC),
    "kde_curve": O.kde_sql("part", PART_NUMERIC),
    "boxplot_stats": O.boxplot_sql("lineitem", LINEITEM_NUMERIC),
    "scatter_points": "SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, "
                      "p_brand AS color FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL",
    "chart_plan": O.chart_plan_sql("customer", CUSTOMER),
    "corr_kendall": O.kendall_sql("part", PART_NUMERIC),
    "corr_kendall_orders": O.kendall_sql("orders", ORDERS_PAIR),
    "csv_roundtrip": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal "
                     "FROM supplier",
    "csv_mixed": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name || chr(10) || 'said \"' "
                 "|| s_nationkey || '\", twice' END AS s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, "
                 "s_acctbal FROM supplier",
    "head_sample": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100",
    "validation_checks": O.validation_sql("part", [c for c, _ in PART]),
    "schema_profile_text": O.schema_profile_sql("documents", DOCUMENTS, "doc_id"),
    "categorical_stats_text": O.categorical_stats_sql("documents", DOC_CATS),
    "schema_profile_embeddings": O.schema_profile_sql("embeddings", EMBEDDINGS, "vec_id"),
    "schema_profile_pages": O.schema_profile_sql("pages", PAGES, "page_id"),
    "numeric_stats_labels": O.numeric_stats_sql("labels", LABELS_NUMERIC),
    "value_counts_roles": O.value_counts_sql("conversations", ["role"]),
    "pairplot_sample": "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LINEITEM_NUMERIC[:4])
                       + f" FROM lineitem ORDER BY md5(CAST({LINEITEM_KEY} AS VARCHAR) || ':42'), {LINEITEM_KEY} LIMIT 1000",
    "strong_correlations_documents": O.strong_sql(O.pearson_raw_sql(
        "(SELECT n_chars, length(text) AS len_text, doc_id FROM documents)", DOC_SIZES), DOC_SIZES),
    "outlier_sweep_events": O.outliers_sql("events", EVENTS_NUMERIC, "event_id", "iqr", keep_positive=True),
    "corr_pearson_pair_constant": O.pearson_sql(PAIR_CONSTANT_SQL, PAIR_CONSTANT),
    "outliers_wide": O.outliers_sql(WIDE_SQL, WIDE, "event_id", "iqr", keep_positive=True),
    "distribution_wide": O.distribution_sql(WIDE_SQL, WIDE),
    "schema_profile_bigkeys": O.bigkeys_schema_sql(BIGKEY_COLS),
    "corr_spearman_bigkeys": O.bigkeys_rank_sql(["big_key", "some_key", "big_dec", "o_orderkey"]),
    "corr_kendall_bigkeys": O.bigkeys_rank_sql(["big_key", "big_dec", "o_orderkey"]),
    "constant_columns_bigkeys": "SELECT 'same_key' AS column_name FROM (SELECT count(DISTINCT same_key) AS d "
                                f"FROM {BIGKEYS_SQL} q) WHERE d = 1",
    "numeric_stats_nulls": O.numeric_stats_sql(NULL_STATS_SQL, NULL_STATS),
    "trend_daily": O.trend_series_sql("events", "ts", "value"),
    "trend_fit": O.trend_fit_sql("events", "ts", "value"),
    "trend_seasonality": O.seasonality_sql("events", "ts", "value"),
    "trend_acf": O.trend_acf_sql("events", "ts", "value"),
    "trend_weekly": O.trend_series_sql("orders", "o_orderdate", "o_custkey", 4, unit="week"),
    "trend_report": O.trend_report_sql("orders", "o_orderdate", ["o_orderkey", "o_custkey", "o_totalprice"]),
    "report_retention": "WITH c AS (SELECT max(ts) - INTERVAL 7 DAY AS cut FROM events) SELECT CAST(ts AS DATE) AS run_date, "
                        "CASE WHEN ts < cut THEN 'expired' ELSE 'kept' END AS state, count(*) AS n, min(event_id) AS first_id "
                        "FROM events, c GROUP BY ALL",
    "insight_rows": O.context_rows_sql("events", "events", EVENTS, "event_id", EVENTS_NUMERIC, EVENTS_CATS),
    "report_rows": O.report_rows_sql("customer", "customer", CUSTOMER, "c_custkey", CUSTOMER_NUMERIC, CUSTOMER_CATS),
    "normality_ks_supplier": O.distribution_sql("supplier", SUPPLIER_NUMERIC, sw_max=0),
    "approx_stats": "SELECT column_name, count(*) AS n, true AS ranks_within, true AS uniques_within FROM "
                    f"({O.numeric_long_sql('lineitem', SKETCHED)}) l GROUP BY column_name",
    "top_categories_text": O.top_values_sql("documents", ["text", "lang"], 20),
}
