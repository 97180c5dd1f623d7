"""Wide frames, large integers, infinities, numeric-looking codes and broken JSON."""

import pytest

from dfprofile import profile
from dfprofile.operators.distribution import distribution_sweep
from dfprofile.operators.outliers import outlier_sweep
from dfprofile.operators.quality import constant_columns, duplicate_rows, quality_score
from dfprofile.operators.correlation import pearson_matrix
from dfprofile.operators.distribution import distribution_analysis
from dfprofile.functions.mathx import norm_cdf_sql, ppf_stages
from dfprofile.sources.csv import load_csv
from dfprofile.operators.freq import log_bucket
from dfprofile.functions.columns import numeric_text
from dfprofile.plans.insights import parse_insights
from pyspark.sql import functions as F


def test_sweeps_cover_all_numeric_columns(spark):
    wide = spark.range(40).select(*[F.when(F.col("id") == 39, 1000.0).otherwise(F.col("id") % 7 + i).alias(f"c{i}")
                                    for i in range(25)])
    assert outlier_sweep(wide).count() == 25 and distribution_sweep(wide).count() == 25


def test_large_integers_keep_their_identity(spark):
    df = spark.range(3).select((F.col("id") + F.lit(2 ** 60)).alias("a"), F.lit(2 ** 60).alias("b"))
    assert [r.column_name for r in constant_columns(df).collect()] == ["b"]


def test_infinite_values_have_end_buckets(spark):
    df = spark.createDataFrame([(float("-inf"),), (-1e300,), (0.0,), (1e300,), (float("inf"),)], "x double")
    got = [r.b for r in df.select("x", log_bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert got == sorted(got) and len(set(got)) == 5


def test_type_letters_are_no_numbers(spark):
    df = spark.createDataFrame([("1d",), ("4f",), ("1.D ",), ("12",), ("-1e3",), ("inf",)], "s string")
    assert [r.n for r in df.select(numeric_text(F.col("s")).alias("n")).collect()] == [None, None, None, 12.0, -1000.0, float("inf")]


def test_broken_json_gives_the_fallback(spark):
    df = spark.createDataFrame([('{"executive_summary": "x", "key_findings": ["a"',), ('{"executive_summary": "x"}',)], "response string")
    assert [r.parsed for r in parse_insights(df).collect()] == [False, True]


def test_trend_needs_a_time_column(spark):
    assert profile(spark.range(20), analyses=("trend",)).trends() is None  # no time column


def test_pearson_is_null_where_a_pair_is_constant_or_infinite(spark):
    rows = [(0.1, 1.0, 1.0), (0.1, 2.0, 5.0), (0.1, 4.0, float("inf")), (0.3, None, 2.0), (None, 3.0, 9.0)]
    m = {(r.column1, r.column2): r.correlation for r in
         pearson_matrix(spark.createDataFrame(rows, "x double, y double, z double")).collect()}
    assert m["x", "y"] is None and m["y", "z"] is None and m["z", "z"] is None and m["x", "x"] == m["y", "y"] == 1.0


def test_duplicates_tell_nulls_in_different_columns_apart(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (None, None), (1, None)], "a int, b int")
    assert tuple(duplicate_rows(df).collect()[0]) == (1, 4)
    plan = quality_score(df)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shapiro_runs_at_any_size_on_demand(spark):
    df = spark.range(6000).select((F.col("id") % 11).cast("double").alias("x"))
    got = {t: distribution_analysis(df, ["x"], test=t).collect()[0].normality_test for t in ("auto", "shapiro", "ks")}
    assert got == {"auto": "ks", "shapiro": "shapiro", "ks": "ks"}


def test_normal_distribution_functions_against_the_standard_library(spark):
    from statistics import NormalDist

    zs = [-6.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.96, 5.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").withColumn("p", F.expr(norm_cdf_sql("z")))
    for r in ppf_stages(df, "p", "back").collect():
        assert r.p == pytest.approx(NormalDist().cdf(r.z), rel=1e-9)
        assert r.back == pytest.approx(r.z, abs=1e-7)


def test_csv_folder_and_glob(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a,b\n" + "".join(f"{i * 10 + j},x{j}\n" for j in range(10)))
    for path in (str(tmp_path), f"{tmp_path}/*.csv"):
        df = load_csv(spark, path)
        assert df.count() == 30 and dict(df.dtypes) == {"a": "bigint", "b": "string"}


def test_report_holds_all_statistics_and_sections(spark):
    df = spark.range(40).select("id", (F.col("id") % 3).cast("string").alias("kind"), F.lit("ab").alias("word"))
    row = profile(df, row_key="id").report("job").collect()[0]
    stats = {c.name: c.stats for c in row.column_statistics}
    assert stats["id"].q1 == 9.75 and stats["id"].iqr == 19.5 and stats["word"].frequency == 40
    assert row.data_quality.duplicate_rows == 0 and [t.value for t in row.top_categories if t.column_name == "word"] == ["ab"]
