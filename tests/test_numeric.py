import math
import random

import pandas as pd
import pytest

from conftest import rows_by
from dfprofile.config import ProfileConfig
from dfprofile.operators.numeric import NumericProfile, numeric_stats


def test_f4_hand_values(spark):
    df = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5, 100]], "x bigint")
    r = rows_by(numeric_stats(df))["x"]
    assert r["count"] == 6
    assert r["mean"] == pytest.approx(19.1667)
    assert (r["median"], r["q1"], r["q3"], r["iqr"]) == (3.5, 2.25, 4.75, 2.5)
    assert r["outlier_count"] == 1
    assert r["min"] == 1 and r["max"] == 100


def test_matches_pandas(spark):
    random.seed(1)
    vals = [round(random.gauss(10, 3), 2) for _ in range(500)] + [50.0, -20.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = rows_by(numeric_stats(df))["x"]
    s = pd.Series(vals)
    assert r["mean"] == round(s.mean(), 4)
    assert r["std_dev"] == round(s.std(), 4)
    assert r["variance"] == round(s.var(), 4)
    assert r["skewness"] == pytest.approx(round(s.skew(), 4), abs=1e-4)
    assert r["kurtosis"] == pytest.approx(round(s.kurtosis(), 4), abs=1e-4)
    assert r["q1"] == pytest.approx(round(s.quantile(0.25), 4))
    assert r["q3"] == pytest.approx(round(s.quantile(0.75), 4))
    assert r["median"] == pytest.approx(round(s.median(), 4))
    assert r["mode"] == s.mode().iloc[0]


def test_e1_constant(spark):
    df = spark.createDataFrame([(2.5,)] * 29, "x double")
    r = rows_by(numeric_stats(df))["x"]
    assert (r["std_dev"], r["skewness"], r["kurtosis"], r["outlier_count"]) == (0.0, 0.0, 0.0, 0)


def test_e2_all_null_keeps_row(spark):
    df = spark.createDataFrame([(None, 1.0)] * 5, "x double, y double")
    r = rows_by(numeric_stats(df))
    assert r["x"]["count"] == 0 and r["x"]["mean"] is None and r["x"]["outlier_count"] is None
    assert r["y"]["count"] == 5


def test_e3_one_row(spark):
    df = spark.createDataFrame([(4.0,)], "x double")
    r = rows_by(numeric_stats(df))["x"]
    assert r["std_dev"] is None and r["skewness"] is None and r["kurtosis"] is None
    assert r["mean"] == 4.0


def test_e5_mode_smallest_tie(spark):
    df = spark.createDataFrame([(x,) for x in [3, 1, 1, 3, 2]], "x bigint")
    assert rows_by(numeric_stats(df))["x"]["mode"] == 1.0


def test_e7_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    r = rows_by(numeric_stats(df))["x"]
    assert r["count"] == 1 and r["mean"] == 1.0


def test_bucketed_ranks_are_exact(spark):
    random.seed(7)
    vals = [(random.choice([1.0, 2.0, 2.0, 7.5]) if i % 3 else random.random() * 100,
             float(random.randint(0, 40))) for i in range(3000)]
    df = spark.createDataFrame(vals, "a double, b double")
    one = NumericProfile(df, ["a", "b"])
    many = NumericProfile(df, ["a", "b"], ProfileConfig(rank_bucket_rows=97))
    assert many.n_buckets > 10
    key = lambda rows: sorted((r[0], r[1], r[2], r[-4], r[-3], r[-2], r[-1]) for r in rows)
    assert key(one.summary_rows()) == key(many.summary_rows())
    r1 = sorted(tuple(x) for x in one.ranked().select("column_name", "value", "cum_before").collect())
    r2 = sorted(tuple(x) for x in many.ranked().select("column_name", "value", "cum_before").collect())
    assert r1 == r2
    s = pd.Series([v[0] for v in vals])
    q = {r[0]: r for r in many.summary_rows()}["a"]
    assert q[11] == pytest.approx(s.quantile(0.25)) and q[13] == pytest.approx(s.quantile(0.75))
    assert not math.isnan(q[3])


def test_sketch_bucket_path_exact_on_driver_table(spark):
    """The at-scale rank path (approximate-quantile splits -> Bucketizer ->
    bucket offsets) must give exactly the single-pass statistics."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    base = numeric_stats(df).orderBy("column_name").collect()
    cfg = ProfileConfig(rank_bucket_rows=300)
    p = NumericProfile(df, None, cfg)
    assert p.n_buckets > 10
    scaled = numeric_stats(df, profile=p).orderBy("column_name").collect()
    assert [r.asDict() for r in base] == [r.asDict() for r in scaled]


def test_frequencies_counted_by_groups_of_columns(spark):
    """Few cells a shuffle and a rank partition: the same table, and more partitions than the session's."""
    from dfprofile.config import DEFAULT
    from dfprofile.operators.numeric import NumericProfile

    df = spark.range(300).selectExpr("id % 7 AS a", "id + 9007199254740993 AS big", "CASE WHEN id % 3 > 0 THEN id / 8.0 END AS c",
                                     "CAST(NULL AS double) AS d")
    small = DEFAULT.with_(group_cells=600, sorted_cells=50)
    whole, parted = NumericProfile(df), NumericProfile(df, config=small)
    rows = lambda p: sorted(map(str, p.ranked().select(sorted(p.ranked().columns)).collect()))
    assert rows(parted) == rows(whole)
    for got, want in zip(parted.summary_rows(), whole.summary_rows()):
        assert got == pytest.approx(want)
    assert parted.ranked().rdd.getNumPartitions() == 24  # 4 columns x 300 rows by 50
    for p in (whole, parted):
        p.release()
