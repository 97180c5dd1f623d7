import random

import numpy as np
import pytest

from conftest import rows_by
from dfprofile.operators.charts import boxplot_stats, histogram_data, kde_curve
from dfprofile.operators.distribution import distribution_analysis


def _col(spark, vals):
    return spark.createDataFrame([(float(v),) for v in vals], "x double")


def test_e10_boundaries(spark):
    random.seed(11)
    out = {}
    for n in (19, 20, 5000, 5001):
        df = _col(spark, [random.gauss(0, 1) for _ in range(n)])
        out[n] = rows_by(distribution_analysis(df))["x"]
    assert out[19]["distribution_type"] == "unknown" and out[19]["is_normal"] is False
    assert out[19]["normality_test"] is None
    assert out[20]["normality_test"] == "shapiro" and out[5000]["normality_test"] == "shapiro"
    assert out[5001]["normality_test"] == "ks"
    assert out[5000]["is_normal"] is True and out[5001]["is_normal"] is True


def test_shapiro_rejects_skewed(spark):
    random.seed(2)
    df = _col(spark, [random.expovariate(1.0) for _ in range(300)])
    r = rows_by(distribution_analysis(df))["x"]
    assert r["distribution_type"] == "right_skewed"
    assert r["is_normal"] is False and r["normality_p_value"] < 0.001
    assert 0.5 < r["normality_test_statistic"] < 0.95


def test_histogram_matches_numpy_continuous(spark):
    rng = np.random.default_rng(4)
    vals = rng.normal(50, 10, 2000)
    h = histogram_data(_col(spark, vals)).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins="auto")
    got = {r.bin: r["count"] for r in h}
    assert len(edges) - 1 == max(got) + 1
    assert [got.get(i, 0) for i in range(len(counts))] == counts.tolist()


def test_kde_matches_direct_sum(spark):
    rng = np.random.default_rng(8)
    vals = rng.normal(0, 1, 300).round(3)
    k = kde_curve(_col(spark, vals)).orderBy("point").collect()
    h = vals.std(ddof=1) * len(vals) ** (-0.2)
    grid = np.linspace(vals.min(), vals.max(), 100)
    dens = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / h) ** 2).sum(1) / (len(vals) * h * np.sqrt(2 * np.pi))
    assert len(k) == 100
    assert [r.density for r in k] == pytest.approx(dens.tolist(), abs=1e-7)


def test_boxplot_whiskers(spark):
    df = _col(spark, [1, 2, 3, 4, 5, 100])
    r = rows_by(boxplot_stats(df))["x"]
    assert (r["whislo"], r["whishi"], r["fliers"]) == (1.0, 5.0, 1)


def test_histogram_lists_empty_bins_like_numpy(spark):
    rng = np.random.default_rng(12)
    vals = np.concatenate([rng.normal(0, 1, 500), rng.normal(40, 1, 500)])
    h = histogram_data(_col(spark, vals)).orderBy("bin").collect()
    counts, edges = np.histogram(vals, bins="auto")
    assert 0 in counts.tolist()
    assert [r["count"] for r in h] == counts.tolist()
    assert h[0].bin_start == round(edges[0], 4) and h[-1].bin_end == round(edges[-1], 4)
