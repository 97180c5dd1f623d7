import math

import duckdb
import numpy as np
import pytest

from conftest import rows_by
from dfprofile.functions.mathx import ks_sf_sql, ks_stages
from dfprofile.operators.distribution import distribution_analysis
from dfprofile.operators.sketch import RANK_ERROR, UNIQUE_ERROR, approx_stats, column_sketches, merge_sketches


def exact_sf(n, d):
    """P(D_n > d) from the power of a matrix of transition weights (Durbin's recursion)."""
    k = int(math.ceil(n * d))
    h = k - n * d
    m = 2 * k - 1
    t = np.tril(np.ones((m, m)), 1)
    edge = 1 - h ** np.arange(1, m + 1)
    t[:, 0] = edge
    t[m - 1, :] = edge[::-1]
    t[m - 1, 0] = 1 - 2 * h ** m + (max(0.0, 2 * h - 1) ** m)
    for i in range(m):
        for j in range(min(i + 2, m)):
            t[i, j] /= math.factorial(i - j + 1) if i >= j else 1
    p, scale = np.eye(m), 0.0
    for i in range(1, n + 1):
        p = p @ t * (i / n)
        top = p.max()
        p /= top
        scale += math.log(top)
    return 1 - p[k - 1, k - 1] * math.exp(scale)


def series(n, d):
    con = duckdb.connect()
    stages = ", ".join(f"{e} AS {name}" for name, e in ks_stages("z", "n"))
    return con.execute(f"SELECT {ks_sf_sql('z')} FROM (SELECT *, {stages} FROM (SELECT {float(n)!r}::DOUBLE AS n, "
                       f"{math.sqrt(n) * d!r}::DOUBLE AS z) a) b").fetchone()[0]


@pytest.mark.parametrize("n", [20, 50, 100, 400, 1000])
def test_ks_tail_against_the_exact_recursion(n):
    for lam in (0.4, 0.5, 0.6, 0.8, 1.0, 1.2, 1.6):  # the series ends with the term in 1 / n^1.5
        d = lam / math.sqrt(n)
        assert abs(series(n, d) - exact_sf(n, d)) < 0.1 / n ** 2


def test_ks_tail_published_values():
    # Marsaglia, Tsang and Wang (2003), P(D_n < d).
    for n, d, cdf in ((2000, 0.04, 0.99676943191713676985), (16000, 0.016, 0.99945234913828052085)):
        assert abs(1 - series(n, d) - cdf) < 1e-9
    assert abs(1 - exact_sf(10, 0.274) - 0.6284796154565) < 1e-9
    assert series(10 ** 6, 1e-5) == pytest.approx(1.0) and series(10 ** 6, 0.5) == 0.0


def test_ks_p_value_of_a_column(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = rows_by(distribution_analysis(df, test="ks"))["x"]
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    d = max((np.arange(1, 301) / 300 - cdf).max(), (cdf - np.arange(300) / 300).max())
    assert r["normality_test_statistic"] == round(d, 4)
    assert abs(r["normality_p_value"] - exact_sf(300, d)) < 6e-5


def _parts(spark):
    df = spark.range(0, 40_000, numPartitions=6).selectExpr(
        "id % 3 AS day", "CAST((id * 7919) % 20011 AS DOUBLE) AS x", "1152921504606846976 + id AS big",
        "CASE WHEN id % 2 = 0 THEN concat('t', id % 500) END AS `a text`",
        "CASE WHEN id % 4 = 0 THEN CAST('NaN' AS DOUBLE) END AS none", "CASE WHEN id % 2 = 0 THEN -0.0D ELSE 0.0D END AS zero")
    return df


def test_merged_sketches_stay_within_their_errors(spark):
    df = _parts(spark)
    cols = ["x", "big", "a text", "none", "zero"]
    daily = column_sketches(df, cols, by=["day"])
    assert daily.count() == 3 * len(cols)
    old, new = daily.where("day < 2").drop("day"), daily.where("day = 2").drop("day")
    got = rows_by(approx_stats(merge_sketches(old, new)))
    whole = rows_by(approx_stats(column_sketches(df, cols)))
    xs = np.sort([(i * 7919) % 20011 for i in range(40_000)])
    for r in (got["x"], whole["x"]):
        assert (r["rows"], r["n"], r["min"], r["max"]) == (40_000, 40_000, xs[0], xs[-1])
        assert r["mean"] == pytest.approx(xs.mean())
        for name, p in (("q1", .25), ("median", .5), ("q3", .75)):
            lo, hi = np.searchsorted(xs, r[name], "left") / len(xs), np.searchsorted(xs, r[name], "right") / len(xs)
            assert lo - RANK_ERROR <= p <= hi + RANK_ERROR
    for c, distinct in (("x", 20011), ("big", 40_000), ("a text", 250), ("none", 0), ("zero", 1)):
        for r in (got[c], whole[c]):
            assert abs(r["unique_count"] - distinct) <= UNIQUE_ERROR * distinct
    assert got["a text"]["n"] == 20_000 and got["a text"]["median"] is None and got["a text"]["min"] is None
    assert (got["none"]["rows"], got["none"]["n"], got["none"]["q1"], got["none"]["mean"]) == (40_000, 0, None, None)


def test_sketches_of_nothing_and_of_clashing_groups(spark):
    df = _parts(spark)
    assert column_sketches(df.where("false"), ["x"]).count() == 0
    with pytest.raises(ValueError):
        column_sketches(df.withColumnRenamed("day", "rows"), ["x"], by=["rows"])


def test_sketches_survive_a_file(spark, tmp_path):
    path = str(tmp_path / "state")
    column_sketches(_parts(spark), ["x"], by=["day"]).write.parquet(path)
    again = rows_by(approx_stats(merge_sketches(spark.read.parquet(path).drop("day"))))
    assert again["x"]["n"] == 40_000
