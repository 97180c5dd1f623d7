import random

from conftest import rows_by
from dfprofile.operators.outliers import detect_outliers, outlier_sweep
from dfprofile.plans.insights import parse_insights


def test_f4_iqr_and_zscore(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 3, 4, 5, 100])],
                               "k bigint, x double")
    iqr = rows_by(detect_outliers(df, ["x"], "iqr", row_key="k"))["x"]
    assert iqr["outlier_count"] == 1 and iqr["outlier_keys"] == [5]
    assert iqr["outlier_percentage"] == 16.67
    z = rows_by(detect_outliers(df, ["x"], "zscore", row_key="k"))["x"]
    assert z["outlier_count"] == 0 and z["method"] == "zscore"


def test_unknown_method_raises(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    try:
        detect_outliers(df, ["x"], "nope")
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_sweep_keeps_positive(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(20)] + [(500.0, 1.0)], "a double, b double")
    assert [r.column_name for r in outlier_sweep(df).collect()] == ["a"]


def test_isolation_forest_flags_extreme(spark):
    random.seed(9)
    vals = [random.gauss(0, 1) for _ in range(600)] + [25.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k bigint, x double")
    r = rows_by(detect_outliers(df, ["x"], "isolation_forest", row_key="k"))["x"]
    assert 0 < r["outlier_count"] <= 61
    assert 600 in r["outlier_keys"]


def test_trend(spark):
    import datetime as dt
    from dfprofile.operators.trend import seasonality, trend_fit, trend_series
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=6 * i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    s = trend_series(df, "ts", "v").orderBy("bucket").collect()
    assert len(s) == 10 and s[0].n == 4 and s[0].mean_value == 1.5
    f = trend_fit(df, "ts", "v").collect()[0]
    assert f.slope == 4.0 and f.r2 == 1.0 and f.direction == "increasing"
    per = {(r.period, r.slot): r.n for r in seasonality(df, "ts", "v").collect()}
    assert per[("hour", 0)] == 10 and per[("weekday", 0)] == 8  # Mondays: Jan 1 and Jan 8


def test_f9_e11_parse_insights(spark):
    good = '{"executive_summary": "ok", "key_findings": ["f"], "data_quality_assessment": "q", ' \
           '"insights": [{"title": "t"}], "recommendations": ["r"]}'
    rows = [(1, good), (2, "```json\n" + good + "\n```"), (3, "not json at all"), (4, '{"key_findings": []}')]
    df = spark.createDataFrame(rows, "id int, response string")
    out = {r.id: r for r in parse_insights(df).collect()}
    assert out[1].parsed and out[1].executive_summary == "ok"
    it = out[1].insights[0]
    assert (it.category, it.title, it.description, it.severity, it.affected_columns) == \
        ("general", "t", "", "info", [])
    assert out[2].parsed and out[2].key_findings == ["f"]
    assert not out[3].parsed and out[3].insights[0].description == "not json at all"
    assert out[3].executive_summary == "Analysis completed with limited insight generation."
    assert out[4].parsed and out[4].executive_summary == "" and out[4].recommendations == []
