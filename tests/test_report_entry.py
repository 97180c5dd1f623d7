from dfprofile.plans.chart_plan import chart_plan_rows
from dfprofile.plans.report import profile


def test_f6_pipeline(spark):
    df = spark.createDataFrame([(a, 2 * a) for a in range(1, 11)], "a bigint, b bigint")
    p = profile(df)
    r = p.report(job_id="t").collect()[0]
    assert r.row_count == 10 and r.column_count == 2
    assert len(r.column_statistics) == 2
    assert r.strong_correlations[0].correlation == 1.0
    p.release()


def test_f7_chart_plan():
    rows = chart_plan_rows({"a": "numeric", "b": "numeric", "category": "categorical"})
    assert [r[1] for r in rows] == ["histogram", "boxplot", "histogram", "boxplot", "heatmap",
                                    "bar_chart", "pairplot"]
    many = {f"c{i}": "numeric" for i in range(10)}
    assert len(chart_plan_rows(many)) == 20
    assert {r[1] for r in chart_plan_rows(many)} == {"histogram", "boxplot"}


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 8
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def test_i6_selection_and_i7_overrides(spark):
    df = spark.createDataFrame([(float(a), float(a * a), "x" if a % 2 else "y") for a in range(1, 31)],
                               "a double, b double, c string")
    only = profile(df, analyses=["descriptive"])
    assert only.correlation() is None and only.outliers() is None and only.distributions() is None
    r = profile(df, overrides={"correlation_method": "spearman", "outlier_method": "zscore"})
    rep = r.report(job_id="x").collect()[0]
    assert rep.correlation_method == "spearman"
    m = {(x.column1, x.column2): x.correlation for x in rep.correlation_matrix}
    assert m[("a", "b")] == 1.0  # monotone -> Spearman 1
    try:
        profile(df, analyses=["nope"])
    except ValueError:
        pass
    else:
        raise AssertionError("expected ValueError")


def test_s9_s10_sink_and_retention(spark):
    import datetime as dt
    import uuid

    from dfprofile.session import ensure_checkpoint_dir
    from dfprofile.sources.sink import read_report, retention, write_report

    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/reports-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(a, 2 * a) for a in range(1, 11)], "a bigint, b bigint")
    rep = profile(df).report(job_id="j1")
    now = dt.datetime(2026, 1, 10)
    write_report(rep, path, "j1", completed_at=now - dt.timedelta(days=1))
    write_report(rep, path, "j2", completed_at=now - dt.timedelta(days=30))
    got = read_report(spark, path, "j1").collect()
    assert len(got) == 1 and got[0].row_count == 10
    kept, expired, counts = retention(spark.read.parquet(path), 7, now)
    c = counts.collect()[0]
    assert (c.kept_count, c.expired_count) == (1, 1)
    assert [r.job_id for r in expired.collect()] == ["j2"]


def test_column_names_with_spaces_and_dots(spark):
    df = spark.createDataFrame([(float(i), i % 3, f"c{i % 4}") for i in range(40)],
                               "`sales amount` double, `a.b` int, `region name` string")
    p = profile(df)
    r = p.report(job_id="x").collect()[0]
    assert [c.column_name for c in r.columns] == ["sales amount", "a.b", "region name"]
    stats = {s.name: s for s in r.column_statistics}
    assert stats["sales amount"].stats.mean == 19.5 and stats["a.b"].stats.max == 2.0
    assert stats["region name"].stats.unique_count == 4
    from dfprofile.operators.charts import pairplot_sample, scatter_points
    from dfprofile.operators.kendall import kendall_matrix
    assert scatter_points(df, "sales amount", "a.b", "region name").count() == 40
    assert pairplot_sample(df).count() == 40
    assert len(kendall_matrix(df, ["sales amount", "a.b"]).collect()) == 4
    p.release()
