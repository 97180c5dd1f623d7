from conftest import rows_by
from dfprofile.operators.categorical import categorical_stats, top_categories, value_counts
from dfprofile.operators.quality import constant_columns, duplicate_rows, quality_score


def test_e6_top_k_ties_by_value(spark):
    df = spark.createDataFrame([(c,) for c in "babac"], "c string")
    top = [(r.rank, r.value, r["count"]) for r in top_categories(df, ["c"], 20).orderBy("rank").collect()]
    assert top == [(1, "a", 2), (2, "b", 2), (3, "c", 1)]
    st = rows_by(categorical_stats(df, ["c"]))["c"]
    assert (st["unique_count"], st["most_frequent"], st["frequency"]) == (3, "a", 2)


def test_value_counts_skip_nulls(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",)], "c string")
    assert [(r.value, r["count"]) for r in value_counts(df).collect()] == [("x", 2)]


def test_empty_categorical_column(spark):
    df = spark.createDataFrame([(None,)] * 3, "c string")
    st = rows_by(categorical_stats(df, ["c"]))["c"]
    assert st["unique_count"] == 0 and st["most_frequent"] is None


def test_e12_duplicates_with_nulls(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,)], "x int")
    r = duplicate_rows(df).collect()[0]
    assert (r.duplicate_rows, r.row_count) == (2, 4)


def test_quality_score(spark):
    rows = [(1, "a", None), (1, "a", None), (1, "b", 2.0), (1, "c", 3.0)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    r = quality_score(df).collect()[0]
    # missing 2/12 = 16.67 %, duplicates 1/4 = 25 % -> 20, one constant column -> 5
    assert r.missing_data_percentage == 16.67
    assert r.duplicate_rows == 1 and r.duplicate_percentage == 25.0
    assert r.constant_columns == 1
    assert r.overall_score == round(100 - 100 * 2 / 12 - 20 - 5, 2)
    assert r.assessment == "poor"  # 58.33 < 60
    assert [x.column_name for x in constant_columns(df).collect()] == ["k"]
