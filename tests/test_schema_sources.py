import os
import tempfile

import pytest

from conftest import rows_by
from dfprofile.operators.schema import (SchemaFacts, dataset_summary, infer_types, missing_data,
                                        schema_profile, type_narrowing)
from dfprofile.sources.csv import (FileValidationError, InsufficientData, load_csv,
                                   validation_checks)


def _csv(text):
    d = tempfile.mkdtemp(prefix="dfprofile-test-")
    p = os.path.join(d, "data.csv")
    with open(p, "w") as f:
        f.write(text)
    return p


def test_f1_load_and_schema(spark):
    regions = ["north", "south", "east", "west"]
    lines = ["sales,region,is_active"] + [
        f"{100 + 10 * i},{regions[i % 4]},{'True' if i % 2 else 'False'}" for i in range(12)]
    df = load_csv(spark, _csv("\n".join(lines) + "\n"))
    assert df.count() == 12 and len(df.columns) == 3
    types = {r.column_name: r.data_type for r in infer_types(df).collect()}
    assert types == {"sales": "numeric", "region": "categorical", "is_active": "boolean"}
    assert dict(df.dtypes)["sales"] == "bigint"
    sp = rows_by(schema_profile(df))
    assert sp["region"]["unique_count"] == 4 and sp["sales"]["missing_count"] == 0


def test_f3_missing_file(spark):
    with pytest.raises(FileValidationError):
        load_csv(spark, "/nonexistent/dir/nonexistent.csv")


def test_f2_too_few_rows(spark):
    with pytest.raises(FileValidationError) as e:
        load_csv(spark, _csv("a\n1\n2\n"))
    assert isinstance(e.value, InsufficientData)


def test_e9_tokens_and_duplicate_header(spark):
    rows = ["a,A,b"] + [f"{i},NA,{'null' if i % 2 else 'n/a'}" for i in range(12)]
    path = _csv("\n".join(rows) + "\n")
    df = load_csv(spark, path, typed=False) if False else None
    from dfprofile.sources.csv import read_csv_strings, read_header
    raw = read_csv_strings(spark, path)
    assert raw.where(raw[raw.columns[1]].isNotNull()).count() == 0
    chk = {r.check: r for r in validation_checks(raw, read_header(spark, path)).collect()}
    assert chk["all_null_columns"].status == "warn"
    assert chk["duplicate_names"].status == "pass"  # a and A differ in case
    rows = ["a,a"] + [f"{i},{i}" for i in range(12)]
    with pytest.raises(FileValidationError):
        load_csv(spark, _csv("\n".join(rows) + "\n"))


def test_e8_string_inference(spark):
    rows = [(f"2024-01-{(i % 28) + 1:02d}", str(i * 1.5), str(1990 + i % 3), "x" * 60 + str(i))
            for i in range(40)]
    df = spark.createDataFrame(rows, "d string, n string, y string, t string")
    types = {r.column_name: r.data_type for r in infer_types(df).collect()}
    assert types == {"d": "datetime", "n": "numeric", "y": "numeric", "t": "text"}


def test_all_null_string_is_unknown(spark):
    df = spark.createDataFrame([(None, 1)] * 4, "s string, k int")
    assert SchemaFacts(df).type_map()["s"] == "unknown"


def test_summary_missing_and_narrowing(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (300, None, "a"), (2, 1.25, None), (3, 2.0, "b")],
                               "i bigint, f double, s string")
    s = dataset_summary(df).collect()[0]
    assert (s.row_count, s.column_count, s.total_missing) == (4, 3, 2)
    m = rows_by(missing_data(df))
    assert m["f"]["missing_count"] == 1 and m["f"]["missing_percentage"] == 25.0
    assert m["f"]["high_missing"] is False
    n = rows_by(type_narrowing(df))
    assert n["i"]["recommended_type"] == "smallint"
    assert n["f"]["recommended_type"] == "float"


def test_csv_typing_integral_vs_decimal(spark):
    rows = ["i,d,t,s"] + [f"{k},{k}.5,2024-01-{k + 1:02d},x{k % 3}" for k in range(12)]
    df = load_csv(spark, _csv("\n".join(rows) + "\n"))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "t": "timestamp", "s": "string"}
    assert df.where("d = 3.5").count() == 1


def test_long_text_digest_path(spark):
    from dfprofile.operators.categorical import categorical_stats
    from dfprofile.plans.report import profile

    long_a, long_b = "lorem ipsum " * 20, "dolor sit amet " * 20
    rows = [(long_a if i % 3 else long_b, "k" if i % 2 else None, i) for i in range(30)]
    df = spark.createDataFrame(rows, "t string, c string, i int")
    f = SchemaFacts(df)
    facts = {r[0]: r for r in f.rows()}
    assert facts["t"][5] == 2 and facts["t"][4] == 0          # unique, missing
    assert facts["c"][5] == 1 and facts["c"][4] == 15
    assert f.type_map()["t"] == "categorical"  # 2 / 30 unique < 0.5
    assert "t" not in f.short_value_columns() and "c" in f.short_value_columns()
    p = profile(df)
    got = {r.column_name: (r.unique_count, r.most_frequent, r.frequency)
           for r in p.categorical_stats().collect()}
    exp = {r.column_name: (r.unique_count, r.most_frequent, r.frequency)
           for r in categorical_stats(df, ["t", "c"]).collect()}
    assert got == exp and got["t"] == (2, long_a, 20)
    p.release()


def test_narrowing_apply_and_head_sample(spark):
    from dfprofile.sources.csv import head_sample

    df = spark.createDataFrame([(i, float(i) / 2, "a") for i in range(30)],
                               "i bigint, f double, s string")
    narrowed = type_narrowing(df, apply=True)
    assert dict(narrowed.dtypes) == {"i": "tinyint", "f": "float", "s": "string"}
    assert narrowed.count() == 30
    first = [r.i for r in head_sample(df, 5, row_key="i").collect()]
    assert first == [0, 1, 2, 3, 4]
