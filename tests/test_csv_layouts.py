"""CSV folders whose files differ, malformed rows, and fields that span lines."""

import pytest

from dfprofile.sources.csv import (DataValidationError, FileValidationError, InsufficientData, layouts,
                                   load_csv, read_csv_strings, read_header)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_extra_fields_are_refused(spark, tmp_path):
    good = "".join(f"{i},x{i}\n" for i in range(20))
    (tmp_path / "f.csv").write_text("a,b\n" + good + "99,y,EXTRA\n")
    with pytest.raises(FileValidationError, match="1 rows with more fields"):
        load_csv(spark, str(tmp_path / "f.csv"))
    assert load_csv(spark, str(tmp_path / "f.csv"), sample_size=15).count() == 15  # not among the rows kept
    (tmp_path / "g.csv").write_text("a,b\n" + good + "99,y,\n")  # an empty field is one too
    with pytest.raises(FileValidationError):
        load_csv(spark, str(tmp_path / "g.csv"))
    (tmp_path / "h.csv").write_text("a,b\n" + good + "99\n\n")  # fewer fields end in NULL, blank lines go
    assert (99, None) in [tuple(r) for r in load_csv(spark, str(tmp_path / "h.csv")).collect()]


def test_other_column_order_is_aligned_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(10)))
    (tmp_path / "2.csv").write_text("b,a\n" + "".join(f"y{i},{i + 10}\n" for i in range(10)))
    (tmp_path / "3 empty.csv").write_text("")
    df = load_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string"}
    assert _rows(df) == [(i, f"x{i}") for i in range(10)] + [(i + 10, f"y{i}") for i in range(10)]
    (tmp_path / "4 other.csv").write_text("a,c\n1,2\n")
    with pytest.raises(FileValidationError, match="differ"):
        load_csv(spark, str(tmp_path))


def test_line_breaks_in_fields_and_header(spark, tmp_path):
    body = "".join(f'{i},"line {i}\nsays ""{i}"", so"\n' for i in range(12))
    (tmp_path / "f.csv").write_text('a,"b\nc"\n' + body)
    assert read_header(spark, str(tmp_path / "f.csv")) == ["a", "b\nc"]
    df = load_csv(spark, str(tmp_path / "f.csv"))
    assert df.columns == ["a", "b\nc"]
    assert _rows(df) == [(i, f'line {i}\nsays "{i}", so') for i in range(12)]
    (tmp_path / "g.csv").write_text('"b\nc",a\n' + "".join(f"z,{i}\n" for i in range(12, 20)))
    assert _rows(load_csv(spark, str(tmp_path)))[12:] == [(i, "z") for i in range(12, 20)]
    assert sorted(x.multi_line for x in layouts(spark, str(tmp_path))) == [True, True]


def test_header_signs_and_repeated_names(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("\ufeffa,b c\r\n".encode() + b"".join(b"%d,NA\r\n" % i for i in range(12)))
    raw = read_csv_strings(spark, str(tmp_path / "f.csv"))
    assert raw.columns == ["a", "b c"] and raw.where("`b c` is null").count() == 12
    (tmp_path / "g.csv").write_text("a,a\n" + "1,2\n" * 12)
    with pytest.raises(DataValidationError):
        load_csv(spark, str(tmp_path / "g.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(InsufficientData):
        load_csv(spark, str(tmp_path / "empty.csv"))
