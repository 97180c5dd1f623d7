"""CSV source (S1-S5): load, validate, type.

A first pass over the lines finds each file's header and whether fields span
lines; only files of which that holds are read unsplit.  Files are then read with
every column as a string (no schema inference pass), aligned by name; a field
behind the last column refuses the input.  The pandas NA tokens become NULL, and
the semantic type decision (S6) — computed in one aggregate over distinct values —
casts numeric / boolean / datetime columns.  Validation reads only counts and the
header (repeated names are told by the header itself).
"""

from __future__ import annotations

import csv
import io
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import numeric_text, qcol
from ..operators.freq import unpivot_pairs

# Strings pandas ``read_csv`` treats as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Strings pandas parses as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


class FileValidationError(Exception):
    """Missing, unreadable or invalid input file."""


class DataLimitExceeded(FileValidationError):
    """More columns (or rows) than the configured limit."""


class InsufficientData(FileValidationError):
    """Empty input or fewer rows than the minimum."""


class DataValidationError(FileValidationError):
    """Structural problem such as duplicate column names."""


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the file, folder or glob names anything."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hpath)
    return found is not None and len(found) > 0


EXTRA, FILE = "__extra_field", "__file"  # helper columns of a raw scan
MAX_LAYOUTS = 1000

# Quotes are doubled inside quoted fields; all fields of a row are read, so that rows
# with another number of fields are told whatever columns are asked for.
PARSER = {"header": True, "mode": "PERMISSIVE", "escape": '"', "nullValue": "", "emptyValue": "",
          "columnPruning": False, "columnNameOfCorruptRecord": EXTRA}


class Layout(NamedTuple):
    """Files that share a header; ``files`` is None if they are all there are."""
    header: list[str]
    multi_line: bool
    files: list[str] | None
    first: str


def _first_record(spark: SparkSession, file: str) -> list[str]:
    """The header of a file whose names hold line breaks."""
    row = spark.read.options(**{**PARSER, "header": False}).option("multiLine", True).csv(file).first()
    return [c or "" for c in row] if row else []


def layouts(spark: SparkSession, path: str) -> list[Layout]:
    """The headers found at ``path`` and the files that hold each, by one pass over
    the lines: a row per file is aggregated, a row per distinct header collected.
    Lines with an odd number of quotes tell that fields span lines."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    per_file = (lines.where(F.trim("value") != "").groupBy("file")
                .agg(F.min_by("value", "at").alias("header"), F.max(odd).alias("spread")))
    spread_header = F.length(F.regexp_replace("header", '[^"]', "")) % 2 == 1
    # a header that is cut by a line break is known only after parsing its file
    kind = F.when(spread_header, F.col("file"))
    kinds = (per_file.groupBy("header", "spread", kind.alias("own"))
             .agg(F.min("file").alias("first")).orderBy("first").limit(MAX_LAYOUTS + 1).collect())
    if len(kinds) > MAX_LAYOUTS:
        raise FileValidationError(f"more than {MAX_LAYOUTS} different headers at {path}")
    out = []
    for r in kinds:
        files = None
        if len(kinds) > 1:  # names of files, as the scan's own listing holds them
            mine = per_file.where((F.col("header") == r["header"]) & (F.col("spread") == r["spread"])
                                  & kind.eqNullSafe(F.lit(r["own"])))
            files = sorted(unquote(f["file"]) for f in mine.select("file").collect())
        first = unquote(r["first"])
        names = (_first_record(spark, first) if r["own"]
                 else next(csv.reader(io.StringIO(r["header"]))))
        names = [names[0].lstrip("\ufeff"), *names[1:]]
        out.append(Layout(names, r["spread"], files, first))
    return out


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names exactly as written in the (first) header."""
    found = layouts(spark, path)
    return found[0].header if found else []


def _column_names(header: list[str]) -> list[str]:
    """Names unique without regard to case: repeated ones get their position."""
    low = [h.lower() for h in header]
    return [h if low.count(h.lower()) == 1 else f"{h}{i}" for i, h in enumerate(header)]


def _scan(spark: SparkSession, path: str, lay: Layout) -> DataFrame:
    """One layout's rows as strings; ``EXTRA`` holds the whole row where it has more fields than
    the header (quoted fields are taken out, then separators counted)."""
    n = len(lay.header)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)]
                          + [T.StructField(EXTRA, T.StringType())])
    raw = (spark.read.options(**PARSER).option("multiLine", lay.multi_line).schema(schema)
           .csv(lay.files or path))
    names = _column_names(lay.header)
    separators = F.length(F.regexp_replace(F.regexp_replace(EXTRA, '"([^"]|"")*"', ""), "[^,]", ""))
    return raw.select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(names)],
                      F.when(separators >= n, F.col(EXTRA)).alias(EXTRA),
                      F.col("_metadata.file_path").alias(FILE))


def scan_csv(spark: SparkSession, path: str, found: list[Layout] | None = None) -> DataFrame:
    """All columns as strings with NA tokens folded to NULL, plus ``EXTRA`` and ``FILE``.

    Files with the same names in another order are aligned by name; files with
    other names are refused.  Rows with fewer fields end in NULLs."""
    found = found if found is not None else layouts(spark, path)
    if not found:
        raise InsufficientData(f"no header at {path}")
    names = _column_names(found[0].header)
    out = None
    for lay in found:
        if sorted(lay.header) != sorted(found[0].header):
            raise FileValidationError(
                f"{lay.first}: columns {lay.header} differ from {found[0].header} in {found[0].first}")
        if lay.header != found[0].header and len(set(lay.header)) < len(lay.header):
            raise DataValidationError(f"{lay.first}: repeated column names in another order")
        part = _scan(spark, path, lay)
        out = part if out is None else out.unionByName(part)
    return out.select(*[F.when(qcol(c).isin(NA_TOKENS), F.lit(None).cast("string"))
                        .otherwise(qcol(c)).alias(c) for c in names], EXTRA, FILE)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings with NA tokens folded to NULL."""
    return scan_csv(spark, path).drop(EXTRA, FILE)


def _refuse_extra_fields(raw: DataFrame) -> None:
    """Rows with more fields than the header raise, as with pandas."""
    bad = raw.agg(F.count(EXTRA).alias("n"), F.min(F.when(F.col(EXTRA).isNotNull(), F.col(FILE))).alias("f"),
                  F.count(qcol(raw.columns[0]))).first()
    if bad["n"]:
        raise FileValidationError(f"{bad['n']} rows with more fields than columns, e.g. in {unquote(bad['f'])}")


def type_columns(df: DataFrame, config: ProfileConfig = DEFAULT, facts=None) -> DataFrame:
    """Cast string columns by their semantic type: integral strings to bigint,
    other numerics to double (D5), pandas boolean tokens to boolean, datetimes
    to timestamp; everything else stays a string."""
    from ..operators.schema import SchemaFacts

    f = facts or SchemaFacts(df, config)
    tmap = f.type_map()
    strings = [c for c, t in f.types.items() if t.simpleString() == "string"]
    bool_like = {}
    integral = {}
    if strings:
        # Long form: one Expand and a per-column aggregate (code size does not
        # grow with the number of columns).
        tokens = TRUE_TOKENS + FALSE_TOKENS
        long = unpivot_pairs(df, strings, {"v": lambda c: qcol(c)})
        v = F.col("v")
        got = {r[0]: (r[1], r[2]) for r in long.groupBy("column_name").agg(
            F.count(F.when(~v.isin(tokens), 1)),
            F.count(F.when(numeric_text(v).isNotNull() & v.try_cast("bigint").isNull(), 1))
        ).collect()}
        bool_like = {c: got.get(c, (0, 0))[0] == 0 for c in strings}
        integral = {c: got.get(c, (0, 0))[1] == 0 for c in strings}
    out = []
    for c in df.columns:
        x = qcol(c)
        t = tmap.get(c)
        has_values = f.rows()[df.columns.index(c)][4] < f.row_count()
        if bool_like.get(c) and has_values:
            out.append(F.when(x.isNull(), None).otherwise(x.isin(TRUE_TOKENS)).alias(c))
        elif c in integral and t == "numeric":
            out.append((x.try_cast("bigint") if integral[c] else numeric_text(x)).alias(c))
        elif c in strings and t == "datetime":
            out.append(x.try_cast("timestamp").alias(c))
        else:
            out.append(x.alias(c))
    return df.select(*out)


def validation_checks(df: DataFrame, header: list[str] | None = None,
                      config: ProfileConfig = DEFAULT) -> DataFrame:
    """S4/S5 as rows ``check, status, detail``: emptiness, minimum rows, column
    limit, all-NULL columns (warning) and duplicate column names."""
    spark = df.sparkSession
    cols = df.columns
    # Long form: per-column non-null counts from one Expand + group-by.
    flags = unpivot_pairs(df, cols, {"present": lambda c: qcol(c).isNotNull().cast("int")})
    per = {r[0]: (r[1], r[2]) for r in flags.groupBy("column_name").agg(
        F.count(F.lit(1)), F.sum("present")).collect()}
    n = next(iter(per.values()))[0] if per else df.count()
    all_null = [c for c in cols if (per.get(c, (0, 0))[1] or 0) == 0]
    names = header if header is not None else cols
    seen, dups = set(), []
    for c in names:
        if c in seen and c not in dups:
            dups.append(c)
        seen.add(c)
    rows = [
        ("not_empty", "pass" if n > 0 else "fail", f"{n} rows"),
        ("min_rows", "pass" if n >= config.min_rows else "fail",
         f"{n} rows, minimum {config.min_rows}"),
        ("column_limit", "pass" if len(names) <= config.max_columns else "fail",
         f"{len(names)} columns, limit {config.max_columns}"),
        ("all_null_columns", "warn" if all_null else "pass", ",".join(all_null)),
        ("duplicate_names", "fail" if dups else "pass", ",".join(dups)),
    ]
    return spark.createDataFrame(rows, "check string, status string, detail string")


def _raise_on(checks: list) -> None:
    by = {r[0]: r for r in checks}
    if by["column_limit"][1] == "fail":
        raise DataLimitExceeded(by["column_limit"][2])
    if by["not_empty"][1] == "fail" or by["min_rows"][1] == "fail":
        raise InsufficientData(by["min_rows"][2])
    if by["duplicate_names"][1] == "fail":
        raise DataValidationError(f"repeated column names: {by['duplicate_names'][2]}")


def head_sample(df: DataFrame, n: int, row_key: str | None = None) -> DataFrame:
    """The first ``n`` rows in key order (file order without a key); a
    per-partition top-n and a merge, never a full sort."""
    key = qcol(row_key) if row_key else F.monotonically_increasing_id()
    return (df.withColumn("__pos", key).orderBy("__pos").limit(n).drop("__pos"))


def load_csv(spark: SparkSession, path: str, sample_size: int | None = None,
             config: ProfileConfig = DEFAULT, typed: bool = True) -> DataFrame:
    """Validated, typed DataFrame from a CSV file with a header, or from a
    folder or glob of files with the same columns in any order.

    Raises ``FileValidationError`` (or a subclass) like the reference: missing
    path, too many columns, too few rows, duplicate names, rows with more
    fields than columns (among the rows kept); also files with other columns.
    ``sample_size`` keeps the first rows of the file (S2); ``max_rows`` in the
    config truncates whenever set (S3, D13).
    """
    try:
        exists = _exists(spark, path)
    except Exception as e:  # noqa: BLE001
        raise FileValidationError(f"cannot look at {path}: {e}") from e
    if not exists:
        raise FileValidationError(f"nothing at {path}")
    try:
        found = layouts(spark, path)
        header = found[0].header if found else []
        if len(header) > config.max_columns:
            raise DataLimitExceeded(f"{len(header)} columns, limit {config.max_columns}")
        raw = scan_csv(spark, path, found)
        limit = sample_size or config.max_rows
        if limit:
            raw = head_sample(raw, limit)
        _refuse_extra_fields(raw)
        df = raw.drop(EXTRA, FILE)
        checks = [tuple(r) for r in validation_checks(df, header, config).collect()]
        _raise_on(checks)
        return type_columns(df, config) if typed else df
    except FileValidationError:
        raise
    except Exception as e:  # noqa: BLE001
        raise FileValidationError(f"cannot read {path} as CSV: {e}") from e
