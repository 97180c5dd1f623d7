"""DuckDB SQL oracles for the registered queries (test support).

Each generator returns plain SQL over the driver's pre-registered views, written
independently of the Spark code path (window functions and exact aggregates on
one machine) so that the two sides check each other.
"""

from __future__ import annotations


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def cols_values(cols: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(cols)) + ") t(column_name, ord)"


def numeric_long_sql(source: str, cols: list[str]) -> str:
    """``(column_name, value)`` long form of numeric columns, NULLs dropped."""
    parts = [f"SELECT '{c}' AS column_name, CAST({_q(c)} AS DOUBLE) AS value FROM {source}"
             for c in cols]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") u WHERE value IS NOT NULL AND NOT isnan(value)"


def numeric_stats_sql(source: str, cols: list[str], threshold: float = 1.5, d: int = 4) -> str:
    return f"""
WITH cols AS (SELECT * FROM {cols_values(cols)}),
long AS ({numeric_long_sql(source, cols)}),
agg AS (
  SELECT column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
         var_samp(value) AS var, min(value) AS mn, max(value) AS mx,
         quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
         quantile_cont(value, 0.75) AS q3
  FROM long GROUP BY column_name),
mom AS (
  SELECT l.column_name, avg(power(l.value - a.mean, 2)) AS m2,
         avg(power(l.value - a.mean, 3)) AS m3, avg(power(l.value - a.mean, 4)) AS m4
  FROM long l JOIN agg a USING (column_name) GROUP BY l.column_name),
f AS (SELECT column_name, value, count(*) AS cnt FROM long GROUP BY column_name, value),
md AS (
  SELECT column_name, value AS mode FROM (
    SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM f)
  WHERE rn = 1),
oc AS (
  SELECT l.column_name,
         count(*) FILTER (WHERE l.value < a.q1 - {threshold} * (a.q3 - a.q1)
                           OR l.value > a.q3 + {threshold} * (a.q3 - a.q1)) AS oc
  FROM long l JOIN agg a USING (column_name) GROUP BY l.column_name)
SELECT c.column_name, CAST(coalesce(a.n, 0) AS BIGINT) AS "count",
  round(a.mean, {d}) AS mean, round(a.med, {d}) AS median, round(md.mode, {d}) AS mode,
  round(a.sd, {d}) AS std_dev, round(a.var, {d}) AS variance,
  round(a.mn, {d}) AS "min", round(a.mx, {d}) AS "max",
  round(a.q1, {d}) AS q1, round(a.q3, {d}) AS q3, round(a.q3 - a.q1, {d}) AS iqr,
  round(CASE WHEN a.n < 3 THEN NULL WHEN a.mn = a.mx THEN 0.0
        ELSE m.m3 / power(m.m2, 1.5) * sqrt(a.n * (a.n - 1.0)) / (a.n - 2.0) END, {d}) AS skewness,
  round(CASE WHEN a.n < 4 THEN NULL WHEN a.mn = a.mx THEN 0.0
        ELSE (a.n - 1.0) / ((a.n - 2.0) * (a.n - 3.0)) * ((a.n + 1.0) * (m.m4 / (m.m2 * m.m2) - 3.0) + 6.0)
        END, {d}) AS kurtosis,
  CAST(CASE WHEN coalesce(a.n, 0) > 0 THEN coalesce(oc.oc, 0) END AS BIGINT) AS outlier_count
FROM cols c LEFT JOIN agg a USING (column_name) LEFT JOIN mom m USING (column_name)
  LEFT JOIN md USING (column_name) LEFT JOIN oc USING (column_name)
"""


# ---- schema family ---------------------------------------------------------

def _type_case(spark_type: str) -> str:
    """SQL for the S6 decision list over a long CTE with string ``value``."""
    if spark_type.startswith("timestamp") or spark_type == "date":
        return "min('datetime')"
    if spark_type == "boolean":
        return "min('boolean')"
    if spark_type in ("tinyint", "smallint", "int", "bigint", "float", "double") or \
            spark_type.startswith("decimal"):
        return "min('numeric')"
    if spark_type != "string":
        return "min('unknown')"
    return ("CASE WHEN count(value) = 0 THEN 'unknown' "
            "WHEN count(try_cast(value AS DOUBLE)) = count(value) THEN 'numeric' "
            "WHEN count(try_cast(value AS TIMESTAMP)) = count(value) THEN 'datetime' "
            "WHEN count(DISTINCT value) / count(*) < 0.5 THEN 'categorical' "
            "WHEN avg(length(value)) > 50 THEN 'text' ELSE 'categorical' END")


def string_long_sql(source: str, schema: list[tuple[str, str]], key: str | None = None) -> str:
    parts = []
    for i, (c, t) in enumerate(schema):
        v = f"CAST({_q(c)} AS VARCHAR)"
        if t in ("double", "float"):
            v = f"CASE WHEN isnan({_q(c)}) THEN NULL ELSE {v} END"
        k = f", {key} AS k" if key else ""
        parts.append(f"SELECT '{c}' AS column_name, {i} AS ord, '{t}' AS spark_type, {v} AS value{k} "
                     f"FROM {source}")
    return " UNION ALL ".join(parts)


def type_inference_sql(tables: list[tuple[str, str, list[tuple[str, str]]]]) -> str:
    """tables: (table_name, source_sql, [(column, spark_type)])."""
    blocks = []
    for tname, source, schema in tables:
        for i, (c, t) in enumerate(schema):
            blocks.append(
                f"SELECT '{tname}' AS table_name, '{c}' AS column_name, {_type_case(t)} AS data_type "
                f"FROM (SELECT CAST({_q(c)} AS VARCHAR) AS value FROM {source}) s")
    return " UNION ALL ".join(blocks)


def _complex(t: str) -> bool:
    return t.startswith(("array", "map", "struct", "binary"))


def schema_profile_sql(source: str, schema: list[tuple[str, str]], key: str, k: int = 5) -> str:
    facts = " UNION ALL ".join(
        f"SELECT column_name, ord, {_type_case(t)} AS data_type, count(*) - count(value) AS n_missing, "
        f"count(*) AS n_rows, "
        f"{'CAST(NULL AS BIGINT)' if _complex(t) else 'count(DISTINCT value)'} AS n_unique "
        f"FROM long WHERE column_name = '{c}' GROUP BY column_name, ord"
        for c, t in schema)
    return f"""
WITH long AS ({string_long_sql(source, schema, key)}),
facts AS ({facts}),
samp AS (
  SELECT column_name, string_agg(value, ', ' ORDER BY k) AS sample_values FROM (
    SELECT column_name, value, k,
           row_number() OVER (PARTITION BY column_name ORDER BY k) AS rn
    FROM long WHERE value IS NOT NULL AND spark_type NOT LIKE 'array%') WHERE rn <= {k}
  GROUP BY column_name)
SELECT f.column_name, f.data_type, CAST(f.n_missing AS BIGINT) AS missing_count,
       round(100.0 * f.n_missing / f.n_rows, 2) AS missing_percentage,
       CAST(f.n_unique AS BIGINT) AS unique_count, coalesce(s.sample_values, '') AS sample_values
FROM facts f LEFT JOIN samp s USING (column_name)
"""


WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
          "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def dataset_summary_sql(source: str, schema: list[tuple[str, str]]) -> str:
    miss = " + ".join(
        f"(count(*) - count(CASE WHEN {'NOT isnan(' + _q(c) + ')' if t in ('double', 'float') else 'TRUE'} "
        f"THEN {_q(c)} END))" for c, t in schema)
    mem = " + ".join(
        f"coalesce(sum(strlen({_q(c)})), 0)" if t == "string" else f"{WIDTHS.get(t, 8)} * count(*)"
        for c, t in schema)
    return f"""
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST({len(schema)} AS INTEGER) AS column_count,
       CAST({miss} AS BIGINT) AS total_missing,
       round(({mem}) / 1048576.0, 2) AS memory_usage_mb
FROM {source}
"""


def missing_data_sql(source: str, schema: list[tuple[str, str]], threshold: float = 0.3) -> str:
    parts = []
    for c, t in schema:
        present = f"NOT isnan({_q(c)})" if t in ("double", "float") else f"{_q(c)} IS NOT NULL"
        parts.append(
            f"SELECT '{c}' AS column_name, CAST(count(*) - count(CASE WHEN {present} THEN 1 END) AS BIGINT) "
            f"AS missing_count, count(*) AS n FROM {source}")
    return f"""
SELECT column_name, missing_count, round(100.0 * missing_count / n, 2) AS missing_percentage,
       (1.0 * missing_count / n) > {threshold} AS high_missing
FROM ({" UNION ALL ".join(parts)}) u
"""


def type_narrowing_sql(source: str, schema: list[tuple[str, str]]) -> str:
    parts = []
    for c, t in schema:
        q = _q(c)
        if t in ("tinyint", "smallint", "int", "bigint"):
            rec = (f"CASE WHEN count({q}) = 0 THEN '{t}' "
                   f"WHEN min({q}) >= -128 AND max({q}) <= 127 THEN 'tinyint' "
                   f"WHEN min({q}) >= -32768 AND max({q}) <= 32767 THEN 'smallint' "
                   f"WHEN min({q}) >= -2147483648 AND max({q}) <= 2147483647 THEN 'int' "
                   f"ELSE 'bigint' END")
        elif t == "double":
            rec = (f"CASE WHEN count({q}) > 0 AND count(CASE WHEN CAST(CAST({q} AS FLOAT) AS DOUBLE) = {q} "
                   f"THEN 1 END) = count({q}) THEN 'float' ELSE 'double' END")
        elif t == "string":
            rec = f"CASE WHEN count(DISTINCT {q}) / count(*) < 0.5 THEN 'category' ELSE 'string' END"
        else:
            rec = f"min('{t}')"
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS current_type, {rec} AS recommended_type "
                     f"FROM {source}")
    return " UNION ALL ".join(parts)


def sample_values_sql(source: str, schema: list[tuple[str, str]], key: str, k: int = 5) -> str:
    return f"""
WITH long AS ({string_long_sql(source, schema, key)})
SELECT column_name, string_agg(value, ', ' ORDER BY k) AS sample_values FROM (
  SELECT column_name, value, k, row_number() OVER (PARTITION BY column_name ORDER BY k) AS rn
  FROM long WHERE value IS NOT NULL) WHERE rn <= {k} GROUP BY column_name
"""


# ---- categorical / correlation / outliers / quality ------------------------

def string_freq_sql(source: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST({_q(c)} AS VARCHAR) AS value FROM {source}" for c in cols]
    return (f"SELECT column_name, value, count(*) AS cnt FROM ({' UNION ALL '.join(parts)}) u "
            f"WHERE value IS NOT NULL GROUP BY column_name, value")


def value_counts_sql(source: str, cols: list[str]) -> str:
    return (f"SELECT column_name, value, CAST(cnt AS BIGINT) AS \"count\" FROM "
            f"({string_freq_sql(source, cols)}) f")


def top_values_sql(source: str, cols: list[str], k: int) -> str:
    return f"""
SELECT column_name, CAST(rn AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS "count" FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn
  FROM ({string_freq_sql(source, cols)}) f) WHERE rn <= {k}
"""


def proven_top_values_sql(source: str, cols: list[str], k: int) -> str:
    """The exact list, of which the sketch is to prove every row."""
    return f"SELECT *, true AS proven FROM ({top_values_sql(source, cols, k)})"


def categorical_stats_sql(source: str, cols: list[str]) -> str:
    return f"""
WITH f AS ({string_freq_sql(source, cols)}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rn FROM f) WHERE rn = 1)
SELECT c.column_name, CAST(coalesce(u.n, 0) AS BIGINT) AS unique_count, t.value AS most_frequent,
       CAST(t.cnt AS BIGINT) AS frequency
FROM (SELECT * FROM {cols_values(cols)}) c
LEFT JOIN (SELECT column_name, count(*) AS n FROM f GROUP BY column_name) u USING (column_name)
LEFT JOIN top t USING (column_name)
"""


def pearson_sql(source: str, cols: list[str], d: int = 4) -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS column1, '{b}' AS column2, "
                         f"corr(CAST({_q(a)} AS DOUBLE), CAST({_q(b)} AS DOUBLE)) AS r FROM {source}")
    return (f"SELECT column1, column2, round(CASE WHEN isnan(r) THEN NULL ELSE r END, {d}) + 0.0 AS correlation "
            f"FROM ({' UNION ALL '.join(parts)}) u")


def strong_sql(matrix_sql: str, cols: list[str], threshold: float = 0.7, d: int = 4,
               rounded_input: bool = False) -> str:
    from ..functions.labels import strength_sql
    order = cols_values(cols).replace("column_name, ord", "name, ord")
    return f"""
WITH m AS ({matrix_sql}), o AS (SELECT * FROM {order})
SELECT column1, column2, round(r, {d}) AS correlation, {strength_sql('abs(r)')} AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction
FROM (SELECT m.column1, m.column2, m.r FROM m JOIN o o1 ON o1.name = m.column1
      JOIN o o2 ON o2.name = m.column2 WHERE o1.ord < o2.ord) x
WHERE abs(r) >= {threshold}
"""


def pearson_raw_sql(source: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS column1, '{b}' AS column2, "
                         f"corr(CAST({_q(a)} AS DOUBLE), CAST({_q(b)} AS DOUBLE)) AS r FROM {source}")
    return " UNION ALL ".join(parts)


def rank_source_sql(source: str, cols: list[str]) -> str:
    """Average ranks (ties averaged) of each column over its own non-null rows."""
    sel = ", ".join(
        f"(rank() OVER (ORDER BY {_q(c)}) + (count(*) OVER (PARTITION BY {_q(c)}) - 1) / 2.0) AS {_q(c)}"
        for c in cols)
    return f"(SELECT {sel} FROM {source})"


def outliers_sql(source: str, cols: list[str], key: str, method: str, t: float = 1.5,
                 zt: float = 3.0, max_keys: int = 100, keep_positive: bool = False) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({_q(c)} AS DOUBLE) AS value, CAST({key} AS BIGINT) AS k "
        f"FROM {source}" for c in cols)
    if method == "iqr":
        cond = f"(l.value < s.q1 - {t} * (s.q3 - s.q1) OR l.value > s.q3 + {t} * (s.q3 - s.q1))"
    else:
        cond = f"(s.sd > 0 AND abs(l.value - s.mean) / s.sd > {zt})"
    keep = "WHERE b.outlier_count > 0" if keep_positive else ""
    return f"""
WITH long AS (SELECT * FROM ({long}) u WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT column_name, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd,
             quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM long GROUP BY column_name),
fl AS (SELECT l.column_name, l.k FROM long l JOIN s USING (column_name) WHERE {cond}),
b AS (SELECT s.column_name, s.n, count(fl.k) AS outlier_count FROM s LEFT JOIN fl USING (column_name)
      GROUP BY s.column_name, s.n),
ks AS (SELECT column_name, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS keys FROM (
         SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY k) AS rn FROM fl)
       WHERE rn <= {max_keys} GROUP BY column_name)
SELECT b.column_name, '{method}' AS method, CAST(b.outlier_count AS BIGINT) AS outlier_count,
       round(100.0 * b.outlier_count / b.n, 2) AS outlier_percentage,
       coalesce(ks.keys, '') AS outlier_keys
FROM b LEFT JOIN ks USING (column_name) {keep}
"""


def quality_sql(source: str, schema: list[tuple[str, str]]) -> str:
    from ..functions.labels import quality_sql as qlab
    cols = [c for c, _ in schema]
    miss = " + ".join(
        f"sum(CASE WHEN {_q(c)} IS NULL {'OR isnan(' + _q(c) + ')' if t in ('double', 'float') else ''} "
        f"THEN 1 ELSE 0 END)" for c, t in schema)
    num = [c for c, t in schema if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    const = " + ".join(
        f"(SELECT CASE WHEN count(DISTINCT {_q(c)}) = 1 THEN 1 ELSE 0 END FROM {source})" for c in num) or "0"
    collist = ", ".join(_q(c) for c in cols)
    return f"""
WITH m AS (SELECT 100.0 * ({miss}) / (count(*) * {len(cols)}) AS miss FROM {source}),
d AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS dups, sum(c) AS n
      FROM (SELECT {collist}, count(*) AS c FROM {source} GROUP BY ALL) g),
c AS (SELECT CAST({const} AS BIGINT) AS consts),
s AS (SELECT greatest(100.0 - least(miss, 30.0) - least(100.0 * dups / n, 20.0)
                      - least(consts * 5.0, 20.0), 0.0) AS score, miss, dups, 100.0 * dups / n AS dp, consts
      FROM m, d, c)
SELECT round(score, 2) AS overall_score, round(miss, 2) AS missing_data_percentage,
       dups AS duplicate_rows, round(dp, 2) AS duplicate_percentage, consts AS constant_columns,
       {qlab('score')} AS assessment FROM s
"""


# ---- distributions ---------------------------------------------------------

def _sqlpoly(coefs, x):
    expr = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        expr = f"({expr} * {x} + {c!r})"
    return expr


def distribution_sql(source: str, cols: list[str], min_n: int = 20, sw_max: int = 5000,
                     alpha: float = 0.05, d: int = 4) -> str:
    from ..functions.mathx import ks_sf_sql, ks_stages, norm_cdf_sql, norm_ppf_sql
    from ..operators.distribution import SW_C1, SW_C2, SW_MU, SW_SIGMA
    return f"""
WITH long AS ({numeric_long_sql(source, cols)}),
s AS (SELECT column_name, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
             min(value) AS mn, max(value) AS mx,
             CASE WHEN count(*) < 3 THEN NULL WHEN min(value) = max(value) THEN 0.0
                  ELSE skewness(value) END AS sk
      FROM long GROUP BY column_name),
pos AS (SELECT l.column_name, l.value AS x, s.n, s.mean, s.mn, s.mx,
               row_number() OVER (PARTITION BY l.column_name ORDER BY l.value) AS i
        FROM long l JOIN s USING (column_name) WHERE s.n >= {min_n} AND s.n <= {sw_max}),
p2 AS (SELECT *, (least(i, n + 1 - i) - 0.375) / (n + 0.25) AS pj FROM pos),
p3 AS (SELECT *, {norm_ppf_sql('pj')} AS mj FROM p2),
p4 AS (SELECT *, CASE WHEN i < n + 1 - i THEN mj WHEN i > n + 1 - i THEN -mj ELSE 0.0 END AS m FROM p3),
ss AS (SELECT column_name, sum(m * m) AS ssm FROM p4 GROUP BY column_name),
p5 AS (SELECT p4.*, ss.ssm, 0.625 / (n + 0.25) AS q1p, 1.625 / (n + 0.25) AS q2p, 1.0 / sqrt(n) AS u
       FROM p4 JOIN ss USING (column_name)),
p6 AS (SELECT *, -{norm_ppf_sql('q1p')} AS mn_, -{norm_ppf_sql('q2p')} AS mn1 FROM p5),
p7 AS (SELECT *, mn_ / sqrt(ssm) + {_sqlpoly(SW_C1, 'u')} AS an,
              mn1 / sqrt(ssm) + {_sqlpoly(SW_C2, 'u')} AS an1 FROM p6),
p8 AS (SELECT *, (ssm - 2 * mn_ * mn_ - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1) AS eps FROM p7),
p9 AS (SELECT *, CASE WHEN i = n THEN an WHEN i = n - 1 THEN an1 WHEN i = 1 THEN -an
                      WHEN i = 2 THEN -an1 ELSE m / sqrt(eps) END AS a FROM p8),
sw0 AS (SELECT column_name, any_value(n) AS n, any_value(mn) AS mn, any_value(mx) AS mx,
               sum(a * x) AS ax, sum((x - mean) * (x - mean)) AS ssx FROM p9 GROUP BY column_name),
sw1 AS (SELECT column_name, n, CASE WHEN mn = mx THEN 1.0 ELSE least(ax * ax / ssx, 1.0) END AS w FROM sw0),
sw2 AS (SELECT *, CASE WHEN w >= 1.0 THEN NULL ELSE
          (ln(1.0 - w) - {_sqlpoly(SW_MU, 'ln(n)')}) / exp({_sqlpoly(SW_SIGMA, 'ln(n)')}) END AS zsw FROM sw1),
sw AS (SELECT column_name, w AS stat,
              CASE WHEN w >= 1.0 THEN 1.0 ELSE 1.0 - {norm_cdf_sql('zsw')} END AS pv, 'shapiro' AS test FROM sw2),
kf AS (SELECT l.column_name, l.value, count(*) AS cnt FROM long l JOIN s USING (column_name)
       WHERE s.n > {sw_max} GROUP BY l.column_name, l.value),
kr AS (SELECT kf.*, coalesce(sum(cnt) OVER (PARTITION BY column_name ORDER BY value
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb FROM kf),
kz AS (SELECT kr.*, s.n, (kr.value - s.mean) / s.sd AS z FROM kr JOIN s USING (column_name) WHERE s.sd > 0),
kc AS (SELECT *, {norm_cdf_sql('z')} AS cdf FROM kz),
k0 AS (SELECT column_name, max(greatest((cb + cnt) / n - cdf, cdf - cb / n)) AS dd, any_value(n) AS n
       FROM kc GROUP BY column_name),
k1 AS (SELECT column_name, dd, CAST(n AS DOUBLE) AS n, greatest(sqrt(n) * dd, 0.05) AS z FROM k0),
k2 AS (SELECT *, {', '.join(f'{e} AS {name}' for name, e in ks_stages('z', 'n'))} FROM k1),
ks AS (SELECT column_name, dd AS stat, {ks_sf_sql('z')} AS pv, 'ks' AS test FROM k2),
t AS (SELECT * FROM sw UNION ALL SELECT * FROM ks)
SELECT s.column_name,
  CASE WHEN s.n < {min_n} THEN 'unknown' WHEN abs(s.sk) < 0.5 THEN 'symmetric'
       WHEN s.sk > 0 THEN 'right_skewed' ELSE 'left_skewed' END AS distribution_type,
  coalesce(s.n >= {min_n} AND t.pv > {alpha}, FALSE) AS is_normal,
  CASE WHEN s.n >= {min_n} THEN t.test END AS normality_test,
  CASE WHEN s.n >= {min_n} THEN round(t.stat, {d}) END AS normality_test_statistic,
  CASE WHEN s.n >= {min_n} THEN round(t.pv, {d}) END AS normality_p_value
FROM s LEFT JOIN t USING (column_name)
"""


def distribution_type_sql(source: str, cols: list[str], min_n: int = 20) -> str:
    return f"""
WITH long AS ({numeric_long_sql(source, cols)}),
s AS (SELECT column_name, count(*) AS n,
             CASE WHEN count(*) < 3 THEN NULL WHEN min(value) = max(value) THEN 0.0
                  ELSE skewness(value) END AS sk FROM long GROUP BY column_name)
SELECT column_name, CASE WHEN n < {min_n} THEN 'unknown' WHEN abs(sk) < 0.5 THEN 'symmetric'
       WHEN sk > 0 THEN 'right_skewed' ELSE 'left_skewed' END AS distribution_type,
       round(sk, 4) AS skewness FROM s
"""


# ---- chart data ------------------------------------------------------------

def histogram_sql(source: str, cols: list[str], d: int = 4) -> str:
    def edge(i):
        return f"(CASE WHEN {i} = nb THEN last ELSE {i} * step + first END)"
    return f"""
WITH long AS ({numeric_long_sql(source, cols)}),
s AS (SELECT column_name, count(*) AS n, min(value) AS mn, max(value) AS mx,
             quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM long GROUP BY column_name),
w AS (SELECT *, (mx - mn) / (log2(n) + 1.0) AS sturges, 2.0 * iqr * power(n, -1.0 / 3.0) AS fd FROM s),
b AS (SELECT *, CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END AS width,
             CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS first,
             CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS last FROM w),
m AS (SELECT *, CASE WHEN width > 0 THEN CAST(ceil((last - first) / width) AS BIGINT) ELSE 1 END AS nb FROM b),
m2 AS (SELECT *, (last - first) / nb AS step FROM m),
f AS (SELECT column_name, value, count(*) AS cnt FROM long GROUP BY column_name, value),
i0 AS (SELECT f.*, m2.n, m2.nb, m2.first, m2.last, m2.step,
              CAST(floor((f.value - m2.first) * (m2.nb / (m2.last - m2.first))) AS BIGINT) AS i
       FROM f JOIN m2 USING (column_name)),
i1 AS (SELECT * REPLACE (CASE WHEN i = nb THEN nb - 1 ELSE i END AS i) FROM i0),
i2 AS (SELECT * REPLACE (CASE WHEN value < {edge('i')} THEN i - 1 ELSE i END AS i) FROM i1),
i3 AS (SELECT * REPLACE (CASE WHEN value >= {edge('(i + 1)')} AND i != nb - 1 THEN i + 1 ELSE i END AS i) FROM i2),
h0 AS (SELECT column_name, i, CAST(sum(cnt) AS BIGINT) AS "count" FROM i3 GROUP BY column_name, i),
allbins AS (SELECT m2.column_name, r.i FROM m2, range(m2.nb) r(i)),
h1 AS (SELECT a.column_name, a.i, coalesce(h0."count", 0) AS "count" FROM allbins a
         LEFT JOIN h0 ON a.column_name = h0.column_name AND a.i = h0.i),
h AS (SELECT h1.*, m2.n, m2.nb, m2.first, m2.last, m2.step FROM h1 JOIN m2 USING (column_name))
SELECT column_name, i AS bin, round({edge('i')}, {d}) AS bin_start, round({edge('(i + 1)')}, {d}) AS bin_end,
       "count", round("count" / (n * ({edge('(i + 1)')} - {edge('i')})), {d + 2}) AS density
FROM h
"""


def kde_sql(source: str, cols: list[str], points: int = 100, min_n: int = 10, d: int = 4) -> str:
    return f"""
WITH long AS ({numeric_long_sql(source, cols)}),
s AS (SELECT column_name, count(*) AS n, min(value) AS mn, max(value) AS mx,
             (max(value) - min(value)) / {points - 1} AS gstep,
             stddev_samp(value) * power(count(*), -0.2) AS h FROM long GROUP BY column_name
      HAVING count(*) > {min_n} AND stddev_samp(value) > 0),
g AS (SELECT s.*, r.point, CASE WHEN r.point = {points - 1} THEN s.mx ELSE r.point * s.gstep + s.mn END AS x
      FROM s, range({points}) r(point)),
f AS (SELECT column_name, value, count(*) AS cnt FROM long GROUP BY column_name, value)
SELECT g.column_name, CAST(g.point AS INTEGER) AS point, round(any_value(g.x), {d}) AS x,
       round(sum(f.cnt * exp(-0.5 * ((g.x - f.value) / g.h) * ((g.x - f.value) / g.h)))
             / (any_value(g.n) * any_value(g.h) * 2.5066282746310002), {d + 4}) AS density
FROM g JOIN f USING (column_name) GROUP BY g.column_name, g.point
"""


def boxplot_sql(source: str, cols: list[str], t: float = 1.5, d: int = 4) -> str:
    return f"""
WITH long AS ({numeric_long_sql(source, cols)}),
s AS (SELECT column_name, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS med,
             quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY column_name),
w AS (SELECT s.column_name, coalesce(min(l.value) FILTER (WHERE l.value >= s.q1 - {t} * (s.q3 - s.q1)), any_value(s.q1)) AS wl,
             coalesce(max(l.value) FILTER (WHERE l.value <= s.q3 + {t} * (s.q3 - s.q1)), any_value(s.q3)) AS wh
      FROM long l JOIN s USING (column_name) GROUP BY s.column_name),
fl AS (SELECT l.column_name, count(*) FILTER (WHERE l.value < w.wl OR l.value > w.wh) AS fliers
       FROM long l JOIN w USING (column_name) GROUP BY l.column_name)
SELECT s.column_name, round(mean, {d}) AS mean, round(med, {d}) AS median, round(q1, {d}) AS q1,
       round(q3, {d}) AS q3, round(q3 - q1, {d}) AS iqr, round(wl, {d}) AS whislo, round(wh, {d}) AS whishi,
       round(med - 1.57 * (q3 - q1) / sqrt(n), {d}) AS cilo, round(med + 1.57 * (q3 - q1) / sqrt(n), {d}) AS cihi,
       CAST(fliers AS BIGINT) AS fliers
FROM s JOIN w USING (column_name) JOIN fl USING (column_name)
"""


def chart_plan_sql(source: str, schema: list[tuple[str, str]], max_plots: int = 20) -> str:
    types = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS ord, {_type_case(t)} AS data_type "
        f"FROM (SELECT CAST({_q(c)} AS VARCHAR) AS value FROM {source}) s"
        for i, (c, t) in enumerate(schema))
    return f"""
WITH types AS ({types}),
num AS (SELECT column_name, row_number() OVER (ORDER BY ord) AS rn FROM types WHERE data_type = 'numeric'),
cat AS (SELECT column_name, row_number() OVER (ORDER BY ord) AS rn FROM types WHERE data_type = 'categorical'),
nn AS (SELECT count(*) AS c, string_agg(column_name, ',' ORDER BY rn) AS cols,
              string_agg(column_name, ',' ORDER BY rn) FILTER (WHERE rn <= 4) AS top4 FROM num),
plots AS (
  SELECT 2 * rn - 1 AS seq, 'histogram' AS viz_type, 'Distribution of ' || column_name AS title,
         column_name AS columns_used FROM num WHERE rn <= 10
  UNION ALL SELECT 2 * rn, 'boxplot', 'Box Plot of ' || column_name, column_name FROM num WHERE rn <= 10
  UNION ALL SELECT 1000, 'heatmap', 'Correlation Heatmap', cols FROM nn WHERE c >= 2
  UNION ALL SELECT 2000 + rn, 'bar_chart', 'Distribution of ' || column_name, column_name FROM cat WHERE rn <= 5
  UNION ALL SELECT 3000, 'pairplot', 'Pairwise Relationships', top4 FROM nn WHERE c >= 2)
SELECT CAST(plot_index AS INTEGER) AS plot_index, viz_type, title, columns_used FROM (
  SELECT row_number() OVER (ORDER BY seq) AS plot_index, * FROM plots) WHERE plot_index <= {max_plots}
"""


def kendall_sql(source: str, cols: list[str], d: int = 4) -> str:
    """Brute-force tau-b over cell pairs (whole table; fine at the check scale)."""
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"""SELECT '{a}' AS column1, '{b}' AS column2, (
  WITH cells AS (SELECT CAST({_q(a)} AS DOUBLE) AS x, CAST({_q(b)} AS DOUBLE) AS y, count(*) AS c
                 FROM {source} WHERE {_q(a)} IS NOT NULL AND {_q(b)} IS NOT NULL GROUP BY ALL),
  t AS (SELECT sum(c) * (sum(c) - 1) / 2.0 AS n0, sum(c * (c - 1) / 2.0) AS n3 FROM cells),
  tx AS (SELECT sum(t * (t - 1) / 2.0) AS n1 FROM (SELECT x, sum(c) AS t FROM cells GROUP BY x)),
  ty AS (SELECT sum(t * (t - 1) / 2.0) AS n2 FROM (SELECT y, sum(c) AS t FROM cells GROUP BY y)),
  dd AS (SELECT coalesce(sum(c1.c * c2.c), 0) AS dsc FROM cells c1 JOIN cells c2 ON c1.x < c2.x AND c1.y > c2.y)
  SELECT CASE WHEN (n0 - n1) * (n0 - n2) > 0
              THEN (n0 - n1 - n2 + n3 - 2.0 * dsc) / sqrt((n0 - n1) * (n0 - n2)) END
  FROM t, tx, ty, dd) AS r""")
    return (f"SELECT column1, column2, round(r, {d}) + 0.0 AS correlation FROM ("
            + " UNION ALL ".join(parts) + ") u")


def validation_sql(source: str, cols: list[str], min_rows: int = 10, max_columns: int = 1000) -> str:
    nulls = " || ".join(
        f"CASE WHEN count({_q(c)}) = 0 THEN '{c},' ELSE '' END" for c in cols)
    return f"""
WITH s AS (SELECT count(*) AS n, {nulls} AS nullcols FROM {source}),
t AS (SELECT n, CASE WHEN nullcols = '' THEN '' ELSE left(nullcols, length(nullcols) - 1) END AS nullcols FROM s)
SELECT 'not_empty' AS "check", CASE WHEN n > 0 THEN 'pass' ELSE 'fail' END AS status, n || ' rows' AS detail FROM t
UNION ALL SELECT 'min_rows', CASE WHEN n >= {min_rows} THEN 'pass' ELSE 'fail' END, n || ' rows, minimum {min_rows}' FROM t
UNION ALL SELECT 'column_limit', CASE WHEN {len(cols)} <= {max_columns} THEN 'pass' ELSE 'fail' END,
  '{len(cols)} columns, limit {max_columns}' FROM t
UNION ALL SELECT 'all_null_columns', CASE WHEN nullcols = '' THEN 'pass' ELSE 'warn' END, nullcols FROM t
UNION ALL SELECT 'duplicate_names', 'pass', '' FROM t
"""


# ---- trend -----------------------------------------------------------------

def trend_series_sql(source: str, ts: str, value: str, window: int = 7, d: int = 4, unit: str = "day") -> str:
    return f"""
WITH b AS (SELECT CAST(date_trunc('{unit}', {ts}) AS DATE) AS bucket, CAST(count(*) AS BIGINT) AS n, avg({value}) AS m
           FROM {source} WHERE {ts} IS NOT NULL GROUP BY 1)
SELECT bucket, n, round(m, {d}) AS mean_value,
       round(avg(m) OVER (ORDER BY bucket ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), {d}) AS moving_avg
FROM b
"""


def trend_fit_sql(source: str, ts: str, value: str, d: int = 6) -> str:
    return f"""
WITH b AS (SELECT CAST({ts} AS DATE) AS bucket, avg({value}) AS m FROM {source}
           WHERE {ts} IS NOT NULL GROUP BY 1),
x AS (SELECT CAST(bucket - (SELECT min(bucket) FROM b) AS DOUBLE) AS x, m AS y FROM b)
SELECT CAST(count(*) AS BIGINT) AS buckets, round(regr_slope(y, x), {d}) AS slope,
       round(regr_intercept(y, x), {d}) AS intercept, round(regr_r2(y, x), {d}) AS r2,
       CASE WHEN regr_slope(y, x) > 0 THEN 'increasing' WHEN regr_slope(y, x) < 0 THEN 'decreasing'
            ELSE 'flat' END AS direction
FROM x
"""


def trend_acf_sql(source: str, ts: str, value: str, max_lag: int = 30, d: int = 4) -> str:
    return f"""
WITH b AS (SELECT CAST({ts} AS DATE) AS bucket, avg({value}) AS m FROM {source} WHERE {ts} IS NOT NULL GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 1 DAY)) AS DATE) AS bucket),
y AS (SELECT s.bucket, coalesce(m - (SELECT avg(m) FROM b), 0.0) AS y FROM s LEFT JOIN b USING (bucket)),
a AS (SELECT CAST(l.lag AS INTEGER) AS lag, (SELECT count(*) FROM y) AS n,
             sum(y1.y * y2.y) / (SELECT sum(y * y) FROM y) AS acf
      FROM generate_series(1, {max_lag}) l(lag) JOIN y y1 ON TRUE JOIN y y2 ON y2.bucket = y1.bucket + CAST(l.lag AS INTEGER)
      GROUP BY l.lag),
p AS (SELECT arg_min(lag, (-acf, lag)) AS period FROM a WHERE lag > 1 AND acf > 2 / sqrt(n))
SELECT lag, round(acf, {d}) AS acf, coalesce(lag = period, FALSE) AS is_period FROM a, p WHERE lag < n
"""


def trend_report_sql(source: str, ts: str, cols: list[str], d: int = 4) -> str:
    return " UNION ALL ".join(f"""
SELECT '{ts}' AS time_column, '{c}' AS column_name, count(*) AS buckets, round(regr_slope(m, x), {d}) AS slope,
       CASE WHEN regr_slope(m, x) > 0 THEN 'increasing' WHEN regr_slope(m, x) < 0 THEN 'decreasing' ELSE 'flat' END AS direction
FROM (SELECT CAST(CAST({ts} AS DATE) - DATE '1970-01-01' AS DOUBLE) AS x, avg({c}) AS m FROM {source} GROUP BY CAST({ts} AS DATE)) t"""
                              for c in cols)


def seasonality_sql(source: str, ts: str, value: str, d: int = 4) -> str:
    return f"""
SELECT 'hour' AS period, hour({ts}) AS slot, CAST(count(*) AS BIGINT) AS n, round(avg({value}), {d}) AS mean_value
FROM {source} WHERE {ts} IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'weekday', isodow({ts}) - 1, CAST(count(*) AS BIGINT), round(avg({value}), {d})
FROM {source} WHERE {ts} IS NOT NULL GROUP BY 2
"""


def spearman_pairwise_sql(source: str, cols: list[str], d: int = 4) -> str:
    """Spearman per pair on its pairwise-complete rows (ranks recomputed per pair)."""
    parts = []
    for a in cols:
        for b in cols:
            x, y = _q(a), _q(b)
            parts.append(f"""SELECT '{a}' AS column1, '{b}' AS column2, (
  SELECT corr(rx, ry) FROM (
    SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
           rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
    FROM (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}
          WHERE {x} IS NOT NULL AND {y} IS NOT NULL) s) t) AS r""")
    return (f"SELECT column1, column2, round(CASE WHEN isnan(r) THEN NULL ELSE r END, {d}) + 0.0 "
            f"AS correlation FROM ({' UNION ALL '.join(parts)}) u")


# Keys beyond 2^53 and decimals beyond 15 digits, in types that hold them.
BIGKEYS = """(SELECT o_orderkey, o_orderkey + 1152921504606846976 AS big_key,
  CASE WHEN o_orderkey % 3 <> 0 THEN -1152921504606846976 - o_orderkey END AS some_key,
  CAST('123456789012345678' AS DECIMAL(28,4)) + CAST(CAST(o_orderkey AS DECIMAL(24,0)) AS DECIMAL(28,4)) * 0.0001 AS big_dec,
  CAST(1152921504606846977 AS BIGINT) AS same_key, o_orderstatus FROM orders)"""


def bigkeys_schema_sql(schema: list[tuple[str, str]]) -> str:
    kind = {"string": "categorical"}
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind.get(t, 'numeric')}' AS data_type, count(*) - count({c}) AS missing_count,
  round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percentage, count(DISTINCT {c}) AS unique_count
FROM {BIGKEYS} s""" for c, t in schema)


def bigkeys_rank_sql(cols: list[str]) -> str:
    """Every column rises or falls with the order key, so rank correlations are 1 or -1."""
    sign = {c: f"(SELECT CASE WHEN count(*) = count(DISTINCT {c}) THEN CASE WHEN arg_max({c}, o_orderkey) > "
               f"arg_min({c}, o_orderkey) THEN 1.0 ELSE -1.0 END END FROM {BIGKEYS} s WHERE {c} IS NOT NULL)" for c in cols}
    return " UNION ALL ".join(f"SELECT '{a}' AS column1, '{b}' AS column2, "
                              f"CAST({sign[a]} * {sign[b]} AS DOUBLE) AS correlation" for a in cols for b in cols)


# ---- reports as long rows ----------------------------------------------------
def section_sql(section: str, source: str, numbers: list[tuple[str, str]], texts: list[tuple[str, str]]) -> str:
    """Leaves of ``source`` (which has ``ord``): fields with the expressions behind them."""
    items = ([f"{{'field': '{f}', 'number': CAST({e} AS DOUBLE), 'text': CAST(NULL AS VARCHAR)}}" for f, e in numbers]
             + [f"{{'field': '{f}', 'number': CAST(NULL AS DOUBLE), 'text': CAST({e} AS VARCHAR)}}" for f, e in texts])
    return (f"SELECT '{section}' AS section, CAST(ord AS INTEGER) AS ord, u.field AS field, u.number AS number, "
            f"u.text AS text FROM (SELECT ord, unnest([{', '.join(items)}]) AS u FROM ({source}) s) x "
            "WHERE u.number IS NOT NULL OR u.text IS NOT NULL")


def _same(*names: str) -> list[tuple[str, str]]:
    return [(n, _q(n)) for n in names]


def _in_order(sql: str, cols: list[str], limit: int = 10 ** 6) -> str:
    """Rows of ``sql`` in the order of their columns, numbered from 0, up to the limit."""
    return (f"SELECT *, row_number() OVER (ORDER BY place) - 1 AS ord FROM (SELECT r.*, t.ord AS place, "
            f"row_number() OVER (ORDER BY t.ord) AS nth FROM ({sql}) r JOIN {cols_values(cols)} "
            f"ON t.column_name = r.column_name) y WHERE nth <= {limit}")


def _summaries_sql(name: str, source: str, schema: list[tuple[str, str]], numeric: list[str], cats: list[str],
                   limit: int, section: str) -> str:
    cols = [c for c, _ in schema]
    wide = f"""
SELECT t.ord, ty.column_name, ty.data_type, n.* EXCLUDE (column_name), c.* EXCLUDE (column_name)
FROM ({type_inference_sql([(name, source, schema)])}) ty JOIN {cols_values(cols)} ON t.column_name = ty.column_name
LEFT JOIN ({numeric_stats_sql(source, numeric)}) n ON n.column_name = ty.column_name
LEFT JOIN ({categorical_stats_sql(source, cats)}) c ON c.column_name = ty.column_name WHERE t.ord < {limit}"""
    stats = ["mean", "median", "std_dev", "min", "max", "skewness", "mode", "variance", "q1", "q3", "iqr", "kurtosis",
             "unique_count", "frequency"]
    return section_sql(section, wide, [(f"stats.{s}", _q(s)) for s in stats] + [("stats.outliers", "outlier_count")],
                       [("name", "column_name"), ("type", "data_type"), ("stats.most_frequent", "most_frequent")])


def context_rows_sql(name: str, source: str, schema: list[tuple[str, str]], key: str, numeric: list[str],
                     cats: list[str]) -> str:
    cols = [c for c, _ in schema]
    strong = (f"SELECT *, row_number() OVER (ORDER BY abs(correlation) DESC, column1, column2) - 1 AS ord "
              f"FROM ({strong_sql(pearson_raw_sql(source, numeric), numeric)}) s")
    return "\nUNION ALL ".join([
        section_sql("dataset_overview", f"SELECT 0 AS ord, * FROM ({dataset_summary_sql(source, schema)}) d",
                    [("rows", "row_count"), ("columns", "column_count"), ("total_missing", "total_missing")], []),
        _summaries_sql(name, source, schema, numeric, cats, 10, "column_summaries"),
        section_sql("correlations", strong, _same("correlation"), _same("column1", "column2", "strength", "direction")),
        section_sql("outliers", _in_order(outliers_sql(source, numeric, key, "iqr", keep_positive=True), cols, limit=10),
                    [("count", "outlier_count"), ("percentage", "outlier_percentage")], [("column", "column_name")]),
        section_sql("distributions", _in_order(distribution_sql(source, numeric), cols, limit=10), [],
                    [("column", "column_name"), ("type", "distribution_type"), ("is_normal", "is_normal")])])


def report_rows_sql(name: str, source: str, schema: list[tuple[str, str]], key: str, numeric: list[str],
                    cats: list[str], k: int = 20) -> str:
    cols = [c for c, _ in schema]
    strong = (f"SELECT *, row_number() OVER (ORDER BY abs(correlation) DESC, column1, column2) - 1 AS ord "
              f"FROM ({strong_sql(pearson_raw_sql(source, numeric), numeric)}) s")
    matrix = (f"SELECT *, row_number() OVER (ORDER BY column1, column2) - 1 AS ord "
              f"FROM ({pearson_sql(source, numeric)}) m")
    top = (f"SELECT r.*, row_number() OVER (ORDER BY t.ord, r.rank) - 1 AS ord FROM ({top_values_sql(source, cats, k)}) r "
           f"JOIN {cols_values(cols)} ON t.column_name = r.column_name")
    return "\nUNION ALL ".join([
        section_sql("report", f"SELECT 0 AS ord, * FROM ({dataset_summary_sql(source, schema)}) d",
                    _same("row_count", "column_count", "total_missing", "memory_usage_mb"),
                    [("job_id", f"'{name}'"), ("correlation_method", "'pearson'")]),
        section_sql("columns", _in_order(schema_profile_sql(source, schema, key), cols),
                    _same("missing_count", "missing_percentage", "unique_count"),
                    _same("column_name", "data_type", "sample_values")),
        _summaries_sql(name, source, schema, numeric, cats, 10 ** 6, "column_statistics"),
        section_sql("correlation_matrix", matrix, _same("correlation"), _same("column1", "column2")),
        section_sql("strong_correlations", strong, _same("correlation"),
                    _same("column1", "column2", "strength", "direction")),
        section_sql("outlier_analysis", _in_order(outliers_sql(source, numeric, key, "iqr", keep_positive=True), cols),
                    _same("outlier_count", "outlier_percentage"),
                    [*_same("column_name", "method"), ("outlier_keys", "replace(outlier_keys, ',', ', ')")]),
        section_sql("distribution_analysis", _in_order(distribution_sql(source, numeric), cols),
                    _same("normality_test_statistic", "normality_p_value"),
                    _same("column_name", "distribution_type", "is_normal")),
        section_sql("top_categories", top, _same("count"), _same("column_name", "value")),
        section_sql("data_quality", f"SELECT 0 AS ord, * FROM ({quality_sql(source, schema)}) d",
                    _same("overall_score", "missing_data_percentage", "duplicate_rows", "duplicate_percentage",
                          "constant_columns"), _same("assessment")),
        section_sql("visualizations", f"SELECT plot_index - 1 AS ord, * FROM ({chart_plan_sql(source, schema)}) v", [],
                    _same("viz_type", "title", "columns_used"))])
