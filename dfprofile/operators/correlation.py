"""Correlation (R1-R5, V4): Pearson, Spearman and Kendall tau-b matrices in long
form, strong pairs and strength labels.

* Pearson, with or without NULLs: pairwise-complete masked sums of all column pairs
  in one scan, per task and then merged; the data rows are not shuffled and only
  k x k rows reach the driver.
* Spearman: exact average ranks from the frequency table (two bounded windows),
  attached by a join on value (broadcast only when the column's distinct count,
  known from the profile, is small), then Pearson on the ranks.  With NULLs, ranks
  are those among pairwise-complete rows, as with pandas: columns fall into classes
  that are present in the same rows, and each column is ranked once a class.
* Kendall tau-b: see ``kendall.py``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ProfileConfig
from ..functions.columns import numeric_columns, qcol, rnd
from ..functions.labels import correlation_strength
from ..session import materialize
from .freq import low_of, numeric_frequencies, running_sums, value_key
from .numeric import NumericProfile

MATRIX_SCHEMA = "column1 string, column2 string, correlation double"


def _matrix_rows(cols: list[str], get) -> list[tuple]:
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = get(i, j)
            rows.append((a, b, None if v is None or math.isnan(v) else float(v)))
    return rows


SUMS = ("n", "s", "ss", "p", "low", "high", "far")


def _pair_sums(clean: DataFrame, cols: list[str], shifts: dict[str, float]) -> dict:
    """What Pearson needs of every ordered column pair (i, j), over the rows where both are present:
    count, sum and square sum of i, product sum, least and greatest i, infinities of i.  One scan;
    a task holds k x k sums and emits k x k rows, which combine before the shuffle.  Shifting by the
    means keeps the sums stable."""
    k = len(cols)
    shift = np.array([s if s is not None and math.isfinite(s) else 0.0
                      for s in (shifts.get(c) for c in cols)])

    def sums(batches):
        n, s, ss, p, far = (np.zeros((k, k)) for _ in range(5))
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) - shift
            there, endless = ~np.isnan(x), np.isinf(x)
            v, m = np.where(there & ~endless, x, 0.0), there.astype(float)
            with np.errstate(over="ignore", invalid="ignore"):
                n += m.T @ m
                s += v.T @ m
                ss += (v * v).T @ m
                p += v.T @ v
            far += endless.astype(float).T @ m
            for j in range(k):
                rows = there[:, j]
                if rows.any():
                    low[:, j] = np.minimum(low[:, j], np.where(there[rows], x[rows], np.inf).min(axis=0))
                    high[:, j] = np.maximum(high[:, j], np.where(there[rows], x[rows], -np.inf).max(axis=0))
        i, j = np.divmod(np.arange(k * k, dtype=np.int32), np.int32(k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), *(pa.array(a.ravel()) for a in (n, s, ss, p, low, high, far))],
            names=["i", "j", *SUMS])

    rows = clean.select(*[qcol(c).alias(f"c{i}") for i, c in enumerate(cols)])
    got = rows.mapInArrow(sums, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))
    merged = got.groupBy("i", "j").agg(*[
        {"low": F.min, "high": F.max}.get(c, F.sum)(c).alias(c) for c in SUMS])
    return {(r["i"], r["j"]): r for r in merged.collect()}  # k x k rows, as the result


def _pearson(sums: dict, i: int, j: int) -> float | None:
    """NULL below two common rows, or where one side is constant or infinite on them."""
    a, b = sums.get((i, j)), sums.get((j, i))
    if a is None or a["n"] < 2 or a["low"] == a["high"] or b["low"] == b["high"] or a["far"] or b["far"]:
        return None
    if i == j:
        return 1.0
    n = a["n"]
    va, vb = a["ss"] - a["s"] * a["s"] / n, b["ss"] - b["s"] * b["s"] / n
    if not (va > 0 and vb > 0):
        return None
    r = (a["p"] - a["s"] * b["s"] / n) / (math.sqrt(va) * math.sqrt(vb))
    return None if math.isnan(r) else min(1.0, max(-1.0, r))


def pearson_matrix(df: DataFrame, columns: list[str] | None = None,
                   config: ProfileConfig = DEFAULT, profile: NumericProfile | None = None
                   ) -> DataFrame:
    """Long matrix ``(column1, column2, correlation)`` over all ordered
    pairs, unrounded; NULL where undefined (constant column, n < 2)."""
    cols = columns or numeric_columns(df)
    p = profile or NumericProfile(df, cols, config)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], MATRIX_SCHEMA)
    sums = _pair_sums(p.clean, cols, {r[0]: r[2] for r in p.light_rows()})
    return spark.createDataFrame(_matrix_rows(cols, lambda i, j: _pearson(sums, i, j)), MATRIX_SCHEMA)


def _look_up(out: DataFrame, ranked: DataFrame, c: str, distinct: int, low: dict, fields: dict[str, str],
             config: ProfileConfig) -> DataFrame:
    """``out`` with the ``fields`` (SQL of the source -> new name) of column ``c``'s row in a ranked table: a
    broadcast where the number of distinct values is small, else a shuffled join."""
    keys = {"__v": F.col("value"), **({"__l": F.col("low")} if low else {})}
    rk = ranked.where(F.col("column_name") == c).select(
        *[e.alias(k) for k, e in keys.items()], *[F.expr(f).alias(n) for f, n in fields.items()])
    on = qcol(c) == F.col("__v")
    if low:
        on = on & (low[c] == F.col("__l"))
    small = distinct <= config.broadcast_row_limit
    return out.join(F.broadcast(rk) if small else rk, on, "left").drop("__v", "__l")


def _with_ranks(df: DataFrame, cols: list[str], config: ProfileConfig,
                profile: NumericProfile | None = None, field: str = "rank"
                ) -> tuple[DataFrame, NumericProfile]:
    """``df`` restricted to ``cols`` with each value replaced by its exact
    average rank (or another ranked-table ``field``, e.g. the dense code
    ``distinct_before``) within its column; NULL stays NULL."""
    p = profile or NumericProfile(df, cols, config)
    ranked = p.ranked()
    distinct = {r[0]: r[2] for r in p.summary_rows()}
    low = low_of(p.clean, p.cols)
    out, names = p.clean, {c: f"__r{i}" for i, c in enumerate(cols)}
    for c in cols:
        out = _look_up(out, ranked, c, distinct.get(c) or 0, low, {field: names[c]}, config)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()]), p


def null_classes(clean: DataFrame, cols: list[str]) -> dict[str, int]:
    """Columns present in exactly the same rows share a class: as many rows hold both as hold
    either.  One scan; a task emits k x k counts."""
    k = len(cols)

    def count(batches):
        n = np.zeros((k, k), np.int64)
        for b in batches:
            m = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.float64)
            n += (m.T @ m).astype(np.int64)
        i, j = np.divmod(np.arange(k * k, dtype=np.int32), np.int32(k))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n.ravel())], names=["i", "j", "n"])

    present = clean.select(*[qcol(c).isNotNull().alias(f"p{i}") for i, c in enumerate(cols)])
    both = present.mapInArrow(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    n = {(r["i"], r["j"]): r["n"] for r in both.collect()}
    firsts: list[int] = []
    out: dict[str, int] = {}
    for j, c in enumerate(cols):
        same = next((g for g, f in enumerate(firsts)
                     if n.get((f, j), 0) == n.get((f, f), 0) == n.get((j, j), 0)), None)
        if same is None:
            firsts.append(j)
            same = len(firsts) - 1
        out[c] = same
    return out


def _class_ranks(p: NumericProfile, cols: list[str], classes: dict[str, int], config: ProfileConfig) -> DataFrame:
    """``(column_name, value[, low], r_<i>)``: average rank of each distinct value among the rows
    where the columns of null class i are present.  One frequency table with a count per class,
    one pair of bounded windows for all classes."""
    given = [next(c for c in cols if classes[c] == i) for i in range(max(classes.values()) + 1)]
    freq = numeric_frequencies(p.clean, cols, p.n_buckets, config, given)
    freq = materialize(freq, p.reuse, p.n_rows() * len(cols))
    weights = [f"cnt_{i}" for i in range(len(given))]
    run = running_sums(freq, ["column_name"], value_key(freq), weights, config.broadcast_row_limit)
    return run.select("column_name", *value_key(freq), *[
        F.when(F.col(w) > 0, F.col(f"before_{w}") + (F.col(w) + 1) / 2.0).alias(f"r_{i}")
        for i, w in enumerate(weights)])


def _class_sums(ranks: DataFrame, cols: list[str], classes: dict[str, int], todo: list[tuple[int, int]],
                shift: float) -> dict:
    """Pearson sums of the pairs ``todo`` in one scan: the rank of i among the rows of j's class with
    that of j among the rows of i's.  ``ranks`` has a column ``__r<i>_<class>`` for each."""
    k, m = len(cols), max(classes.values()) + 1
    of = [classes[c] for c in cols]

    def sums(batches):
        acc = {t: np.zeros(6) for t in todo}
        ends = {t: np.array([np.inf, -np.inf] * 2) for t in todo}
        for b in batches:
            x = [[b.column(i * m + g).to_numpy(zero_copy_only=False).astype(float) - shift for g in range(m)] for i in range(k)]
            for (i, j), a in acc.items():
                u, v = x[i][of[j]], x[j][of[i]]
                both = ~(np.isnan(u) | np.isnan(v))
                u, v = u[both], v[both]
                a += (len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v)
                if len(u):
                    e = ends[i, j]
                    e[0::2] = np.minimum(e[0::2], (u.min(), v.min()))
                    e[1::2] = np.maximum(e[1::2], (u.max(), v.max()))
        i, j = (pa.array(np.array([t[s] for t in todo], np.int32)) for s in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [i, j, *(pa.array([a[s] for a in acc.values()]) for s in range(6)),
             *(pa.array([e[s] for e in ends.values()]) for s in range(4))], names=["i", "j", *names])

    names = ["n", "sx", "sy", "sxx", "syy", "sxy", "x0", "x1", "y0", "y1"]
    merge = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    got = ranks.select(*[F.col(f"__r{i}_{g}") for i in range(k) for g in range(m)]).mapInArrow(
        sums, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    merged = got.groupBy("i", "j").agg(*[merge.get(c, F.sum)(c).alias(c) for c in names])
    return {(r["i"], r["j"]): r for r in merged.collect()}  # a row per pair


def _spearman_by_class(p: NumericProfile, cols: list[str], classes: dict[str, int],
                       todo: list[tuple[str, str]], config: ProfileConfig) -> dict[tuple[str, str], float | None]:
    """Spearman of column pairs on their pairwise-complete rows.  The rank of a value there depends
    only on the other column's null class, so each column is ranked once a class; ranks come back to
    the rows by one look-up a column."""
    m = max(classes.values()) + 1
    ranked = materialize(_class_ranks(p, cols, classes, config), p.reuse, p.n_rows() * len(cols))
    distinct = {r[0]: r[1] for r in ranked.groupBy("column_name").count().collect()}
    low, out = low_of(p.clean, p.cols), p.clean
    for i, c in enumerate(cols):
        out = _look_up(out, ranked, c, distinct.get(c, 0), low, {f"r_{g}": f"__r{i}_{g}" for g in range(m)}, config)
    at = {c: i for i, c in enumerate(cols)}
    sums = _class_sums(out, cols, classes, [(at[a], at[b]) for a, b in todo], (p.n_rows() + 1) / 2)
    got = {(c, c): 1.0 if distinct.get(c, 0) > 1 else None for c in cols}
    for a, b in todo:
        got[(a, b)] = None
        r = sums.get((at[a], at[b]))
        if r is None or r["n"] < 2 or r["x0"] == r["x1"] or r["y0"] == r["y1"]:
            continue
        n = r["n"]
        vxx, vyy = r["sxx"] - r["sx"] * r["sx"] / n, r["syy"] - r["sy"] * r["sy"] / n
        if vxx > 0 and vyy > 0:
            v = (r["sxy"] - r["sx"] * r["sy"] / n) / math.sqrt(vxx * vyy)
            got[(a, b)] = max(-1.0, min(1.0, v))
    if p.reuse == "persist":
        ranked.unpersist()
    return got


def spearman_matrix(df: DataFrame, columns: list[str] | None = None,
                    config: ProfileConfig = DEFAULT, profile: NumericProfile | None = None
                    ) -> DataFrame:
    """R2: Spearman rank correlation, long matrix, unrounded."""
    cols = columns or numeric_columns(df)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], MATRIX_SCHEMA)
    p = profile or NumericProfile(df, cols, config)
    todo = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    classes = null_classes(p.clean, cols)
    if max(classes.values()) == 0:  # present in the same rows: one rank a value
        ranked, _ = _with_ranks(df, cols, config, p)
        sums = _pair_sums(ranked, cols, {c: (p.n_rows() + 1) / 2 for c in cols})
        values = {(a, b): _pearson(sums, i, j) for i, a in enumerate(cols) for j, b in enumerate(cols)}
    else:
        values = _spearman_by_class(p, cols, classes, todo, config)
    rows = _matrix_rows(cols, lambda i, j: values.get((cols[i], cols[j]),
                                                     values.get((cols[j], cols[i]))))
    return spark.createDataFrame(rows, MATRIX_SCHEMA)


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, method: str | None = None,
                       config: ProfileConfig = DEFAULT, profile: NumericProfile | None = None
                       ) -> DataFrame:
    """R1-R3 dispatcher by method; rounded to the configured precision."""
    method = (method or config.correlation_method).lower()
    if method == "pearson":
        m = pearson_matrix(df, columns, config, profile)
    elif method == "spearman":
        m = spearman_matrix(df, columns, config, profile)
    elif method == "kendall":
        from .kendall import kendall_matrix
        m = kendall_matrix(df, columns, config)
    else:
        raise ValueError(f"Unknown correlation method: {method}")
    return m.select("column1", "column2",
                    rnd(F.col("correlation"), config.numeric_precision).alias("correlation"))


def strong_correlations(matrix: DataFrame, columns: list[str],
                        config: ProfileConfig = DEFAULT) -> DataFrame:
    """Pairs i < j (column order) with |r| >= threshold, sorted by |r|
    descending; strength label and direction from the unrounded value."""
    spark = matrix.sparkSession
    order = spark.createDataFrame([(c, i) for i, c in enumerate(columns)], "name string, i int")
    m = (matrix.join(F.broadcast(order.withColumnsRenamed({"name": "column1", "i": "i1"})), "column1")
         .join(F.broadcast(order.withColumnsRenamed({"name": "column2", "i": "i2"})), "column2"))
    r = F.col("correlation")
    return (m.where((F.col("i1") < F.col("i2")) & (F.abs(r) >= F.lit(config.correlation_threshold)))
            .orderBy(F.abs(r).desc(), "i1", "i2")
            .select("column1", "column2", rnd(r, config.numeric_precision).alias("correlation"),
                    correlation_strength(F.abs(r)).alias("strength"),
                    F.when(r > 0, "positive").otherwise("negative").alias("direction")))
