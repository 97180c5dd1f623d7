import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from dfprofile.operators.correlation import (correlation_matrix, pearson_matrix, spearman_matrix,
                                             strong_correlations)
from dfprofile.operators.kendall import kendall_matrix


def mat(df):
    return {(r[0], r[1]): r[2] for r in df.collect()}


def test_f5_perfect_pair(spark):
    df = spark.createDataFrame([(x, 2 * x) for x in range(1, 6)], "x bigint, y bigint")
    m = pearson_matrix(df)
    s = strong_correlations(m, ["x", "y"]).collect()
    assert len(s) == 1
    r = s[0]
    assert (r.column1, r.column2, r.correlation, r.strength, r.direction) == \
        ("x", "y", 1.0, "very_strong", "positive")


def test_e4_pairwise_complete_matches_pandas(spark):
    random.seed(3)
    rows = []
    for i in range(200):
        a = random.gauss(0, 1)
        b = a * 0.5 + random.gauss(0, 1)
        c = random.gauss(5, 2)
        rows.append((None if i % 7 == 0 else a, None if i % 11 == 0 else b, c))
    df = spark.createDataFrame(rows, "a double, b double, c double")
    pdf = pd.DataFrame(rows, columns=["a", "b", "c"])
    got = mat(pearson_matrix(df))
    exp = pdf.corr()
    for x, y in itertools.product("abc", repeat=2):
        assert got[(x, y)] == pytest.approx(exp.loc[x, y], abs=1e-9)
    got_s = mat(spearman_matrix(df))
    exp_s = pdf.corr(method="spearman")
    for x, y in itertools.product("abc", repeat=2):
        assert got_s[(x, y)] == pytest.approx(exp_s.loc[x, y], abs=1e-9)


def test_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(30)], "x double, k double")
    m = mat(correlation_matrix(df, None, "pearson"))
    assert m[("x", "k")] is None and m[("k", "k")] is None and m[("x", "x")] == 1.0


def _tau_b(xs, ys):
    n0 = n1 = n2 = n3 = c = d = 0
    for i in range(len(xs)):
        for j in range(i + 1, len(xs)):
            dx, dy = xs[i] - xs[j], ys[i] - ys[j]
            n0 += 1
            n1 += dx == 0
            n2 += dy == 0
            n3 += dx == 0 and dy == 0
            if dx * dy > 0:
                c += 1
            elif dx * dy < 0:
                d += 1
    return (c - d) / math.sqrt((n0 - n1) * (n0 - n2))


def test_kendall_matches_brute_force_with_ties(spark):
    random.seed(5)
    rows = [(float(random.randint(0, 12)), float(random.randint(0, 9)), random.random())
            for _ in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = mat(kendall_matrix(df))
    for x, y in [("a", "b"), ("a", "c"), ("b", "c")]:
        i, j = "abc".index(x), "abc".index(y)
        exp = _tau_b([r[i] for r in rows], [r[j] for r in rows])
        assert got[(x, y)] == pytest.approx(exp, abs=1e-12)
        assert got[(y, x)] == pytest.approx(exp, abs=1e-12)


def test_kendall_pairwise_complete_with_nulls(spark):
    random.seed(21)
    rows = [(None if i % 5 == 0 else float(random.randint(0, 6)),
             None if i % 7 == 0 else float(random.randint(0, 4))) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = mat(kendall_matrix(df))
    keep = [(x, y) for x, y in rows if x is not None and y is not None]
    exp = _tau_b([x for x, _ in keep], [y for _, y in keep])
    assert got[("a", "b")] == pytest.approx(exp, abs=1e-12)


def test_kendall_counts_each_pair_of_rows_in_a_block_or_the_grid(spark, monkeypatch):
    """Small blocks, values of more rows than a block, nulls; rows are dealt once a column, not once a digit."""
    from dfprofile.operators import kendall as K

    rng = np.random.default_rng(8)
    n = 1500
    a = rng.integers(0, 400, n).astype(float)
    a[rng.random(n) < 0.3] = 7.0
    b = np.round(a + rng.normal(0, 60, n))
    b[rng.random(n) < 0.2] = -3.0
    c = rng.permutation(n).astype(float)
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    for col, share in (("a", 0.05), ("b", 0.1)):
        pdf.loc[rng.random(n) < share, col] = np.nan
    dealt = []
    inversions = K._inversions
    for rows in (20, 250, 250_000):
        monkeypatch.setattr(K, "BLOCK_ROWS", rows)
        monkeypatch.setattr(K, "_inversions", lambda df, *args: dealt.append(df.count()) or inversions(df, *args))
        got = mat(kendall_matrix(spark.createDataFrame(
            [tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "a double, b double, c double")))
        for x, y in itertools.product(pdf.columns, repeat=2):
            u, v = (np.sign(w[:, None] - w) for w in pdf[[x, y]].dropna().to_numpy().T) if x != y else (np.ones(1),) * 2
            assert abs(got[x, y] - (u * v).sum() / np.sqrt((u * u).sum() * (v * v).sum())) < 1e-12, (rows, x, y)
    assert max(dealt[2:]) < 300, dealt  # the grid's cells, not the rows, where blocks hold 250 rows or more
