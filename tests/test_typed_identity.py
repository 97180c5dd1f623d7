"""Values that share a double keep apart; Spearman ranks by null class."""

from decimal import Decimal

import numpy as np
import pandas as pd

from dfprofile.config import ProfileConfig
from dfprofile.operators.correlation import null_classes, spearman_matrix
from dfprofile.operators.kendall import kendall_matrix
from dfprofile.operators.numeric import NumericProfile, numeric_stats
from dfprofile.operators.schema import schema_profile, type_narrowing


def _matrix(df):
    return {(r.column1, r.column2): r.correlation for r in df.collect()}


def test_integers_and_decimals_beyond_doubles(spark):
    rows = [(2 ** 60 + i, -2 ** 63 + i, 2 ** 63 - 1 - i, Decimal(10 ** 20 + i) / 1000, i, i / 7) for i in range(20)]
    df = spark.createDataFrame(rows, "a long, low long, high long, d decimal(28,3), i int, x double")
    got = {r.column_name: r.unique_count for r in schema_profile(df).collect()}
    assert got == dict.fromkeys(["a", "low", "high", "d", "i", "x"], 20)
    m = _matrix(spearman_matrix(df))
    assert all(abs(abs(v) - 1) < 1e-12 for v in m.values()) and m["a", "high"] < 0 < m["a", "d"]
    k = _matrix(kendall_matrix(df))
    assert k["a", "low"] == 1.0 and k["d", "high"] == -1.0
    few = ProfileConfig(rank_bucket_rows=4)
    assert _matrix(spearman_matrix(df, config=few))["a", "low"] > 0.999999
    assert NumericProfile(df, ["a", "x"]).basic_rows()["a"][1] == 20
    assert {r.column_name: r["mode"] for r in numeric_stats(df, ["a"]).collect()}["a"] == float(2 ** 60)
    kinds = {r.column_name: r.recommended_type for r in type_narrowing(df).collect()}
    assert kinds["a"] == "bigint" or kinds["a"] is None


def test_small_integers_need_no_residual(spark):
    p = NumericProfile(spark.createDataFrame([(1, 2.0), (2 ** 53, None)], "a long, b double"))
    assert p.clean.columns == ["a", "b"] and "low" not in p.raw_freq().columns
    p.release()


def test_spearman_by_null_class(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({c: rng.integers(0, 30, n).astype(float) for c in "abcde"})
    pdf.loc[::3, "b"] = np.nan
    pdf.loc[::3, "c"] = np.nan  # the same rows as b
    pdf.loc[rng.random(n) < 0.4, "d"] = np.nan
    pdf["f"], pdf["g"] = 5.0, np.nan
    pdf.loc[pdf.b.notna(), "h"] = 1.0
    pdf.loc[3, "h"] = 1.0
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in pdf.itertuples(index=False)],
                               ", ".join(f"{c} double" for c in pdf.columns))
    cls = null_classes(NumericProfile(df).clean, list(pdf.columns))
    assert cls["a"] == cls["e"] == cls["f"] and cls["b"] == cls["c"] and len(set(cls.values())) == 5
    want = pdf.corr("spearman")
    for cfg in (ProfileConfig(), ProfileConfig(broadcast_row_limit=0), ProfileConfig(rank_bucket_rows=50)):
        got = _matrix(spearman_matrix(df, config=cfg))
        for a in pdf.columns:
            for b in pdf.columns:
                w, v = want.loc[a, b], got[a, b]
                assert (v is None and (w != w)) or (v is not None and abs(v - w) < 1e-9), (a, b, v, w)


def test_one_narrow_range_still_ranks_in_parallel(spark):
    """Epoch seconds of one year share their leading bits; buckets come from quantiles."""
    df = spark.range(4000).selectExpr("1700000000 + id * 7919 % 31536000 AS ts",
                                      "CASE WHEN id % 5 <> 0 THEN id END AS v")
    p = NumericProfile(df, ["ts", "v"], ProfileConfig(rank_bucket_rows=100))
    assert p.raw_freq().where("column_name = 'ts'").select("bucket").distinct().count() >= 30
    p.release()


def test_kendall_counts_inversions_over_levels_and_blocks(spark, monkeypatch):
    from dfprofile.operators import kendall as K

    rng = np.random.default_rng(5)
    rows = [("p0", int(x), int(y), int(c)) for x, y, c in zip(rng.integers(0, 700, 900), rng.integers(0, 70000, 900), rng.integers(1, 4, 900))]
    rows += [("p1", 5, int(y), 1) for y in rng.integers(0, 9, 50)] + [("p2", 1, 2, 3)]
    for blocks, batch in ((4096, 200_000), (4, 7)):
        monkeypatch.setattr(K, "MAX_BLOCKS", blocks)
        monkeypatch.setattr(K._inversions, "__defaults__", (batch,))
        df = spark.createDataFrame(rows, "pair string, x long, y long, c long").groupBy("pair", "x", "y").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c")
        got = {r["pair"]: r["tau"] for r in K.kendall_tau(df, 17).collect()}
        x, y, c = (np.array([r[i] for r in rows if r[0] == "p0"], float) for i in (1, 2, 3))
        s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y) * c[:, None] * c
        tie = lambda v: ((v[:, None] != v) * c[:, None] * c).sum()
        assert abs(got["p0"] - s.sum() / np.sqrt(tie(x) * tie(y))) < 1e-12
        assert got["p1"] is None and got["p2"] is None
