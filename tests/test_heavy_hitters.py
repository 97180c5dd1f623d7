import random
from collections import Counter

import pytest

from dfprofile.operators.heavy import count_sketch, heavy_hitters, merge_sketches


def frame(spark, seed, n=4000):
    rng = random.Random(seed)
    rows = [(f"v{int(rng.paretovariate(0.6)) % 3000}", rng.randrange(5), None) for _ in range(n)]
    return spark.createDataFrame(rows, "`a.b` string, n int, empty string"), Counter(r[0] for r in rows)


@pytest.mark.parametrize("slots,candidates", [(1 << 16, 1024), (256, 24), (16, 2), (8, 8)])
def test_proven_rows_are_the_exact_ones(spark, slots, candidates):
    df, exact = frame(spark, 3)
    want = sorted(exact.items(), key=lambda x: (-x[1], x[0]))
    got = heavy_hitters(df, ["a.b", "n", "empty"], 20, slots=slots, candidates=candidates).collect()
    assert not [r for r in got if r.column_name == "empty"]
    rows = sorted((r for r in got if r.column_name == "a.b"), key=lambda r: r["rank"])
    listed = {r.value for r in rows}
    for r in rows:
        assert exact[r.value] == r["count"]
        if r.proven:
            assert want[r["rank"] - 1] == (r.value, r["count"])
    if rows:
        least = min(r["count"] for r in rows) if len(rows) == 20 else 0
        assert all(c <= max(rows[0].unseen, least) for v, c in exact.items() if v not in listed)
    if slots > 1000 or slots == candidates:
        assert [(r.value, r["count"], r.proven) for r in rows] == [(*x, True) for x in want[:20]]


def test_sketches_merge(spark):
    (a, x), (b, y) = frame(spark, 5), frame(spark, 6, 1500)
    both = merge_sketches(count_sketch(a, ["a.b"]), count_sketch(b, ["a.b"]))
    whole = a.unionByName(b)
    assert Counter(both.collect()) == Counter(count_sketch(whole, ["a.b"]).collect())
    got = heavy_hitters(whole, ["a.b"], 5, sketch=both).orderBy("rank").collect()
    assert [(r.value, r["count"]) for r in got] == sorted((x + y).items(), key=lambda v: (-v[1], v[0]))[:5]


def test_texts_are_not_shuffled_for_the_sketch(spark):
    df = spark.createDataFrame([("x" * 5000,)] * 3, "t string")
    plan = count_sketch(df, ["t"])._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange" in line)
    assert "value" not in exchange


def test_empty_table(spark):
    assert heavy_hitters(spark.createDataFrame([], "a string"), ["a"]).count() == 0
