import random
from collections import Counter

from conftest import rows_by
from dfprofile import profile
from dfprofile.operators.categorical import HEAD, categorical_stats, top_categories, value_heads
from dfprofile.plans.insights import insight_context
from dfprofile.plans.unfold import unfold, unfold_context


def _check(spark, texts, k):
    df = spark.createDataFrame([(t,) for t in texts], "`a.b` string").repartition(5)
    got = [(r.rank, r.value, r["count"]) for r in top_categories(df, ["a.b"], k).orderBy("rank").collect()]
    best = sorted(Counter(t for t in texts if t is not None).items(), key=lambda i: (-i[1], i[0].encode()))[:k]
    assert got == [(i + 1, v, c) for i, (v, c) in enumerate(best)]
    r = rows_by(categorical_stats(df, ["a.b"]))["a.b"]
    want = best[0] if best else (None, None)
    assert (r["unique_count"], r["most_frequent"], r["frequency"]) == (len(set(texts) - {None}), *want)


def test_winners_among_long_texts_are_exact(spark):
    rng = random.Random(5)
    same = "h" * HEAD  # ties in count and head: only whole texts tell the order
    texts = [same + str(rng.randrange(60)) for _ in range(400)] + ["é" * 70, "é" * 64, "", None, "x" * HEAD]
    texts += ["y" * 65] * 9 + ["z" * 5000] * 12 + ["short"] * 12
    for k in (1, 4, 20, 1000):
        _check(spark, texts, k)


def test_all_texts_tie(spark):
    texts = ["p" * 100 + f"{i:04d}" for i in range(300)]
    random.Random(1).shuffle(texts)
    _check(spark, texts, 7)


def test_a_digest_as_a_value_is_another_value(spark):
    import hashlib
    long = "w" * 200
    _check(spark, [long, long, hashlib.md5(long.encode()).hexdigest(), None, long[:HEAD]], 5)


def test_no_values(spark):
    _check(spark, [None, None], 3)


def test_no_text_in_the_shuffle_of_counts(spark):
    df = spark.range(10).selectExpr("repeat(CAST(id AS STRING), 500) AS t")
    heads = value_heads(df, ["t"])
    assert heads.columns == ["column_name", "head", "digest", "cnt"]
    assert max(len(r.head) for r in heads.collect()) == HEAD
    plan = heads._jdf.queryExecution().executedPlan().toString()
    key = next(line for line in plan.splitlines() if "hashpartitioning" in line)
    assert "value" not in key


def test_unfolded_report_holds_every_leaf(spark):
    df = spark.createDataFrame([(i, float(i % 7), ("a", "b")[i % 2]) for i in range(60)], "k int, x double, c string")
    p = profile(df, row_key="k")
    rows = {(r.section, r.ord, r.field): r.number if r.text is None else r.text
            for r in unfold(p.report(job_id="j")).collect()}
    assert rows["report", 0, "job_id"] == "j" and rows["report", 0, "row_count"] == 60
    assert rows["columns", 2, "column_name"] == "c" and rows["columns", 2, "unique_count"] == 2
    assert rows["column_statistics", 1, "stats.median"] == 3.0
    assert rows["top_categories", 0, "value"] == "a" and rows["top_categories", 0, "count"] == 30
    assert rows["distribution_analysis", 0, "is_normal"] in ("true", "false")
    assert not [key for key in rows if key[0] == "strong_correlations"]
    ctx = {(r.section, r.ord, r.field): r.number for r in unfold_context(insight_context(p)).collect()}
    assert ctx["dataset_overview", 0, "rows"] == 60 and ctx["column_summaries", 1, "stats.max"] == 6.0
    p.release()


def test_unfold_of_nulls_and_of_no_rows(spark):
    df = spark.sql("SELECT 1 AS n, CAST(NULL AS STRING) AS t, array(1, NULL, 3) AS a, "
                   "CAST(NULL AS ARRAY<STRUCT<x: INT>>) AS s, array(named_struct('x', CAST(NULL AS INT)), "
                   "named_struct('x', 4)) AS u")
    got = sorted((r.section, r.ord, r.field, r.number, r.text) for r in unfold(df).collect())
    assert got == [("report", 0, "a", None, "1, 3"), ("report", 0, "n", 1.0, None), ("u", 1, "x", 4.0, None)]
    assert unfold(df.where("false")).count() == 0
