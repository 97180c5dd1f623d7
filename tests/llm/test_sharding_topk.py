import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dfprofile.llm import sharding, topk


def check_shards(rows, docs, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs)
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_edge_rows(edge_docs):
    check_shards(sharding.shard(edge_docs, 3).collect(), edge_docs.collect(), 3)


def test_empty(empty_docs):
    assert sharding.shard(empty_docs).count() == 0


def test_links_stay_together_and_a_hot_text_is_split(make_docs):
    rows = [(i, "hot text") for i in range(200)] + [(200 + i, f"pair {i // 4}") for i in range(200)]
    rows += [(400 + i, f"single {i}") for i in range(200)]
    docs = make_docs(rows)
    got = sharding.shard(docs, 10).collect()
    check_shards(got, docs.collect(), 10)
    where = defaultdict(set)
    for r in got:
        where[r.group].add(r.shard)
    split = [g for g, s in where.items() if len(s) > 1]
    assert len(split) <= 1 + 10 and max(len(s) for s in where.values()) <= 7  # the hot text needs 4 at least


def brute(vectors, k):
    out = {}
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in ok:
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(b) == len(a))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_topk_equals_brute_force(spark, block):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.normal(0, 0.4, 8).tolist()) for i in range(301)]
    vectors += [(301, None), (302, [1.0, None] + [0.0] * 6), (303, [float("nan")] * 8), (304, [float("inf")] * 8),
                (350, vectors[0][1]), (351, vectors[0][1]), (352, [0.5, 0.25]), (400, [0.5, -0.25]), (450, [1e9] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2 AS score", "3 AS dim")
    v = topk.integer_vectors(df)
    got = defaultdict(list)
    for r in sorted(topk.search(v, v.where("vec_id % 50 = 0"), block_rows=block, query_rows=block).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    want = {q: x for q, x in brute(vectors, 5).items() if x}
    assert dict(got) == want


def test_topk_empty(spark):
    v = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(v, v).count() == 0


def test_topk_deals_blocks_of_one_length_over_partitions(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(0, 0.4, 4).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df)
    found = topk.search(v, v.where("vec_id % 50 = 0"), block_rows=10, query_rows=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan and "RoundRobin" not in plan  # full blocks are shuffled once
    joins = [x for x in plan.split("\n") if "hashpartitioning(dim" in x]
    assert joins and all("salt" in x for x in joins), plan
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], 5)
    assert Counter((r.query_id, r.vec_id, r.score) for r in found.collect()) == Counter(
        (q, i, x) for q, best in want.items() for i, x in best)


def test_topk_null_ids_and_components_beyond_64_bits(spark):
    rows = [(None, [1.0, 2.0]), (0, [1.0, 1.0]), (50, [2.0, 1.0]), (3, None), (4, [1.0, float("nan")])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = topk.integer_vectors(t)
    got = topk.search(v, v.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, 50), (50, 0)]
    far = spark.createDataFrame([(0, [1e300, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.integer_vectors(far).collect()
