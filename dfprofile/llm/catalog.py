"""Registered queries of the subpackage and the SQL that repeats them, where SQL can."""

from __future__ import annotations

from dfprofile.llm import (align, decontaminate, jaccard, langid, packing, quality, repeats, sharding, token_files, topk,
                           toxicity, trie, wordpiece)

QUERIES = {
    "op1_packing": packing.q_packing,
    "op2_sharding": sharding.q_sharding,
    "op3_topk": topk.q_topk,
    "op4_decontaminate": decontaminate.q_decontaminate,
    "op5_token_counts": wordpiece.q_token_counts,
    "op6_langid": langid.q_langid,
    "op7_quality": quality.q_quality,
    "op8_token_files": token_files.q_token_files,
    "op9_jaccard": jaccard.q_jaccard,
    "op10_repeats": repeats.q_repeats,
    "op11_align": align.q_align,
    "op12_trie": trie.q_trie,
    "op13_toxicity": toxicity.q_toxicity,
}

ORACLES = {
    "op3_topk": """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND q.vec_id % 50 = 0 AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY rank <= 5
""",
    "op12_trie": """
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) AS pos, dig, bytes
  FROM (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
               md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig
        FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT DISTINCT c, c - c % 5 AS base,
         xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
           lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
                                    lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM t),
r AS (
  SELECT c.c, 0 AS own, t.pos, t.dig, t.bytes FROM c JOIN t ON t.c = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.c, 1, t.pos, t.dig, t.bytes FROM c JOIN t ON t.c = c.c AND t.pos > c.h),
p AS (
  SELECT c, CAST(row_number() OVER w AS BIGINT) AS d, string_agg(dig, '') OVER w AS key, bytes
  FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL
  SELECT c, 0, '', 0 FROM c),
e AS (SELECT c, max(d) AS d FROM p GROUP BY c),
n AS (
  SELECT d, key, min(p.c) AS conv, count(*) AS n_convs, max(bytes) AS bytes,
         string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE e.c IS NOT NULL) AS ends
  FROM p LEFT JOIN e USING (c, d) GROUP BY d, key),
k AS (
  SELECT n.*, up.conv AS parent, coalesce(kids.n, 0) AS n_children
  FROM n LEFT JOIN n up ON up.d = n.d - 1 AND up.key = substr(n.key, 1, 32 * (n.d - 1))
  LEFT JOIN (SELECT d - 1 AS d, substr(key, 1, 32 * (d - 1)) AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL) kids
    ON kids.d = n.d AND kids.key = n.key),
s AS (
  SELECT p.d, p.key, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((k.n_convs - 1) * k.bytes) AS saved
  FROM k JOIN p ON p.c = k.conv AND p.d <= k.d GROUP BY p.d, p.key)
SELECT k.conv AS conv_id, k.d AS depth, k.parent AS parent_conv_id, k.n_convs, k.n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM k JOIN s ON s.d = k.d AND s.key = k.key
""",
}
