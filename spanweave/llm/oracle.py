"""DuckDB SQL of the queries that SQL can express, in the plainest form: all pairs, whole tables."""

PERMUTED = "(({b}) * (2 * ({e} * 40503 % 1009) + 1237) + {e} * 2654 + 97) % 4096"
SOUND = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE = {
    "op1_mix_sources": f"""WITH t AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS n, CAST('0x' || substr(md5('mix:' || doc_id), 1, 7) AS BIGINT) % 4096 AS block,
    CAST('0x' || substr(md5('mix:in:' || doc_id), 1, 7) AS BIGINT) AS inner_ FROM documents),
  s AS (SELECT source, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY source),
  a AS (SELECT max(n) AS most, CASE WHEN max(n) <= 2 * min(n) THEN 0 ELSE round(1 - ln(2) / ln(max(n) / min(n)), 6) END AS alpha FROM s),
  z AS (SELECT sum(pow(n, alpha)) AS z FROM s, a),
  q AS (SELECT source, n, round(pow(n, alpha) / z, 9) AS weight, CAST(round(pow(most / n, 1 - alpha) * n) AS BIGINT) AS quota FROM s, a, z),
  e AS (SELECT *, quota // n AS epochs, quota % n AS rest, quota / n AS passes FROM q),
  b AS (SELECT source, block, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY source, block),
  r AS (SELECT b.source, b.n, e.rest, {PERMUTED.format(b='b.block', e='e.epochs')} AS rank FROM b JOIN e USING (source)),
  c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY rank) - n AS before FROM r),
  l AS (SELECT source, coalesce(max(CASE WHEN rest > 0 AND before * 2 + n <= rest * 2 THEN rank END), -1) AS last FROM c GROUP BY source),
  d AS (SELECT t.*, e.weight, e.passes, e.epochs + CASE WHEN {PERMUTED.format(b='t.block', e='e.epochs')} <= l.last THEN 1 ELSE 0 END AS copies FROM t JOIN e USING (source) JOIN l USING (source)),
  x AS (SELECT *, unnest(range(copies)) AS copy FROM d)
SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, weight, CAST(block AS INTEGER) AS block, CAST(copy AS INTEGER) AS copy,
  CAST(floor((copy + ({PERMUTED.format(b='block', e='copy')} + inner_ / 268435456.0) / 4096.0) / passes * 1e12) AS BIGINT) AS mix_rank FROM x""",
    "op8_near_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {SOUND}),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
  r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
  c AS (SELECT node, min(seen) AS m FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.m, vec_id) AS component_id, coalesce(c.m, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op9_exact_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings WHERE {SOUND}),
  j AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.w, b.w) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM j)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_near_duplicates": """WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(trim(lower(text), ' \t\r\n'), '\\s+') AS w FROM documents WHERE trim(text, ' \t\r\n') <> ''),
  g AS (SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT *, unnest(range(greatest(1, len(w) - 4))) AS i FROM w) z),
  s AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY doc_id, g), t AS (SELECT doc_id, sum(n) AS t FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
  l AS (SELECT a, b FROM p JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b WHERE x >= 0.8 * (ta.t + tb.t - x)), y AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT a AS node, a AS seen FROM y UNION SELECT r.node, y.b FROM r JOIN y ON y.a = r.seen), c AS (SELECT node, min(seen) AS m FROM r GROUP BY node)
SELECT doc_id, coalesce(m, doc_id) AS class_id, coalesce(m, doc_id) = doc_id AS kept FROM documents LEFT JOIN c ON c.node = doc_id""",
}
