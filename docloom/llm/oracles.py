"""DuckDB's SQL for the queries of this folder that SQL can express: brute force over whole tables."""

from __future__ import annotations

# Every 50-byte string of every text, the first document that holds it, and the runs that such strings cover.
PREFIX_FREE = """WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 49, 0)::BIGINT)) AS i FROM h),
g AS (SELECT p.doc_id, i, substr(h, (2 * i + 1)::BIGINT, 100) AS s FROM p JOIN h USING (doc_id)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
o AS (SELECT *, CASE WHEN i > lag(i) OVER w + 50 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM o),
r AS (SELECT doc_id, island, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY ALL),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS front, max(z) AS z, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(front, '') || substr(h, (2 * coalesce(z, 0) + 1)::BIGINT))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id)"""

# crc32 by its table, made by the rule of the polynomial; shards by the largest of their md5 digits (equal weights).
SHARDING = """WITH t AS (SELECT list_transform(range(256), lambda k: list_reduce([k::UBIGINT] || list_transform(range(8), lambda x: x::UBIGINT),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
h AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT *, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::UBIGINT) AS b FROM h),
c AS (SELECT doc_id, key, length(h) // 2 + 8 AS size, xor(list_reduce([4294967295::UBIGINT] || b, lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM b, t),
u AS (SELECT key, i, substr(md5(key || '/' || i), 1, 13) AS u FROM (SELECT DISTINCT key FROM c), range(25) r(i)),
s AS (SELECT key, i FROM u WHERE i < 24 QUALIFY row_number() OVER (PARTITION BY key ORDER BY u DESC, i) = 1),
g AS (SELECT key, i FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY u DESC, i) = 1)
SELECT doc_id, size, text_crc32, 'key' AS law, s.i::INT AS shard, row_number() OVER (PARTITION BY s.i ORDER BY md5(key || '/' || text_crc32), doc_id, size, text_crc32) - 1 AS slot, g.i::INT AS grown_shard
FROM c JOIN s USING (key) JOIN g USING (key)"""

# Distinct word triples, all pairs that share one, and what is reachable over links.
NEAR_DUP = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT x, b FROM reach JOIN e ON y = a),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = w.doc_id"""

ORACLES = {"op1_prefix_free": PREFIX_FREE, "op4_sharding": SHARDING, "op6_near_dup": NEAR_DUP}
