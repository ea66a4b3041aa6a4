"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: A-Z alone are lower-cased; words are runs of anything but blank and 0x09-0x0D.
_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
)

#: Components of the links (a, b), by following them from every node: (node, component).
_REACH = """
reach(node, seen) AS (
  SELECT DISTINCT a, a FROM (SELECT a FROM links UNION ALL SELECT b FROM links)
  UNION
  SELECT r.node, CASE WHEN l.a = r.seen THEN l.b ELSE l.a END
  FROM reach r JOIN links l ON l.a = r.seen OR l.b = r.seen
),
component AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
"""

CHAT = """
WITH turns AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
logged AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS t, max(turn) AS final
  FROM turns GROUP BY conv_id
),
single AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, t, any_value(final) AS final FROM logged GROUP BY t),
kept AS (
  SELECT * FROM single a WHERE NOT EXISTS (
    SELECT 1 FROM single b
    WHERE b.t[1] = a.t[1] AND len(b.t) > len(a.t) AND b.t[1:len(a.t)] = a.t AND b.t[len(a.t) + 1].turn > a.final)
),
parts AS (
  SELECT conv_id, copies, floor(turn / 256) AS chunk, count(*) AS turns,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
  FROM kept JOIN turns USING (conv_id) GROUP BY ALL
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY chunk) - 1 AS INTEGER) AS part, turns, copies, text FROM parts
"""

NEAR_DEDUP = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM docs
),
shingles AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)
), {_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN component ON node = doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), {_REACH},
degree AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM links UNION ALL SELECT b FROM links) GROUP BY node)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN component c ON c.node = vec_id LEFT JOIN degree d ON d.node = vec_id
"""

#: CRC-32 of a column of ASCII text, bit by bit (the polynomial is the standard's, reflected).
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)), lambda s, b: "
    "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)

TRIE = f"""
WITH raw AS (
  SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS bytes,
         sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS hash
  FROM conversations WHERE conv_id IS NOT NULL
),
ranked AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, hash) AS p, hash, bytes FROM raw),
own AS (SELECT c, count(*) AS n, {_CRC32.format("c::VARCHAR")} % 9 AS h FROM ranked GROUP BY c),
conv AS (
  SELECT o.c, o.c - o.c % 5 AS b, o.h, least(o.h, coalesce(b.n, 0)) AS k, least(o.h, coalesce(b.n, 0)) + greatest(o.n - o.h, 0) AS n
  FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 5
),
rebuilt AS (
  SELECT v.c, r.p, r.hash, r.bytes FROM conv v JOIN ranked r ON r.c = v.b AND r.p <= v.k
  UNION ALL SELECT v.c, v.k + r.p - v.h, r.hash, r.bytes FROM conv v JOIN ranked r ON r.c = v.c AND r.p > v.h
),
path AS (
  SELECT c, p AS d, list(hash) OVER (PARTITION BY c ORDER BY p) AS key, bytes FROM rebuilt
  UNION ALL SELECT c, 0, [], 0 FROM conv
),
grouped AS (SELECT d, key, min(c) AS o, count(*) AS n_convs, any_value(bytes) AS bytes FROM path GROUP BY d, key),
member AS MATERIALIZED (SELECT p.c, p.d, g.o FROM path p JOIN grouped g ON g.d = p.d AND g.key = p.key),
node AS MATERIALIZED (SELECT g.o, g.d, m.o AS parent, g.n_convs, (g.n_convs - 1) * g.bytes AS saved FROM grouped g LEFT JOIN member m ON m.c = g.o AND m.d = g.d - 1),
child AS (SELECT parent AS o, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
subtree AS (
  SELECT m.o, m.d, sum(u.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM node u JOIN member m ON m.c = u.o AND m.d <= u.d LEFT JOIN child c ON c.o = u.o AND c.d = u.d GROUP BY m.o, m.d
),
ends AS (SELECT m.o, m.d, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) AS ids FROM member m JOIN conv v ON v.c = m.c AND v.n = m.d GROUP BY m.o, m.d)
SELECT n.o AS conv_id, n.d::BIGINT AS depth, n.parent AS parent_conv_id, n.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM node n JOIN subtree s ON s.o = n.o AND s.d = n.d LEFT JOIN child c ON c.o = n.o AND c.d = n.d LEFT JOIN ends e ON e.o = n.o AND e.d = n.d
"""


def clusters(k: int = 8, rounds: int = 10, dimensions: int = 64) -> str:
    """SQL of ``cluster_vectors``: all distances of every round, the rounds one after the other."""

    def assigned(i: int) -> str:
        return (
            f"d{i} AS MATERIALIZED (SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{i} c ON c.i = x.i GROUP BY x.r, c.c),\n"
            f"a{i} AS MATERIALIZED (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
        )

    steps = []
    for i in range(rounds):
        steps.append(assigned(i))
        steps.append(f"m{i} AS (SELECT a.c, x.i, sum(x.x) AS s, count(*) AS n FROM a{i} a JOIN x ON x.r = a.r GROUP BY a.c, x.i)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x)::BIGINT AS x FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c AND m.i = c.i)")
    steps.append(assigned(rounds))
    joined = ",\n".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
x AS MATERIALIZED (SELECT r, i, floor(1024 * v[i]::DOUBLE)::BIGINT AS x FROM kept, range(1, {dimensions + 1}) t(i)),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR), r) - 1 AS c FROM kept WHERE vec_id IS NOT NULL),
c0 AS MATERIALIZED (SELECT s.c, x.i, x.x FROM s JOIN x ON x.r = s.r WHERE s.c < {k}),
{joined},
digest AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)
SELECT k.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, g.h AS centroid_sha256
FROM a{rounds} a JOIN kept k ON k.r = a.r JOIN digest g ON g.c = a.c
"""
