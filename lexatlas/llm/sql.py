"""DuckDB SQL for the training-data queries that SQL can express, over the same tables."""

#: Exact near-duplicates: full shingle sets, links from shared shingles, least reachable doc_id.
NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM w
  UNION
  SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x
), roots AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, roots.component_id, w.doc_id = roots.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN roots ON roots.doc_id = w.doc_id
"""

#: Bytes as hex digits; every window of 100 bytes that starts later than an equal one covers its bytes.
SUFFIX_DEDUP = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents WHERE doc_id IS NOT NULL
), wins AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS win
  FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM wins) WHERE k > 1
), runs AS (
  SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS head FROM later
), numbered AS (SELECT doc_id, p, sum(head) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM runs),
spans AS (SELECT doc_id, r, min(p) AS s, max(p) + 100 AS e FROM numbered GROUP BY 1, 2),
gaps AS (
  SELECT doc_id, s AS upto, e AS nxt, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM spans
), kept AS (
  SELECT d.doc_id, any_value(d.n) AS n, sum(g.nxt - g.upto) AS removed, count(*) AS n_spans,
    string_agg(substr(d.h, 2 * g.since + 1, 2 * (g.upto - g.since)), '' ORDER BY g.upto) || substr(any_value(d.h), 2 * max(g.nxt) + 1) AS h
  FROM d JOIN gaps g ON g.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(kept.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(kept.n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: crc32 of the decimal digits of doc_id, byte by byte.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)))"""

#: Levels of doubling: periods up to 2**RUN_LEVELS words.
RUN_LEVELS = 15


def periodic_runs() -> str:
    """Runs of period q in (w/2, w]: places whose w words come again first after q words, in a row."""
    doubled = "".join(f"""
g{k + 1} AS (SELECT doc_id, i, CASE WHEN h IS NOT NULL AND r IS NOT NULL THEN md5(h || r) END AS h FROM (SELECT *, lead(h, {1 << k}) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM g{k})),"""
                      for k in range(RUN_LEVELS))
    found = " UNION ALL ".join(
        f"SELECT doc_id, {1 << k} AS w, i, lead(i) OVER (PARTITION BY doc_id, h ORDER BY i) - i AS q FROM g{k} WHERE h IS NOT NULL" for k in range(RUN_LEVELS + 1)
    )
    return rf"""
WITH w0 AS (SELECT doc_id, {CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
w1 AS (SELECT *, len(ws) AS n, h // 10 AS g FROM w0),
w2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM w1),
w3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w2),
words AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS ws FROM w3),
g0 AS (SELECT doc_id, unnest(range(n)) AS i, md5(unnest(ws)) AS h FROM words),{doubled}
near AS (SELECT * FROM ({found}) WHERE q > w // 2 AND q <= w),
placed AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, w, q ORDER BY i) AS island FROM near),
runs AS (
  SELECT doc_id, min(i) AS s, max(i) + q + w AS e, q FROM placed GROUP BY doc_id, w, q, island
  HAVING max(i) + q + w - min(i) >= greatest(6, 4 * q)
), dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM runs),
kept AS (
  SELECT x.doc_id, string_agg(x.t, ' ' ORDER BY x.i) AS body
  FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(ws) AS t FROM words) x ANTI JOIN dropped d ON d.doc_id = x.doc_id AND d.i = x.i GROUP BY x.doc_id
), summed AS (
  SELECT doc_id, count(*) AS n_runs, min({{'l': s - e, 's': s, 'q': q}}) AS top, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
)
SELECT words.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, -top.l AS length, top.q AS period, 1000 * -top.l // top.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM words LEFT JOIN summed ON summed.doc_id = words.doc_id LEFT JOIN kept ON kept.doc_id = words.doc_id
"""


#: Trees level by level; a node's sibling stands at its index with the last bit turned.
MERKLE = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars, source, lang, text, CASE WHEN ({CRC}) % 7 = 0 THEN 1 ELSE 0 END AS more FROM documents
), h AS (
  SELECT doc_id, tree,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS size, coalesce(strlen(CAST(n_chars + more AS VARCHAR)) || ':' || (n_chars + more), '-') AS size2,
    coalesce(strlen(text) || ':' || text, '-') AS body
  FROM d
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, tree, sha256(head || size || body) AS leaf, sha256(head || size2 || body) AS now FROM h)
), nodes AS (
  SELECT tree, 0 AS lv, i, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, any_value(lv) + 1, i // 2, sha256(string_agg(hash, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, i // 2
), subroots AS (
  SELECT tree, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, max(lv) OVER () + 1 AS base, lv FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS lv, i, subroot AS hash, n FROM subroots
  UNION ALL
  SELECT any_value(lv) + 1, i // 2, sha256(string_agg(hash, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM upper WHERE n > 1 GROUP BY i // 2
), path AS (
  SELECT l.doc_id, l.tree, l.i AS leaf_at, x.lv, x.i % 2 AS right_side, x.sibling
  FROM leaves l JOIN (SELECT a.tree, a.lv, a.i, b.hash AS sibling FROM nodes a LEFT JOIN nodes b ON b.tree = a.tree AND b.lv = a.lv AND b.i = xor(a.i, 1) WHERE a.n > 1) x
    ON x.tree = l.tree AND x.i = l.i >> x.lv
  UNION ALL
  SELECT l.doc_id, l.tree, l.i, s.base + u.lv, u.i % 2, u.sibling
  FROM leaves l JOIN subroots s ON s.tree = l.tree
    JOIN (SELECT a.lv, a.i, b.hash AS sibling FROM upper a LEFT JOIN upper b ON b.lv = a.lv AND b.i = xor(a.i, 1) WHERE a.n > 1) u ON u.i = s.i >> u.lv
), steps AS (
  SELECT tree, leaf_at, list({{'r': right_side, 'x': coalesce(sibling, '')}} ORDER BY lv) AS way, string_agg(coalesce(sibling, ''), '' ORDER BY lv) AS proof FROM path GROUP BY tree, leaf_at
)
SELECT l.doc_id, l.leaf, s.subroot, r.hash AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = r.hash AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree CROSS JOIN (SELECT hash FROM upper WHERE n = 1) r LEFT JOIN steps p ON p.tree = l.tree AND p.leaf_at = l.i
  JOIN (
    SELECT l.tree, l.i, list_reduce(list_prepend({{'r': 0::BIGINT, 'x': l.now}}, coalesce(p.way, [])),
      lambda c, y: {{'r': 0::BIGINT, 'x': sha256(CASE WHEN y.r = 1 THEN y.x || c.x ELSE c.x || y.x END)}}).x AS folded_root
    FROM leaves l LEFT JOIN steps p ON p.tree = l.tree AND p.leaf_at = l.i
  ) f ON f.tree = l.tree AND f.i = l.i
"""
