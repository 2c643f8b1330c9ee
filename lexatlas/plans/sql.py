"""DuckDB SQL of the catalogue's queries, over the same tables."""

from lexatlas.functions.text import CHUNK_OVERLAP, CHUNK_SIZE, GENERIC_TERMS, MARKED, PLAIN, stop_words

_STOP = ", ".join(f"'{w}'" for w in stop_words())
_GENERIC = ", ".join(f"'{w}'" for w in GENERIC_TERMS)
_TOKENS = f"regexp_extract_all(translate(lower(coalesce(text, '')), '{MARKED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_ONE = r"trim(regexp_replace(coalesce({}, ''), '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'), ' ')"
_TITLE = "(list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: " + _ONE.format("x") + "), lambda x: x <> '')[1])"
_BIGRAMS = "list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)"


def _no_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda x: x NOT IN ({_STOP}))"


_PLAIN_WORDS = _no_stop(r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')")

_STATUS = """corpus AS (
  SELECT d.doc_id, d.text, d.source || '/' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') || '.txt' AS relative_path, length(d.text) AS char_count,
    CASE WHEN d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'missing' ELSE 'active' END AS status
  FROM documents d
)"""


def _weights(words: str, table: str = "documents", key: str = "doc_id") -> str:
    return f"""tok AS (SELECT {key} AS k, {words} AS w FROM {table}),
trm AS (SELECT k, unnest({_BIGRAMS}) AS term FROM tok),
cnt AS (SELECT k, term, count(*) AS tf FROM trm GROUP BY 1, 2),
idf AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT k) FROM tok)) / (1 + count(*))) + 1 AS idf FROM cnt GROUP BY 1),
raw AS (SELECT k, term, tf * idf AS raw FROM cnt JOIN idf USING (term)),
nrm AS (SELECT k, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1),
wgt AS (SELECT k AS doc_id, term, raw / norm AS weight FROM raw JOIN nrm USING (k))"""


def _bm25(words: str) -> str:
    return f"""tok AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
len AS (SELECT count(*) AS n, avg(len(w)) AS mean_length FROM tok),
pst AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM tok) WHERE term IN ({words}) GROUP BY 1, 2, 3),
dfs AS (SELECT term, count(*) AS df FROM pst GROUP BY 1),
sco AS (
  SELECT doc_id, -sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END)
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS score
  FROM pst JOIN dfs USING (term), len GROUP BY 1
)"""


BM25 = f"""WITH {_bm25(f"SELECT unnest({_TOKENS}) FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)")}
SELECT doc_id, round(score, 6) AS score FROM sco ORDER BY round(score, 6), doc_id LIMIT 10"""

FTS_BOOLEAN = f"""WITH tok AS (SELECT doc_id, {_TOKENS} AS w FROM documents)
SELECT doc_id FROM tok WHERE (len(list_filter(w, lambda x: starts_with(x, 'erst'))) > 0 OR list_contains(w, 'tion')) AND NOT list_contains(w, 'des')"""

FTS_FALLBACK = f"""WITH {_STATUS}, {_bm25("'the', 'tion', 'and'")}, hit AS (SELECT doc_id, relative_path, score FROM sco JOIN corpus USING (doc_id) WHERE status = 'active')
SELECT CAST(row_number() OVER (ORDER BY round(score, 9), relative_path) AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM hit ORDER BY 1 LIMIT 10"""

_COLS = (("t", "title"), ("p", "relative_path"), ("x", "text"))
_WHOLE = "list_filter(range(1, len({w}) + 1), lambda i: {test})"


def _phrase(words: list[str], begun: bool = False, columns: str = "tpx") -> str:
    """Hits of a phrase in the token lists of some columns."""
    test = " AND ".join(f"starts_with(coalesce({{w}}[i + {j}], ''), '{x}')" if begun and j == len(words) - 1 else f"coalesce({{w}}[i + {j}], '') = '{x}'" for j, x in enumerate(words))
    return " + ".join(f"len({_WHOLE.format(w=c, test=test.format(w=c))})" for c in columns)


def _phrases(corpus: str, parts: list[str], match: str, raw: list[str] | None = None, given: list[str] | None = None) -> str:
    """Scores of rows (key, t, p, x: token lists) by the hits f0, f1, ... of phrases; raw: hits that count for a phrase's rows; given: what else must hold for a phrase to add."""
    n = range(len(parts))
    raw, given = raw or parts, given or ["TRUE"] * len(parts)
    idf = lambda k: f"(CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) > 0 THEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) ELSE 1e-6 END)"
    return f"""{corpus},
fts_hits AS (SELECT *, len(t) + len(p) + len(x) AS length, {", ".join(f"{x} AS f{k}, ({raw[k]}) > 0 AS r{k}" for k, x in enumerate(parts))} FROM fts_rows),
fts_stat AS (SELECT count(*) AS n, avg(length) AS mean_length, {", ".join(f"count(*) FILTER (WHERE r{k}) AS d{k}" for k in n)} FROM fts_hits),
fts_score AS (
  SELECT key, -({" + ".join(f"(CASE WHEN f{k} > 0 AND {given[k]} THEN {idf(k)} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * length / mean_length)) ELSE 0 END)" for k in n)}) AS score
  FROM fts_hits, fts_stat WHERE {match}
)"""


def _tokens_of(column: str) -> str:
    return _TOKENS.replace("text", column)


def _shown(rows: str, statuses: str = "'active'") -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY round(score, 9), relative_path) AS INTEGER) AS rank, key AS {rows}, round(score, 6) AS score
FROM fts_score JOIN fts_lib ON fts_lib.id = key WHERE status IN ({statuses}) ORDER BY 1 LIMIT 20"""


def fts_query(library: str, parts, match, raw=None, given=None, key: str = "document_id", statuses: str = "'active'") -> str:
    """SQL of a ranked search; library: CTEs up to one named lib (document_id, title, relative_path, text, status)."""
    rows = "fts_lib AS (SELECT document_id AS id, relative_path, status FROM lib),\nfts_rows AS (SELECT document_id AS key, " + ", ".join(f"{_tokens_of(c)} AS {a}" for a, c in _COLS) + " FROM lib)"
    return f"WITH {_phrases(f'{library}, {rows}', parts, match, raw, given)}\n{_shown(key, statuses)}"


TOP_TERMS = f"""WITH {_weights(_PLAIN_WORDS)},
rnk AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 12) DESC, term) AS INTEGER) AS rank FROM wgt)
SELECT doc_id, rank, term, round(weight, 4) AS weight FROM rnk WHERE rank <= 8"""

_NEIGHBOURS = f"""{_weights(_PLAIN_WORDS)},
pos AS (SELECT a.doc_id, b.doc_id AS neighbour, round(sum(a.weight * b.weight), 12) AS score FROM wgt a JOIN wgt b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY 1, 2),
ful AS (SELECT a.doc_id, b.doc_id AS neighbour, coalesce(score, 0) AS score FROM documents a JOIN documents b ON a.doc_id <> b.doc_id LEFT JOIN pos ON pos.doc_id = a.doc_id AND pos.neighbour = b.doc_id),
knn AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, neighbour) AS INTEGER) AS rank FROM ful) WHERE rank <= 5)"""

KNN = f"WITH {_NEIGHBOURS} SELECT doc_id, rank, neighbour, round(score, 4) AS score FROM knn"
KNN_EDGES = f"""WITH {_NEIGHBOURS}, pub AS (SELECT doc_id, rank, neighbour, round(score, 4) AS score FROM knn)
SELECT least(doc_id, neighbour) AS source, greatest(doc_id, neighbour) AS target, arg_min(score, doc_id) AS score FROM pub WHERE score > 0 GROUP BY 1, 2"""

CLUSTER_TERMS_SIMPLE = f"""WITH {_weights(_PLAIN_WORDS)},
tot AS (SELECT d.lang AS cluster_id, term, sum(weight) AS total FROM wgt JOIN documents d USING (doc_id) GROUP BY 1, 2),
rnk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(total, 9) DESC, term) AS rank FROM tot)
SELECT cluster_id, string_agg(term, ' / ' ORDER BY rank) AS label FROM rnk WHERE rank <= 3 GROUP BY 1"""


def _label_tokens(source: str) -> str:
    """Whole ASCII tokens among word-character runs; the corpus has no hyphens or underscores next to letters that matter."""
    return _no_stop(rf"list_filter(regexp_extract_all({source}, '[\p{{L}}\p{{N}}_-]+'), lambda x: regexp_full_match(x, '[a-z][a-z0-9_-]+'))")


_WORDS_OF = "regexp_extract_all(lower(term), '[a-z0-9]+')"
_TELLING = f"len(list_filter({_WORDS_OF}, lambda x: length(x) > 2 AND x NOT IN ({_GENERIC}))) > 0"
_INFORMATIVE = f"{_TELLING} AND length(trim(term)) >= 3 AND len(list_filter({_WORDS_OF}, lambda x: NOT regexp_full_match(x, '[0-9]+'))) > 0"

_CTFIDF = f"""{_STATUS}, body AS (
  SELECT d.lang AS cluster_id, c.doc_id, c.relative_path, c.text, coalesce({_TITLE.replace("text", "c.text")}, '') AS title FROM corpus c JOIN documents d USING (doc_id)
),
tok AS (SELECT cluster_id AS k, {_label_tokens("lower(title || chr(10) || relative_path || chr(10) || coalesce(text, ''))")} AS w FROM body),
trm AS (SELECT k, unnest({_BIGRAMS}) AS term FROM tok),
cnt AS (SELECT k, term, count(*) AS tf FROM trm GROUP BY 1, 2),
idf AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT k) FROM tok)) / (1 + count(*))) + 1 AS idf FROM cnt GROUP BY 1),
raw AS (SELECT k, term, tf * idf AS raw FROM cnt JOIN idf USING (term)),
nrm AS (SELECT k, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1),
lab AS (SELECT * FROM (
  SELECT k AS cluster_id, CAST(row_number() OVER (PARTITION BY k ORDER BY round(raw / norm, 9) DESC, term) AS INTEGER) AS rank, term, round(round(raw / norm, 9), 4) AS score
  FROM raw JOIN nrm USING (k) WHERE {_INFORMATIVE}) WHERE rank <= 6)"""

CTFIDF = f"WITH {_CTFIDF} SELECT cluster_id, rank, term, score FROM lab"
_CHOSEN = """sco AS (
  SELECT cluster_id, doc_id, relative_path, round(len(list_filter(terms, lambda t: contains(lower(title || ' ' || relative_path || ' ' || coalesce(text, '')), t))) + least(length(coalesce(text, '')) / 10000.0, 0.5), 4) AS score
  FROM body JOIN ter USING (cluster_id)
), cho AS (SELECT * FROM (SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, relative_path) AS INTEGER) AS rank, doc_id, score FROM sco) WHERE rank <= 3)"""
REPRESENTATIVES = f"WITH {_CTFIDF}, ter AS (SELECT cluster_id, list(term) AS terms FROM lab GROUP BY 1), {_CHOSEN} SELECT cluster_id, rank, doc_id, score FROM cho"

_SIGNED = """sig AS (SELECT lang AS cluster_id, count(*) AS size, 'cluster_' || substr(sha256('[' || string_agg('"' || CAST(doc_id AS VARCHAR) || '"', ',' ORDER BY CAST(doc_id AS VARCHAR)) || ']'), 1, 16) AS signature FROM documents GROUP BY 1)"""
SIGNATURE = f"WITH {_SIGNED} SELECT cluster_id, size, signature FROM sig"
OVERRIDES = f"""WITH {_SIGNED} SELECT cluster_id, CASE WHEN cluster_id IN ('en', 'fr') THEN 'my ' || cluster_id ELSE 'cluster ' || cluster_id END AS display_label,
  CASE WHEN cluster_id IN ('en', 'fr') THEN 'manual' ELSE 'generated' END AS source FROM sig"""

_PAIRS = """prs AS (SELECT item_id AS pair_id, 'source' AS side, text FROM benchmark UNION ALL SELECT doc_id, 'target', text FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark))"""
PAIR_TERMS = f"""WITH {_PAIRS},
tok AS (SELECT pair_id, side, {_label_tokens("lower(coalesce(text, ''))")} AS w FROM prs),
cnt AS (SELECT pair_id, side, term, count(*) AS tf FROM (SELECT pair_id, side, unnest({_BIGRAMS}) AS term FROM tok) GROUP BY 1, 2, 3),
raw AS (SELECT *, tf * (ln(3.0 / (1 + count(*) OVER (PARTITION BY pair_id, term))) + 1) AS raw, count(*) OVER (PARTITION BY pair_id, term) AS df FROM cnt),
nrm AS (SELECT pair_id, side, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1, 2),
mul AS (SELECT pair_id, term, exp(sum(ln(raw / norm))) AS product FROM raw JOIN nrm USING (pair_id, side) WHERE df = 2 GROUP BY 1, 2)
SELECT pair_id, rank, term, score FROM (
  SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY round(product, 9) DESC, term) AS INTEGER) AS rank, term, round(round(product, 9), 4) AS score
  FROM mul WHERE {_TELLING}) WHERE rank <= 8"""

_STEP = CHUNK_SIZE - CHUNK_OVERLAP


def _chunks(text: str) -> str:
    cut = f"list_transform(range(0, CASE WHEN length({text}) <= {CHUNK_SIZE} THEN 1 ELSE CAST(ceil((length({text}) - {CHUNK_SIZE}) / {_STEP}.0) AS BIGINT) + 1 END), lambda k: trim(substr({text}, k * {_STEP} + 1, {CHUNK_SIZE}), ' '))"
    return f"CASE WHEN length({text}) > 0 THEN list_filter({cut}, lambda c: c <> '') ELSE [] END"


PAIR_CHUNKS = f"""WITH {_PAIRS},
lst AS (SELECT pair_id, side, {_chunks("text")} AS c FROM prs),
chk AS (SELECT pair_id, side, unnest(range(0, len(c))) AS chunk, unnest(c) AS text FROM lst),
num AS (SELECT pair_id, count(*) AS n FROM chk GROUP BY 1),
tok AS (SELECT pair_id, side, chunk, {_label_tokens("lower(coalesce(text, ''))")} AS w FROM chk),
cnt AS (SELECT pair_id, side, chunk, term, count(*) AS tf FROM (SELECT pair_id, side, chunk, unnest({_BIGRAMS}) AS term FROM tok) GROUP BY 1, 2, 3, 4),
raw AS (SELECT cnt.*, tf * (ln((1.0 + n) / (1 + count(*) OVER (PARTITION BY pair_id, term))) + 1) AS raw FROM cnt JOIN num USING (pair_id)),
nrm AS (SELECT pair_id, side, chunk, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1, 2, 3),
wgt AS (SELECT pair_id, side, chunk, term, raw / norm AS w FROM raw JOIN nrm USING (pair_id, side, chunk)),
sco AS (SELECT a.pair_id, a.chunk AS source_chunk, b.chunk AS target_chunk, round(sum(a.w * b.w), 9) AS score FROM wgt a JOIN wgt b ON a.pair_id = b.pair_id AND a.term = b.term AND a.side = 'source' AND b.side = 'target' GROUP BY 1, 2, 3)
SELECT pair_id, rank, CAST(source_chunk AS INTEGER) AS source_chunk, CAST(target_chunk AS INTEGER) AS target_chunk, round(score, 4) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, source_chunk, target_chunk) AS INTEGER) AS rank FROM sco WHERE score > 0) WHERE rank <= 3"""

SHARED_WORDS = f"""WITH wds AS (
  SELECT item_id AS pair_id, unnest(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))) AS w, d.text AS other FROM benchmark b JOIN documents d ON d.doc_id = b.item_id
), keep AS (
  SELECT pair_id, w, row_number() OVER (PARTITION BY pair_id ORDER BY length(w) DESC, w) AS rank FROM wds
  WHERE length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_GENERIC}) AND list_contains(regexp_extract_all(lower(other), '[a-z0-9]+'), w)
)
SELECT b.item_id AS pair_id, coalesce((SELECT string_agg(w, ' ' ORDER BY rank) FROM keep WHERE keep.pair_id = b.item_id AND rank <= 10), '') AS words FROM benchmark b JOIN documents d ON d.doc_id = b.item_id"""

CHUNKS = f"""WITH lst AS (SELECT doc_id, {_chunks("text")} AS c FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, length(chunk) AS char_count, md5(chunk) AS digest FROM (SELECT doc_id, unnest(range(0, len(c))) AS i, unnest(c) AS chunk FROM lst)"""
CHUNK_STATS = f"""WITH lst AS (SELECT source, unnest({_chunks("text")}) AS chunk FROM documents)
SELECT source, count(*) AS chunks, CAST(sum(length(chunk)) AS BIGINT) AS chars, max(length(chunk)) AS longest FROM lst GROUP BY 1"""
NORMALISED = f"SELECT doc_id, md5({_ONE.format('text')}) AS digest, length({_ONE.format('text')}) AS n FROM documents"
FIRST_LINE = rf"SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: {_ONE.format('x')}), lambda x: x <> '')[1] AS title FROM documents"
SNIPPET = f"""WITH one AS (SELECT doc_id, {_ONE.format('text')} AS t FROM documents),
hit AS (SELECT doc_id, t, coalesce(list_min(list_filter([instr(lower(t), 'tion'), instr(lower(t), 'ment'), instr(lower(t), 'keit')], lambda p: p > 0)), 0) AS p FROM one),
beg AS (SELECT doc_id, t, CASE WHEN p > 0 THEN greatest(0, least(p - 1 - 80, length(t) - 240)) ELSE 0 END AS s FROM hit)
SELECT doc_id, CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(t, s + 1, 240), ' ') || CASE WHEN s + 240 < length(t) THEN '...' ELSE '' END AS snippet FROM beg"""



def _decoded(x: str) -> str:
    """The entities that the pages hold."""
    for entity, letter in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, '{entity}', '{letter}')"
    return x


#: Scripts and styles stay as they are written, comments and tags go, texts are decoded, all are joined by spaces and decoded once more.
HTML_TEXT = rf"""WITH tok AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]*>|[^<]+') AS t FROM pages),
frg AS (SELECT page_id, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^<(script|style)[ >]') THEN regexp_replace(x, '(?s)^<(script|style)[^>]*>(.*)</(script|style)>$', '\2') WHEN starts_with(x, '<') THEN '' ELSE {_decoded('x')} END) AS f FROM tok),
jnd AS (SELECT page_id, {_decoded("array_to_string(list_filter(f, lambda x: x <> ''), ' ')")} AS j FROM frg)
SELECT page_id, {_ONE.format('j')} AS text FROM jnd"""

_COS = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
VEC_TOPK = f"""WITH s AS (SELECT vec_id, round({_COS.format('embedding', '(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)')}, 9) AS raw FROM embeddings)
SELECT CAST(row_number() OVER (ORDER BY raw DESC, vec_id) AS INTEGER) AS rank, vec_id, round(raw, 4) AS score FROM s ORDER BY 1 LIMIT 10"""
_VKNN = f"""knn AS (SELECT * FROM (SELECT vec_id, neighbour, score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS INTEGER) AS rank FROM (
  SELECT a.vec_id, b.vec_id AS neighbour, round({_COS.format('a.embedding', 'b.embedding')}, 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 5)"""
VEC_KNN = f"WITH {_VKNN} SELECT vec_id, rank, neighbour, round(score, 4) AS score FROM knn"
VEC_PURITY = f"""WITH {_VKNN} SELECT a.label, count(*) AS neighbours, count(*) FILTER (a.label = b.label) AS same FROM knn JOIN embeddings a ON a.vec_id = knn.vec_id JOIN embeddings b ON b.vec_id = knn.neighbour GROUP BY 1"""
VECTOR_STATS = "SELECT label, count(*) AS vectors, min(vec_id) AS first_id, max(vec_id) AS last_id, CAST(max(len(embedding)) AS INTEGER) AS dimension FROM embeddings GROUP BY 1"
HYBRID = f"""WITH {_weights(_PLAIN_WORDS)},
lex AS (SELECT b.doc_id, sum(a.weight * b.weight) AS lexical FROM wgt a JOIN wgt b ON a.term = b.term AND a.doc_id = 0 AND b.doc_id <> 0 GROUP BY 1),
den AS (SELECT vec_id AS doc_id, {_COS.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS dense FROM embeddings WHERE vec_id <> 0),
bth AS (SELECT doc_id, coalesce(lexical, 0) AS lexical, coalesce(dense, 0) AS dense FROM lex FULL JOIN den USING (doc_id)),
sco AS (SELECT *, round(0.65 * dense + 0.35 * lexical, 9) AS score FROM bth)
SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, round(lexical, 4) AS lexical, round(dense, 4) AS dense, round(score, 4) AS score FROM sco ORDER BY sco.score DESC, doc_id LIMIT 10"""
EMBED_INCREMENTAL = "SELECT source, count(*) AS embedded, 64 AS dimension FROM documents WHERE doc_id % 3 = 0 GROUP BY 1"

_MERGE = """old AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'unindexed' WHEN doc_id % 6 = 0 THEN 'missing' ELSE 'active' END AS st FROM documents WHERE doc_id % 7 <> 0),
now AS (SELECT doc_id, doc_id % 4 = 0 AS changed, doc_id % 11 = 0 AS skip, length(text) AS n FROM documents WHERE doc_id % 5 <> 0),
mrg AS (SELECT o.doc_id AS a, w.doc_id AS b, st, CASE
    WHEN w.doc_id IS NULL AND st = 'active' THEN 'missing' WHEN w.doc_id IS NULL THEN 'kept'
    WHEN o.doc_id IS NOT NULL AND NOT changed AND st IN ('active', 'missing') THEN 'unchanged'
    WHEN skip THEN 'skipped' WHEN n < 80 THEN 'low_text' WHEN o.doc_id IS NOT NULL THEN 'updated' ELSE 'inserted' END AS branch
  FROM old o FULL JOIN now w ON o.doc_id = w.doc_id),
cls AS (SELECT *, CASE WHEN branch = 'missing' THEN 'missing' WHEN branch = 'kept' THEN st WHEN branch IN ('skipped', 'low_text') THEN CASE WHEN a IS NOT NULL THEN 'unindexed' END ELSE 'active' END AS status FROM mrg)"""
INDEX_MERGE = f"WITH {_MERGE} SELECT branch, status, count(*) AS n FROM cls GROUP BY 1, 2"
INDEX_COUNTERS = f"""WITH {_MERGE} SELECT count(b) AS files_seen, count(*) FILTER (branch = 'inserted') AS inserted, count(*) FILTER (branch = 'updated') AS updated, count(*) FILTER (branch = 'unchanged') AS unchanged,
  count(*) FILTER (branch IN ('skipped', 'low_text')) AS skipped, count(*) FILTER (branch = 'low_text') AS low_text, count(*) FILTER (branch = 'missing') AS missing FROM cls"""
UPSERT = """WITH new AS (SELECT doc_id * 2 AS doc_id FROM documents WHERE doc_id % 2 = 0),
nxt AS (SELECT coalesce(d.doc_id, n.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL THEN 't0' ELSE 't1' END AS first_seen_at, CASE WHEN n.doc_id IS NOT NULL THEN 't1' ELSE 't0' END AS updated_at FROM documents d FULL JOIN new n ON d.doc_id = n.doc_id)
SELECT first_seen_at, updated_at, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM nxt WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 = 1) GROUP BY 1, 2"""
LATEST = "SELECT user_id, event_id, event_type, json_extract_string(props, '$.k') AS field FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
DB_STATS = f"""WITH {_STATUS} SELECT count(*) AS documents, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unindexed') AS unindexed,
  CAST(coalesce(sum(char_count) FILTER (status = 'active'), 0) AS BIGINT) AS total_chars FROM corpus"""
HISTOGRAM = f"WITH {_STATUS} SELECT d.status, count(c.doc_id) AS n FROM (VALUES ('active'), ('missing'), ('unindexed')) d(status) LEFT JOIN corpus c ON c.status = d.status GROUP BY 1"
DANGLING = """SELECT 'labels_without_document' AS code, count(*) AS n FROM labels l ANTI JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id IS NOT NULL
UNION ALL SELECT 'documents_without_label', count(*) FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL
UNION ALL SELECT 'orders_without_customer', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL
UNION ALL SELECT 'customers_without_order', count(*) FROM customer ANTI JOIN orders ON o_custkey = c_custkey WHERE c_custkey IS NOT NULL"""
RUN_CONSISTENCY = """WITH p AS (SELECT l_orderkey AS run_id, count(DISTINCT l_partkey) AS points, count(DISTINCT l_suppkey) AS clusters FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, CAST(3 AS BIGINT) AS document_count, coalesce(points, 0) AS points, CAST(2 AS BIGINT) AS cluster_count, coalesce(clusters, 0) AS clusters
FROM orders LEFT JOIN p ON p.run_id = o_orderkey WHERE coalesce(points, 0) <> 3 OR coalesce(clusters, 0) <> 2"""
LIST_PAGE = f"WITH {_STATUS} SELECT doc_id, relative_path, char_count FROM corpus WHERE status = 'active' ORDER BY relative_path LIMIT 20 OFFSET 40"
LOOKUP = f"WITH {_STATUS} SELECT 'doc_' || doc_id AS document_id, relative_path, status FROM corpus WHERE doc_id = 17"
ITEM_FILTER = "SELECT conv_id AS item_key, count(*) AS turns FROM conversations GROUP BY 1 HAVING count(*) > 4 AND count(*) FILTER (role = 'assistant') > 0 AND count(*) FILTER (role = 'user') > 0"
COLLECTION_PATHS = """WITH RECURSIVE tree AS (SELECT 'r' || r_regionkey AS key, r_name AS name, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation),
up AS (SELECT key, name AS path, parent FROM tree UNION ALL SELECT up.key, t.name || ' / ' || up.path, t.parent FROM up JOIN tree t ON t.key = up.parent)
SELECT key, path FROM up WHERE parent IS NULL"""
READING_STATUS = """WITH tag AS (SELECT quality = 0 AS noted, lower(list_extract(['To Read', 'Reading', 'current', 'queue', 'unread', 'finished', 'read', 'in progress', 'done'], CAST(doc_id % 10 + 1 AS INTEGER))) AS t FROM labels)
SELECT CASE WHEN t IN ('reading', 'current') THEN 'reading' WHEN t IN ('to read', 'unread', 'queue') THEN 'to_read' WHEN t IN ('read', 'finished') OR noted THEN 'read' ELSE 'unknown' END AS status, count(*) AS n FROM tag GROUP BY 1"""
ITEM_DETAIL = "SELECT conv_id AS item_key, string_agg(turn || ':' || role || ':' || length(text), ',' ORDER BY turn, role, length(text)) AS notes FROM conversations GROUP BY 1"


# the texts that the registered queries build; RE2 has neither lookbehind nor back-references, which these texts don't need
_HEADING = r"(?m)^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$"
MARKDOWN = rf"""WITH raw AS (SELECT doc_id, '---' || chr(10) || 'topic: a' || chr(10) || '---' || chr(10) || '# ' || text AS raw FROM documents WHERE text IS NOT NULL),
fenced AS (SELECT doc_id, raw, regexp_replace(raw, '(?s)```.*?```|~~~.*?~~~', ' ', 'g') AS t FROM raw),
body AS (SELECT doc_id, raw, regexp_replace(substr(t, length('---' || chr(10) || 'topic: a' || chr(10) || '---' || chr(10)) + 1), '\r\n|[\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]', chr(10), 'g') AS t FROM fenced),
linked AS (SELECT doc_id, raw, regexp_replace(regexp_replace(regexp_replace(t, '\[\[[^\]|]+\|([^\]]+)\]\]', '\1', 'g'), '\[\[([^\]|]+)\]\]', '\1', 'g'), '\[([^\]]+)\]\(([^)\s]+)(?:\s+"[^"]*")?\)', '\1', 'g') AS t FROM body)
SELECT doc_id, CASE WHEN regexp_matches(raw, '{_HEADING}') THEN trim(regexp_extract(raw, '{_HEADING}', 1)) ELSE {_ONE.format("'a ' || t")} END AS title,
  {_ONE.format("'a ' || regexp_replace(t, '" + _HEADING + r"', '\1', 'g')")} AS text, CAST(len(regexp_extract_all(t, '{_HEADING}')) AS INTEGER) AS n_sections FROM linked"""

_LATEX_STEPS = (
    ("%.*", ""), (r"(?is)\\begin\{abstract\}(.*?)\\end\{abstract\}", r"abstract \1"), (r"\\(part|chapter|section|subsection|subsubsection)\*?\{([^{}]+)\}", r"\1 \2"), (r"\\caption\{([^{}]+)\}", r"caption \1"),
    (r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1"), (r"\$\$?|\[|\]", " "), (r"\\[a-zA-Z]+", " "), ("[{}]", " "),
)


def _latex(text: str) -> str:
    for pattern, put in _LATEX_STEPS:
        text = f"regexp_replace({text}, '{pattern}', '{put}', 'g')"
    return text


LATEX = rf"""WITH raw AS (SELECT doc_id, '\title{{T}}\begin{{abstract}}' || text || '\end{{abstract}}\cite{{a,b}}' AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'T' AS title, {_ONE.format(_latex("t"))} AS text, CASE WHEN contains(regexp_replace(t, '%.*', '', 'g'), '\cite{{a,b}}') THEN 'cite:a,cite:b' ELSE '' END AS links FROM raw"""
