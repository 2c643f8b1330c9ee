"""Registered queries of the library's records: lookups, joins, counts, imports, reports, maps. Each stands beside its SQL.

Roles of the driver's tables here: documents and labels are the library's documents, as in the catalogue; embeddings
their vectors (vec_id the document's or chunk's number, label the model); orders and lineitem saved runs and their
points; customer bibliographic items, nation and region their collections, supplier attachments, part files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.functions import text as T
from lexatlas.operators import biblio, layout, library, maps, similarity, state, tfidf, validation
from lexatlas.plans import sql as S
from lexatlas.plans.catalogue import _clustered, _pairs, corpus, query, read
from lexatlas.plans.sql import _CHOSEN, _CTFIDF, _PAIRS, _PLAIN_WORDS, _SIGNED, _STATUS, _TELLING, _TITLE, _chunks, _label_tokens, _weights

_LIBRARY = f"""{_STATUS}, lib AS (SELECT CAST(c.doc_id AS VARCHAR) AS document_id, d.source AS corpus_id, relative_path, coalesce({_TITLE.replace('text', 'c.text')}, '') AS title, status, char_count, c.text FROM corpus c JOIN documents d ON d.doc_id = c.doc_id),
cut AS (SELECT document_id, {_chunks("text")} AS c FROM lib),
chk AS (SELECT document_id, document_id || '_chunk_' || lpad(CAST(i AS VARCHAR), 6, '0') AS chunk_id, CAST(i AS INTEGER) AS chunk_index, t AS text FROM (SELECT document_id, unnest(range(0, len(c))) AS i, unnest(c) AS t FROM cut))"""


def documents(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("corpus_id"), "relative_path", F.coalesce(T.first_line(F.col("text")), F.lit("")).alias("title"), F.lit("txt").alias("file_type"), "status", "char_count", F.lit("t0").alias("updated_at"), "text")


def chunks(spark, sf_dir):
    cut = documents(spark, sf_dir).select("document_id", F.posexplode(T.window_chunks(F.col("text"))).alias("chunk_index", "text"))
    return cut.select("document_id", F.concat("document_id", F.lit("_chunk_"), F.lpad(F.col("chunk_index").cast("string"), 6, "0")).alias("chunk_id"), "chunk_index", "text", F.length("text").cast("long").alias("char_count"))


# lookups and joins of documents, texts and chunks


@query(f"WITH {_LIBRARY} SELECT document_id, title, status FROM lib WHERE corpus_id = (SELECT source FROM documents WHERE doc_id = 17) AND relative_path LIKE '%/000000000017.txt'")
def corpus_path_lookup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ref = docs.where("document_id = '17'").first()
    return library.by_corpus_path(docs, ref.corpus_id, ref.relative_path).select("document_id", "title", "status")


@query("SELECT text FROM documents WHERE doc_id = 17")
def document_text(spark, sf_dir):
    return library.text_of(documents(spark, sf_dir), "17")


@query(f"WITH {_LIBRARY} SELECT chunk_id, chunk_index, md5(text) AS digest FROM chk WHERE document_id = (SELECT CAST(doc_id AS VARCHAR) FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1) ORDER BY chunk_index LIMIT 5 OFFSET 1")
def document_chunks_page(spark, sf_dir):
    longest = read(spark, sf_dir, "documents").orderBy(F.desc(F.length("text")), "doc_id").limit(1).first()
    return library.chunks_of(chunks(spark, sf_dir), str(longest.doc_id), 5, 1).select("chunk_id", "chunk_index", F.md5("text").alias("digest"))


@query(f"WITH {_LIBRARY} SELECT document_id, relative_path, title, md5(text) AS digest FROM lib WHERE status = 'active' ORDER BY relative_path LIMIT 50")
def documents_with_text(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return library.documents_with_text(docs.drop("text"), docs.where("text is not null").select("document_id", "text"), limit=50).select("document_id", "relative_path", "title", F.md5("text").alias("digest"))


@query(f"WITH {_LIBRARY} SELECT chk.chunk_id, relative_path, chunk_index, status, length(chk.text) AS n FROM chk JOIN lib USING (document_id) WHERE status = 'missing' ORDER BY relative_path, chunk_index LIMIT 60")
def chunks_with_documents(spark, sf_dir):
    out = library.chunks_with_documents(chunks(spark, sf_dir), documents(spark, sf_dir).drop("text"), ["missing"], 60)
    return out.select("chunk_id", "relative_path", "chunk_index", "status", F.col("char_count").alias("n"))


@query(f"WITH {_LIBRARY} SELECT n AS chunks, count(*) AS documents FROM (SELECT lib.document_id, count(chunk_id) AS n FROM lib LEFT JOIN chk USING (document_id) GROUP BY 1) GROUP BY 1")
def chunk_counts(spark, sf_dir):
    return library.chunk_counts(documents(spark, sf_dir), chunks(spark, sf_dir)).groupBy("chunks").agg(F.count("*").alias("documents"))


@query("SELECT 'documents' AS \"table\", count(*) AS rows FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'map_points', count(*) FROM lineitem")
def row_counts(spark, sf_dir):
    return library.row_counts(documents=read(spark, sf_dir, "documents"), vectors=read(spark, sf_dir, "embeddings"), map_points=read(spark, sf_dir, "lineitem"))


_RUNS = "runs AS (SELECT event_id AS run_id, user_id AS model_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS started_at, CASE WHEN event_type <> 'error' THEN strftime(ts + INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S') END AS finished_at FROM events)"


def runs(spark, sf_dir):
    """Events as runs of a model (their user); those that failed have no end."""
    shown = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    ts = F.col("ts").cast("timestamp_ntz")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("user_id").alias("model_id"), shown(ts).alias("started_at"), F.when(F.col("event_type") != "error", shown(ts + F.expr("INTERVAL 1 MINUTE"))).alias("finished_at"))


@query(f"""WITH {_LIBRARY}, {_RUNS} SELECT (SELECT count(*) FROM lib) AS documents, (SELECT count(*) FROM lib WHERE status = 'active') AS active, (SELECT count(*) FROM lib WHERE status = 'missing') AS missing,
  CAST(0 AS BIGINT) AS unindexed, CAST((SELECT coalesce(sum(char_count), 0) FROM lib WHERE status = 'active') AS BIGINT) AS total_chars, (SELECT count(*) FROM chk) AS chunks, (SELECT count(*) FROM runs) AS scan_runs,
  (SELECT coalesce(finished_at, started_at) FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1) AS last_scan_time""")
def library_stats(spark, sf_dir):
    return library.full_statistics(documents(spark, sf_dir), chunks(spark, sf_dir), runs(spark, sf_dir))


# vectors and models

_VECTORS = "vec AS (SELECT label AS model_id, CASE WHEN vec_id % 3 = 0 THEN 'chunk' ELSE 'document' END AS object_type, CASE WHEN vec_id % 3 = 0 THEN (vec_id // 3) || '_chunk_000000' ELSE CAST(vec_id AS VARCHAR) END AS object_id, vec_id, embedding FROM embeddings)"


def vectors(spark, sf_dir):
    chunk = F.col("vec_id") % 3 == 0
    third = F.floor(F.col("vec_id") / 3).cast("string")
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("model_id"), F.when(chunk, "chunk").otherwise("document").alias("object_type"), F.when(chunk, F.concat(third, F.lit("_chunk_000000"))).otherwise(F.col("vec_id").cast("string")).alias("object_id"), "vec_id", "embedding")


def models(spark, sf_dir):
    return read(spark, sf_dir, "nation").where("n_nationkey <> 3").select(F.col("n_nationkey").alias("model_id"), F.col("n_name").alias("name"))


@query(f"WITH {_VECTORS} SELECT model_id, n_name AS name, object_type, count(*) AS vectors, min(object_id) AS first_id, max(object_id) AS last_id FROM vec JOIN nation ON n_nationkey = model_id WHERE n_nationkey <> 3 GROUP BY 1, 2, 3")
def vector_model_stats(spark, sf_dir):
    return library.vector_statistics(vectors(spark, sf_dir), models(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT n_nationkey AS model_id, n_name AS name, run_id, started_at FROM nation LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY started_at DESC, run_id DESC) = 1) r ON r.model_id = n_nationkey WHERE n_nationkey <> 3")
def latest_model_runs(spark, sf_dir):
    return library.latest_runs(models(spark, sf_dir), runs(spark, sf_dir).withColumn("model_id", F.col("model_id").cast("int")))


@query(f"WITH {_VECTORS} SELECT object_id, len(embedding) AS dimension FROM vec WHERE model_id = 4 AND object_type = 'document' ORDER BY object_id LIMIT 30")
def model_vectors(spark, sf_dir):
    own = vectors(spark, sf_dir).where("model_id = 4 and object_type = 'document'")
    return library.page(own, "object_id", limit=30).select("object_id", F.size("embedding").cast("long").alias("dimension"))


_PROBE = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_SNIP = """snp AS (SELECT *, coalesce(list_min(list_filter([instr(lower(t), 'tion'), instr(lower(t), 'ment')], lambda p: p > 0)), 0) AS p FROM hit),
beg AS (SELECT *, CASE WHEN p > 0 THEN greatest(0, least(p - 1 - 80, length(t) - 240)) ELSE 0 END AS s FROM snp),
shw AS (SELECT *, CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(t, s + 1, 240), ' ') || CASE WHEN s + 240 < length(t) THEN '...' ELSE '' END AS snippet FROM beg)"""


@query(f"""WITH {_LIBRARY}, {_VECTORS}, hit AS (SELECT object_id, relative_path, status, round({S._COS.format('embedding', _PROBE)}, 9) AS raw, {S._ONE.format('lib.text')} AS t FROM vec JOIN lib ON lib.document_id = object_id WHERE object_type = 'document' AND status = 'active' AND lib.text IS NOT NULL ORDER BY raw DESC, relative_path LIMIT 10), {_SNIP}
SELECT CAST(row_number() OVER (ORDER BY raw DESC, relative_path) AS INTEGER) AS rank, object_id, relative_path, status, round(raw, 4) AS score, snippet FROM shw""")
def semantic_search_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    probe = read(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first().embedding
    return library.semantic_documents(vectors(spark, sf_dir), docs.where("text is not null"), docs, probe, ["tion", "ment"])


@query(f"""WITH {_LIBRARY}, {_VECTORS}, hit AS (SELECT object_id, relative_path, chunk_index, status, round({S._COS.format('embedding', _PROBE)}, 9) AS raw, {S._ONE.format('chk.text')} AS t FROM vec JOIN chk ON chunk_id = object_id JOIN lib ON lib.document_id = chk.document_id WHERE object_type = 'chunk' AND status = 'active' ORDER BY raw DESC, relative_path, chunk_index LIMIT 10), {_SNIP}
SELECT CAST(row_number() OVER (ORDER BY raw DESC, relative_path, chunk_index) AS INTEGER) AS rank, object_id, relative_path, chunk_index, status, round(raw, 4) AS score, snippet FROM shw""")
def semantic_search_chunks(spark, sf_dir):
    probe = read(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first().embedding
    return library.semantic_chunks(vectors(spark, sf_dir), chunks(spark, sf_dir), documents(spark, sf_dir).drop("text"), probe, ["tion", "ment"])


@query(f"""WITH {_weights(_PLAIN_WORDS)},
lex AS (SELECT b.doc_id, sum(a.weight * b.weight) AS v FROM wgt a JOIN wgt b ON a.term = b.term AND a.doc_id = 0 AND b.doc_id <> 0 GROUP BY 1),
den AS (SELECT vec_id AS doc_id, {S._COS.format('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} AS v FROM embeddings WHERE vec_id <> 0),
bth AS (SELECT doc_id, coalesce(lex.v, 0) AS l, coalesce(den.v, 0) AS d FROM lex FULL JOIN den USING (doc_id)),
sco AS (SELECT 'tfidf' AS mode, doc_id, round(v, 9) AS s FROM lex UNION ALL SELECT 'dense', doc_id, round(v, 9) FROM den UNION ALL SELECT 'hybrid', doc_id, round(0.65 * d + 0.35 * l, 9) FROM bth)
SELECT mode, CAST(rank AS INTEGER) AS rank, doc_id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY s DESC, doc_id) AS rank FROM sco) WHERE rank <= 10""")
def compare_neighbors(spark, sf_dir):
    """The first document's neighbours by text, by vector and by both."""
    docs, embedded = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    lexical = tfidf.similar_to(docs, 0)
    probe = embedded.where("vec_id = 0").first().embedding
    dense = embedded.where("vec_id <> 0").select(F.col("vec_id").alias("doc_id"), similarity.cosine(F.col("embedding"), F.array(*map(F.lit, probe))).alias("score"))
    return maps.compare_neighbours(lexical, dense)


@query(f"WITH {_LIBRARY} SELECT document_id FROM lib WHERE status = 'active' AND CAST(document_id AS BIGINT) % 5 = 0")
def index_backfill(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return library.unindexed_texts(docs, docs.where("document_id % 5 <> 0").select("document_id"))


# text views


@query(f"""WITH {_LIBRARY} SELECT document_id, md5(rtrim(title || chr(10) || title || chr(10) || title || chr(10) || relative_path || chr(10) || substr(coalesce(text, ''), 1, 8000), ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM lib WHERE title <> ''""")
def embedding_texts(spark, sf_dir):
    docs = documents(spark, sf_dir).where("title <> ''")
    return docs.select("document_id", F.md5(library.document_embedding_text(F.col("title"), F.col("relative_path"), F.coalesce("text", F.lit("")))).alias("digest"))


@query(f"WITH {_LIBRARY} SELECT chunk_id, md5(substr(text, 1, 700)) AS digest FROM chk")
def chunk_embedding_texts(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", F.md5(library.chunk_embedding_text(F.col("text"), 700)).alias("digest"))


@query(f"WITH one AS (SELECT doc_id, {S._ONE.format('text')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 1200 THEN rtrim(substr(t, 1, 1200), ' ') || '...' ELSE t END AS preview FROM one")
def previews(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(f"""WITH one AS (SELECT doc_id, {S._ONE.format('text')} AS t FROM documents),
hit AS (SELECT doc_id, t, CASE WHEN instr(lower(t), 'keit') > 0 THEN instr(lower(t), 'keit') ELSE instr(lower(t), 'tion') END AS p FROM one),
beg AS (SELECT doc_id, t, CASE WHEN p > 0 THEN greatest(0, least(p - 1 - 73, length(t) - 220)) ELSE 0 END AS s FROM hit)
SELECT doc_id, CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(t, s + 1, 220), ' ') || CASE WHEN s + 220 < length(t) THEN '...' ELSE '' END AS excerpt FROM beg""")
def excerpts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), ["keit", "tion"]).alias("excerpt"))


_TOKEN_RUNS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+[^\p{L}\p{N}]*')"


@query(rf"""WITH tok AS (SELECT doc_id, text, {_TOKEN_RUNS} AS w FROM documents WHERE text IS NOT NULL),
fld AS (SELECT doc_id, text, w, len(w) AS n, list_transform(w, lambda x: regexp_extract(translate(lower(x), '{T.MARKED}', '{T.PLAIN}'), '^[\p{{L}}\p{{N}}]+')) AS f FROM tok),
hit AS (SELECT *, list_filter(range(0, n), lambda i: f[i + 1] IN ('the', 'der', 'que')) AS h, list_filter(range(0, n), lambda i: i = 0 OR regexp_matches(w[i], '[.:][ \t\n\r]+$')) AS b FROM fld),
one AS (SELECT doc_id, unnest(h) AS x FROM hit),
offers AS (
  SELECT doc_id, x, x AS s, 0 AS bonus, 0 AS turn FROM one
  UNION ALL
  SELECT doc_id, x, bg AS s, CASE WHEN bg = 0 THEN 120 ELSE 100 END, 1 FROM (SELECT one.doc_id, x, list_max(list_filter(b, lambda i: i <= x)) AS bg FROM one JOIN hit USING (doc_id) WHERE n > 16) WHERE bg < x
), rated AS (
  SELECT offers.doc_id, x, s, turn, n, list_filter(h, lambda i: i >= s AND i < s + 16) AS inside, f, bonus FROM offers JOIN hit USING (doc_id)
), scored AS (
  SELECT doc_id, x, turn, 999 * len(list_distinct(list_transform(inside, lambda i: f[i + 1]))) + len(inside) + bonus AS score,
    CASE WHEN turn = 1 THEN s ELSE greatest(least(x - (16 - (list_max(inside) + 1 - x)) // 2, n - 16), 0) END AS s
  FROM rated
), best AS (SELECT doc_id, arg_min(s, {{'a': -score, 'x': x, 't': turn}}) AS s FROM scored GROUP BY 1),
shw AS (
  SELECT doc_id, text, n, coalesce(s, 0) AS s, array_to_string(list_transform(range(coalesce(s, 0), least(n, coalesce(s, 0) + 16)), lambda i: CASE WHEN list_contains(h, i) THEN regexp_replace(w[i + 1], '^([\p{{L}}\p{{N}}]+)', '[\1]') ELSE w[i + 1] END), '') AS body
  FROM hit LEFT JOIN best USING (doc_id)
)
SELECT doc_id, md5(CASE WHEN s > 0 THEN ' ... ' ELSE regexp_extract(text, '^[^\p{{L}}\p{{N}}]*') END || CASE WHEN s + 16 < n THEN regexp_replace(body, '[^\p{{L}}\p{{N}}\]]+$', '') || ' ... ' ELSE body END) AS digest FROM shw""")
def match_excerpts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(T.match_excerpt(F.col("text"), ["the", "der", "que"])).alias("digest"))


@query(f"WITH {_LIBRARY} SELECT relative_path, title, 'text' AS method, char_count FROM lib WHERE document_id = '17'")
def extraction_preview(spark, sf_dir):
    docs = documents(spark, sf_dir).select("relative_path", "title", F.lit("text").alias("method"), F.lit(None).cast("string").alias("skip_reason"), "char_count", "text", F.array().cast("array<string>").alias("sections"), F.array().cast("array<string>").alias("links"))
    ref = docs.where("relative_path like '%/000000000017.txt'").first().relative_path
    return library.extraction_preview(docs, ref).select("relative_path", "title", "method", "char_count")


# bibliographic items

_ITEMS = """itm AS (SELECT c_custkey AS item_key, c_name AS title, 'about ' || c_mktsegment AS abstract, CASE WHEN c_acctbal < 0 THEN 'reading' WHEN c_custkey % 3 = 0 THEN 'read' ELSE 'unknown' END AS reading_status FROM customer),
col AS (SELECT 'n' || n_nationkey AS key, n_name AS name, r_name || ' / ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
mem AS (SELECT c_custkey AS item_key, 'n' || c_nationkey AS collection_key FROM customer UNION SELECT c_custkey, 'n' || ((c_nationkey + 7) % 25) FROM customer WHERE c_custkey % 2 = 0),
tag AS (SELECT DISTINCT o_custkey AS item_key, o_orderpriority AS tag FROM orders),
lnk AS (SELECT c_custkey AS item_key, CAST(c_custkey * 3 AS VARCHAR) AS document_id FROM customer),
att AS (SELECT s_suppkey AS attachment_key, s_suppkey * 3 % (SELECT count(*) FROM customer) AS item_key, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 'storage:a.pdf' WHEN s_suppkey % 5 = 2 THEN '/other/' || s_suppkey || '.pdf' WHEN s_suppkey % 5 = 3 THEN 'sub/' || s_suppkey || '.txt' ELSE '/data/' || s_suppkey END AS path, CASE WHEN s_suppkey % 10 = 5 THEN 'b.pdf' END AS filename FROM supplier)"""


def bibliography(spark, sf_dir):
    """items, collections, memberships, tags, links and attachments."""
    c, n, r, o, s = (read(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders", "supplier"))
    key = F.col("c_custkey").alias("item_key")
    items = c.select(key, F.col("c_name").alias("title"), F.concat(F.lit("about "), "c_mktsegment").alias("abstract"), F.when(F.col("c_acctbal") < 0, "reading").when(F.col("c_custkey") % 3 == 0, "read").otherwise("unknown").alias("reading_status"))
    collections = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.col("n_name").alias("name"), F.concat("r_name", F.lit(" / "), "n_name").alias("path"))
    second = c.where("c_custkey % 2 = 0").select(key, F.concat(F.lit("n"), (F.col("c_nationkey") + 7) % 25))
    memberships = c.select(key, F.concat(F.lit("n"), "c_nationkey").alias("collection_key")).union(second).distinct()
    tags = o.select(F.col("o_custkey").alias("item_key"), F.col("o_orderpriority").alias("tag")).distinct()
    links = c.select(key, (F.col("c_custkey") * 3).cast("string").alias("document_id"))
    k = F.col("s_suppkey")
    path = F.when(k % 5 == 1, "storage:a.pdf").when(k % 5 == 2, F.concat(F.lit("/other/"), k, F.lit(".pdf"))).when(k % 5 == 3, F.concat(F.lit("sub/"), k, F.lit(".txt"))).when(k % 5 == 4, F.concat(F.lit("/data/"), k))
    attachments = s.select(k.alias("attachment_key"), (k * 3 % F.lit(c.count())).alias("item_key"), path.alias("path"), F.when(k % 10 == 5, "b.pdf").alias("filename"))
    return items, collections, memberships, tags, links, attachments


def files(spark, sf_dir):
    """Files that exist: those of every other attachment."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.explode(F.array(F.concat(F.lit("/data/storage/"), k, F.lit("/a.pdf")), F.concat(F.lit("/other/"), k, F.lit(".pdf")), F.concat(F.lit("/data/sub/"), k, F.lit(".txt")), F.concat(F.lit("/data/"), k))).alias("path"))


_RESOLVED = f"""{_ITEMS}, res AS (SELECT *, CASE WHEN path IS NULL AND filename IS NULL THEN 'no_local_file' WHEN path IS NULL THEN 'missing' WHEN attachment_key % 2 = 1 THEN 'missing' WHEN path LIKE '/other/%' THEN 'linked_outside_data_dir' ELSE 'resolved' END AS path_status FROM att)"""


def resolved(spark, sf_dir):
    return biblio.resolve_attachments(bibliography(spark, sf_dir)[5], files(spark, sf_dir), "/data")


@query(f"WITH {_ITEMS} SELECT item_key FROM itm WHERE (lower(title) LIKE '%00001%' OR lower(abstract) LIKE '%00001%') AND reading_status = 'unknown'")
def items_like(spark, sf_dir):
    return biblio.matching(bibliography(spark, sf_dir)[0], "unknown", "00001").select("item_key")


@query(f"WITH {_ITEMS} SELECT DISTINCT itm.item_key FROM itm JOIN mem USING (item_key) JOIN col ON col.key = mem.collection_key JOIN tag USING (item_key) WHERE lower(col.name) = 'nation_4' AND tag = '1-URGENT' AND reading_status = 'unknown'")
def items_by_collection_and_tag(spark, sf_dir):
    items, collections, memberships, tags, _, _ = bibliography(spark, sf_dir)
    return biblio.chosen_items(items, tags, memberships, collections, "unknown", "Nation_4", "1-URGENT").select("item_key")


@query(f"WITH {_ITEMS}, {_LIBRARY} SELECT item_key, document_id, itm.title, relative_path, md5(lib.text) AS digest FROM itm JOIN lnk USING (item_key) JOIN lib USING (document_id) WHERE status = 'active' AND reading_status = 'unknown' ORDER BY itm.title, item_key, document_id LIMIT 40")
def reading_documents(spark, sf_dir):
    items, _, _, _, links, _ = bibliography(spark, sf_dir)
    docs = documents(spark, sf_dir).where("text is not null")
    return biblio.reading_documents(biblio.matching(items, "unknown"), links, docs, docs, 40).select("item_key", "document_id", "title", "relative_path", F.md5("text").alias("digest"))


@query(f"WITH {_ITEMS} SELECT item_key, string_agg(path, ' | ' ORDER BY lower(path), path) AS paths FROM mem JOIN col ON col.key = collection_key GROUP BY 1")
def item_collections(spark, sf_dir):
    _, collections, memberships, _, _, _ = bibliography(spark, sf_dir)
    return biblio.collections_of(memberships, collections).select("item_key", F.array_join("paths", " | ").alias("paths"))


@query(f"WITH {_ITEMS}, {_LIBRARY} SELECT coalesce(status, 'gone') AS status, count(*) AS links FROM lnk LEFT JOIN lib USING (document_id) GROUP BY 1")
def item_document_links(spark, sf_dir):
    links = bibliography(spark, sf_dir)[4]
    return biblio.links_of(links, documents(spark, sf_dir)).groupBy(F.coalesce("status", F.lit("gone")).alias("status")).agg(F.count("*").alias("links"))


@query(f"""WITH {_RESOLVED}, t AS (SELECT item_key, string_agg(tag, '; ' ORDER BY lower(tag), tag) AS tags FROM tag GROUP BY 1), c AS (SELECT item_key, string_agg(path, '; ' ORDER BY lower(path), path) AS collections FROM mem JOIN col ON col.key = collection_key GROUP BY 1),
a AS (SELECT item_key, string_agg(path_status, '; ' ORDER BY attachment_key) AS attachment_status, arg_min(path_status, attachment_key) AS primary_attachment_status FROM res GROUP BY 1)
SELECT item_key, coalesce(tags, '') AS tags, coalesce(collections, '') AS collections, coalesce(attachment_status, '') AS attachment_status, primary_attachment_status FROM itm LEFT JOIN t USING (item_key) LEFT JOIN c USING (item_key) LEFT JOIN a USING (item_key)""")
def reading_meta(spark, sf_dir):
    items, collections, memberships, tags, _, _ = bibliography(spark, sf_dir)
    return biblio.reading_meta(items, tags, memberships, collections, resolved(spark, sf_dir))


@query(f"WITH {_RESOLVED} SELECT path_status, count(*) AS n FROM res GROUP BY 1")
def attachment_statuses(spark, sf_dir):
    return resolved(spark, sf_dir).groupBy("path_status").agg(F.count("*").alias("n"))


@query(f"WITH {_RESOLVED} SELECT count(*) AS seen, count(*) FILTER (path_status IN ('resolved', 'linked_outside_data_dir')) AS resolved, count(*) FILTER (path LIKE 'storage:%') AS stored, count(*) FILTER (path IS NOT NULL AND path NOT LIKE 'storage:%') AS linked FROM res")
def attachment_counts(spark, sf_dir):
    return biblio.attachment_counts(resolved(spark, sf_dir))


@query(f"WITH {_RESOLVED} SELECT (SELECT count(*) FROM itm) AS items, (SELECT count(DISTINCT document_id) FROM lnk) AS documents, (SELECT count(*) FROM res) AS attachments, (SELECT count(*) FROM res WHERE path_status IN ('missing', 'no_local_file', 'unsupported')) AS missing_attachments")
def item_stats(spark, sf_dir):
    items, _, _, _, links, _ = bibliography(spark, sf_dir)
    return biblio.item_statistics(items, links, resolved(spark, sf_dir))


def _records(spark, sf_dir):
    """Parts as JSON records of items, some of whose fields are blank."""
    k = F.col("p_partkey")
    creators = F.array(F.struct(F.lit("author").alias("creatorType"), F.col("p_brand").alias("firstName"), F.col("p_type").alias("lastName"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("author").alias("creatorType"), F.lit(None).cast("string").alias("firstName"), F.lit(None).cast("string").alias("lastName"), F.when(k % 2 == 0, F.col("p_name")).otherwise(F.lit(" ")).alias("name")))
    data = F.struct(F.concat(F.lit("K"), k).alias("key"), k.alias("version"), F.lit("book").alias("itemType"), F.when(k % 4 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("title"), creators.alias("creators"), F.concat(F.lit("May "), 1890 + k % 200).alias("date"), F.array(F.struct(F.concat(F.lit(" "), "p_type").alias("tag")), F.struct(F.lit("").alias("tag"))).alias("tags"), F.array(F.lit("c1")).alias("collections"))
    return read(spark, sf_dir, "part").select(F.to_json(F.struct(F.concat(F.lit("K"), k).alias("key"), k.alias("version"), data.alias("data"))).alias("json"))


@query("""SELECT 'K' || p_partkey AS item_key, p_partkey AS version, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS title, p_brand || ' ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '; ' || p_name ELSE '' END AS creators,
  CAST(1890 + p_partkey % 200 AS VARCHAR) AS year, p_type AS tags FROM part""")
def normalised_items(spark, sf_dir):
    return biblio.normalise_items(_records(spark, sf_dir)).select("item_key", "version", "title", F.array_join("creators", "; ").alias("creators"), "year", F.array_join("tags", "; ").alias("tags"))


@query("SELECT max(p_partkey) AS version FROM part")
def newest_version(spark, sf_dir):
    return biblio.newest_version(biblio.normalise_items(_records(spark, sf_dir)))


@query("SELECT 'C' || n_nationkey AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'R' || n_regionkey END AS parent FROM nation")
def normalised_collections(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    data = F.struct(F.concat(F.lit("C"), "n_nationkey").alias("key"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("R"), "n_regionkey")).otherwise(F.lit("false")).alias("parentCollection"))
    return biblio.normalise_collections(n.select(F.to_json(F.struct(data.alias("data"))).alias("json"))).select("key", "name", "parent")


@query("SELECT conv_id || '-' || turn AS key, CAST(conv_id AS VARCHAR) AS parent, CASE WHEN turn % 2 = 0 THEN 'note' ELSE 'annotation' END AS kind, length(CASE WHEN turn % 2 = 0 THEN nullif(trim(text, ' '), '') END) AS note_chars FROM conversations")
def normalised_children(spark, sf_dir):
    t = read(spark, sf_dir, "conversations")
    even = F.col("turn") % 2 == 0
    data = F.struct(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("conv_id").cast("string").alias("parentItem"), F.when(even, "note").otherwise("annotation").alias("itemType"), F.when(even, F.col("text")).alias("note"), F.when(~even, F.col("text")).alias("annotationText"))
    return biblio.normalise_children(t.select(F.to_json(F.struct(data.alias("data"))).alias("json"))).select("key", "parent", "kind", F.length("note").cast("long").alias("note_chars"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'zotero://select/items/AB' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') END AS uri FROM supplier")
def select_uris(spark, sf_dir):
    key = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "AB").otherwise("ab"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", biblio.select_uri(key).alias("uri"))


@query(f"WITH {_ITEMS} SELECT attachment_key, coalesce(filename, path, '') LIKE '%.pdf' AS pdf FROM att")
def pdf_attachments(spark, sf_dir):
    a = bibliography(spark, sf_dir)[5]
    return a.select("attachment_key", biblio.is_pdf(F.lit(None).cast("string"), F.col("filename"), F.col("path")).alias("pdf"))


_IMPORT = """imp AS (SELECT doc_id AS item_key, coalesce(text, '') AS text, doc_id % 3 <> 2 AS has_pdf, doc_id % 3 = 0 AS pdf_resolved, CASE WHEN doc_id % 6 = 0 THEN 'read' ELSE '' END AS pdf_text FROM documents),
out AS (SELECT *, CASE WHEN length(text) < 80 THEN 'skipped' WHEN has_pdf AND pdf_text = '' THEN 'skipped' WHEN item_key % 4 = 0 THEN 'imported' WHEN item_key % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome FROM imp)"""


@query(f"""WITH {_RESOLVED}, {_IMPORT} SELECT count(*) AS items_seen, count(*) FILTER (outcome = 'imported') AS items_imported, count(*) FILTER (outcome = 'updated') AS items_updated, count(*) FILTER (outcome = 'unchanged') AS items_unchanged, count(*) FILTER (outcome = 'skipped') AS skipped,
  count(*) FILTER (has_pdf) AS pdfs_seen, count(*) FILTER (has_pdf AND NOT pdf_resolved) AS pdfs_missing, count(*) FILTER (has_pdf AND pdf_text <> '') AS pdfs_extracted, count(*) FILTER (has_pdf AND pdf_resolved AND pdf_text = '') AS pdfs_extraction_failed,
  count(*) FILTER (outcome <> 'skipped' AND pdf_text = '') AS metadata_only_documents, (SELECT count(*) FROM res) AS attachments_seen, (SELECT count(*) FROM res WHERE path_status IN ('resolved', 'linked_outside_data_dir')) AS attachments_resolved,
  (SELECT count(*) FROM res WHERE path LIKE 'storage:%') AS stored_attachments, (SELECT count(*) FROM res WHERE path IS NOT NULL AND path NOT LIKE 'storage:%') AS linked_attachments,
  (SELECT count(*) FROM conversations WHERE turn % 2 = 0) AS notes_imported, (SELECT count(*) FROM conversations WHERE turn % 2 = 1) AS annotations_imported FROM out""")
def import_counters(spark, sf_dir):
    """Documents as items that are imported again, under the policy that a named PDF must be readable."""
    d = read(spark, sf_dir, "documents")
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    items = d.select(k.alias("item_key"), text.alias("text"), (k % 3 != 2).alias("has_pdf"), (k % 3 == 0).alias("pdf_resolved"), F.when(k % 6 == 0, "read").otherwise("").alias("pdf_text"))
    known = d.where("doc_id % 4 <> 0").select(k.alias("item_key"), F.when(k % 5 == 0, F.lit("old")).otherwise(F.sha2(text, 256)).alias("sha256"))
    outcomes = biblio.import_items(items, known, metadata_only=False, pdf_policy="skip-missing")
    notes = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_key"), F.when(F.col("turn") % 2 == 0, "note").otherwise("annotation").alias("kind"))
    return biblio.import_counters(outcomes, resolved(spark, sf_dir), notes)


@query("SELECT c_custkey AS item_key, md5(array_to_string(list_filter([c_name, c_name, c_name, c_mktsegment, c_mktsegment, 'a b', 'a b', 'x'], lambda v: trim(v) <> ''), chr(10))) AS digest FROM customer")
def bibliographic_text(spark, sf_dir):
    words = F.array(F.lit("a"), F.lit("b"))
    none = F.array().cast("array<string>")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_key"), F.md5(biblio.weighted_text(F.col("c_name"), F.col("c_mktsegment"), words, none, none, [F.lit(" "), F.lit("x")])).alias("digest"))


# runs, overrides, validation


def _map_tables(spark, sf_dir):
    o, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at")), lines.select(F.col("l_orderkey").alias("run_id"), (F.col("l_partkey") * 3).alias("doc_id"), F.col("l_linenumber").alias("line"))


@query("SELECT o_orderkey AS run_id, o_orderpriority AS name, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM (SELECT *, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderpriority, o_orderkey) AS k FROM orders) WHERE k <= 25")
def map_run_list(spark, sf_dir):
    return maps.list_runs(_map_tables(spark, sf_dir)[0], 25)


@query(f"WITH {_LIBRARY} SELECT l_partkey * 3 AS doc_id, l_linenumber AS line, status FROM lineitem LEFT JOIN lib ON document_id = CAST(l_partkey * 3 AS VARCHAR) WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)")
def map_run_documents(spark, sf_dir):
    points = _map_tables(spark, sf_dir)[1]
    first = points.agg(F.min("run_id")).first()[0]
    docs = documents(spark, sf_dir).withColumn("document_id", F.col("document_id").cast("long"))
    return maps.run_documents(points.withColumn("run_id", F.col("run_id").cast("string")), docs, str(first)).select("doc_id", "line", "status")


@query("SELECT 'map_runs' AS \"table\", count(*) AS rows FROM orders WHERE o_orderkey <> 7 UNION ALL SELECT 'map_points', count(*) FROM lineitem WHERE l_orderkey <> 7")
def delete_map_run(spark, sf_dir):
    header, points = _map_tables(spark, sf_dir)
    left = maps.delete_run({"map_runs": header.withColumn("run_id", F.col("run_id").cast("string")), "map_points": points.withColumn("run_id", F.col("run_id").cast("string"))}, "7")
    return library.row_counts(**left)


_OVERRIDES = "ovr AS (SELECT 's' || s_suppkey AS signature, s_name AS manual_label, CAST(s_suppkey % 4 AS VARCHAR) AS updated_at FROM supplier)"


def overrides(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("signature"), F.col("s_name").alias("manual_label"), (F.col("s_suppkey") % 4).cast("string").alias("updated_at"))


@query(f"WITH {_OVERRIDES} SELECT signature, manual_label, CAST(row_number() OVER (ORDER BY updated_at DESC, signature) AS INTEGER) AS place FROM ovr QUALIFY place <= 8")
def override_list(spark, sf_dir):
    """Newest first, ties by signature; place shows the order."""
    from pyspark.sql.window import Window

    order = [F.desc("updated_at"), F.col("signature")]
    return library.page(overrides(spark, sf_dir), *order, limit=8).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("signature", "manual_label", "place")


@query(f"WITH {_OVERRIDES} SELECT signature FROM ovr WHERE CAST(substr(signature, 2) AS BIGINT) % 3 <> 0")
def stale_overrides(spark, sf_dir):
    all_ = overrides(spark, sf_dir)
    live = read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("signature"))
    return validation.stale_overrides(all_, live).select("signature")


@query(f"""WITH d AS ({S.DANGLING}), r AS ({S.RUN_CONSISTENCY}), s AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey % 3 <> 0),
i AS (SELECT 'error' AS severity FROM d WHERE n > 0 UNION ALL SELECT 'error' FROM (SELECT count(*) AS n FROM r) WHERE n > 0 UNION ALL SELECT 'warning' FROM s WHERE n > 0)
SELECT CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'ERRORS' WHEN count(*) > 0 THEN 'WARNINGS' ELSE 'OK' END AS status, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM i""")
def validation_report(spark, sf_dir):
    from lexatlas.plans import catalogue

    found = validation.issues(catalogue.dangling_counts(spark, sf_dir), catalogue.run_consistency(spark, sf_dir), stale_overrides(spark, sf_dir))
    return validation.status(found)


# state


def _full_merge(spark, sf_dir):
    """A classified run whose rows carry texts and times: every seventh document is new, every fifth gone, every fourth changed."""
    d = read(spark, sf_dir, "documents").select(F.lit("c").alias("corpus_id"), F.col("doc_id").cast("string").alias("relative_path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id")
    old = d.where("doc_id % 7 <> 0").select("corpus_id", "relative_path", F.sha2("text", 256).alias("sha256"), F.when(k % 13 == 0, "unindexed").otherwise("active").alias("status"), F.lit("f").alias("fingerprint"), "text", *(F.lit("t0").alias(c) for c in ("first_seen_at", "last_seen_at", "updated_at")))
    text = F.when(k % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    path = F.when(k % 22 == 0, F.concat("relative_path", F.lit(".png"))).otherwise(F.col("relative_path"))
    now = d.where("doc_id % 5 <> 0").select("corpus_id", "relative_path", F.sha2(text, 256).alias("sha256"), F.lit("f").alias("fingerprint"), F.when(k % 11 == 0, F.when(k % 2 == 0, "reading failed").otherwise("unsupported")).alias("skip_reason"), F.length(text).cast("long").alias("char_count"), text.alias("text"), F.lit("text").alias("method"))
    return state.classify(old, now)


_FULL = """src AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
mrg AS (SELECT doc_id, text, doc_id % 7 <> 0 AS was, doc_id % 5 <> 0 AS seen, doc_id % 4 = 0 AS changed, CASE WHEN doc_id % 13 = 0 THEN 'unindexed' ELSE 'active' END AS st, length(text) + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS n FROM src WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0),
cls AS (SELECT *, CASE WHEN NOT seen AND st = 'active' THEN 'missing' WHEN NOT seen THEN 'kept' WHEN was AND NOT changed AND st = 'active' THEN 'unchanged' WHEN doc_id % 11 = 0 THEN 'skipped' WHEN n < 80 THEN 'low_text' WHEN was THEN 'updated' ELSE 'inserted' END AS branch FROM mrg)"""


@query(f"""WITH {_FULL}, nxt AS (SELECT *, CASE WHEN branch = 'missing' THEN 'missing' WHEN branch = 'kept' THEN st WHEN branch IN ('skipped', 'low_text') THEN 'unindexed' ELSE 'active' END AS status FROM cls WHERE was OR branch NOT IN ('skipped', 'low_text'))
SELECT CAST(doc_id AS VARCHAR) AS relative_path, status, sha256(text || CASE WHEN changed AND branch IN ('inserted', 'updated', 'skipped', 'low_text') THEN '!' ELSE '' END) AS sha256, md5(text || CASE WHEN changed AND branch IN ('inserted', 'updated') THEN '!' ELSE '' END) AS digest,
  CASE WHEN was THEN 't0' ELSE 't1' END AS first_seen_at, CASE WHEN seen THEN 't1' ELSE 't0' END AS last_seen_at, CASE WHEN branch IN ('unchanged', 'kept') THEN 't0' ELSE 't1' END AS updated_at FROM nxt""")
def next_documents(spark, sf_dir):
    out = state.next_documents(_full_merge(spark, sf_dir), "t1")
    return out.select("relative_path", "status", "sha256", F.md5("text").alias("digest"), "first_seen_at", "last_seen_at", "updated_at")


@query(f"""WITH {_FULL}, rep AS (SELECT CAST(doc_id AS VARCHAR) AS relative_path, CASE WHEN branch IN ('inserted', 'updated', 'unchanged') THEN 'extracted' WHEN branch = 'low_text' THEN 'unindexed' WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'skipped' END AS status,
  CASE WHEN branch = 'unchanged' THEN 'unchanged' WHEN branch = 'skipped' THEN 'unknown' ELSE 'text' END AS method FROM cls WHERE seen)
SELECT 'extract_' || substr(sha256('r1' || chr(0) || relative_path || chr(0) || status), 1, 16) AS report_id, relative_path, status, method FROM rep""")
def extraction_reports(spark, sf_dir):
    return state.reports(_full_merge(spark, sf_dir), "r1").select("report_id", "relative_path", "status", "method")


@query(f"""WITH {_FULL}, cut AS (SELECT unnest({_chunks("(text || CASE WHEN changed THEN '!' ELSE '' END)")}) AS c FROM cls WHERE branch IN ('inserted', 'updated'))
SELECT 'r1' AS run_id, 't0' AS started_at, 't1' AS finished_at, 'completed' AS run_status, count(*) FILTER (seen) AS files_seen, count(*) FILTER (branch = 'inserted') AS inserted, count(*) FILTER (branch = 'updated') AS updated, count(*) FILTER (branch = 'unchanged') AS unchanged,
  count(*) FILTER (branch IN ('skipped', 'low_text')) AS skipped, count(*) FILTER (branch = 'low_text') AS low_text, count(*) FILTER (branch = 'missing') AS missing, (SELECT count(*) FROM cut) AS chunks_indexed, CAST((SELECT coalesce(sum(length(c)), 0) FROM cut) AS BIGINT) AS characters_indexed,
  count(*) FILTER (branch IN ('skipped', 'low_text')) AS warnings, count(*) FILTER (branch IN ('inserted', 'updated', 'unchanged') OR branch = 'kept' AND st = 'active') AS active_documents, count(*) FILTER (branch IN ('inserted', 'updated')) AS extracted, count(*) FILTER (branch = 'skipped' AND was) AS unindexed FROM cls""")
def index_run_row(spark, sf_dir):
    merged = _full_merge(spark, sf_dir)
    written = merged.where(F.col("branch").isin("inserted", "updated")).select(F.explode(T.window_chunks(F.col("new_text"))).alias("c")).select(F.length("c").cast("long").alias("char_count"))
    return state.run_row(merged, written, "r1", "t0", "t1")


@query("SELECT CASE WHEN k = 0 THEN 'ocr_unavailable' WHEN k = 1 THEN 'failed' ELSE 'skipped' END AS status, CASE WHEN k IN (0, 2) THEN 'image-ocr-tesseract' WHEN k = 1 THEN 'pdf-pypdf' ELSE 'unknown' END AS method, count(*) AS n FROM (SELECT doc_id % 4 AS k FROM documents) GROUP BY 1, 2")
def skip_statuses(spark, sf_dir):
    k = F.col("doc_id") % 4
    rows = read(spark, sf_dir, "documents").select(F.element_at(F.array(*map(F.lit, ["a/b.PNG", "x.pdf", "c.tiff", "d.docx"])), (k + 1).cast("int")).alias("path"), F.element_at(F.array(*map(F.lit, ["OCR is off", "reading Failed", "too large", "unsupported"])), (k + 1).cast("int")).alias("reason"))
    return rows.groupBy(state.skip_status(F.col("path"), F.col("reason")).alias("status"), state.skip_method(F.col("path")).alias("method")).agg(F.count("*").alias("n"))


# maps, from given clusters (the language)


@query(f"""WITH {_CTFIDF}, {_SIGNED}, ter AS (SELECT cluster_id, string_agg(term, ' / ' ORDER BY rank) FILTER (rank <= 3) AS label, list(term) AS terms FROM lab GROUP BY 1), {_CHOSEN},
top AS (SELECT cluster_id, string_agg(doc_id, ',' ORDER BY rank) AS representatives FROM cho GROUP BY 1)
SELECT cluster_id, size, signature, coalesce(label, 'Cluster ' || cluster_id) AS generated_label, representatives FROM sig LEFT JOIN ter USING (cluster_id) LEFT JOIN top USING (cluster_id)""")
def cluster_labels(spark, sf_dir):
    out = maps.label_clusters(_clustered(spark, sf_dir))
    return out.select("cluster_id", "size", "signature", "generated_label", F.array_join(F.transform("representatives", lambda r: r["doc_id"].cast("string")), ",").alias("representatives"))


@query(f"""WITH {_SIGNED}, r AS (SELECT lang AS cluster_id, string_agg(doc_id, ',' ORDER BY doc_id) FILTER (k <= 3) AS representatives FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) GROUP BY 1)
SELECT cluster_id, size, signature, CASE WHEN cluster_id = 'en' THEN 'mine' ELSE 'Cluster ' || cluster_id END AS display_label, representatives FROM sig JOIN r USING (cluster_id)""")
def fallback_labels(spark, sf_dir):
    simple = spark.createDataFrame([("en", "mine"), ("fr", "")], "cluster_id string, label string")
    out = maps.fallback_labels(_clustered(spark, sf_dir), simple)
    return out.select("cluster_id", "size", "signature", "display_label", F.array_join(F.transform("representatives", lambda r: r["doc_id"].cast("string")), ",").alias("representatives"))


@query(f"""WITH {S._NEIGHBOURS}, nei AS (SELECT doc_id, string_agg(neighbour || ':' || CAST(CAST(round(score * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS neighbours FROM (SELECT doc_id, neighbour, rank, round(score, 4) AS score FROM knn) GROUP BY 1),
tms AS (SELECT doc_id, string_agg(term, ',' ORDER BY k) AS top_terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 12) DESC, term) AS k FROM wgt) WHERE k <= 8 GROUP BY 1)
SELECT d.doc_id, lang AS cluster_label, coalesce(top_terms, '') AS top_terms, neighbours FROM documents d LEFT JOIN nei USING (doc_id) LEFT JOIN tms USING (doc_id)""")
def map_points(spark, sf_dir):
    """A map's points, over given clusters and without places."""
    docs = read(spark, sf_dir, "documents")
    names = docs.select(F.col("lang").alias("cluster_id"), F.col("lang").alias("display_label"), F.col("lang").alias("signature")).distinct()
    none = docs.where("false").select("doc_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    out = maps.points(docs, tfidf.coded_weights(docs, shared=True), none, docs.select("doc_id", F.col("lang").alias("cluster_id")), names)
    return out.select("doc_id", "cluster_label", F.array_join("top_terms", ",").alias("top_terms"), F.array_join(F.transform("neighbours", lambda n: F.concat_ws(":", n["neighbour"], F.round(n["score"] * 10000).cast("long"))), ",").alias("neighbours"))


@query("SELECT lang AS cluster_id, lang AS cluster_label, count(*) AS points FROM documents GROUP BY 1, 2")
def legend_counts(spark, sf_dir):
    return maps.legend(_clustered(spark, sf_dir).withColumn("cluster_label", F.col("cluster_id")))


@query(f"""WITH {S._NEIGHBOURS}, p AS (SELECT least(doc_id, neighbour) AS a, greatest(doc_id, neighbour) AS b, arg_min(struct_pack(s := doc_id, t := neighbour, r := rank), doc_id * 100 + rank) AS m, min(doc_id * 100 + rank) AS o FROM knn GROUP BY 1, 2)
SELECT m.s AS source, m.t AS target FROM (SELECT * FROM p ORDER BY o LIMIT 15)""")
def nearest_pairs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return maps.first_pairs(docs, 15)


@query("""WITH p AS (SELECT doc_id, length(text) AS n, doc_id % 4 AS pages FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN pages <= 0 OR n <= 0 THEN 'empty' WHEN n / pages < 40 THEN 'very_low' WHEN n / pages < 200 THEN 'low' ELSE 'ok' END AS quality, pages > 0 AND (n < 80 OR n / pages < 40) AS scanned, count(*) AS n FROM p GROUP BY 1, 2""")
def pdf_quality(spark, sf_dir):
    """Documents as PDF files of up to three pages with the same number of characters each."""
    from lexatlas.sources import extract

    d = read(spark, sf_dir, "documents").where("text is not null").select(F.length("text").alias("n"), (F.col("doc_id") % 4).cast("int").alias("pages"))
    counts = F.when(F.col("pages") > 0, F.array_repeat(F.col("n") / F.col("pages"), F.col("pages"))).otherwise(F.array().cast("array<double>"))
    return d.groupBy(extract.quality_label(F.col("n"), F.col("pages")).alias("quality"), extract.scanned_candidate(F.col("n"), counts).alias("scanned")).agg(F.count("*").alias("n"))


@query(f"WITH e AS ({S.KNN_EDGES}) SELECT CASE WHEN source = 0 THEN target ELSE source END AS id FROM e WHERE source = 0 OR target = 0 UNION SELECT 0")
def focus_set(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return tfidf.focus(tfidf.edges(tfidf.neighbours(docs, tfidf.coded_weights(docs, shared=True), 5)), 0)


@query("SELECT doc_id FROM documents WHERE contains(lower(lang || ' ' || source), 'en')")
def interface_filter(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("relative_path"), F.col("lang").alias("cluster_label"), F.array("source").alias("top_terms"))
    return library.interface_filter(docs, " EN ").select("doc_id")


@query(f"""WITH {_PAIRS},
tok AS (SELECT pair_id, side, {_label_tokens("lower(coalesce(text, ''))")} AS w FROM prs),
cnt AS (SELECT pair_id, side, term, count(*) AS tf FROM (SELECT pair_id, side, unnest({S._BIGRAMS}) AS term FROM tok) GROUP BY 1, 2, 3),
raw AS (SELECT *, tf * (ln(3.0 / (1 + count(*) OVER (PARTITION BY pair_id, term))) + 1) AS raw, count(*) OVER (PARTITION BY pair_id, term) AS df FROM cnt),
nrm AS (SELECT pair_id, side, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY 1, 2),
mul AS (SELECT pair_id, term, exp(sum(ln(raw / norm))) AS product FROM raw JOIN nrm USING (pair_id, side) WHERE df = 2 GROUP BY 1, 2),
agg AS (SELECT pair_id, round(sum(product), 4) AS s, least(count(*) FILTER ({_TELLING}), 8) AS n FROM mul GROUP BY 1)
SELECT DISTINCT prs.pair_id, coalesce(s, 0.0) AS lexical_score, coalesce(n, 0) AS n_terms FROM prs LEFT JOIN agg USING (pair_id)""")
def pair_explanations(spark, sf_dir):
    out = maps.explain_pairs(_pairs(spark, sf_dir))
    return out.select("pair_id", "lexical_score", F.coalesce(F.size("shared_terms"), F.lit(0)).cast("long").alias("n_terms")).withColumn("n_terms", F.greatest("n_terms", F.lit(0).cast("long")))


# samples, references, child rows


@query(f"""WITH {_RESOLVED}, smp AS (SELECT item_key FROM itm ORDER BY md5(CAST(item_key AS VARCHAR)), item_key LIMIT 400),
own AS (SELECT *, path IS NOT NULL AND path LIKE 'storage:%' AS st, coalesce(filename, path, '') LIKE '%.pdf' AS pdf, attachment_key % 7 = 0 AS bad, attachment_key % 3 <> 0 AS att FROM res WHERE item_key IN (SELECT item_key FROM smp))
SELECT count(*) FILTER (NOT bad) AS children, count(*) FILTER (NOT bad AND att) AS attachments, count(*) FILTER (NOT bad AND att AND st) AS stored, count(*) FILTER (NOT bad AND att AND path IS NOT NULL AND NOT st) AS linked,
  count(*) FILTER (NOT bad AND att AND path_status IN ('missing', 'no_local_file', 'unsupported')) AS missing, count(*) FILTER (NOT bad AND att AND path_status = 'linked_outside_data_dir') AS linked_outside,
  count(*) FILTER (NOT bad AND att AND pdf AND path_status IN ('resolved', 'linked_outside_data_dir')) AS resolved_pdf, count(*) FILTER (NOT bad AND att AND pdf AND path_status NOT IN ('resolved', 'linked_outside_data_dir')) AS missing_pdf,
  count(DISTINCT item_key) FILTER (bad) AS failed FROM own""")
def child_sample_counters(spark, sf_dir):
    """Children of a sample of items; every seventh could not be read, every third is a note."""
    k = F.col("attachment_key")
    children = resolved(spark, sf_dir).withColumn("kind", F.when(k % 3 == 0, "note").otherwise("attachment")).withColumn("error", F.when(k % 7 == 0, "time out")).withColumn("content_type", F.lit(None).cast("string"))
    return biblio.sample_counters(bibliography(spark, sf_dir)[0], children, 400)


@query("""WITH kid AS (SELECT conv_id, turn, text, conv_id % 3 AS third FROM conversations), old AS (SELECT conv_id, turn, text FROM kid WHERE third <> 1),
new AS (SELECT conv_id, turn, 'new ' || text AS text FROM kid WHERE third <> 0 AND turn < 2)
SELECT conv_id, count(*) AS n, md5(string_agg(turn || ':' || text, ',' ORDER BY turn)) AS digest FROM (SELECT * FROM old WHERE conv_id NOT IN (SELECT conv_id FROM kid WHERE third <> 0) UNION ALL SELECT * FROM new) GROUP BY 1""")
def child_sets_replaced(spark, sf_dir):
    """Turns as child rows: those of the conversations that come again are replaced as sets, down to none."""
    kids = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    third = F.col("conv_id") % 3
    came = kids.where(third != 0)
    rows = state.replace_children(kids.where(third != 1), came.where("turn < 2").withColumn("text", F.concat(F.lit("new "), "text")), "conv_id", ["conv_id", "turn"], came)
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.col("turn").cast("string"), F.lit(":"), "text").alias("x")))), lambda r: r["x"]), ",")).alias("digest"))


@query("SELECT least(8, greatest(2, CAST(round(sqrt(count(*))) AS INTEGER))) AS clusters, count(*) AS documents, count(*) AS placed FROM documents")
def cluster_invariants(spark, sf_dir):
    """k-means gives each document one of as many clusters as their number asks for."""
    docs = read(spark, sf_dir, "documents")
    found = layout.kmeans(docs, tfidf.coded_weights(docs))
    return found.agg(F.countDistinct("cluster_id").cast("int").alias("clusters"), F.countDistinct("doc_id").alias("documents"), F.count("*").alias("placed"))


from lexatlas.plans import search  # noqa: E402, F401  registers its queries here
