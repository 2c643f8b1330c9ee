"""Registered corpus queries: name -> callable(spark, sf_dir), and the equivalent DuckDB SQL.

The driver's tables play these roles: documents is the corpus (source: its collection, lang: a given clustering), labels
a side table that tells statuses, pages holds notes in HTML, conversations parents with children, embeddings the
vectors, events the run log, orders and lineitem runs and their points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.distribution import ship, stored
from lexatlas.functions import text as T
from lexatlas.operators import biblio, explain, fts, layout, similarity, state, tfidf
from lexatlas.plans import sql as S
from lexatlas.sources import extract

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with relative_path, and status: missing where its label says quality 0, else active."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    bad = read(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("missing").alias("status"))
    out = docs.join(bad, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("active")))
    return out.withColumn("relative_path", F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))).withColumn("char_count", F.length("text").cast("long"))


def first_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").orderBy("item_id").limit(1)


# full-text search


@query(S.BM25)
def fts_bm25_search(spark, sf_dir):
    """Documents ranked for any of the words of the first benchmark item."""
    words = first_item(spark, sf_dir).select(F.explode(F.array_distinct(T.fts_tokens(F.col("text")))).alias("term"))
    scored = fts.bm25(read(spark, sf_dir, "documents"), words).withColumn("score", F.round("score", 6))
    return scored.orderBy("score", "doc_id").limit(10)


@query(S.FTS_BOOLEAN)
def fts_boolean(spark, sf_dir):
    """A query with a prefix, OR and NOT: ids that match."""
    tree = fts._with_prefix(fts.parse("(erst* OR tion) NOT des"))
    docs = read(spark, sf_dir, "documents").select("doc_id", T.fts_tokens(F.col("text")).alias("t_text"))
    return docs.where(fts.matches(tree, ["t_text"])).select("doc_id")


@query(S.FTS_FALLBACK)
def fts_or_fallback(spark, sf_dir):
    """A text that is no query counts as any of its words; only active documents are found."""
    docs = corpus(spark, sf_dir).withColumn("title", F.lit(""))
    return fts.search(docs, "the-tion AND", limit=10, columns=("text",)).select("rank", "doc_id", F.round("score", 6).alias("score"))


# TF-IDF


@query(S.TOP_TERMS)
def tfidf_top_terms(spark, sf_dir):
    return tfidf.best_terms(read(spark, sf_dir, "documents")).select("doc_id", "rank", "term", F.round("weight", 4).alias("weight"))


@query(S.KNN)
def tfidf_knn(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return tfidf.neighbours(docs, tfidf.coded_weights(docs, shared=True), 5)


@query(S.KNN_EDGES)
def knn_edges(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return tfidf.edges(tfidf.neighbours(docs, tfidf.coded_weights(docs, shared=True), 5))


@query(S.CLUSTER_TERMS_SIMPLE)
def cluster_terms_simple(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return explain.simple_labels_of(docs, docs.select("doc_id", F.col("lang").alias("cluster_id")))


def _clustered(spark, sf_dir):
    """Documents with title, path and text, clustered by language."""
    return corpus(spark, sf_dir).select(F.col("lang").alias("cluster_id"), "doc_id", F.coalesce(T.first_line(F.col("text")), F.lit("")).alias("title"), "relative_path", "text")


@query(S.CTFIDF)
def ctfidf_labels(spark, sf_dir):
    return explain.cluster_terms(_clustered(spark, sf_dir))


@query(S.REPRESENTATIVES)
def cluster_representatives(spark, sf_dir):
    docs = _clustered(spark, sf_dir)
    # a small table by its size, which the planner can send whole
    found = stored(explain.cluster_terms(docs).groupBy("cluster_id").agg(F.collect_list("term").alias("terms")), "terms")
    return explain.representatives(docs, found)


@query(S.SIGNATURE)
def cluster_signature(spark, sf_dir):
    return explain.signatures(read(spark, sf_dir, "documents").select(F.col("lang").alias("cluster_id"), "doc_id"))


@query(S.OVERRIDES)
def override_labels(spark, sf_dir):
    """Manual labels by signature, for the clusters of two languages."""
    clusters = read(spark, sf_dir, "documents").select(F.col("lang").alias("cluster_id"), "doc_id")
    labels = explain.signatures(clusters).select("cluster_id", "signature", F.concat(F.lit("cluster "), "cluster_id").alias("label"))
    manual = labels.where(F.col("cluster_id").isin("en", "fr")).select("signature", F.concat(F.lit("my "), "cluster_id").alias("manual_label"))
    return explain.apply_overrides(labels, manual).select("cluster_id", "display_label", "source")


def _pairs(spark, sf_dir):
    """Each benchmark item against the document of the same number."""
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    left = items.select(F.col("item_id").alias("pair_id"), F.lit("source").alias("side"), "text")
    right = docs.join(items.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("pair_id"), F.lit("target").alias("side"), "text")
    return left.union(right)


@query(S.PAIR_TERMS)
def pair_shared_terms(spark, sf_dir):
    return explain.shared_terms(_pairs(spark, sf_dir))


@query(S.PAIR_CHUNKS)
def pair_chunk_matches(spark, sf_dir):
    return explain.chunk_matches(_pairs(spark, sf_dir))


@query(S.SHARED_WORDS)
def shared_words(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    side = lambda s: pairs.where(F.col("side") == s).select("pair_id", F.col("text").alias(s))
    return side("source").join(side("target"), "pair_id").select("pair_id", F.array_join(explain.words_in_both(F.col("source"), F.col("target")), " ").alias("words"))


# text


@query(S.CHUNKS)
def chunk_windows(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.window_chunks(F.col("text"))).alias("chunk_index", "chunk"))
    return chunks.select("doc_id", "chunk_index", F.length("chunk").cast("long").alias("char_count"), F.md5("chunk").alias("digest"))


@query(S.CHUNK_STATS)
def chunk_stats(spark, sf_dir):
    chunks = read(spark, sf_dir, "documents").select("source", F.explode(T.window_chunks(F.col("text"))).alias("chunk"))
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("chunk")).cast("long").alias("chars"), F.max(F.length("chunk")).cast("long").alias("longest"))


@query(S.NORMALISED)
def normalise_text(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(T.normalised(F.col("text"))).alias("digest"), F.length(T.normalised(F.col("text"))).cast("long").alias("n"))


@query(S.FIRST_LINE)
def first_line_title(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.first_line(F.col("text")).alias("title"))


@query(S.SNIPPET)
def snippet_center(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), ["tion", "ment", "keit"]).alias("snippet"))


@query(S.HTML_TEXT)
def html_to_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", extract.html_to_text("html").alias("text"))


@query(S.MARKDOWN)
def markdown_extract(spark, sf_dir):
    """Documents read as Markdown files with their first line as heading."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("---\ntopic: a\n---\n# "), "text").cast("binary").alias("content"))
    return docs.withColumn("x", extract.extracted(F.lit("a.md"), "content")).select("doc_id", "x.title", "x.text", F.size("x.sections").alias("n_sections"))


@query(S.LATEX)
def latex_extract(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\\title{T}\\begin{abstract}"), "text", F.lit("\\end{abstract}\\cite{a,b}")).cast("binary").alias("content"))
    return docs.withColumn("x", extract.extracted(F.lit("a.tex"), "content")).select("doc_id", "x.title", "x.text", F.array_join("x.links", ",").alias("links"))


# vectors


@query(S.VEC_TOPK)
def vec_cosine_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    probe = vectors.orderBy("vec_id").limit(1).first().embedding
    return similarity.semantic_search(vectors, probe, 10)


@query(S.VEC_KNN)
def vec_knn(spark, sf_dir):
    return similarity.nearest(read(spark, sf_dir, "embeddings"), 5)


@query(S.VEC_PURITY)
def vec_label_purity(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    found = similarity.nearest(vectors, 5)
    label = lambda key, name: vectors.select(F.col("vec_id").alias(key), F.col("label").alias(name))
    both = found.join(label("vec_id", "label"), "vec_id").join(label("neighbour", "other"), "neighbour")
    return both.groupBy("label").agg(F.count("*").alias("neighbours"), F.count_if(F.col("label") == F.col("other")).alias("same"))


@query(S.VECTOR_STATS)
def vector_stats(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("vectors"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"), F.max(F.size("embedding")).alias("dimension"))


@query(S.HYBRID)
def hybrid_neighbors(spark, sf_dir):
    """The first document's neighbours by text and by the vector of the same number."""
    docs = read(spark, sf_dir, "documents")
    lexical = tfidf.similar_to(docs, 0)
    vectors = read(spark, sf_dir, "embeddings")
    probe = vectors.where("vec_id = 0").first().embedding
    dense = vectors.where("vec_id <> 0").select(F.col("vec_id").alias("doc_id"), similarity.cosine(F.col("embedding"), F.array(*map(F.lit, probe))).alias("score"))
    return similarity.hybrid(lexical, dense, 10)


@query(S.EMBED_INCREMENTAL)
def embed_incremental(spark, sf_dir):
    """Documents embedded anew when every third has changed: how many, by source."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("object_id"), "text", "source")
    old = docs.select("object_id", F.sha2("text", 256).alias("text_hash"))
    now = docs.withColumn("text", F.when(F.col("object_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    made = similarity.embed(now, old, similarity.HashingEncoder())
    return made.join(docs.select("object_id", "source"), "object_id").groupBy("source").agg(F.count("*").alias("embedded"), F.max(F.size("vector")).alias("dimension"))


# state


def _snapshots(spark, sf_dir):
    """The corpus as it was (ids not divisible by 7) and as a scan now finds it (not by 5; every fourth text changed, every eleventh skipped)."""
    docs = read(spark, sf_dir, "documents").select(F.lit("c").alias("corpus_id"), F.col("doc_id").cast("string").alias("relative_path"), "doc_id", "text")
    sha = F.sha2("text", 256)
    old = docs.where("doc_id % 7 <> 0").select("corpus_id", "relative_path", sha.alias("sha256"), F.when(F.col("doc_id") % 13 == 0, "unindexed").when(F.col("doc_id") % 6 == 0, "missing").otherwise("active").alias("status"), F.lit("f").alias("fingerprint"))
    now = docs.where("doc_id % 5 <> 0").select(
        "corpus_id", "relative_path", F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(sha).alias("sha256"), F.lit("f").alias("fingerprint"),
        F.when(F.col("doc_id") % 11 == 0, "unsupported").alias("skip_reason"), F.length("text").cast("long").alias("char_count"),
    )
    return old, now


@query(S.INDEX_MERGE)
def index_state_merge(spark, sf_dir):
    return state.classify(*_snapshots(spark, sf_dir)).groupBy("branch", "status").agg(F.count("*").alias("n"))


@query(S.INDEX_COUNTERS)
def index_counters(spark, sf_dir):
    return state.counters(state.classify(*_snapshots(spark, sf_dir)))


@query(S.UPSERT)
def upsert_documents(spark, sf_dir):
    """Keyed upsert that keeps first_seen_at, then a delete."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.lit("t0").alias("first_seen_at"), F.lit("t0").alias("updated_at"))
    new = docs.where("doc_id % 2 = 0").select((F.col("doc_id") * 2).alias("doc_id"), F.lit("t1").alias("first_seen_at"), F.lit("t1").alias("updated_at"))
    out = state.delete(state.upsert(docs, new, ["doc_id"], ("first_seen_at",)), docs.where("doc_id % 10 = 1"), ["doc_id"])
    return out.groupBy("first_seen_at", "updated_at").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(S.LATEST)
def latest_fingerprint(spark, sf_dir):
    """Each user's newest event and a field of its JSON."""
    events = read(spark, sf_dir, "events")
    newest = state.latest(events, "user_id", F.desc("ts"), F.desc("event_id"))
    return newest.select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").alias("field"))


@query(S.DB_STATS)
def db_stats(spark, sf_dir):
    return state.statistics(corpus(spark, sf_dir))


@query(S.HISTOGRAM)
def status_histogram_zero_filled(spark, sf_dir):
    return state.histogram(corpus(spark, sf_dir), "status", ["active", "missing", "unindexed"])


@query(S.DANGLING)
def dangling_counts(spark, sf_dir):
    t = lambda name: read(spark, sf_dir, name)
    return (
        state.dangling(t("labels"), t("documents"), "doc_id", "doc_id", "labels_without_document")
        .union(state.dangling(t("documents"), t("labels"), "doc_id", "doc_id", "documents_without_label"))
        .union(state.dangling(t("orders"), t("customer"), "o_custkey", "c_custkey", "orders_without_customer"))
        .union(state.dangling(t("customer"), t("orders"), "c_custkey", "o_custkey", "customers_without_order"))
    )


@query(S.RUN_CONSISTENCY)
def run_consistency(spark, sf_dir):
    """Orders as runs that say they have three points and two clusters."""
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit(3).cast("long").alias("document_count"), F.lit(2).cast("long").alias("cluster_count"))
    lines = read(spark, sf_dir, "lineitem")
    return state.run_consistency(runs, lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("document_id")), lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("cluster_id")))


@query(S.LIST_PAGE)
def list_page(spark, sf_dir):
    return state.list_documents(corpus(spark, sf_dir), ["active"], 20, 40).select("doc_id", "relative_path", "char_count")


@query(S.LOOKUP)
def id_or_path_lookup(spark, sf_dir):
    docs = corpus(spark, sf_dir).withColumn("document_id", F.concat(F.lit("doc_"), "doc_id"))
    return state.by_id_or_path(docs, "doc_17").select("document_id", "relative_path", "status")


# bibliographic


def _items(spark, sf_dir):
    """Conversations as items: their roles are tags, the number of turns in tens a collection, turns are notes."""
    rows = read(spark, sf_dir, "conversations")
    return rows.groupBy(F.col("conv_id").alias("item_key")).agg(
        F.array_sort(F.collect_set("role")).alias("tags"), F.array(F.concat(F.lit("c"), F.floor(F.count("*") / F.lit(3)).cast("string"))).alias("collections"), F.when(F.count("*") > 4, "journalArticle").otherwise("book").alias("item_type"), F.count("*").alias("turns")
    )


@query(S.ITEM_FILTER)
def item_filter_all_tags(spark, sf_dir):
    return biblio.filter_items(_items(spark, sf_dir), tags=("assistant", "user"), item_types=("journalArticle, report",)).select("item_key", "turns")


@query(S.COLLECTION_PATHS)
def collection_paths(spark, sf_dir):
    """Regions over nations as a tree."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    tree = r.select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent")).union(
        n.select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.concat(F.lit("r"), "n_regionkey"))
    )
    return biblio.collection_paths(tree)


@query(S.READING_STATUS)
def reading_status(spark, sf_dir):
    words = F.array(*map(F.lit, ["To Read", "Reading", "current", "queue", "unread", "finished", "read", "in progress", "done"]))
    rows = read(spark, sf_dir, "labels").select(F.filter(F.array(F.get(words, (F.col("doc_id") % 10).cast("int"))), lambda t: t.isNotNull()).alias("tags"), (F.col("quality") == 0).alias("noted"))
    return rows.groupBy(biblio.reading_status(F.col("tags"), F.lit(None).cast("array<string>"), F.col("noted")).alias("status")).agg(F.count("*").alias("n"))


@query(S.ITEM_DETAIL)
def item_detail_nested(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_key"), F.col("turn").alias("position"), "role", F.length("text").cast("long").alias("n"))
    items = turns.select("item_key").distinct()
    full = biblio.detail(items, "item_key", notes=turns)
    return full.select("item_key", F.array_join(F.transform("notes", lambda x: F.concat_ws(":", x["position"], x["role"], x["n"])), ",").alias("notes"))


# maps


@query()
def kmeans_clusters(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return layout.kmeans(docs, tfidf.coded_weights(docs))


@query()
def svd_layout(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return layout.layout_of(docs)


from lexatlas.plans import records  # noqa: E402, F401  registers its queries here
