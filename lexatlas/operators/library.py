"""The library's tables put together: documents with texts and chunks, vectors with models, lists, pages and counts.

Tables and their columns: documents (document_id, corpus_id, relative_path, title, file_type, status, char_count,
updated_at), texts (document_id, text), chunks (document_id, chunk_id, chunk_index, text, char_count), models (model_id,
name), vectors (vector_id, model_id, object_type, object_id, embedding), runs (run_id, model_id, started_at, finished_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.functions.text import preview, snippet
from lexatlas.functions.vectors import cosine
from lexatlas.operators.state import latest

#: Tables whose rows may be counted by name.
TABLES = ("documents", "texts", "chunks", "models", "vectors", "runs", "overrides", "map_runs", "map_points", "map_clusters", "items", "attachments", "links", "reports", "skipped")


def page(rows: DataFrame, *order: Column | str, limit: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows; negative numbers count as 0."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def with_status(rows: DataFrame, statuses) -> DataFrame:
    """Rows of some statuses; of all, if none are named."""
    return rows.where(F.col("status").isin(list(statuses))) if statuses else rows


def by_corpus_path(documents: DataFrame, corpus_id: str, relative_path: str) -> DataFrame:
    return documents.where((F.col("corpus_id") == corpus_id) & (F.col("relative_path") == relative_path))


def text_of(texts: DataFrame, document_id: str) -> DataFrame:
    return texts.where(F.col("document_id") == document_id).select("text")


def chunks_of(chunks: DataFrame, document_id: str, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(chunks.where(F.col("document_id") == document_id), "chunk_index", limit=limit, offset=offset)


def documents_with_text(documents: DataFrame, texts: DataFrame, statuses=("active",), limit: int = 1000) -> DataFrame:
    """Documents and their text, by path. Status and limit stand before the join, so only the page's texts are read."""
    chosen = page(with_status(documents.join(texts.select("document_id"), "document_id", "left_semi"), statuses), "relative_path", limit=limit)
    return chosen.join(texts.select("document_id", "text"), "document_id").orderBy("relative_path")


def chunks_with_documents(chunks: DataFrame, documents: DataFrame, statuses=("active",), limit: int = 1000) -> DataFrame:
    """Chunks with path, title and status of their document, by path and place."""
    own = with_status(documents, statuses).select("document_id", "relative_path", "title", "status")
    return page(chunks.join(own, "document_id"), "relative_path", "chunk_index", limit=limit)


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id and chunks of every document, 0 too."""
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return documents.select("document_id").join(counted, "document_id", "left").fillna(0, ["chunks"])


def row_counts(**tables: DataFrame) -> DataFrame:
    """table and rows; ValueError for a name that is no table of the library."""
    if wrong := sorted(set(tables) - set(TABLES)):
        raise ValueError(f"no such tables: {wrong}")
    counted = [t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, t in tables.items()]
    out = counted[0]
    for x in counted[1:]:
        out = out.union(x)
    return out


def full_statistics(documents: DataFrame, chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents by status, characters of active ones, chunks, runs, and when the newest run ended (or began)."""
    is_ = lambda s: F.col("status") == s
    docs = documents.agg(
        F.count("*").alias("documents"), F.count_if(is_("active")).alias("active"), F.count_if(is_("missing")).alias("missing"), F.count_if(is_("unindexed")).alias("unindexed"),
        F.coalesce(F.sum(F.when(is_("active"), F.col("char_count"))), F.lit(0)).cast("long").alias("total_chars"),
    )
    ended = F.coalesce("finished_at", "started_at")
    done = runs.agg(F.count("*").alias("scan_runs"), F.max_by(ended, F.struct("started_at", "run_id")).alias("last_scan_time"))
    return docs.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks")))).crossJoin(F.broadcast(done))  # three one-row frames


def vector_statistics(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """Vectors by model and kind of object: count, first and last id."""
    counted = vectors.groupBy("model_id", "object_type").agg(F.count("*").alias("vectors"), F.min("object_id").alias("first_id"), F.max("object_id").alias("last_id"))
    return counted.join(models.select("model_id", "name"), "model_id").select("model_id", "name", "object_type", "vectors", "first_id", "last_id")


def latest_runs(models: DataFrame, runs: DataFrame) -> DataFrame:
    """Every model with its newest run, null if it has none."""
    newest = latest(runs, "model_id", F.desc("started_at"), F.desc("run_id")).select("model_id", "run_id", "started_at")
    return models.select("model_id", "name").join(newest, "model_id", "left")


def unindexed_texts(documents: DataFrame, postings: DataFrame) -> DataFrame:
    """Active documents that the full-text index does not hold yet (document_id)."""
    return documents.where("status = 'active'").select("document_id").join(postings.select("document_id").distinct(), "document_id", "left_anti")


def semantic_documents(vectors: DataFrame, documents: DataFrame, texts: DataFrame, query: list[float], words: list[str], limit: int = 10, include_missing: bool = False) -> DataFrame:
    """The documents nearest to a query vector, with a snippet around the query's words. Only hits meet their texts."""
    allowed = ["active", "missing"] if include_missing else ["active"]
    found = vectors.where("object_type = 'document'").join(with_status(documents, allowed).select(F.col("document_id").alias("object_id"), "relative_path", "status"), "object_id")
    return _ranked(found, texts.select(F.col("document_id").alias("object_id"), "text"), query, words, limit, ["relative_path"])


def semantic_chunks(vectors: DataFrame, chunks: DataFrame, documents: DataFrame, query: list[float], words: list[str], limit: int = 10) -> DataFrame:
    """The chunks of active documents nearest to a query vector."""
    own = chunks.join(with_status(documents, ["active"]).select("document_id", "relative_path", "status"), "document_id").select(F.col("chunk_id").alias("object_id"), "relative_path", "status", "chunk_index")
    found = vectors.where("object_type = 'chunk'").join(own, "object_id")
    return _ranked(found, chunks.select(F.col("chunk_id").alias("object_id"), "text"), query, words, limit, ["relative_path", "chunk_index"])


def _ranked(found: DataFrame, texts: DataFrame, query: list[float], words: list[str], limit: int, ties: list[str]) -> DataFrame:
    literal = F.array(*[F.lit(float(x)) for x in query])
    best = found.withColumn("raw", F.round(cosine(F.col("embedding"), literal), 9)).drop("embedding").orderBy(F.desc("raw"), *ties).limit(max(0, limit))
    shown = best.join(texts, "object_id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("raw"), *ties)))
    return shown.select("rank", "object_id", *ties, "status", F.round("raw", 4).alias("score"), snippet(F.col("text"), words).alias("snippet"))


def document_embedding_text(title: Column, path: Column, text: Column, most: int = 8000) -> Column:
    """Title three times, path and the first characters of the text, a line each."""
    lines = F.concat_ws("\n", title, title, title, path, F.substring(text, 1, max(0, most)))
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")


def chunk_embedding_text(text: Column, most: int = 2000) -> Column:
    return F.substring(text, 1, max(0, most))


def extraction_preview(scanned: DataFrame, relative_path: str) -> DataFrame:
    """What extraction makes of one file, without writing anything."""
    one = scanned.where(F.col("relative_path") == relative_path)
    return one.select("relative_path", "title", "method", "skip_reason", "char_count", preview(F.col("text")).alias("preview"), F.size("sections").alias("sections"), F.size("links").alias("links"))


def interface_filter(points: DataFrame, needle: str) -> DataFrame:
    """Points whose title, path, label or top terms hold a string, without regard to case."""
    if not needle.strip():
        return points
    shown = F.lower(F.concat_ws(" ", "title", "relative_path", "cluster_label", F.concat_ws(" ", "top_terms")))
    return points.where(F.contains(shown, F.lit(needle.strip().lower())))


def capped(rows: DataFrame, *order: Column | str, limit: int, what: str = "rows") -> tuple[DataFrame, list[str]]:
    """The first rows of an order, and a warning if there were more."""
    total = rows.count()
    warnings = [f"the first {max(0, limit)} of {total} {what} because of limit={limit}"] if total > max(0, limit) else []
    return page(rows, *order, limit=limit), warnings
