"""Stable identifiers: a prefix and the first 16 hex digits of a SHA-256 over parts joined by a zero character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, 16))


def corpus_id(root: Column) -> Column:
    return stable("corpus_", root)


def document_id(corpus: Column, path: Column) -> Column:
    return stable("doc_", corpus, path)


def chunk_id(document: Column, index: Column) -> Column:
    return F.concat(document, F.lit("_chunk_"), F.lpad(index.cast("string"), 6, "0"))


def report_id(run: Column, path: Column, status: Column) -> Column:
    return stable("extract_", run, path, status)


def vector_id(model: Column, kind: Column, item: Column) -> Column:
    return stable("vec_", model, kind, item)


def item_id(source: Column, key: Column) -> Column:
    return stable("zotero_item_", source, key)


def cluster_signature(members: Column) -> Column:
    """Of an array of document ids, whatever their order."""
    return F.concat(F.lit("cluster_"), F.substring(F.sha2(F.to_json(F.array_sort(members)), 256), 1, 16))
