"""Registered queries of ranked search: phrases, beginnings, column filters, NEAR groups, and the stored index as it changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexatlas.distribution import scratch
from lexatlas.operators import fts, index
from lexatlas.plans.catalogue import query
from lexatlas.plans.records import _LIBRARY, documents
from lexatlas.plans.sql import _WHOLE, _phrase, fts_query


def _found(spark, sf_dir, text: str, include_missing: bool = False):
    docs = documents(spark, sf_dir).withColumnRenamed("document_id", "doc_id")
    found = fts.search(docs, text, 20, include_missing)
    return found.select("rank", F.col("doc_id").alias("document_id"), F.round("score", 6).alias("score"))


@query(fts_query(_LIBRARY, [_phrase(["of", "the"]), _phrase(["that"], True), _phrase(["was", "it"])], "f0 > 0 AND f1 > 0 AND NOT f2 > 0", given=["TRUE", "TRUE", "FALSE"]))
def fts_phrase_search(spark, sf_dir):
    """Two words in a row, a beginning, and a phrase that must not be there."""
    return _found(spark, sf_dir, '"of the" AND that* NOT "was it"')


@query(fts_query(_LIBRARY, [_phrase(["erst"], True)], "f0 > 0", statuses="'active', 'missing'"))
def fts_prefix_search(spark, sf_dir):
    return _found(spark, sf_dir, "erst*", include_missing=True)


@query(fts_query(_LIBRARY, [_phrase(["src1"], columns="tp"), _phrase(["src2"], columns="p"), _phrase(["the"], columns="x"), _phrase(["the", "in"], True, "x")], "(f0 > 0 OR f1 > 0) AND (f2 > 0 OR f3 > 0)"))
def fts_column_search(spark, sf_dir):
    """Filters by one column, several, all but some, and over a whole expression; alternatives count where they match."""
    return _found(spark, sf_dir, '(-text:src1 OR relative_path:src2) AND text:(the OR {text title}:"the in" *)')


def _close(one: str, other: str, distance: int) -> str:
    """Places of a word with another within a distance, over the columns."""
    places = lambda c, w: _WHOLE.format(w=c, test=f"{c}[i] = '{w}'")
    return " + ".join(f"len(list_filter({places(c, one)}, lambda a: len(list_filter({places(c, other)}, lambda b: abs(a - b) <= {1 + distance})) > 0))" for c in "tpx")


@query(fts_query(_LIBRARY, [_close("that", "with", 3), _close("with", "that", 3), _phrase(["and"])], "(f0 > 0 AND f1 > 0) OR f2 > 0", raw=[_phrase(["that"]), _phrase(["with"]), _phrase(["and"])]))
def fts_near_search(spark, sf_dir):
    """A NEAR group, whose phrases weigh by all rows that hold them but count only close by, or a word."""
    return _found(spark, sf_dir, "NEAR(that with, 3) OR and")


_CHANGED = f"""{_LIBRARY.replace("lib AS (", "lib0 AS (", 1).replace("FROM lib)", "FROM lib0)")},
lib AS (
  SELECT document_id, CASE WHEN lang = 'fr' THEN 'edited' ELSE title END AS title, relative_path, CASE WHEN lang = 'fr' THEN 'of the ' || coalesce(lib0.text, '') ELSE lib0.text END AS text, status, source
  FROM lib0 JOIN documents d ON CAST(d.doc_id AS VARCHAR) = document_id WHERE source <> 'src3' OR lang = 'de'
)"""


@query(fts_query(_CHANGED, [_phrase(["of", "the"]), _phrase(["edit"], True), _phrase(["le"])], "f0 > 0 OR f1 > 0 AND f2 > 0", given=["TRUE", "f2 > 0", "f1 > 0"]))
def fts_index_upkeep(spark, sf_dir):
    """The stored index after French documents were edited, a source taken out, and its German documents put back."""
    folder, docs = scratch(spark, "index"), documents(spark, sf_dir)
    tongue = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("document_id"), "lang")
    rows = docs.join(tongue, "document_id").select("document_id", "title", "relative_path", "text", "lang", F.col("corpus_id").alias("source"))
    index.write(spark, folder, rows)
    edited = rows.where("lang = 'fr' and source <> 'src3'").withColumn("title", F.lit("edited")).withColumn("text", F.concat(F.lit("of the "), F.coalesce("text", F.lit(""))))
    index.write(spark, folder, edited, rows.where("source = 'src3'"))
    # only what is not there comes in: the German documents of the source
    index.backfill(spark, folder, rows.where("lang = 'de'"))
    index.merge(spark, folder, most=2)
    left = docs.join(tongue, "document_id").where("corpus_id <> 'src3' or lang = 'de'")
    found = index.search(spark, folder, left, '"of the" OR edit* AND le', 20)
    return found.select("rank", "document_id", F.round("score", 6).alias("score"))
