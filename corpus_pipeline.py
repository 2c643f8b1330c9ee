"""The corpus pipeline: quality classifier, near-dedup, suffix-array dedup, secret scans, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs that have a doc_id; all but the last return the
columns of documents, and no others: extra columns of docs, whatever their names, are not read. run() applies them in
order to the documents table, each result written and read again; a result goes when the next one is written.

Null and empty texts: the classifier scores them as texts without features (they go if that score is under the threshold),
near-dedup keeps them, the others leave them as they are, and packing gives each its end id. Rows equal in doc_id and text
count once from near-dedup on. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm import near_dedup, packing, quality_classifier, runtime, secret_scan, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Similarity in hundredths from which the near-dedup stage links; 85 belongs to op1's own contract.
STAGE_SIMILAR = 80


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of training rows among docs, does not reject."""
    docs = docs.select(*COLUMNS).where("doc_id is not null")
    model, prior = quality_classifier.fit(docs, runtime.table(spark, sf_dir, "labels"))
    return quality_classifier.keep(docs, model, prior)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (linked from STAGE_SIMILAR): the one with the smallest doc_id.

    Of rows equal in doc_id and text one stays. Different texts under one doc_id are documents of their own, in the
    order of their texts.
    """
    docs = docs.select(*COLUMNS).where("doc_id is not null")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        numbered = docs.withColumn("_id", F.col("doc_id"))
    else:
        # numbers that rise with doc_id and text
        numbered = runtime.stored(docs.dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text").withColumn("_id", F.monotonically_increasing_id()), "numbered")
    found = near_dedup.near_duplicates(numbered.select(F.col("_id").alias("doc_id"), "text"), similar=STAGE_SIMILAR)
    kept = found.where("kept").select(F.col("doc_id").alias("_id"))
    return numbered.join(kept.hint("merge"), "_id", "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the characters of strings of 100 bytes or more that occur earlier."""
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), 100, as_text=True)
    return _measured(cut.select("doc_id", F.col("kept").cast("string").alias("text"), "rest.lang", "rest.source", "rest.n_chars"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with found secrets replaced by a mark."""
    return _measured(secret_scan.redact_secrets(docs.select(*COLUMNS)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids, packed into sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_duplicates), ("suffix_dedup", repeats), ("secret_scan", secrets), ("best_fit_packing", packed)]

#: The classifier and the tokenizer have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        written = runtime.stored(out, name)
        runtime.discard(docs)
        docs = written
    return docs
