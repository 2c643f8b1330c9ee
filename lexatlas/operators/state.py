"""Document state across scans: snapshot merge, keyed upserts, child replacement, statistics, integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.functions.ids import report_id

MIN_CHARS = 80


def classify(old: DataFrame, scan: DataFrame, min_chars: int = MIN_CHARS, force: bool = False) -> DataFrame:
    """Full outer merge of the last snapshot with a scan on (corpus_id, relative_path): branch, counter and next status.

    old: corpus_id, relative_path, sha256, status, fingerprint. scan: corpus_id, relative_path, sha256, fingerprint,
    skip_reason (null: extracted), char_count. Columns of the result carry old_ and new_ in front of the sides' names.
    """
    keys = ["corpus_id", "relative_path"]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in keys], F.lit(True).alias("was"))
    b = scan.select(*keys, *[F.col(c).alias(f"new_{c}") for c in scan.columns if c not in keys], F.lit(True).alias("seen"))
    both = a.join(b, keys, "full_outer").withColumn("was", F.coalesce("was", F.lit(False))).withColumn("seen", F.coalesce("seen", F.lit(False)))
    same = F.col("was") & (F.col("old_sha256") == F.col("new_sha256")) & F.col("old_status").isin("active", "missing") & (F.col("old_fingerprint") == F.col("new_fingerprint")) & ~F.lit(force)
    branch = (
        F.when(~F.col("seen") & (F.col("old_status") == "active"), "missing")
        .when(~F.col("seen"), "kept")
        .when(same, "unchanged")
        .when(F.col("new_skip_reason").isNotNull(), "skipped")
        .when(F.col("new_char_count") < min_chars, "low_text")
        .when(F.col("was"), "updated")
        .otherwise("inserted")
    )
    status = (
        F.when(F.col("branch") == "missing", "missing")
        .when(F.col("branch") == "kept", F.col("old_status"))
        .when(F.col("branch").isin("skipped", "low_text"), F.when(F.col("was"), "unindexed"))
        .otherwise("active")
    )
    return both.withColumn("branch", branch).withColumn("status", status)


def counters(classified: DataFrame) -> DataFrame:
    """One row of run counters."""
    count = lambda *b: F.count_if(F.col("branch").isin(*b))
    return classified.agg(
        F.count_if("seen").alias("files_seen"), count("inserted").alias("inserted"), count("updated").alias("updated"), count("unchanged").alias("unchanged"),
        count("skipped", "low_text").alias("skipped"), count("low_text").alias("low_text"), count("missing").alias("missing"),
    )


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Next rows of a keyed table: new rows win, columns in keep (created_at, first_seen_at) stay as they were first."""
    kept = old.select(*keys, *[F.col(c).alias(f"_first_{c}") for c in keep])
    fresh = new.join(kept, keys, "left").select(*[F.coalesce(f"_first_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(new.select(*keys), keys, "left_anti").unionByName(fresh.select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: str, keys: list[str], parents: DataFrame | None = None) -> DataFrame:
    """Child rows of parents that came anew are replaced as sets; parents: those that came, if some may have no child."""
    came = (parents if parents is not None else new).select(parent).distinct()
    return old.join(came, parent, "left_anti").unionByName(new.dropDuplicates(keys).select(*old.columns))


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The last row of each key in an order that names every tie-breaker."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def list_documents(docs: DataFrame, statuses: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    chosen = docs.where(F.col("status").isin(statuses)) if statuses else docs
    return chosen.orderBy("relative_path").offset(max(0, offset)).limit(max(0, limit))


def by_id_or_path(docs: DataFrame, ref: str) -> DataFrame:
    """One document by id or path; the id wins."""
    found = docs.where((F.col("document_id") == ref) | (F.col("relative_path") == ref))
    return found.orderBy(F.when(F.col("document_id") == ref, 0).otherwise(1), "document_id").limit(1)


def statistics(docs: DataFrame) -> DataFrame:
    """Counts by status and the characters of active documents, in one pass."""
    is_ = lambda s: F.col("status") == s
    return docs.agg(
        F.count("*").alias("documents"), F.count_if(is_("active")).alias("active"), F.count_if(is_("missing")).alias("missing"), F.count_if(is_("unindexed")).alias("unindexed"),
        F.coalesce(F.sum(F.when(is_("active"), F.col("char_count"))), F.lit(0)).cast("long").alias("total_chars"),
    )


def histogram(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Counts over a fixed domain, zero where a value does not occur."""
    every = rows.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dangling(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, code: str) -> DataFrame:
    """code and number of children (null keys aside) without a parent."""
    named = children.where(F.col(child_key).isNotNull()).select(F.col(child_key).alias("_key"))
    return named.join(parents.select(F.col(parent_key).alias("_key")), "_key", "left_anti").agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), "n")


def run_consistency(runs: DataFrame, points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Runs whose stored counts differ from their distinct points or clusters; both are counted before they are joined."""
    p = points.groupBy("run_id").agg(F.countDistinct("document_id").alias("points"))
    c = clusters.groupBy("run_id").agg(F.countDistinct("cluster_id").alias("clusters"))
    both = runs.join(p, "run_id", "left").join(c, "run_id", "left").fillna(0, ["points", "clusters"])
    return both.where((F.col("points") != F.col("document_count")) | (F.col("clusters") != F.col("cluster_count"))).select("run_id", "document_count", "points", "cluster_count", "clusters")


def skip_status(path, reason):
    """How a file that was not read is reported: OCR lacking for an image, a failure, or skipped."""
    image = F.lower(path).rlike(r"\.(png|jpg|jpeg|webp|tif|tiff)$")
    return F.when(image & F.contains(reason, F.lit("OCR")), "ocr_unavailable").when(F.contains(F.lower(reason), F.lit("failed")), "failed").otherwise("skipped")


def skip_method(path):
    """The reader that a skipped file was meant for."""
    lower = F.lower(path)
    return F.when(lower.rlike(r"\.(png|jpg|jpeg|webp|tif|tiff)$"), "image-ocr-tesseract").when(lower.rlike(r"\.pdf$"), "pdf-pypdf").otherwise("unknown")


def next_documents(classified: DataFrame, now: str) -> DataFrame:
    """The documents table after a run: classified must also carry old_ and new_ text, and old_ first_seen_at, last_seen_at, updated_at.

    A touched document keeps its text and updated_at; one that is no longer read keeps its text but takes the file's hash;
    a missing one keeps all but its status; new and changed ones take everything of the scan. Skipped new files have no row.
    """
    b = F.col("branch")
    fresh, seen = b.isin("inserted", "updated"), b.isin("inserted", "updated", "unchanged", "skipped", "low_text")
    take = lambda c: F.when(fresh, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}"))
    return classified.where(~(b.isin("skipped", "low_text") & ~F.col("was"))).select(
        "corpus_id", "relative_path", "status", F.when(fresh | b.isin("skipped", "low_text"), F.col("new_sha256")).otherwise(F.col("old_sha256")).alias("sha256"),
        take("text").alias("text"), F.coalesce("old_first_seen_at", F.lit(now)).alias("first_seen_at"), F.when(seen, F.lit(now)).otherwise(F.col("old_last_seen_at")).alias("last_seen_at"),
        F.when(b.isin("unchanged", "kept"), F.col("old_updated_at")).otherwise(F.lit(now)).alias("updated_at"),
    )


def reports(classified: DataFrame, run_id: str) -> DataFrame:
    """One report row for each file that a run saw: status and method. classified carries new_method."""
    b = F.col("branch")
    status = F.when(b.isin("inserted", "updated", "unchanged"), "extracted").when(b == "low_text", "unindexed").otherwise(skip_status(F.col("relative_path"), F.col("new_skip_reason")))
    method = F.when(b == "unchanged", "unchanged").when(b == "skipped", skip_method(F.col("relative_path"))).otherwise(F.col("new_method"))
    seen = classified.where("seen").withColumn("report_status", status)
    return seen.select(report_id(F.lit(run_id), F.col("relative_path"), F.col("report_status")).alias("report_id"), F.lit(run_id).alias("run_id"), "relative_path", F.col("report_status").alias("status"), method.alias("method"), F.col("new_skip_reason").alias("reason"))


def run_row(classified: DataFrame, chunks: DataFrame, run_id: str, started: str, finished: str) -> DataFrame:
    """The finished run with all its counters; chunks: the rows of chunks that the run wrote."""
    written = chunks.agg(F.count("*").alias("chunks_indexed"), F.coalesce(F.sum("char_count"), F.lit(0)).cast("long").alias("characters_indexed"))
    b = F.col("branch")
    counted = counters(classified).crossJoin(F.broadcast(written)).crossJoin(  # one row each
        F.broadcast(classified.agg(F.count_if(b.isin("skipped", "low_text")).alias("warnings"), F.count_if(F.col("status") == "active").alias("active_documents"), F.count_if(b.isin("inserted", "updated")).alias("extracted"), F.count_if((b == "skipped") & F.col("was")).alias("unindexed")))
    )
    return counted.select(F.lit(run_id).alias("run_id"), F.lit(started).alias("started_at"), F.lit(finished).alias("finished_at"), F.lit("completed").alias("run_status"), "*")
