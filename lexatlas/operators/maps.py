"""Maps: their parts put together, saved runs, pair and neighbour views.

A map is three tables: points (document_id, x, y, cluster_id, cluster_label, cluster_signature, top_terms, neighbours),
clusters (cluster_id, signature, generated_label, display_label, source, size, top_terms, representatives) and the
documents that they stand for. Runs keep copies of points and clusters under a run_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.distribution import stored
from lexatlas.functions.ids import stable
from lexatlas.operators import biblio, explain, layout, similarity, tfidf
from lexatlas.operators.library import capped

LIMIT, NEIGHBOURS = 1000, 5


def _gathered(rows: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """key and an array of structs of columns, by rank."""
    found = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("_all"))
    return found.select(key, F.transform("_all", lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))


def label_clusters(docs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Clusters with signature, generated and display label, source, size, top terms and representatives.

    docs: cluster_id, doc_id, text, and title and relative_path if it has them. A cluster without informative terms is called by its id.
    """
    terms = _gathered(stored(explain.cluster_terms(docs), "terms"), "cluster_id", "top_terms", "term", "score")
    words = terms.select("cluster_id", F.transform("top_terms", lambda t: t["term"]).alias("terms"))
    shown = _gathered(explain.representatives(docs, words), "cluster_id", "representatives", "doc_id", "score")
    label = F.array_join(F.slice(F.transform("top_terms", lambda t: t["term"]), 1, 3), " / ")
    out = explain.signatures(docs).join(terms, "cluster_id", "left").join(shown, "cluster_id", "left")
    out = out.withColumn("label", F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))))
    if overrides is None:
        return out.withColumnRenamed("label", "generated_label").withColumn("display_label", F.col("generated_label")).withColumn("source", F.lit("generated"))
    return explain.apply_overrides(out, overrides).withColumnRenamed("label", "generated_label")


def fallback_labels(docs: DataFrame, simple: DataFrame) -> DataFrame:
    """Clusters (docs: cluster_id, doc_id) with their simple label (cluster_id, label), or "Cluster n", and their first three documents."""
    first = docs.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("doc_id"))).where("rank <= 3")
    out = explain.signatures(docs).join(simple, "cluster_id", "left").join(_gathered(first, "cluster_id", "representatives", "doc_id"), "cluster_id")
    name = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
    return out.select("cluster_id", "size", "signature", name.alias("generated_label"), name.alias("display_label"), F.lit("generated").alias("source"), "representatives")


def points(docs: DataFrame, weighted: DataFrame, coordinates: DataFrame, assigned: DataFrame, clusters: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """A row for each document (doc_id): its place, cluster, neighbours and top terms; documents without terms have empty lists.

    weighted has terms, or codes (those of terms that documents share are enough), and then top terms are looked up in the texts.
    """
    near = _gathered(tfidf.neighbours(docs, weighted, neighbours), "doc_id", "neighbours", "neighbour", "score")
    ranked = tfidf.best_terms(docs) if "code" in weighted.columns else tfidf.top_terms(weighted)
    terms = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select("doc_id", F.transform("t", lambda x: x["term"]).alias("top_terms"))
    names = clusters.select("cluster_id", F.col("display_label").alias("cluster_label"), F.col("signature").alias("cluster_signature"))
    out = docs.select("doc_id").join(coordinates, "doc_id", "left").join(assigned, "doc_id", "left").join(names, "cluster_id", "left").join(near, "doc_id", "left").join(terms, "doc_id", "left")
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | F.col(c).isNull(), 0.0).otherwise(F.col(c)).alias(c)
    return out.select("doc_id", finite("x"), finite("y"), "cluster_id", "cluster_label", "cluster_signature", F.coalesce("top_terms", F.array().cast("array<string>")).alias("top_terms"), "neighbours")


def build(docs: DataFrame, overrides: DataFrame | None = None, limit: int = LIMIT, neighbours: int = NEIGHBOURS, seed: int = 42, clusters: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(points, clusters, warnings) of the first documents by path (doc_id, relative_path, text, perhaps title; at most limit: a map's cap)."""
    shown, warnings = capped(docs, "relative_path", limit=limit, what="documents")
    if shown.isEmpty():
        warnings.append("no active indexed documents")
    weighted = tfidf.weights(shown)
    assigned = layout.kmeans(shown, weighted, requested=clusters, seed=seed)
    labelled = label_clusters(shown.join(assigned, "doc_id"), overrides)
    return points(shown, weighted, layout.layout(weighted, shown), assigned, labelled, neighbours), labelled, warnings


def legend(points_rows: DataFrame) -> DataFrame:
    """cluster_id, label and how many points it has."""
    return points_rows.groupBy("cluster_id", "cluster_label").agg(F.count("*").alias("points"))


def set_signature(documents: DataFrame, **parameters) -> DataFrame:
    """One row: a digest of (document_id, updated_at, char_count) of all documents and of the parameters, whatever their order.

    Rows are hashed on the executors and folded in ranges of their hashes, so no task holds the ids of all.
    """
    row = F.sha2(F.concat_ws("\0", F.col("document_id").cast("string"), F.coalesce(F.col("updated_at").cast("string"), F.lit("")), F.coalesce(F.col("char_count").cast("string"), F.lit("0"))), 256)
    ranges = documents.select(row.alias("h")).groupBy(F.substring("h", 1, 4).alias("r")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    folded = ranges.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), ",").alias("all"))
    return folded.select(F.sha2(F.concat_ws("\0", F.lit(repr(sorted(parameters.items()))), "all"), 256).alias("set_signature"))


def run_id(name: Column, signature: Column, stamp: Column) -> Column:
    return stable("map_run_", name, signature, stamp)


def saved_run(name: str, points_rows: DataFrame, clusters: DataFrame, signature: str, stamp: str, warnings: list[str], mode: str = "tfidf") -> dict[str, DataFrame]:
    """The rows that a saved map adds to map_runs, map_points and map_clusters; ValueError for a mode other than tfidf."""
    if mode != "tfidf":
        raise ValueError("only tfidf maps are saved")
    spark = points_rows.sparkSession
    counts = points_rows.agg(F.countDistinct("doc_id").alias("document_count"), F.countDistinct("cluster_id").alias("cluster_count"))
    header = counts.withColumn("run_id", run_id(F.lit(name), F.lit(signature), F.lit(stamp))).withColumns({"name": F.lit(name), "set_signature": F.lit(signature), "created_at": F.lit(stamp), "warnings": F.array(*map(F.lit, warnings)).cast("array<string>")})
    key = spark.range(1).select(run_id(F.lit(name), F.lit(signature), F.lit(stamp)).alias("run_id"))
    own = lambda rows: rows.crossJoin(F.broadcast(key))  # noqa: E731  one row
    return {"map_runs": header, "map_points": own(points_rows), "map_clusters": own(clusters)}


def list_runs(runs: DataFrame, limit: int = 100) -> DataFrame:
    """Newest first; ties by name, then by id."""
    return runs.orderBy(F.desc("created_at"), "name", "run_id").limit(max(0, limit))


def run_documents(map_points: DataFrame, documents: DataFrame, run: str) -> DataFrame:
    """A run's points with their present documents (null where gone)."""
    own = map_points.where(F.col("run_id") == run)
    return own.join(documents.select(F.col("document_id").alias("doc_id"), "relative_path", "status"), "doc_id", "left")


def missing_points(placed: DataFrame) -> list[str]:
    """The warning about points whose document is gone."""
    gone = placed.where("status is null").count()
    return [f"{gone} saved map point(s) no longer match a current document"] if gone else []


def delete_run(tables: dict[str, DataFrame], run: str) -> dict[str, DataFrame]:
    """map_runs, map_points and map_clusters without a run."""
    return {name: rows.where(F.col("run_id") != run) if name in ("map_runs", "map_points", "map_clusters") else rows for name, rows in tables.items()}


def nearest_pairs(neighbour_rows: DataFrame, limit: int) -> DataFrame:
    """The first distinct pairs (source, target) of neighbour lists (doc_id, rank, neighbour), read document by document."""
    first = neighbour_rows.groupBy(F.least("doc_id", "neighbour").alias("a"), F.greatest("doc_id", "neighbour").alias("b")).agg(F.min(F.struct("doc_id", "rank", "neighbour")).alias("m"))
    return first.orderBy("m.doc_id", "m.rank").limit(max(0, limit)).select(F.col("m.doc_id").alias("source"), F.col("m.neighbour").alias("target"))


def first_pairs(docs: DataFrame, limit: int, neighbours: int = NEIGHBOURS) -> DataFrame:
    """nearest_pairs() of all neighbour lists, from those that it reads: the first documents' by doc_id.

    A pair is in two lists at most, so the lists of m documents hold m * neighbours / 2 pairs; where lists are shorter, all documents are among the first.
    """
    own = max(-(-2 * max(0, limit) // neighbours), neighbours + 1)
    first = [r.doc_id for r in docs.select("doc_id").where("doc_id is not null").orderBy("doc_id").limit(own).collect()]
    return nearest_pairs(tfidf.lists_of(docs, first, neighbours), limit)


def reading_run_id(name: Column, signature: Column, **parameters) -> Column:
    """Of a reading map: the same for the same name, documents and parameters, so that building it again replaces it."""
    return stable("map_run_", name, signature, F.lit(repr(sorted(parameters.items()))))


def reading_map(items: DataFrame, tags: DataFrame, memberships: DataFrame, collections: DataFrame, links: DataFrame, documents: DataFrame, texts: DataFrame, status: str | None = None, collection: str | None = None, tag: str | None = None, **options) -> tuple[DataFrame, DataFrame, list[str]]:
    """build() over the active documents of the items that pass the filters."""
    chosen = biblio.chosen_items(items, tags, memberships, collections, status, collection, tag)
    found = biblio.reading_documents(chosen, links, documents, texts, options.get("limit", LIMIT))
    return build(found.select(F.col("document_id").alias("doc_id"), "relative_path", "text").dropDuplicates(["doc_id"]), **options)


def scan_map(scanned: DataFrame, min_chars: int = 80, **options) -> tuple[DataFrame, DataFrame, list[str], DataFrame]:
    """A map straight from a scan's rows (document_id, relative_path, text, skip_reason), nothing stored: build()'s three and the skipped files."""
    short = F.length("text") < min_chars
    skipped = scanned.where(F.col("skip_reason").isNotNull() | short).select("relative_path", F.coalesce("skip_reason", F.lit("text is too short")).alias("reason"))
    kept = scanned.where(F.col("skip_reason").isNull() & ~short)
    place = kept.select("relative_path", "text", F.conv(F.substring(F.sha2(F.concat_ws("\0", "relative_path", "text"), 256), 1, 15), 16, 10).cast("long").alias("doc_id"))
    return *build(place, **options), skipped


def explain_pairs(pairs: DataFrame) -> DataFrame:
    """pair_id, lexical_score, shared_terms, chunk_matches and warnings; pairs: pair_id, side (source or target), text."""
    terms = _gathered(explain.shared_terms(pairs), "pair_id", "shared_terms", "term", "score")
    chunks = _gathered(explain.chunk_matches(pairs), "pair_id", "chunk_matches", "source_chunk", "target_chunk", "score")
    out = pairs.select("pair_id").distinct().join(explain.pair_scores(pairs), "pair_id", "left").join(terms, "pair_id", "left").join(chunks, "pair_id", "left").fillna(0.0, ["lexical_score"])
    missing = F.filter(F.array(F.when(F.col("shared_terms").isNull(), "no shared terms"), F.when(F.col("chunk_matches").isNull(), "no matching chunks")), lambda w: w.isNotNull())
    return out.withColumn("warnings", missing)


def compare_neighbours(lexical: DataFrame, dense: DataFrame, limit: int = 10) -> DataFrame:
    """mode (tfidf, dense, hybrid), rank, doc_id, score: three rankings of scored documents (doc_id, score); ties by doc_id."""
    ranked = lambda rows, mode: rows.select(F.lit(mode).alias("mode"), "doc_id", F.round("score", 9).alias("s")).orderBy(F.desc("s"), "doc_id").limit(max(0, limit))
    hybrid = similarity.hybrid(lexical, dense, limit).select(F.lit("hybrid").alias("mode"), "rank", "doc_id", "score")
    single = ranked(lexical, "tfidf").union(ranked(dense, "dense"))
    return single.select("mode", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("s"), "doc_id")).alias("rank"), "doc_id", F.round("s", 4).alias("score")).union(hybrid)
