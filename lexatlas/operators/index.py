"""A stored positional index of documents: segments that are only added, tombstones, a numbered pointer to what is current.

Each change writes one segment (tables in its folder) and then the next pointer; readers take the highest whole one, as
for snapshots (sources.files). A segment has
  postings  term, document_id, col, length (tokens of the row), pos; sorted in this order, so that all but pos is stored as runs;
            a folder for each range of terms
  bounds    bucket, first, last: the terms of each range
  rows      document_id, length
A row that is replaced or removed gets a tombstone (segment, document_id). A search reads the bounds, then only the ranges
that its words and beginnings can be in, and leaves out tombstones before it counts anything, so scores equal those of an
index written anew. Ranges part by term and row: a term that every row holds spreads over many.

Rows stay in the index when their document is missing or no longer read; the documents table says what may be shown. So
ST2 is write(upserts), ST3 and the backfill are backfill(), a delete is write(removes). Null columns count as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.distribution import stored
from lexatlas.functions.text import fts_tokens
from lexatlas.operators import fts
from lexatlas.sources.files import _highest

COLUMNS = ("title", "relative_path", "text")
KEY = "document_id"
POINTER = "segments array<struct<name:string,n:long,tokens:long>>, dead array<string>"
#: Segments that a folder keeps; the smallest are merged beyond that.
MOST_SEGMENTS = 8


class Current:
    """What the highest pointer of a folder names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.number = _highest(spark, folder) or 0
        found = spark.read.schema(POINTER).json(f"{folder}/pointers/{self.number:012d}").first() if self.number else None
        self.segments = [(s.name, s.n, s.tokens) for s in found.segments] if found else []
        self.dead = list(found.dead) if found else []

    def part(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/segments/{segment}/{name}")

    def tombstones(self, key_type: str) -> DataFrame:
        if not self.dead:
            return self.spark.createDataFrame([], f"segment string, {KEY} {key_type}")
        return self.spark.read.parquet(*[f"{self.folder}/dead/{d}" for d in self.dead])

    def _alive(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.join(self.tombstones(dict(out.dtypes)[KEY]), ["segment", KEY], "left_anti") if self.dead else out

    def rows(self) -> DataFrame | None:
        """segment, document_id and length of the rows that count; None if there is no segment."""
        return self._alive([self.part(s, "rows").withColumn("segment", F.lit(s)) for s, *_ in self.segments]) if self.segments else None

    def postings(self, wanted: list[str] | None = None, begun: list[str] = (), segments: list[str] | None = None) -> DataFrame | None:
        """Postings that count, of some words and beginnings (None: of all); only their ranges are read."""
        parts = []
        for s, *_ in self.segments:
            if segments is not None and s not in segments:
                continue
            one = self.part(s, "postings").withColumn("segment", F.lit(s))
            if wanted is not None:
                at, last = F.col("first"), F.col("last")
                inside = F.exists(fts_literal(wanted), lambda w: (w >= at) & (w <= last)) | F.exists(fts_literal(begun), lambda w: (w <= last) & ((at <= w) | at.startswith(w)))
                # at most one row for each of a segment's ranges
                ranges = [r.bucket for r in self.part(s, "bounds").where(inside).select("bucket").collect()]
                one = one.where(F.col("bucket").isin(ranges) if ranges else F.lit(False)).where(fts.is_wanted(F.col("term"), list(wanted), list(begun)))
            parts.append(one)
        return self._alive(parts).drop("bucket") if parts else None

    def statistics(self) -> DataFrame:
        """One row: n and mean_length."""
        n, tokens = (sum(s[k] for s in self.segments) for k in (1, 2))
        return self.spark.createDataFrame([(n, tokens / n if n else None)], "n long, mean_length double")


def fts_literal(words):
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _point(current: Current, segments: list[tuple[str, int, int]], dead: list[str]) -> None:
    row = ([s for s in segments if s[1]], dead)
    current.spark.createDataFrame([row], POINTER).coalesce(1).write.json(f"{current.folder}/pointers/{current.number + 1:012d}")


def _write_postings(dealt: DataFrame, place: str) -> None:
    """Postings whose partitions are ranges, sorted and written, and the bounds of the ranges."""
    spark = dealt.sparkSession
    dealt = dealt.select(F.spark_partition_id().alias("bucket"), "term", KEY, "col", "length", "pos")
    dealt.sortWithinPartitions("bucket", "term", KEY, "col", "pos").write.partitionBy("bucket").parquet(f"{place}/postings")
    schema = "term string, bucket int"
    spark.read.schema(schema).parquet(f"{place}/postings").groupBy("bucket").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1).write.parquet(f"{place}/bounds")


def _ranges(spark: SparkSession, ranges: int | None) -> int:
    return ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))


def write(spark: SparkSession, folder: str, upserts: DataFrame | None = None, removes: DataFrame | None = None, ranges: int | None = None) -> None:
    """Index rows (document_id, title, relative_path, text) anew, and take others (document_id) out; both at once, as one step.

    A row that is there already is replaced; ids that are not there are nothing to remove. ValueError if an id comes twice
    in upserts. ranges: into how many ranges of terms the segment is dealt (the session's shuffle partitions).
    """
    current = Current(spark, folder)
    segments, dead = list(current.segments), list(current.dead)
    ids = [x.select(KEY) for x in (upserts, removes) if x is not None]
    if not ids:
        return
    if upserts is not None and not upserts.groupBy(KEY).count().where("count > 1").isEmpty():
        raise ValueError("a document comes twice")
    if segments:
        gone = ids[0] if len(ids) == 1 else ids[0].union(ids[1])
        name = uuid.uuid4().hex
        current.rows().join(gone, KEY, "left_semi").select("segment", KEY, "length").write.parquet(f"{folder}/dead/{name}")
        lost = {r.segment: (r.n, r.tokens) for r in spark.read.parquet(f"{folder}/dead/{name}").groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect()}  # a row a segment
        if lost:
            dead.append(name)
            segments = [(s, n - lost.get(s, (0, 0))[0], t - lost.get(s, (0, 0))[1]) for s, n, t in segments]
    if upserts is not None:
        name = uuid.uuid4().hex
        place = f"{folder}/segments/{name}"
        # texts are read once: the rows, the bounds of the ranges and the postings come from their tokens
        tokens = stored(upserts.select(KEY, *[fts_tokens(F.col(c)).alias(c) for c in COLUMNS]), "tokens")
        sized = tokens.withColumn("length", sum((F.size(c) for c in COLUMNS), F.lit(0)).cast("long"))
        sized.select(KEY, "length").write.parquet(f"{place}/rows")
        each = sized.select(KEY, "length", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("tokens")) for c in COLUMNS])).alias("x"))
        placed = each.select(KEY, "x.col", "length", F.posexplode("x.tokens").alias("pos", "term"))
        _write_postings(placed.repartitionByRange(_ranges(spark, ranges), "term", KEY), place)
        size = spark.read.parquet(f"{place}/rows").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        segments.append((name, size[0], size[1]))
    _point(current, segments, dead)


def backfill(spark: SparkSession, folder: str, documents: DataFrame, **how) -> None:
    """Index those of some documents that the index does not hold; the others stay as they are."""
    held = Current(spark, folder).rows()
    write(spark, folder, documents if held is None else documents.join(held.select(KEY), KEY, "left_anti"), **how)


def unindexed(spark: SparkSession, folder: str, documents: DataFrame) -> DataFrame:
    """document_id of the documents that the index does not hold."""
    held = Current(spark, folder).rows()
    return documents.select(KEY) if held is None else documents.select(KEY).join(held.select(KEY), KEY, "left_anti")


def merge(spark: SparkSession, folder: str, most: int = MOST_SEGMENTS, ranges: int | None = None) -> None:
    """Bring an index to at most `most` segments by merging the smallest ones, without their tombstones and without reading texts."""
    current = Current(spark, folder)
    if len(current.segments) <= max(1, most):
        return
    ordered = sorted(current.segments, key=lambda s: (s[1], s[0]))
    chosen, kept = ordered[: len(ordered) - max(1, most) + 1], ordered[len(ordered) - max(1, most) + 1 :]
    names, name = [s for s, *_ in chosen], uuid.uuid4().hex
    place = f"{folder}/segments/{name}"
    current.rows().where(F.col("segment").isin(names)).select(KEY, "length").write.parquet(f"{place}/rows")
    dealt = current.postings(segments=names).select("term", KEY, "col", "length", "pos").repartitionByRange(_ranges(spark, ranges), "term", KEY)
    _write_postings(dealt, place)
    dead = []
    if current.dead:
        rest, left = uuid.uuid4().hex, spark.read.parquet(*[f"{folder}/dead/{d}" for d in current.dead])
        left.where(~F.col("segment").isin(names)).write.parquet(f"{folder}/dead/{rest}")
        dead = [rest]
    _point(current, [*kept, (name, sum(s[1] for s in chosen), sum(s[2] for s in chosen))], dead)


def discard_old(spark: SparkSession, folder: str) -> None:
    """Delete the segments, tombstones and pointers that the current pointer does not name. No reader may still use them."""
    current = Current(spark, folder)
    keep = {"segments": {s for s, *_ in current.segments}, "dead": set(current.dead), "pointers": {f"{current.number:012d}"}}
    jvm = spark._jvm.org.apache.hadoop.fs
    for name, names in keep.items():
        place = jvm.Path(f"{folder}/{name}")
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in store.listStatus(place) if store.exists(place) else []:
            if status.getPath().getName() not in names:
                store.delete(status.getPath(), True)


def occurrences(current: Current, query: fts.Query) -> DataFrame | None:
    """document_id, length, col, term, pos of the words of a query; None if nothing is indexed."""
    found = current.postings(*fts.words_of(query))
    return None if found is None else found.select(KEY, "length", "col", "term", "pos")


def matches(spark: SparkSession, folder: str, text: str) -> DataFrame | None:
    """document_id and score of every indexed row that a query text matches; None if it has no words or nothing is indexed."""
    query, current = fts.read_query(text, COLUMNS), Current(spark, folder)
    found = None if query is None else occurrences(current, query)
    return None if found is None else fts.ranked(found, current.statistics(), query, KEY)


def search(spark: SparkSession, folder: str, documents: DataFrame, text: str, limit: int = 10, include_missing: bool = False) -> DataFrame:
    """Ranked documents that match a query text: rank, document_id, relative_path, title, score.

    documents: document_id, title, relative_path, status, as they are now.
    """
    scored = matches(spark, folder, text)
    if scored is None:
        return documents.select(F.lit(0).alias("rank"), KEY, "relative_path", "title", F.lit(0.0).alias("score")).where(F.lit(False))
    return fts.best(scored, documents, limit, include_missing, KEY)
