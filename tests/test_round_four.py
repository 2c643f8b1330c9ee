"""Findings of the third round: whole results from less work, against plain computations."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexatlas import distribution
from lexatlas.functions import text as T
from lexatlas.operators import explain, maps, similarity, tfidf


@pytest.fixture(scope="module")
def odd(spark, small_dir):
    """Documents with copies, empty texts and texts without terms."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 60")
    more = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "the of", "xx"), (-4, "lone zebra", None)], "doc_id long, text string, lang string")
    return docs.union(docs.where("doc_id < 4").withColumn("doc_id", F.col("doc_id") + 1000)).union(more).cache()


def test_stored_tables_leave_no_shuffle_files(spark):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = held()
    kept = distribution.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before
    assert kept.count() == 7 and spark.conf.get(distribution.CLEANUP, None) in (None, "false")


def test_workers_look_at_bounded_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([[1] * 3, [2] * 9, [], [3] * 2, [4] * 2, [5]])], ["k", "v"])
    parts = list(tfidf.slices(batch, 1, 5))
    assert [p.column(0).to_pylist() for p in parts] == [[0], [1], [2, 3, 4, 5]]
    assert [p.column(0).to_pylist() for p in tfidf.slices(batch.slice(2), 1, 4)] == [[2, 3, 4], [5]]


def test_similar_documents_of_one(odd):
    rows = tfidf.weights(odd).collect()
    own = {r.term: r.weight for r in rows if r.doc_id == 2}
    want = {}
    for r in rows:
        if r.term in own and r.doc_id != 2:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.weight * own[r.term]
    got = {r.doc_id: r.score for r in tfidf.similar_to(odd, 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert tfidf.similar_to(odd, -1).count() == 0


def test_first_pairs_read_the_first_lists_only(odd, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    every = tfidf.neighbours(odd, tfidf.weights(odd), 5)
    wanted = rows(maps.nearest_pairs(every, 15))
    lists = rows(every.where(F.col("doc_id").isin(-4, -1, 3, 1003)))
    monkeypatch.setattr(tfidf, "neighbours", None)
    assert rows(maps.first_pairs(odd, 15)) == wanted
    assert rows(tfidf.lists_of(odd, [-4, -1, 3, 1003], 5)) == lists
    few = odd.where("doc_id < 2 and doc_id > -3")
    assert maps.first_pairs(few, 15).count() == 6 and maps.first_pairs(few, 1).count() == 1


def test_simple_labels_by_codes(odd):
    clusters = odd.select("doc_id", F.col("lang").alias("cluster_id"))
    assert sorted(map(repr, explain.simple_labels_of(odd, clusters).collect())) == sorted(map(repr, explain.simple_labels(tfidf.weights(odd), clusters).collect()))


def test_terms_are_counted_before_they_are_shuffled(spark, odd):
    texts = ["data model 12a3 a1", "results results zz", "x-ray a_1 ab-c9 the-end", "figure table figure table alpha", None, ""]
    docs = spark.createDataFrame([(k % 3 or None, t) for k, t in enumerate(texts)], "cluster_id int, text string").union(odd.select(F.lit(7), "text"))
    words = T.terms(F.col("text"), T.LABEL_TOKEN, T.stop_words())
    want = docs.select("cluster_id", F.explode(words).alias("term")).groupBy("cluster_id", "term").agg(T.informative(F.first("term")).alias("telling"), F.count("*").alias("tf"))
    assert sorted(map(repr, explain._term_counts(docs, "cluster_id").select("cluster_id", "term", "telling", "tf").collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("block, side", [(16, 2), (2048, 16), (7, 1)])
def test_nearest_with_ties_and_odd_vectors(spark, block, side):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 8)).astype(np.float32)
    m[10:40], m[50], m[60:63] = m[0], 0, m[61] * (1 + 1e-7)
    m[70, 3] = np.nan
    ids = rng.permutation(1000)[:120]
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)], "vec_id long, embedding array<float>")
    unit = m.astype(np.float64)
    unit /= np.where((n := np.linalg.norm(unit, axis=1, keepdims=True)) > 0, n, 1)
    scores = np.round(unit @ unit.T, 9)
    want = {}
    for a in range(120):
        near = sorted((-scores[a, b], ids[b]) for b in range(120) if b != a and np.isfinite(scores[a, b]))[:5]
        want |= {(int(ids[a]), n + 1): int(i) for n, (_, i) in enumerate(near)}
    got = {(r.vec_id, r["rank"]): r.neighbour for r in similarity.nearest(rows, 5, block=block, side=side).collect()}
    assert got == want
    many = similarity._Best(np.arange(3000), 2)
    same = np.ones((3000, 2)) / np.sqrt(2)
    similarity._meet(many, same, slice(0, 3000), many, same, slice(0, 3000), True)
    assert many.other[:4].tolist() == [[1, 2], [0, 2], [0, 1], [0, 1]]


def test_neighbours_in_waves(odd, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()))
    at_once = rows(tfidf.neighbours(odd, tfidf.weights(odd), 5))
    monkeypatch.setattr(tfidf, "STRIPE", 2)
    met = []
    waves = tfidf._waves
    monkeypatch.setattr(tfidf, "_waves", lambda vectors, n, *rest: met.append(n) or waves(vectors, n, *rest))
    assert rows(tfidf.neighbours(odd, tfidf.coded_weights(odd, shared=True), 5, block=6, side=2)) == at_once
    assert met and met[0] > 2


def test_points_of_coded_weights(odd):
    none = odd.where("false").select("doc_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    names = odd.select(F.col("lang").alias("cluster_id"), F.col("lang").alias("display_label"), F.col("lang").alias("signature")).distinct()
    put = lambda weighted: sorted(map(repr, maps.points(odd, weighted, none, odd.select("doc_id", F.col("lang").alias("cluster_id")), names).collect()))
    assert put(tfidf.coded_weights(odd, shared=True)) == put(tfidf.weights(odd))


def test_turns_of_the_layout_leave_one_table(spark, odd, monkeypatch):
    from lexatlas.operators import layout

    made, gone = [], []
    put, drop = layout.stored, layout.discard
    monkeypatch.setattr(layout, "stored", lambda df, name, *by: made.append(name) or put(df, name, *by))
    monkeypatch.setattr(layout, "discard", lambda *frames: gone.extend(f for f in frames if f is not None) or drop(*frames))
    docs = odd.where("doc_id < 20")
    assert layout.layout(tfidf.coded_weights(docs), docs).count() == docs.count()
    assert len(made) - len(gone) == 2  # the last image and the components
    held = len(made)
    gone.clear()
    assert layout.kmeans(docs, tfidf.coded_weights(docs)).count() == docs.count()
    assert len(gone) >= made[held:].count("placed") - 1 > 0
