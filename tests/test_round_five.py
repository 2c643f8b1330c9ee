"""Findings of the fourth round: packed blocks of terms, against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.operators import explain, layout, layout_blocks, tfidf


@pytest.fixture(scope="module")
def odd(spark, small_dir):
    """Documents with copies, empty texts and texts without terms."""
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 60")
    more = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "the of", "xx"), (-4, "lone zebra", None), (-5, "results", "yy")], "doc_id long, text string, lang string")
    return docs.union(docs.where("doc_id < 4").selectExpr("doc_id + 1000", "text", "lang")).union(more).cache()


def test_layout_by_packed_blocks(odd, monkeypatch):
    monkeypatch.setattr(layout, "_product", None)  # no row of a sum for each term
    monkeypatch.setattr(tfidf, "GROUP", 4096)
    monkeypatch.setattr(layout_blocks, "MOST_COLUMNS", 20)
    weights = {}
    for r in tfidf.coded_weights(odd).collect():
        weights.setdefault(r.doc_id, {})[r.code] = r.weight
    ids = sorted(r.doc_id for r in odd.select("doc_id").collect())
    codes = {c: k for k, c in enumerate(sorted(set().union(*weights.values())))}
    dense = np.zeros((len(ids), len(codes)))
    for n, i in enumerate(ids):
        for c, w in weights.get(i, {}).items():
            dense[n, codes[c]] = w
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    want = u[:, :2] * s[:2]
    want *= np.sign(want[np.abs(want).argmax(axis=0), [0, 1]])
    want = 2 * (want - want.min(axis=0)) / (want.max(axis=0) - want.min(axis=0)) - 1
    got = {r.doc_id: (r.x, r.y) for r in layout.layout_of(odd).collect()}
    assert sorted(got) == ids
    assert np.abs(np.array([got[i] for i in ids]) - want).max() < 1e-4


@pytest.mark.parametrize("texts", [[], ["one word"], ["one word", "two words"], ["word", "word", None, "word"], ["red apple", "red apple", "red apple", None], ["a b", "b c", "c", ""], ["red", "blue", "green"]])
def test_layout_of_few_texts(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    place = lambda rows: {r.doc_id: (round(r.x, 6), round(r.y, 6)) for r in rows.collect()}
    if texts[:1] == ["red"]:  # any two of three equal values
        assert sorted(place(layout.layout_of(docs))) == [0, 1, 2]
    else:
        assert place(layout.layout_of(docs)) == place(layout.layout(tfidf.coded_weights(docs), docs))


def test_labels_meet_their_counts_once(spark, odd, monkeypatch):
    docs = odd.select("lang", "text").union(spark.createDataFrame([("zz", "bb cat-1 aa dog 12 a1b"), ("zz", "dog dog data"), ("one", "zebra")], "lang string, text string")).withColumnRenamed("lang", "cluster_id")
    counts = explain._term_counts(docs, "cluster_id")
    n = docs.select("cluster_id").distinct().count()
    raw = counts.withColumn("raw", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.count("*").over(Window.partitionBy("term")))) + 1))
    norms = raw.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    scored = raw.where("telling").join(norms, "cluster_id").withColumn("score", F.round(F.col("raw") / F.col("norm"), 9))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "term")
    want = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 6").select("cluster_id", "rank", "term", F.round("score", 4))
    want = sorted(map(tuple, want.collect()))
    monkeypatch.setattr(explain, "_term_counts", None)  # no row for each term of a batch
    monkeypatch.setattr(explain, "WORDS", 500)
    monkeypatch.setattr(explain, "RANGE", 2048)
    assert sorted(map(tuple, explain.cluster_terms(docs).collect())) == want
    assert explain.cluster_terms(docs.where("false")).count() == 0


def test_top_terms_meet_their_counts_in_groups(spark, odd, monkeypatch):
    docs = odd.union(spark.createDataFrame([(-6, "ab abc ab_ abc1 ab é zz", "en"), (-7, "ab abc ab abc", "en")], "doc_id long, text string, lang string"))
    rows = lambda df: sorted((r.doc_id, r["rank"], r.term, round(r.weight, 12)) for r in df.collect())
    want = rows(tfidf.top_terms(tfidf.weights(docs), 5))
    monkeypatch.setattr(tfidf, "coded_weights", None)  # no row for each term of a text
    monkeypatch.setattr(tfidf, "GROUP", 2048)
    monkeypatch.setattr(tfidf, "WORDS", 300)
    assert rows(tfidf.best_terms(docs, 5)) == want
    assert tfidf.best_terms(docs.where("false")).count() == 0
