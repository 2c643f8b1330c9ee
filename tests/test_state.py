"""Snapshot merges, keyed tables, bibliography, vectors, layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.functions import ids, vectors
from lexatlas.operators import biblio, explain, layout, similarity, state, tfidf
from lexatlas.sources import files


def test_transitions(spark):
    old = spark.createDataFrame([("c", p, "s", st, "f") for p, st in (("same", "active"), ("back", "missing"), ("un", "unindexed"), ("gone", "active"), ("gone_un", "unindexed"), ("skip", "active"), ("short", "active"), ("new_f", "active"))], "corpus_id string, relative_path string, sha256 string, status string, fingerprint string")
    scan = spark.createDataFrame(
        [("c", "same", "s", "f", None, 100), ("c", "back", "s", "f", None, 100), ("c", "un", "s", "f", None, 100), ("c", "skip", "t", "f", "why", 0), ("c", "short", "t", "f", None, 5), ("c", "new_f", "s", "g", None, 100), ("c", "fresh", "s", "f", None, 100), ("c", "fresh_skip", "s", "f", "why", 0)],
        "corpus_id string, relative_path string, sha256 string, fingerprint string, skip_reason string, char_count long",
    )
    got = {r.relative_path: (r.branch, r.status) for r in state.classify(old, scan).collect()}
    assert got == {
        "same": ("unchanged", "active"), "back": ("unchanged", "active"), "un": ("updated", "active"), "gone": ("missing", "missing"), "gone_un": ("kept", "unindexed"), "skip": ("skipped", "unindexed"),
        "short": ("low_text", "unindexed"), "new_f": ("updated", "active"), "fresh": ("inserted", "active"), "fresh_skip": ("skipped", None),
    }
    assert {r.branch for r in state.classify(old, scan, force=True).where("relative_path = 'same'").collect()} == {"updated"}


def test_upsert_children_delete(spark):
    old = spark.createDataFrame([(1, "t0", "a"), (2, "t0", "b")], "id long, created_at string, v string")
    new = spark.createDataFrame([(2, "t1", "B"), (3, "t1", "C")], "id long, created_at string, v string")
    out = state.upsert(old, new, ["id"], ("created_at",))
    assert sorted(map(tuple, out.collect())) == [(1, "t0", "a"), (2, "t0", "B"), (3, "t1", "C")]
    assert sorted(map(tuple, state.upsert(out, new, ["id"], ("created_at",)).collect())) == sorted(map(tuple, out.collect()))
    kids = state.replace_children(spark.createDataFrame([(1, "x"), (2, "y")], "id long, tag string"), spark.createDataFrame([(2, "z"), (2, "z")], "id long, tag string"), "id", ["id", "tag"])
    assert sorted(map(tuple, kids.collect())) == [(1, "x"), (2, "z")]
    assert state.delete(old, new, ["id"]).count() == 1


def test_scan_and_snapshot(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, body in (("a.txt", "plain text " * 12), ("sub/b.md", "# Head\n\nbody " * 9), ("c.tex", "\\title{T} words " * 9), (".hidden/x.txt", "no"), ("build/y.txt", "no"), ("z.pdf", "x"), ("n.csv", "1,2")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    got = {r.relative_path: r for r in files.scan(spark, str(root)).collect()}
    assert sorted(got) == ["a.txt", "build/y.txt", "c.tex", "sub/b.md", "z.pdf"]
    assert got["sub/b.md"].title == "Head" and got["c.tex"].title == "T" and got["z.pdf"].skip_reason
    files.publish({"documents": spark.range(3).toDF("id")}, str(tmp_path / "snap"))
    files.publish({"documents": spark.range(5).toDF("id")}, str(tmp_path / "snap"))
    assert files.current(spark, str(tmp_path / "snap"))["documents"].count() == 5


def test_stream(spark, tmp_path):
    from lexatlas.streaming.incremental import stream_documents

    source, folder = str(tmp_path / "in"), str(tmp_path / "snap")
    rows = spark.createDataFrame([("a", "1"), ("b", "1")], "document_id string, text string")
    rows.write.parquet(source)
    stream_documents(spark, source, "document_id string, text string", folder, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("b", "2"), ("c", "2")], "document_id string, text string").write.mode("append").parquet(source)
    stream_documents(spark, source, "document_id string, text string", folder, str(tmp_path / "cp")).awaitTermination()
    assert {r.document_id: r.text for r in files.current(spark, folder)["documents"].collect()} == {"a": "1", "b": "2", "c": "2"}


def test_items(spark):
    record = '{"key":"AAAA1111","version":3,"data":{"itemType":"book","title":" T ","creators":[{"firstName":"A","lastName":"B"},{"name":"C"}],"date":"May 1999","tags":[{"tag":"x"},{"tag":" "},{"tag":"x"}],"collections":["K"]}}'
    item = biblio.normalise_items(spark.createDataFrame([(record,)], "json string")).first()
    assert (item.item_key, item.version, item.title, item.creators, item.year, item.tags, item.collections, item.doi) == ("AAAA1111", 3, "T", ["A B", "C"], "1999", ["x"], ["K"], None)


def test_collections(spark):
    tree = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("x", "X", "y"), ("y", "Y", "x"), ("o", "O", "nowhere")], "key string, name string, parent string")
    paths = biblio.collection_paths(tree)
    got = {r.key: r.path for r in paths.collect()}
    assert got["c"] == "A / B / C" and got["a"] == "A" and got["x"] == "x / Y / X" and got["o"] == "O"
    named = tree.join(paths, "key")
    assert biblio.resolve_collection(named, "a / b") == "b" and biblio.resolve_collection(named, "c") == "c"
    with pytest.raises(LookupError):
        biblio.resolve_collection(named, "none")


def test_reading_status(spark):
    rows = spark.createDataFrame([(["Reading"], [], False), (["To Read"], [], True), ([], [], True), (["x"], ["Read Papers"], False), (["read"], [], False), (["to-read"], [], False), (["in progress", "done"], [], False), ([], ["Queue"], True), (["finished", "current"], [], True)], "t array<string>, p array<string>, n boolean")
    assert [r.s for r in rows.select(biblio.reading_status(F.col("t"), F.col("p"), F.col("n")).alias("s")).collect()] == ["reading", "to_read", "read", "unknown", "read", "unknown", "unknown", "to_read", "reading"]
    assert biblio.normalise_status("to-read") == "to_read"
    with pytest.raises(ValueError):
        biblio.normalise_status("later")


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    row = v.select(vectors.normalised(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("a")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("o"), vectors.decoded(vectors.encoded(F.col("a"))).alias("r")).first()
    assert np.allclose(row.n, [0.6, 0.8]) and abs(row.c - 1) < 1e-12 and row.o == 0 and row.r == [3.0, 4.0]
    with pytest.raises(Exception):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b"))).collect()


def test_embedding_is_incremental(spark):
    texts = spark.createDataFrame([("a", "one two"), ("b", "three")], "object_id string, text string")
    first = similarity.embed(texts, spark.createDataFrame([], "object_id string, text_hash string"), similarity.HashingEncoder())
    stored = spark.createDataFrame(first.collect(), first.schema)
    assert stored.count() == 2 and similarity.embed(texts, stored, similarity.HashingEncoder()).count() == 0
    assert similarity.pending(texts, stored, force=True).count() == 2


@pytest.mark.parametrize("n, requested, want", [(0, None, 0), (1, 5, 1), (2, None, 1), (3, None, 2), (100, None, 8), (9, 20, 9), (9, 0, 1)])
def test_cluster_count(n, requested, want):
    assert layout.cluster_count(n, requested) == want


def test_labels_and_ids(spark):
    assert explain.manual_label("  a   b ") == "a b"
    for bad in (" ", "x" * 121):
        with pytest.raises(ValueError):
            explain.manual_label(bad)
    import hashlib

    got = spark.range(1).select(ids.document_id(F.lit("c"), F.lit("a/b.txt")).alias("d"), ids.chunk_id(F.lit("doc"), F.lit(3)).alias("k")).first()
    assert got.d == "doc_" + hashlib.sha256(b"c\0a/b.txt").hexdigest()[:16] and got.k == "doc_chunk_000003"


def test_neighbours_pad_with_zero_scores_and_match_dense(spark):
    texts = ["alpha beta gamma", "alpha beta", "delta epsilon", "", "alpha beta gamma"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tfidf.neighbours(docs, tfidf.weights(docs), 3, block=2, side=1).collect()
    assert len(got) == 15 and all(r.doc_id != r.neighbour for r in got)
    best = {r.doc_id: (r.neighbour, r.score) for r in got if r.rank == 1}
    assert best[0] == (4, 1.0) and best[4] == (0, 1.0) and best[3] == (0, 0.0)


def test_tables_in_buckets(spark, tmp_path):
    folder = str(tmp_path / "b")
    frame = lambda rows: spark.createDataFrame(rows, "document_id string, text string, first string")
    got = lambda: sorted(tuple(r) for r in files.current(spark, folder)["documents"].collect())
    assert files.merge(spark, folder, "documents", frame([(f"d{k}", "old", "t0") for k in range(40)]), ["document_id"], ("first",), buckets=8, epoch=0)
    before = files._pointer(spark, folder).parts["documents"]
    assert files.merge(spark, folder, "documents", frame([("d7", "new", "t1")]), ["document_id"], ("first",), epoch=1)
    after = files._pointer(spark, folder).parts["documents"]
    assert len(after) == 8 and sum(after[b] != before[b] for b in after) == 1
    assert got() == sorted((f"d{k}", "new" if k == 7 else "old", "t0") for k in range(40))
    assert not files.merge(spark, folder, "documents", frame([("d8", "again", "t1")]), ["document_id"], epoch=1)
    assert files._pointer(spark, folder).parts["documents"] == after
    files.merge(spark, folder, "documents", frame([("x", "y", "z")]), ["document_id"], removes=frame([("d7", None, None), ("no", None, None)]))
    assert [r for r in got() if r[1] != "old"] == [("x", "y", "z")] and len(got()) == 40 and files._pointer(spark, folder).epoch == 1
    files.discard_old(spark, folder)
    assert len(got()) == 40 and len(list((tmp_path / "b" / "pointers").iterdir())) == 1
    files.merge(spark, folder, "documents", frame([]), ["document_id"], removes=files.current(spark, folder)["documents"])
    assert got() == []
