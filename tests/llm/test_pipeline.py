"""Registered queries against their SQL, and the pipeline stage by stage against brute force."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))
import brute  # noqa: E402
from conftest import compare, views  # noqa: E402

import corpus_pipeline  # noqa: E402
from lexatlas.llm import registry, runtime  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, small_dir, name):
    compare(registry.QUERIES[name](spark, small_dir), views(small_dir), registry.ORACLE_SQL[name])


def test_pipeline_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small_dir}/labels.parquet").collect()}
    (_, quality), (_, near), (_, repeats), (_, secrets), (_, packed) = corpus_pipeline.STAGES
    good = runtime.stored(quality(spark, docs, small_dir), "good")
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert good.columns == corpus_pipeline.COLUMNS and sum(i in kept for i in clean) >= 0.95 * len(clean)
    one = runtime.stored(near(spark, good, small_dir), "one")
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in one.collect()} == {i for i, (_, _, k) in brute.near_duplicates(rows, corpus_pipeline.STAGE_SIMILAR).items() if k}
    cut = runtime.stored(repeats(spark, one, small_dir), "cut")
    want = brute.repeats([(r.doc_id, r.text) for r in one.collect()])
    for r in cut.collect():
        n_bytes, removed, _, _ = want[r.doc_id]
        assert n_bytes - removed <= len(r.text.encode()) <= n_bytes - removed + 6 * (removed // 100 + 1) * (removed > 0) and r.n_chars == len(r.text)
    safe = runtime.stored(secrets(spark, cut, small_dir), "safe")
    assert safe.columns == corpus_pipeline.COLUMNS and safe.count() == cut.count()
    assert all(not brute.secrets(r.text or "") for r in safe.collect())
    pieces = packed(spark, safe, small_dir)
    assert pieces.select("doc_id").distinct().count() == safe.count()


def test_pipeline_of_nothing(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = runtime.stored(stage(spark, docs, small_dir), "empty")
    assert docs.count() == 0
