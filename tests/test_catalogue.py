"""Every registered corpus query against its SQL, and those without SQL for sense."""

import pytest
from conftest import compare, views

from lexatlas.plans import catalogue


@pytest.fixture(scope="module")
def con(small_dir):
    return views(small_dir)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, small_dir, con, name):
    compare(catalogue.QUERIES[name](spark, small_dir), con, catalogue.ORACLE_SQL[name])


def test_clusters_and_layout(spark, small_dir):
    clusters = catalogue.QUERIES["kmeans_clusters"](spark, small_dir)
    assert clusters.count() == clusters.select("doc_id").distinct().count()
    points = catalogue.QUERIES["svd_layout"](spark, small_dir).collect()
    assert all(-1 - 1e-9 <= p.x <= 1 + 1e-9 and -1 - 1e-9 <= p.y <= 1 + 1e-9 for p in points)


@pytest.mark.parametrize("name", ["html_to_text", "markdown_extract", "latex_extract"])
def test_extraction_rows(spark, small_dir, name):
    out = catalogue.QUERIES[name](spark, small_dir)
    assert out.count() > 0 and out.where("text is null").isEmpty()


def test_entry_imports_and_registers():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
