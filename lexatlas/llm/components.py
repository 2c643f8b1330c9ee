"""Connected components of a link table, in Spark: alternating large and small stars until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import runtime

MOST_ROUNDS = 64


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.lit(0))).first())


def _toward_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node's neighbours are linked to the least of it and them: all larger ones, or the node itself and the smaller."""
    least = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    joined = edges.join(least, "a")
    if larger_only:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """(id, root) of every node that the links (a, b) name, but roots themselves; root is the least id that it reaches.

    settled: what this gave for earlier links, which then count too. It is deleted, unless no link is new and it stays.
    """
    if settled is not None:
        if edges.isEmpty():
            return settled
        edges = edges.select("a", "b").union(settled.select(F.col("id").alias("a"), F.col("root").alias("b")))
    stars = runtime.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    if settled is not None:
        runtime.discard(settled)
    before = _digest(stars)
    for _ in range(MOST_ROUNDS):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward_least(both, True)
        after_large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        new = runtime.stored(_toward_least(after_large, False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        runtime.discard(stars)
        stars, now = new, _digest(new)
        if now == before:
            out = stars.select(F.col("a").alias("id"), F.col("b").alias("root"))
            out._lexatlas_path = stars._lexatlas_path
            return out
        before = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
