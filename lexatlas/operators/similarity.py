"""Dense similarity: semantic search, exact nearest vectors, hybrid ranking, incremental embedding."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.distribution import ship
from lexatlas.functions.vectors import cosine

DENSE_WEIGHT, LEXICAL_WEIGHT = 0.65, 0.35
#: Rows of a block that is multiplied at once, blocks of a tile.
BLOCK, SIDE = 2048, 16


def semantic_search(vectors: DataFrame, query: list[float], limit: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """rank, key and score of the vectors most similar to one query vector; ties by key."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(cosine(F.col(vector), literal), 9).alias("raw")).orderBy(F.desc("raw"), key).limit(max(0, limit))
    return scored.select(F.row_number().over(Window.orderBy(F.desc("raw"), key)).alias("rank"), key, F.round("raw", 4).alias("score"))


class _Best:
    """The k best (rounded score, id) of each row so far, ties by id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score, self.other = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def floor(self, part: slice) -> np.ndarray:
        """What a score must reach to be among the best."""
        return self.score[part, -1]

    def add(self, row: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        at = np.unique(row)
        own = np.repeat(at, self.k)
        row, score, other = np.concatenate([own, row]), np.concatenate([self.score[at].ravel(), score]), np.concatenate([self.other[at].ravel(), other])
        order = np.lexsort((other, -score, row))
        row, score, other = row[order], score[order], other[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[row[keep], place[keep]], self.other[row[keep], place[keep]] = score[keep], other[keep]

    def rows(self) -> tuple[np.ndarray, ...]:
        ok = self.score > -np.inf
        return np.repeat(self.ids, ok.sum(axis=1)), self.other[ok], self.score[ok]


def _meet(x: _Best, a: np.ndarray, part_a: slice, y: _Best, b: np.ndarray, part_b: slice, same: bool) -> None:
    """Offers the rows of two blocks (unit vectors) to each other; same: to themselves.

    Single-precision products tell which pairs can be among the best at all; those are multiplied again in double precision.
    """
    a, b, k = a[part_a], b[part_b], x.k
    rough = a.astype(np.float32) @ b.astype(np.float32).T
    slack = np.float32(1e-9 + (a.shape[1] + 8) * 1.2e-7)  # more than the two roundings can differ by
    rough[~np.isfinite(rough)] = -np.inf
    if x is y:
        rough[x.ids[part_a][:, None] == y.ids[part_b][None, :]] = -np.inf
    for best, part, own, others, ids, side in ((x, part_a, a, b, y.ids[part_b], rough), (y, part_b, b, a, x.ids[part_a], rough.T))[: 1 if same else 2]:
        floor = best.floor(part).astype(np.float32)
        if side.shape[1] > k:
            fresh = np.flatnonzero(floor == -np.inf)
            floor[fresh] = np.partition(side[fresh], side.shape[1] - k, axis=1)[:, side.shape[1] - k]
        hit = (side >= (floor - slack)[:, None]) & (side > -np.inf)
        many = hit.sum(axis=1)
        # rows in equal steps, so that very many ties are never listed at once
        for rows in np.split(np.arange(len(many)), np.flatnonzero(np.diff(np.cumsum(many) // 1_000_000)) + 1):
            r, c = np.nonzero(hit[rows])
            if len(r):
                r = r + rows[0]
                best.add(r + part.start, np.round(np.einsum("ij,ij->i", own[r], others[c]), 9), ids[c])


def nearest(vectors: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """key, rank, neighbour, score: the k nearest by cosine of every vector, others only; ties by key.

    Vectors are dealt in tiles of side blocks; each pair of tiles is one group, compared block by block, so a vector is copied once a tile.
    """
    spark = vectors.sparkSession
    ship(spark)
    k = max(0, k)
    n = vectors.count()
    # not fewer tiles than give every core some pairs
    n_tiles = max(1, -(-n // (side * block)), min(-(-n // block), math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))))
    dealt = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(n_tiles)).cast("int").alias("tile"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))).withColumn("x", F.least("tile", "other")).withColumn("y", F.greatest("tile", "other"))

    def matrix(table: pa.Table):
        values = table.column("v").combine_chunks()
        m = values.flatten().to_numpy().astype(np.float64).reshape(len(values), -1)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return _Best(table.column("id").to_numpy(), k), m / np.where(length > 0, length, 1)

    def run(table: pa.Table) -> pa.Table:
        x, y, tiles = table.column("x")[0].as_py(), table.column("y")[0].as_py(), table.column("tile").to_numpy()
        best_x, a = matrix(table.filter(pa.array(tiles == x)))
        best_y, b = matrix(table.filter(pa.array(tiles == y))) if y != x else (best_x, a)
        parts = lambda m: [slice(at, min(at + block, len(m))) for at in range(0, len(m), block)]
        for i, p in enumerate(parts(a) if len(b) else []):
            for q in parts(b)[i if x == y else 0 :]:
                _meet(best_x, a, p, best_y, b, q, x == y and p == q)
        cols = [np.concatenate(c) for c in zip(*[best.rows() for best in ([best_x, best_y] if y != x else [best_x])])]
        return pa.table({"id": cols[0], "neighbour": cols[1], "score": cols[2]})

    order = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    found = dealt.select("x", "y", "tile", "id", "v").groupBy("x", "y").applyInArrow(run, "id long, neighbour long, score double") if k else vectors.where("false").select(F.col(key).alias("id"), F.col(key).alias("neighbour"), F.lit(0.0).alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(key), "rank", "neighbour", F.round("score", 4).alias("score"))


def hybrid(lexical: DataFrame, dense: DataFrame, limit: int = 10, dense_weight: float = DENSE_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """doc_id, rank, lexical, dense, score of the union of two scored sets (doc_id, score); a missing score is 0."""
    both = lexical.withColumnRenamed("score", "lexical").join(dense.withColumnRenamed("score", "dense"), "doc_id", "full_outer").fillna(0.0, ["lexical", "dense"])
    scored = both.withColumn("score", F.round(dense_weight * F.col("dense") + lexical_weight * F.col("lexical"), 9)).orderBy(F.desc("score"), "doc_id").limit(max(0, limit))
    return scored.select("doc_id", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), F.round("lexical", 4).alias("lexical"), F.round("dense", 4).alias("dense"), F.round("score", 4).alias("score"))


class Encoder(Protocol):
    """An embedding model: name, dimension and a function from texts to rows of numbers."""

    name: str
    dimension: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic offline default: signed counts of hashed words."""

    def __init__(self, dimension: int = 64):
        self.name, self.dimension = f"hashing-{dimension}", dimension

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dimension] += 1 if h >> 31 else -1
        return out


class ModelError(RuntimeError):
    """A model that is not there, or would have to be fetched."""


class LocalEncoder:
    """A sentence encoder in a folder, read by the optional library. It travels as its path; each worker reads the model once."""

    def __init__(self, name: str, dimension: int | None = None):
        self.name, self._model = name, None
        self.dimension = dimension if dimension is not None else int(self._loaded().get_sentence_embedding_dimension() or 0)

    def _loaded(self):
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as error:
                raise ModelError("the library of sentence encoders is not installed") from error
            self._model = SentenceTransformer(self.name)
        return self._model

    def __getstate__(self) -> dict:
        return {"name": self.name, "dimension": self.dimension, "_model": None}

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self._loaded().encode(list(texts), show_progress_bar=False), np.float32)


def load_encoder(model: str, allow_download: bool = False) -> Encoder:
    """The encoder of a folder; a name that is no folder would be fetched from afar, and is refused unless that is allowed."""
    from pathlib import Path

    place = Path(model).expanduser()
    if place.exists():
        return LocalEncoder(str(place.resolve()))
    if not allow_download:
        raise ModelError(f"{model!r} is no local model, and fetching models is not allowed")
    return LocalEncoder(model)


def pending(texts: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """texts (object_id, text) whose hash differs from the stored one, or all of them."""
    hashed = texts.withColumn("text_hash", F.sha2(F.col("text"), 256))
    if force:
        return hashed
    return hashed.join(stored.select("object_id", F.col("text_hash").alias("old_hash")), "object_id", "left").where(~F.col("text_hash").eqNullSafe(F.col("old_hash"))).drop("old_hash")


def embed(texts: DataFrame, stored: DataFrame, encoder: Encoder, force: bool = False, normalize: bool = True) -> DataFrame:
    """object_id, text_hash, vector of what has changed. The filter stands before the encoder."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.asarray(encoder.encode(pdf["text"].tolist()), np.float32)
            if normalize:
                length = np.linalg.norm(m, axis=1, keepdims=True)
                m = m / np.where(length > 0, length, 1)
            yield pd.DataFrame({"object_id": pdf["object_id"], "text_hash": pdf["text_hash"], "vector": list(m)})

    kind = texts.schema["object_id"].dataType.simpleString()
    return pending(texts, stored, force).select("object_id", "text", "text_hash").mapInPandas(run, f"object_id {kind}, text_hash string, vector array<float>")
