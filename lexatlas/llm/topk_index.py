"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers and stored, for each block of vectors, as bitmaps: slice s of dimension d holds
bit s of (component + bias) of every vector. A query's score is a weighted sum of slices; it is added up with bitmap
arithmetic (carry-save adders over packed words, one weight class after another), which gives the slices of the score
of all vectors at once. The top rows are then selected from the most significant slice downward, and rows that tie at
the boundary are resolved exactly by vec_id.

Blocks of queries meet blocks of vectors; each pair gives at most k rows a query, and the best k of these are final.

Results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id;
vectors of different lengths are not compared; of rows that repeat a vec_id the smallest vector counts. Scores must fit
in 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.llm import runtime

SCALE, QUERY_STEP, TOP = 256, 50, 5
BLOCK_VECTORS, BLOCK_QUERIES = 1 << 16, 128


class SlicedBlock:
    """Bit slices of a block of integer vectors, rows in ascending vec_id order."""

    def __init__(self, ids: np.ndarray, slices: np.ndarray, bias: int):
        self.ids, self.slices, self.bias = ids, slices, bias  # slices: bits x dimensions x words

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        bias = -min(0, int(vectors.min()))
        raised = (vectors + bias).astype(np.uint64).T
        bits = max(1, int(raised.max()).bit_length())
        padded = np.zeros((raised.shape[0], -(-len(ids) // 64) * 64), np.uint64)
        padded[:, : len(ids)] = raised
        slices = np.stack([np.packbits((padded >> np.uint64(s) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for s in range(bits)])
        return cls(ids, slices, bias)

    def tobytes(self) -> bytes:
        return np.array([len(self.ids), *self.slices.shape, self.bias], np.int64).tobytes() + self.ids.astype(np.int64).tobytes() + self.slices.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> SlicedBlock:
        n, bits, dims, words, bias = np.frombuffer(raw, np.int64, 5).tolist()
        return cls(np.frombuffer(raw, np.int64, n, 40), np.frombuffer(raw, np.uint64, bits * dims * words, 40 + 8 * n).reshape(bits, dims, words), bias)

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices (least first) of sum(|q| * y), where y is a raised component or, for q < 0, its complement; and what must be added to get the score."""
        bits = len(self.slices)
        size = np.abs(query)
        negative = query < 0
        classes: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            used = (size >> j & 1).astype(bool)
            plus, minus = np.flatnonzero(used & ~negative), np.flatnonzero(used & negative)
            for s in range(bits):
                classes.setdefault(j + s, []).extend([self.slices[s, plus], ~self.slices[s, minus]])
        out, w = [], 0
        while classes:
            rows = np.concatenate(classes.pop(w, [np.zeros((1, self.slices.shape[2]), np.uint64)]))
            carries = []
            while len(rows) >= 3:
                m = len(rows) // 3
                a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
                both = a ^ b
                carries.append((a & b) | (c & both))
                rows = np.concatenate([both ^ c, rows[3 * m :]])
            if len(rows) == 2:
                carries.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
            out.append(rows[0] if len(rows) else np.zeros(self.slices.shape[2], np.uint64))
            if carries:
                classes.setdefault(w + 1, []).extend(carries)
            w += 1
        shift = -self.bias * int(query.sum()) - ((1 << bits) - 1) * int(size[negative].sum())
        return out, shift

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the k best rows, without the row of the query itself."""
        slices, shift = self.score_slices(query)
        n = len(self.ids)
        live = np.zeros(self.slices.shape[2] * 64, np.uint8)
        live[:n] = self.ids != own
        edge = np.packbits(live, bitorder="little").view(np.uint64)
        sure = np.zeros_like(edge)
        for bitmap in reversed(slices):
            with_bit = edge & bitmap
            count = int(np.bitwise_count(sure | with_bit).sum())
            if count >= k:
                edge = with_bit
                if count == k:
                    break
            else:
                sure |= with_bit
                edge = edge & ~bitmap
        rows_of = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        chosen = rows_of(sure)
        chosen = np.concatenate([chosen, rows_of(edge)[: k - len(chosen)]])  # the edge's rows tie, or are just as many as wanted
        score = np.full(len(chosen), shift, np.int64)
        for w, bitmap in enumerate(slices):
            score += (bitmap[chosen >> 6] >> (chosen & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << w
        return list(zip(self.ids[chosen].tolist(), score.tolist()))


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and q (array of long) of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = embeddings.where("vec_id is not null and embedding is not null").where((F.size("embedding") > 0) & fine)
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q")).groupBy("vec_id").agg(F.min("q").alias("q"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def build_index(vectors: DataFrame, block: int = BLOCK_VECTORS) -> DataFrame:
    """One row for each block and vector length: dim, block, payload."""
    n_blocks = max(1, -(-vectors.count() // block))

    def run(table: pa.Table) -> pa.Table:
        built = SlicedBlock.build(table.column("vec_id").to_numpy(), _matrix(table.column("q")))
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "payload": pa.array([built.tobytes()], pa.binary())})

    dealt = vectors.select("vec_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"))
    return dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block int, payload binary")


def search(index: DataFrame, queries: DataFrame, k: int = TOP, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors for each query (vec_id, q)."""
    n_blocks = max(1, -(-queries.count() // block))

    def gather(table: pa.Table) -> pa.Table:
        return pa.table({"dim": table.column("dim")[:1], "part": table.column("part")[:1], "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "qs": pa.array([_matrix(table.column("q")).astype(np.int64).tobytes()], pa.binary())})

    parts = queries.select("vec_id", "q", F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_blocks)).cast("int").alias("part"))
    parts = parts.groupBy("dim", "part").applyInArrow(gather, "dim int, part int, ids binary, qs binary")

    def run(batches):
        for batch in batches:
            for payload, ids, qs in zip(batch.column(0), batch.column(1), batch.column(2)):
                sliced = SlicedBlock.frombytes(payload.as_py())
                own = np.frombuffer(ids.as_py(), np.int64)
                found = [(q, *hit) for q, query in zip(own.tolist(), np.frombuffer(qs.as_py(), np.int64).reshape(len(own), -1)) for hit in sliced.top(query, q, k)]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*found)] or [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])

    # a stated query set against all rows, in blocks: each pair of blocks is one row, dealt evenly
    last = index.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    spread = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    paired = index.join(spread.hint("merge"), ["dim", "block"])
    dealt = paired.repartition(runtime.partitions(index.sparkSession), "dim", "block", "part").select("payload", "ids", "qs")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    """The digest query over embeddings: rows whose vec_id is divisible by 50 against all rows."""
    vectors = runtime.stored(quantised(runtime.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    index = runtime.stored(build_index(vectors), "index")
    return search(index, vectors.where(F.col("vec_id") % QUERY_STEP == 0))

