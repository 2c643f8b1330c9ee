"""Sum-of-squares packing of token pieces into sequences of a fixed capacity.

Every piece goes where the sum over residual gaps of (number of open sequences with that gap) squared becomes
smallest: an open sequence of some gap, or a new one. Pieces are dealt to groups of about GROUP_PIECES by a hash; each
group is packed by itself in one task, so the work and the few sequences that a group leaves unfilled grow with the
input. After a first pass in hash order, the pieces of all sequences not yet full are packed again by the same rule,
longest first, as long as that saves sequences.

Results: rows without doc_id are dropped; a null or empty text is its end id alone; rows that repeat a doc_id are
packed each by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import runtime
from lexatlas.llm.textkernel import of_batches, of_group
from lexatlas.llm.word_encoder import default_path, encoder

CAPACITY, END_ID = 2048, 0
GROUP_PIECES = 65_536
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: all but the first hold `capacity` ids."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((x, x + capacity) for x in range(first, n, capacity))]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of each document's ids and end id: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    path = tokenizer or default_path()
    schema = pa.schema([*PIECES_ARROW, ("ids", pa.binary())]) if with_ids else PIECES_ARROW

    def run(batches):
        code, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, counts, ids in code.encode_column(batch.column(1)):
                raw, at = ids.astype("<u4", copy=False).tobytes(), 0
                out: list[list] = [[] for _ in schema]
                for doc_id, n in zip(names[first:], (4 * counts).tolist()):
                    own = raw[at : at + n] + end
                    at += n
                    for k, (x, y) in enumerate(cuts(len(own) // 4, capacity)):
                        part = own[4 * x : 4 * y]
                        for to, v in zip(out, (doc_id, k, x, y - x, zlib.crc32(part), part)):
                            to.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    return runtime.id_text(docs).mapInArrow(of_batches(run), PIECES + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The number of the sequence of each piece, in the given order of pieces."""
    gaps = np.zeros(capacity + 1, np.int64)  # gaps[g]: open sequences with g free places
    holders: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(lengths), np.int64)
    made = 0
    for i, size in enumerate(lengths.tolist()):
        candidates = np.flatnonzero(gaps[size:capacity]) + size
        rest = candidates - size
        change = np.where(rest > 0, 2 * gaps[rest] + 1, 0) - (2 * gaps[candidates] - 1)
        fresh = 2 * gaps[capacity - size] + 1 if size < capacity else 0
        k = int(change.argmin()) if len(candidates) else -1
        if k >= 0 and change[k] <= fresh:
            gap = int(candidates[k])
            gaps[gap] -= 1
            where = holders[gap].pop()
        else:
            gap, where, made = capacity, made, made + 1
        out[i] = where
        if gap > size:
            gaps[gap - size] += 1
            holders[gap - size].append(where)
    return out


def pack_lengths(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence numbers of pieces: a first pass in the given order, then the unfilled sequences again, longest piece first."""
    out = sum_of_squares(lengths, capacity)
    while True:  # every round saves a sequence, or it is the last one
        load = np.bincount(out, weights=lengths, minlength=1)
        loose = np.flatnonzero(load[out] < capacity)
        loose = loose[np.argsort(-lengths[loose], kind="stable")]
        before = len(np.unique(out[loose]))
        again = sum_of_squares(lengths[loose], capacity)
        after = int(again.max(initial=-1)) + 1
        if after >= before:
            return out
        out[loose] = len(load) + again
        out = np.unique(out, return_inverse=True)[1]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset (the piece's place there, gapless from 0) to pieces with doc_id, piece and length."""
    n_groups = max(1, -(-pieces.count() // group_pieces))
    grouped = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_groups)))
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(table: pa.Table) -> pa.Table:
        group = table.column("pack_group")[0].as_py()
        table = table.drop_columns("pack_group").sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "piece", "length") if c in table.column_names])
        lengths = table.column("length").to_numpy()
        number = pack_lengths(lengths, capacity)
        order = np.argsort(number, kind="stable")
        filled = np.cumsum(lengths[order]) - lengths[order]
        head = np.searchsorted(number[order], np.arange(number.max() + 1))
        offset = np.empty(len(order), np.int64)
        offset[order] = filled - filled[head][number[order]]
        return table.append_column("sequence_id", pa.array(number * n_groups + group)).append_column("offset", pa.array(offset))

    return grouped.groupBy("pack_group").applyInArrow(of_group(run), schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encode, cut and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(runtime.stored(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def op2(spark, sf_dir: str) -> DataFrame:
    """The digest query over documents: see pack_documents."""
    return pack_documents(runtime.table(spark, sf_dir, "documents"))
