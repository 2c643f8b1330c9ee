"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A shard file, little-endian: magic, header (HEADER), the boundary code, the doc_id code, the ids (16 bits each if the
vocabulary allows, else 32). A code of n ascending values below u keeps l = floor(log2(u / n)) low bits of each value
packed, the high parts as a unary bit vector, and the place of every SAMPLE-th one bit: about 2 + log2(u / n) bits a
value. offset(i) finds the i-th one bit from the nearest sample, so no table of 64-bit offsets exists anywhere.

Shards hold ascending ranges of doc_id. Each is written by one task under a name of its own and counts only once its
row is in the manifest, so a task that runs again leaves at most a file that nothing reads.

Results: rows without doc_id are dropped; a null or empty text is its end id alone; rows that repeat a doc_id follow
each other, ordered by a hash of the text, and may lie in several shards. Extra columns are not written.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.llm import runtime
from lexatlas.llm.textkernel import of_batches
from lexatlas.llm.word_encoder import default_path, encoder

MAGIC = b"LXIDS001"
HEADER = struct.Struct("<IQQQQQ")  # id bytes, documents, ids, bytes of the boundary code, bytes of the doc_id code, least doc_id
CODE = struct.Struct("<QQIQ")  # values, universe, low bits, bytes of the unary part
SAMPLE = 64
END_ID = 2
SHARD_BYTES = 32 << 20
MANIFEST = "path string, shard long, n_docs long, n_tokens long"
#: Documents read from a shard at a time; shards whose ids are added up before the driver sees a sum.
READ_DOCS, SHARD_GROUP = 4096, 1024


class EliasFano:
    """n ascending integers in [0, universe]."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self._low, self._high, self._samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n, universe = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((universe >> low_bits) + n + 1, np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def tobytes(self) -> bytes:
        return CODE.pack(self.n, self.universe, self.low_bits, len(self._high)) + self._high.tobytes() + self._low.tobytes() + self._samples.astype("<u8").tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> EliasFano:
        n, universe, low_bits, size = CODE.unpack_from(raw)
        at = CODE.size
        high = np.frombuffer(raw, np.uint8, size, at)
        n_low = (n * low_bits + 7) // 8
        low = np.frombuffer(raw, np.uint8, n_low, at + size)
        return cls(n, universe, low_bits, low, high, np.frombuffer(raw, "<u8", -(-n // SAMPLE), at + size + n_low))

    def select(self, i: int) -> int:
        """The place of the i-th one bit of the unary part: from its sample, a byte at a time."""
        place, left = int(self._samples[i // SAMPLE]), i % SAMPLE
        byte, window = place >> 3, int(self._high[place >> 3]) >> (place & 7) << (place & 7)
        while (ones := window.bit_count()) <= left:
            left -= ones
            byte += 1
            window = int(self._high[byte])
        for _ in range(left):
            window &= window - 1
        return 8 * byte + (window & -window).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first, last = i * self.low_bits >> 3, ((i + 1) * self.low_bits + 7) >> 3
        low = int.from_bytes(self._low[first:last].tobytes(), "little") >> (i * self.low_bits & 7) & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def run(self, first: int, last: int) -> np.ndarray:
        """Values first .. last - 1: select gives the ends of their unary part, and only that is unpacked."""
        first, last = max(first, 0), min(last, self.n)
        if first >= last:
            return np.zeros(0, np.int64)
        begin, end = self.select(first), self.select(last - 1)
        ones = np.flatnonzero(np.unpackbits(self._high[begin >> 3 : (end >> 3) + 1], bitorder="little")) + (begin & ~7)
        high = ones[(ones >= begin) & (ones <= end)] - np.arange(first, last)
        from_bit, n_bits = first * self.low_bits, (last - first) * self.low_bits
        packed = self._low[from_bit >> 3 : (from_bit + n_bits + 7) >> 3]
        bits = np.unpackbits(packed, bitorder="little")[from_bit & 7 :][:n_bits].reshape(last - first, self.low_bits)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return (high.astype(np.int64) << self.low_bits) + low

    def values(self) -> np.ndarray:
        """All values at once."""
        return self.run(0, self.n)


class IdShard:
    """A shard file's content, decoded."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token-id shard")
        width, self.n_docs, self.n_tokens, n_bounds, n_ids, self.least_doc = HEADER.unpack_from(raw, 8)
        at = 8 + HEADER.size
        self.bounds = EliasFano.frombytes(raw[at : at + n_bounds])
        self.docs = EliasFano.frombytes(raw[at + n_bounds : at + n_bounds + n_ids])
        self.ids = np.frombuffer(raw, f"<u{width}", self.n_tokens, at + n_bounds + n_ids)
        self.least_doc -= 1 << 63

    def document(self, i: int) -> tuple[int, np.ndarray]:
        return self.docs[i] + self.least_doc, self.ids[self.bounds[i] : self.bounds[i + 1]]

    @staticmethod
    def encode(doc_ids: np.ndarray, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
        """ids: little-endian, of that width."""
        bounds = EliasFano.build(np.concatenate([[0], np.cumsum(lengths)])).tobytes()
        docs = EliasFano.build((doc_ids.astype(np.int64) - doc_ids[0]).astype(np.uint64)).tobytes()
        return MAGIC + HEADER.pack(width, len(doc_ids), int(lengths.sum()), len(bounds), len(docs), int(doc_ids[0]) + (1 << 63)) + bounds + docs + ids


def open_store(path: str):
    """(filesystem, path) of a place that every executor can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_id_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode all documents and write them to shard files in ascending doc_id order; returns the manifest, kept in folder/manifest."""
    path = tokenizer or default_path()
    spark = docs.sparkSession
    texts = runtime.id_text(docs)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    texts = texts.withColumn("h", F.xxhash64("text"))
    n = max(runtime.partitions(spark), -(-total // shard_bytes))

    def run(batches):
        from pyspark import TaskContext

        code = encoder(path)
        width = 2 if code.vocabulary <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        doc_ids, lengths, parts = [], [], []
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            for _, counts, ids in code.encode_column(batch.column(1)):
                lengths += (counts + 1).tolist()
                raw, at = ids.astype(f"<u{width}").tobytes(), 0
                for n in (width * counts).tolist():
                    parts += [raw[at : at + n], end]
                    at += n
        if not doc_ids:
            return
        raw = IdShard.encode(np.array(doc_ids), np.array(lengths), b"".join(parts), width)
        store, place = open_store(folder)
        store.create_dir(place)
        name = f"part-{uuid.uuid4().hex}.ids"
        with store.open_output_stream(f"{place}/{name}") as f:
            f.write(raw)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "shard": [TaskContext.get().partitionId()], "n_docs": [len(doc_ids)], "n_tokens": [sum(lengths)]})

    # partitions are ascending ranges, so the partition's number orders the shards
    manifest = texts.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").mapInArrow(of_batches(run), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_id_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Decode the shards of a folder: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids.

    Starts of shards are sums over the manifest (a row for each shard): within groups of SHARD_GROUP shards by window,
    and over the groups on the driver (a row for each 32 GB of text).
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("of", F.floor(F.col("shard") / SHARD_GROUP))
    before, sums = 0, []
    for of, n_tokens in sorted(map(tuple, manifest.groupBy("of").agg(F.sum("n_tokens")).collect())):
        sums.append((of, before))
        before += n_tokens
    ahead = Window.partitionBy("of").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.join(F.broadcast(spark.createDataFrame(sums, "of long, before long")), "of")
    listed = placed.select("path", (F.col("before") + F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).alias("base"), "shard")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * with_ids])

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = open_store(path)
                with store.open_input_stream(place) as f:
                    shard = IdShard(f.read())
                for first in range(0, shard.n_docs, READ_DOCS):
                    last = min(first + READ_DOCS, shard.n_docs)
                    bounds = shard.bounds.run(first, last + 1)
                    wide = shard.ids[bounds[0] : bounds[-1]].astype("<u4")
                    raw, at = wide.tobytes(), bounds - bounds[0]
                    crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                    columns = [pa.array(shard.docs.run(first, last) + shard.least_doc), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(wide.view("<i4"))))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    n_shards = manifest.count()
    dealt = listed.repartition(max(1, n_shards), "shard").select("path", "base")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op9(spark, sf_dir: str) -> DataFrame:
    """The digest query over documents: written to id files in the shared folder and read back."""
    folder = runtime.scratch_path(spark, "ids")
    write_id_files(runtime.table(spark, sf_dir, "documents"), folder)
    return read_id_files(spark, folder, with_ids=False)
