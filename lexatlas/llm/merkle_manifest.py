"""A Merkle manifest of a table: one tree for each language, one over their roots, and every row's proof.

A leaf is the sha256 of a row's fields; every digest is used as its 64 hexadecimal characters. The leaves of a language
ascend by doc_id, equal ones by leaf; while several nodes remain, every `fanout` consecutive ones become the digest of their
characters (the last run may hold fewer, even one). The roots of the languages, null first, then by their bytes, give the
root in the same way.

Leaves are numbered within their language by a range sort and the counts of its partitions, so no language meets in one
task. Aligned blocks of fanout ** BLOCK_LEVELS leaves are groups: their digests lie in a contiguous array of bytes, whose
rows are hashed level by level and whose index gives every sibling. The blocks' roots are the leaves of the next round,
until each language has one; going down again, each block gets the part of the proof above it once.

Results: rows without doc_id take part (their field is `-`) and come before the others; rows equal in all fields have equal
leaves and proofs of their own; an empty table has no root and gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from binascii import hexlify
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.llm import runtime
from lexatlas.llm.textkernel import of_batches, text_buffers

FANOUT, BLOCK_LEVELS = 2, 12
HEX = 64
#: Counts of partitions that may be broadcast; more are joined like any other table.
MOST_BROADCAST = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, pos long, n long, hash string"


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _hashed(rows: np.ndarray) -> np.ndarray:
    """The digests of the rows of a byte matrix, in hexadecimal, as the rows of another."""
    width, raw = rows.shape[1], np.ascontiguousarray(rows).tobytes()
    digests = b"".join([sha256(raw[x : x + width]).digest() for x in range(0, len(raw), width)])
    return np.frombuffer(hexlify(digests), np.uint8).reshape(len(rows), HEX)


def climb(block: np.ndarray, n: int, fanout: int, most: int) -> list[np.ndarray]:
    """The levels of an aligned block of a tree of n leaves, itself first: until the tree has one node, at most `most` more."""
    levels = [block]
    while n > 1 and len(levels) <= most:
        rows = levels[-1]
        whole = len(rows) // fanout
        up = [_hashed(rows[: whole * fanout].reshape(whole, fanout * HEX))] if whole else []
        if len(rows) % fanout:
            up.append(_hashed(rows[whole * fanout :].reshape(1, -1)))
        levels.append(np.concatenate(up))
        n = -(-n // fanout)
    return levels


def siblings(levels: list[np.ndarray], fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each leaf of a block: the others of its run on every level, left to right (leaves x slots x HEX), and which of these slots are there."""
    index = np.arange(len(levels[0]))
    slots, there = [], []
    for rows in levels[:-1]:
        first, place = index // fanout * fanout, index % fanout
        for k in range(fanout - 1):
            other = first + k + (k >= place)
            inside = other < len(rows)
            slots.append(rows[np.where(inside, other, 0)])
            there.append(inside)
        index = index // fanout
    m = len(levels[0])
    return (np.stack(slots, 1), np.stack(there, 1)) if slots else (np.zeros((m, 0, HEX), np.uint8), np.zeros((m, 0), bool))


def _matrix(column: pa.Array) -> np.ndarray:
    return text_buffers(column)[0].reshape(-1, HEX)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with pos, the place of each row in its group (a column without nulls) in an order, and n, the group's size."""
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(runtime.partitions(spark), group, *order).sortWithinPartitions(group, *order)
    # the low 33 bits of the id count the rows of a partition
    kept = runtime.stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sorted")
    counts = kept.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_from"))
    mine = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runtime.stored(counts.select(group, "_part", (before - F.col("_from")).alias("_shift"), F.sum("_rows").over(mine).alias("n")), "offsets")
    few = F.broadcast(offsets) if offsets.count() <= MOST_BROADCAST else offsets
    return kept.join(few, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def _block(size: int) -> Column:
    return F.expr(f"pos div {size}")


def ascend(nodes: DataFrame, fanout: int, most: int) -> list[DataFrame]:
    """Rounds of nodes (tree, pos, n, hash), the given ones first; the last round has one node of each tree."""
    if fanout < 2 or most < 1:
        raise ValueError("a run has at least two nodes, a block at least one level")
    size = fanout**most

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        levels = climb(_matrix(table.column("hash")), n, fanout, most)
        return pa.table({"tree": table.column("tree").slice(0, 1), "pos": [table.column("pos")[0].as_py() // size], "n": [-(-n // size)], "hash": [levels[-1].tobytes().decode()]})

    rounds, left = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while True:
        up = rounds[-1].select("tree", "pos", "n", "hash").groupBy("tree", _block(size).alias("block")).applyInArrow(run, NODE)
        rounds.append(runtime.stored(up, "nodes"))
        left = -(-left // size)
        if left <= 1:
            return rounds


def descend(rounds: list[DataFrame], top: DataFrame, carried: tuple[str, ...], fanout: int, most: int) -> DataFrame:
    """The first round's rows with their proof and the carried columns of top.

    top: tree, proof (of the tree's root in what lies above, empty for nothing) and the carried columns, a row for each tree.
    """
    above = top.select("tree", F.lit(0).cast("long").alias("block"), "proof", *carried)
    for k in range(len(rounds) - 2, -1, -1):
        nodes = rounds[k]
        own = [c for c in nodes.columns if c != "block"]
        fields = [f for f in nodes.schema.fields if f.name in own]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["proof string"] + [f"`{c}` {dict(above.dtypes)[c]}" for c in carried])

        def run(table: pa.Table, over: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.table({c: [] for c in [*own, "proof", *carried]})
            table = table.sort_by("pos")
            found, there = siblings(climb(_matrix(table.column("hash")), table.column("n")[0].as_py(), fanout, most), fanout)
            tail = np.frombuffer(over.column("proof")[0].as_py().encode(), np.uint8).reshape(1, -1, HEX)
            m = len(found)
            found = np.concatenate([found, np.broadcast_to(tail, (m, *tail.shape[1:]))], axis=1)
            there = np.concatenate([there, np.ones((m, tail.shape[1]), bool)], axis=1)
            ends = np.concatenate([[0], np.cumsum(there.sum(axis=1) * HEX)])
            proofs = pa.LargeStringArray.from_buffers(m, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found[there].tobytes())).cast(pa.string())
            out = {c: table.column(c) for c in own} | {"proof": proofs}
            return pa.table(out | {c: pa.array([over.column(c)[0].as_py()] * m, over.schema.field(c).type) for c in carried})

        dealt = nodes.withColumn("block", _block(fanout**most))
        proved = dealt.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)
        above = proved.select("tree", F.col("pos").alias("block"), "proof", *carried) if k else proved
    return above


def manifest(docs: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS, **more: Column) -> DataFrame:
    """Each row's doc_id, lang, leaf, place (pos of n leaves, tree_pos of trees subroots), proof, subroot and root.

    The proof is the digests of all siblings from the leaf up to the root, left to right, one after the other. more: further
    columns to keep, as expressions over docs.
    """
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
    runtime.prepare(docs.sparkSession)
    leaves = runtime.stored(docs.select("doc_id", "lang", tree.alias("tree"), leaf(*map(F.col, FIELDS)).alias("hash"), *[v.alias(k) for k, v in more.items()]), "leaves")
    nodes = runtime.stored(numbered(leaves, "tree", "doc_id", "hash"), "leaf-nodes")
    rounds = ascend(nodes, fanout, block_levels)
    # the trees' roots are the leaves of one more tree
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), "hash")
    upper = ascend(runtime.stored(numbered(subroots, "tree", "own"), "subroots"), fanout, block_levels)
    top = upper[-1].select("tree", F.lit("").alias("proof"), F.col("hash").alias("root"))
    over = descend(upper, top, ("root",), fanout, block_levels).select(F.col("own").alias("tree"), "proof", F.col("hash").alias("subroot"), F.col("pos").alias("tree_pos"), F.col("n").alias("trees"), "root")
    proved = descend(rounds, runtime.stored(over, "over"), ("subroot", "tree_pos", "trees", "root"), fanout, block_levels)
    return proved.select("doc_id", "lang", F.col("hash").alias("leaf"), "pos", "n", "tree_pos", "trees", "proof", "subroot", "root", *more)


def fold(start: str, proof: str, places: list[tuple[int, int]], fanout: int) -> str:
    """The root that a leaf and its proof give; places: (pos, n) in its tree, then in each tree above."""
    now, rest, at = start.encode(), proof.encode(), 0
    for pos, n in places:
        while n > 1:
            place = pos % fanout
            others = min(fanout, n - (pos - place)) - 1
            cut, end = at + place * HEX, at + others * HEX
            now = hexlify(sha256(rest[at:cut] + now + rest[cut:end]).digest())
            at, pos, n = end, pos // fanout, -(-n // fanout)
    return now.decode()


def folded(rows: DataFrame, start: str, fanout: int = FANOUT) -> DataFrame:
    """Rows of a manifest with folded_root: what the leaf of column `start` and the row's proof give, by index arithmetic alone."""

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
            roots = [fold(s, p, [(a, n), (b, m)], fanout) for s, p, a, n, b, m in zip(get(start), get("proof"), get("pos"), get("n"), get("tree_pos"), get("trees"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "folded_root"])

    return rows.mapInArrow(of_batches(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", folded_root string")


def op13(spark, sf_dir: str) -> DataFrame:
    """The digest query: every document's leaf, proof and root, and whether it still folds to the root after a tampering of a seventh."""
    docs = runtime.table(spark, sf_dir, "documents").select(*FIELDS)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf(*[F.when(touched, F.col(c) + 1).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = folded(manifest(docs, now=changed), "now")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
