"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

How it works, for a minimum length L:

1. Every window of L bytes belongs to one *anchor*, the smallest of the hashed grams in it (leftmost on ties). Equal
   windows have equal anchors at equal places, so the windows of an anchor, a *block*, need only be compared with
   blocks of the same anchor. Anchors are dealt by hash as packed arrays; each map batch first folds equal blocks.
2. Blocks equal as a whole are settled there: all but the first are covered. Anchors seen once are done.
3. Blocks of anchors with several distinct blocks go to suffix buckets of bounded size. A bucket's text is cut into
   shards; each shard gets a Burrows-Wheeler transform over symbols of k bytes (k divides L, one chain for each
   residue), and the transforms are merged by refining their interleave: iteration h orders it by h symbols and marks
   where common prefixes of h - 1 symbols end. No suffix is sorted again. After L / k iterations an interval without
   a mark is a set of equal windows; all but its first are covered.
4. An anchor with more than HOT_BLOCKS distinct blocks can't share a bucket: its windows are dealt one by one by their
   own hash and folded as in step 2, which is exact as well.
5. Covered windows return to their documents; their union is removed.

Results: rows without doc_id are dropped; a null or empty text has no spans; texts under L bytes can't repeat;
identical rows with one doc_id count as one document and get the same result each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexatlas.llm import runtime
from lexatlas.llm.textkernel import RADIX_INVERSE, U, mix, of_batches, of_group, of_pair, powers, prefix_hash, span_codes, span_digests, text_buffers

#: Bytes of an anchor's gram.
GRAM = 40
#: Text bytes dealt to one anchor bucket and one document bucket, and block bytes of one suffix bucket.
BUCKET_BYTES, SUFFIX_BYTES, SHARD_BYTES = 8 << 20, 1 << 19, 1 << 17
#: Distinct blocks of one anchor that may share a suffix bucket.
HOT_BLOCKS = 4_096
WIDEST_SYMBOL = 25

ANCHORS, COVERED, MIXED, HOT = 0, 1, 2, 3
PACKED = "kind int, bucket int, n_bytes long, a binary, c binary, doc binary, lo binary, n binary"


def planes(values: np.ndarray) -> bytes:
    """The bytes of an array, most similar bytes together, which shuffles compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def packed(kind: int, bucket: np.ndarray, a, c, doc, lo, n, length: int) -> list[dict]:
    """One row for each bucket with its share of the arrays."""
    if len(bucket) == 0:
        return []
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = []
    for part in np.split(order, ends):
        rows.append({
            "kind": kind, "bucket": int(bucket[part[0]]), "n_bytes": int(n[part].sum()) + (length - 1) * len(part),
            "a": b"" if a is None else a[part].astype(np.uint32).tobytes(), "c": b"" if c is None else c[part].tobytes(),
            "doc": planes(doc[part].astype(np.int64)), "lo": planes(lo[part].astype(np.int32)), "n": planes(n[part].astype(np.int32)),
        })
    return rows


PACKED_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n_bytes", pa.int64()), ("a", pa.binary()), ("c", pa.binary()), ("doc", pa.binary()), ("lo", pa.binary()), ("n", pa.binary())])


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=PACKED_ARROW)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    k, m = 1, v
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    rest = width - k
    return np.minimum(m[: len(v) - width + 1], m[rest : rest + len(v) - width + 1]) if rest else m


def blocks_of(data: np.ndarray, length: int, gram: int):
    """(first window, number of windows, anchor hash, hash of the block's bytes) of one text's blocks."""
    pre = prefix_hash(data)
    back = powers(RADIX_INVERSE, len(pre))
    grams = mix((pre[gram:] - pre[:-gram]) * back[: len(pre) - gram])
    # A gram's place in the low bits makes the leftmost of equal grams the smallest; PIECE keeps places within them.
    starts = len(data) - length + 1
    place = np.concatenate([anchor_places(grams[x : min(x + PIECE, starts) + length - gram], length - gram + 1) + x for x in range(0, starts, PIECE)])
    turn = np.flatnonzero(place[1:] != place[:-1]) + 1
    lo = np.concatenate([[0], turn])
    hi = np.concatenate([turn, [starts]])
    n = hi - lo
    return lo, n, grams[place[lo]], span_digests(data, lo, hi + (length - 1))


PLACE_BITS = 24
PIECE = 1 << (PLACE_BITS - 1)


def anchor_places(grams: np.ndarray, width: int) -> np.ndarray:
    low = U((1 << PLACE_BITS) - 1)
    return (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width) & low).astype(np.int64)


def fold(content: np.ndarray, doc: np.ndarray, lo: np.ndarray):
    """(indices of the first of each content in (doc, lo) order, indices of the others that start later)."""
    order = np.lexsort((lo, doc, content))
    c, d, s = content[order], doc[order], lo[order]
    head = np.ones(len(order), bool)
    head[1:] = c[1:] != c[:-1]
    at = np.flatnonzero(head)
    which = np.cumsum(head) - 1
    later = ~head & ((d != d[at][which]) | (s != s[at][which]))
    return order[head], order[later]


def no_fold(content: np.ndarray, doc: np.ndarray, lo: np.ndarray):
    """fold() that settles nothing: the first of each place (rows that repeat a document hold it twice), none later."""
    order = np.lexsort((lo, doc))
    head = np.ones(len(order), bool)
    head[1:] = (np.diff(doc[order]) != 0) | (np.diff(lo[order]) != 0)
    return order[head], order[:0]


def map_anchors(length: int, gram: int, n_anchor: int, n_doc: int, fold=fold):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = text_buffers(batch.column(1))
            got = [], [], [], [], []
            for i in np.flatnonzero(np.diff(off) >= length):
                lo, n, a, c = blocks_of(data[off[i] : off[i + 1]], length, gram)
                for to, x in zip(got, (np.full(len(lo), ids[i], np.int64), lo, n, a, c)):
                    to.append(x)
            if not got[0]:
                continue
            doc, lo, n, a, c = map(np.concatenate, got)
            first, later = fold(c, doc, lo)
            rows = packed(ANCHORS, ((a & U(0xFFFFFFFF)) % U(n_anchor)).astype(np.int64)[first], (a >> U(32))[first], c[first], doc[first], lo[first], n[first], length)
            rows += spread(packed(COVERED, doc[later] % n_doc, None, None, doc[later], lo[later], n[later], length))
            yield as_batch(rows)

    return run


def spread(rows: list[dict]) -> list[dict]:
    """Covered windows pass through the anchor buckets; their own bucket is that of the document, kept in n_bytes' place."""
    return [r | {"n_bytes": r["bucket"]} for r in rows]


def unpack(rows: list[dict], kind: int):
    """The arrays of the rows of a kind, put together."""
    rows = [r for r in rows if r["kind"] == kind]
    if not rows:
        return (np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    a = np.concatenate([np.frombuffer(r["a"], np.uint32) for r in rows])
    c = np.concatenate([np.frombuffer(r["c"], np.uint64) for r in rows])
    return (a, c, *(np.concatenate([unplanes(r[k], t) for r in rows]) for k, t in (("doc", np.int64), ("lo", np.int32), ("n", np.int32))))


def reduce_anchors(length: int, n_doc: int, hot: int, fold=fold):
    """Of one anchor bucket: covered blocks, and the distinct blocks of anchors that have several."""

    def run(table: pa.Table) -> pa.Table:
        got = table.to_pylist()
        rows = [r | {"bucket": r["n_bytes"]} for r in got if r["kind"] == COVERED]
        a, c, doc, lo, n = unpack(got, ANCHORS)
        del got
        if len(a):
            content = mix(c ^ (a.astype(np.uint64) * U(0x9FB21C651E98DF25)))
            first, later = fold(content, doc, lo)
            rows += packed(COVERED, doc[later] % n_doc, None, None, doc[later], lo[later], n[later], length)
            a, doc, lo, n = a[first], doc[first], lo[first], n[first]
            _, which, count = np.unique(a, return_inverse=True, return_counts=True)
            count = count[which]
            for kind, these in ((MIXED, (count > 1) & (count <= hot)), (HOT, count > hot)):
                rows += packed(kind, doc[these] % n_doc, a[these], None, doc[these], lo[these], n[these], length)
        return pa.Table.from_batches([as_batch(rows)])

    return run


def fetch_blocks(length: int, n_suffix: int, n_window: int):
    """Of one document bucket: the bytes of its mixed blocks, by suffix bucket, and the windows of hot ones."""
    schema = pa.schema([*PACKED_ARROW, ("bytes", pa.binary())])

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        if not rows:
            return pa.Table.from_batches([], schema=schema)
        ids = docs.column("doc_id").to_numpy()
        data, off = text_buffers(docs.column("text"))
        by_id = np.argsort(ids, kind="stable")
        out = []
        for kind in (MIXED, HOT):
            a, _, doc, lo, n = unpack(rows, kind)
            if not len(doc):
                continue
            at = by_id[np.searchsorted(ids[by_id], doc)]
            start = off[at] + lo
            fits = start + n + (length - 1) <= off[at + 1]  # rows that share an id but not a text
            a, doc, lo, n, start = a[fits], doc[fits], lo[fits], n[fits], start[fits]
            bucket = (a % np.uint32(n_suffix)).astype(np.int64)
            order = np.lexsort((lo, doc, bucket))
            a, doc, lo, n, start, bucket = a[order], doc[order], lo[order], n[order], start[order], bucket[order]
            size = n + (length - 1)
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(bucket)) + 1):
                text = data[spread_ranges(start[part], size[part])]
                if kind == MIXED:
                    out += [r | {"bytes": text.tobytes()} for r in packed(MIXED, bucket[part], a[part], None, doc[part], lo[part], n[part], length)]
                else:
                    out += hot_windows(text, doc[part], lo[part], n[part], length, n_window)
        return pa.Table.from_pylist(out, schema=schema)

    return run


def spread_ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. start[0] + size[0] - 1, start[1], ..."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def hot_windows(text: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int, n_window: int) -> list[dict]:
    """Every window of some blocks (their bytes put together), dealt by its own hash; those folded here are covered."""
    w = spread_ranges(np.concatenate([[0], np.cumsum(n + (length - 1))[:-1]]), n)
    h = span_digests(text, w, w + length)
    doc, at, one = np.repeat(doc, n), spread_ranges(lo.astype(np.int64), n), np.ones(len(w), np.int32)
    first, later = fold(h, doc, at)
    rows = packed(ANCHORS, ((h & U(0xFFFFFFFF)) % U(n_window)).astype(np.int64)[first], (h >> U(32))[first], h[first], doc[first], at[first], one[first], length)
    rows += packed(COVERED, np.zeros(len(later), np.int64), None, None, doc[later], at[later], one[later], length)
    return [r | {"bytes": b""} for r in rows]


def stable_order(codes: np.ndarray) -> np.ndarray:
    """Stable argsort of codes under 2**32 by two passes of a 16-bit counting sort."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    high = (codes >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def symbol_width(length: int) -> int:
    return max(k for k in range(1, WIDEST_SYMBOL + 1) if length % k == 0)


class Shard:
    """Burrows-Wheeler transform of some strings over symbols of k bytes.

    A string of m bytes has slots 0 .. m: slot p stands for the suffix that begins at byte p, read k bytes at a time;
    the last k slots are the ends (empty suffixes) of its k chains. code[p] is the symbol at p, 0 at an end.
    """

    def __init__(self, code: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int, depth: int):
        """begin, end: of each slot, the first and the last slot of its string."""
        slots = np.arange(len(code))
        order = slots
        for j in range(depth - 1, -1, -1):
            at = order + j * k
            inside = at <= end[order]
            symbol = np.where(inside, code[np.minimum(at, len(code) - 1)], 0)
            order = order[stable_order(symbol)]
        is_end = slots > end - k
        self.suffix = np.concatenate([slots[is_end], order[~is_end[order]]])
        before = self.suffix - k
        self.bwt = np.where(before >= begin[self.suffix], code[np.maximum(before, 0)], 0)
        self.ends = int(is_end.sum())


def merge(shards: list[Shard], depth: int):
    """Refine the interleave of the shards' transforms depth times.

    Returns (source shard, common prefix with the predecessor in symbols, at most depth) of each merged suffix. Suffixes
    between two places with a common prefix under depth agree in depth symbols; among them the order follows the shards.
    """
    number = np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16 if len(shards) < 65536 else np.uint32)
    source = np.repeat(number, [len(s.bwt) for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    ends = sum(s.ends for s in shards)
    fixed = np.repeat(number, [s.ends for s in shards])
    interval = np.zeros(len(source), np.int32)
    common = np.full(len(source), depth, np.int32)
    for h in range(depth):
        symbol = np.empty(len(source), bwt.dtype)
        symbol[np.argsort(source, kind="stable")] = bwt
        order = stable_order(symbol)[ends:]
        c, i = symbol[order], interval[order]
        mark = np.zeros(len(source), bool)
        if len(order):
            mark[ends] = True
            mark[ends + 1 :] = (c[1:] != c[:-1]) | (i[1:] != i[:-1])
        source = np.concatenate([fixed, source[order]])
        common[mark & (common == depth)] = h
        interval = np.cumsum(mark, dtype=np.int32)
    return source, common


def repeated_windows(data: np.ndarray, size: np.ndarray, length: int, shard_bytes: int) -> np.ndarray:
    """Of strings put together (sizes at least `length`), the places of windows that equal an earlier one: slots, where string s begins at slot sum(size[:s] + 1)."""
    k = symbol_width(length)
    depth = length // k
    begin_byte = np.concatenate([[0], np.cumsum(size)[:-1]])
    slots = size + 1
    first_slot = np.concatenate([[0], np.cumsum(slots)[:-1]])
    string = np.repeat(np.arange(len(size)), slots)
    begin, end = first_slot[string], (first_slot + size)[string]
    slot = np.arange(len(string))
    real = slot <= end - k
    at = (slot - begin + begin_byte[string])[real]
    code = np.zeros(len(string), np.int64)
    code[real] = np.unique(span_codes(data, at, at + k), return_inverse=True)[1] + 1
    del at
    cuts = np.unique(np.searchsorted(first_slot, np.arange(shard_bytes, first_slot[-1] + 1, shard_bytes)))
    shards, offset = [], []
    for part in np.split(np.arange(len(size)), cuts):
        if len(part):
            x, y = first_slot[part[0]], first_slot[part[-1]] + slots[part[-1]]
            shards.append(Shard(code[x:y], begin[x:y] - x, end[x:y] - x, k, depth))
            offset.append(x)
    source, common = merge(shards, depth)
    suffix = np.empty(len(source), np.int64)
    suffix[np.argsort(source, kind="stable")] = np.concatenate([s.suffix + x for s, x in zip(shards, offset)])
    interval = np.cumsum(common < depth)  # a repeated interval is a run of common prefixes of the whole depth
    window = suffix <= end[suffix] - length
    suffix, interval = suffix[window], interval[window]
    if not len(suffix):
        return suffix
    head = np.concatenate([[0], np.flatnonzero(np.diff(interval)) + 1])
    least = np.repeat(np.minimum.reduceat(suffix, head), np.diff(np.concatenate([head, [len(suffix)]])))
    return np.sort(suffix[suffix != least])


def reduce_suffixes(length: int, n_doc: int, shard_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        _, _, doc, lo, n = unpack(rows, MIXED)
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        size = n.astype(np.int64) + (length - 1)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        order = np.lexsort((lo, doc))
        if not (order == np.arange(len(order))).all():
            to = np.concatenate([[0], np.cumsum(size[order])[:-1]])
            data = data[np.repeat(start[order] - to, size[order]) + np.arange(size.sum())]
        doc, lo, size = doc[order], lo[order], size[order]
        found = repeated_windows(data, size, length, shard_bytes)
        if not len(found):
            return pa.Table.from_batches([], schema=PACKED_ARROW)
        first_slot = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        string = np.searchsorted(first_slot, found, "right") - 1
        at = found - first_slot[string] + lo[string]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(found) != 1) | (np.diff(string) != 0)]))
        count = np.diff(np.concatenate([head, [len(found)]]))
        d = doc[string][head]
        return pa.Table.from_batches([as_batch(packed(COVERED, d % n_doc, None, None, d, at[head], count, length))])

    return run


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    head = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[head], reach[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(start) - 1]])]


def cut_documents(length: int, as_text: bool, out_schema: pa.Schema):
    def run(docs: pa.Table, covered: pa.Table) -> pa.Table:
        _, _, doc, lo, n = unpack(covered.to_pylist(), COVERED)
        order = np.argsort(doc, kind="stable")
        doc, lo, n = doc[order], lo[order].astype(np.int64), n[order]
        ids = docs.column("doc_id").to_numpy()
        data, off = text_buffers(docs.column("text"))
        first, last = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
        spans, kept = [], []
        for i in range(len(ids)):
            text = data[off[i] : off[i + 1]]
            if first[i] == last[i]:
                spans.append([])
                kept.append(text.tobytes())
                continue
            s, e = union(lo[first[i] : last[i]], np.minimum(lo[first[i] : last[i]] + n[first[i] : last[i]] + (length - 1), len(text)))
            if as_text:
                s, e = to_characters(text, s, e)
            keep = np.ones(len(text) + 1, np.int8)
            keep[s] -= 1
            step = np.zeros(len(text) + 1, np.int32)
            step[s] -= 1
            step[e] += 1
            kept.append(text[np.cumsum(step[:-1]) == 0].tobytes())
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e)])
        columns = {"doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(off), pa.int64()), "spans": pa.array(spans, out_schema.field("spans").type), "kept": pa.array(kept, pa.binary()), "rest": docs.column("rest")}
        return pa.Table.from_arrays([columns[k] for k in out_schema.names], schema=pa.schema([pa.field(k, columns[k].type) for k in out_schema.names]))

    return run


def to_characters(text: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans drawn in to whole characters; those left empty go."""
    inner = np.append((text & 0xC0) == 0x80, False)
    s, e = s.copy(), e.copy()
    for _ in range(3):
        s += inner[s]
        e -= inner[e]
    return s[s < e], e[s < e]


def next_prime(n: int) -> int:
    return next(x for x in range(max(n, 2), 4 * max(n, 2)) if all(x % y for y in range(2, int(x**0.5) + 1)))


def remove_repeats(docs: DataFrame, min_length: int = 100, *, as_text: bool = False, gram: int = GRAM, hot_blocks: int = HOT_BLOCKS, suffix_bytes: int = SUFFIX_BYTES, shard_bytes: int = SHARD_BYTES, fold_equal: bool = True) -> DataFrame:
    """Remove each byte that a string of min_length bytes covers which also starts earlier (smaller doc_id, or earlier in the document).

    Returns doc_id, n_bytes, spans (array of start, end: removed byte runs), kept (binary: the remaining bytes) and rest
    (a struct of the other columns). as_text draws the spans in to whole characters, so that kept is UTF-8.
    fold_equal=False leaves out steps 2 and 4, which only save work: every repeat is then found by the merged transforms,
    and an anchor's blocks must fit a task.
    """
    spark = docs.sparkSession
    gram = min(gram, min_length)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    whole = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))
    texts = whole.select("doc_id", "text")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_anchor = max(runtime.partitions(spark), -(-total // BUCKET_BYTES))
    n_doc = next_prime(n_anchor)
    dealt = texts.mapInArrow(of_batches(map_anchors(min_length, gram, n_anchor, n_doc, fold if fold_equal else no_fold)), PACKED)
    found = runtime.stored(dealt.repartition(n_anchor, "bucket").groupBy("bucket").applyInArrow(of_group(reduce_anchors(min_length, n_doc, hot_blocks if fold_equal else 1 << 62, fold if fold_equal else no_fold)), PACKED), "anchors")
    mixed = found.where(F.col("kind").isin(MIXED, HOT))
    n_suffix = max(runtime.partitions(spark), -(-(mixed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]) // suffix_bytes))
    by_bucket = lambda df: df.withColumn("bucket", F.pmod("doc_id", F.lit(n_doc)).cast("int"))
    blocks = runtime.stored(by_bucket(texts).repartition(n_doc, "bucket").groupBy("bucket").cogroup(mixed.repartition(n_doc, "bucket").groupBy("bucket")).applyInArrow(of_pair(fetch_blocks(min_length, n_suffix, n_suffix)), PACKED + ", bytes binary"), "blocks")
    merged = blocks.where(F.col("kind") == MIXED).repartition(n_suffix, "bucket").groupBy("bucket").applyInArrow(of_group(reduce_suffixes(min_length, n_doc, shard_bytes)), PACKED)
    single = blocks.where((F.col("kind") == ANCHORS) & (F.length("c") > 0)).drop("bytes").groupBy("bucket").applyInArrow(of_group(reduce_anchors(min_length, n_doc, 1 << 62)), PACKED).where(F.col("kind") == COVERED)
    local = split_hot_covered(blocks.where(F.col("kind") == COVERED).drop("bytes"), n_doc)
    covered = found.where(F.col("kind") == COVERED).unionByName(merged).unionByName(single).unionByName(local)
    kind = by_bucket(whole)
    # the other columns' types as they are, with what may be null in them
    out = StructType([*StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").fields, StructField("rest", whole.schema["rest"].dataType)])
    names = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("rest", pa.null())])
    return kind.repartition(n_doc, "bucket").groupBy("bucket").cogroup(covered.repartition(n_doc, "bucket").groupBy("bucket")).applyInArrow(of_pair(cut_documents(min_length, as_text, names)), out)


def split_hot_covered(covered: DataFrame, n_doc: int) -> DataFrame:
    """Windows folded while hot blocks were fetched: dealt again by document."""

    def run(batches):
        for batch in batches:
            _, _, doc, lo, n = unpack(batch.to_pylist(), COVERED)
            if len(doc):
                yield as_batch(packed(COVERED, doc % n_doc, None, None, doc, lo, n, 1))

    return covered.mapInArrow(run, PACKED)


def op6(spark, sf_dir: str) -> DataFrame:
    """The digest query over documents: see remove_repeats."""
    cut = remove_repeats(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"), 100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
