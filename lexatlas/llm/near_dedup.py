"""Near-duplicate detection with bottom-k sketches of one hash function.

1. A document's set: the distinct hashes of its word shingles. Its sketch: the SKETCH smallest of them.
2. Documents with equal sets form a class; only its smallest doc_id goes on.
3. Inverted lists: retained value -> classes. Similar documents share most of their retained values, so a list need
   only hold a document under its rarest values (those in the fewest sketches, prefix_reach of them; a set that the
   sketch holds whole needs only the share that a similar one may lack): a passage that many documents share fills few
   of them. Values that one sketch has are dropped, and of lists with equal members one stays.
4. In each list every member is compared with the first, later with the last; pairs whose sizes or whose estimate from
   the union of both sketches rule similarity out go; the others are verified on the full sets of their texts.
   Verified links make components. Lists whose members are all in one component are done. What the others hold
   together is a family: all its members' full sets are compared in pairs of bounded blocks, so no link is left out.
5. The links' components, by alternating stars.

Results: rows without doc_id are dropped; a document without words has an empty set and no links; one with fewer words
than a shingle has one shingle, the whole sequence; rows that repeat a doc_id each get its component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.llm import runtime
from lexatlas.llm.components import components
from lexatlas.llm.textkernel import U, Words, mix, of_batches, of_group, slices, text_buffers

SHINGLE, SKETCH = 5, 64
#: Similarity in hundredths from which documents are linked.
SIMILAR = 85
#: Chance that a pair at exactly the threshold meets in no list, and that its estimate rules it out.
MISSED = 1e-10
#: Documents and shingles of one block of a family; columns of incidence multiplied at a time.
BLOCK_DOCS, BLOCK_SHINGLES, COLUMNS = 1536, 800_000, 2048


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """The sorted distinct shingle hashes of each document of a run."""
    words = Words(data, offsets, lower=True)
    hashes, valid = words.windows(n)
    first, count = words.first, words.count
    for d in range(len(offsets) - 1):
        x, m = first[d], count[d]
        if m >= n:
            yield np.unique(hashes[x : x + m - n + 1])
        elif m:
            acc = np.full(1, m, np.uint64)
            for h in words.hash[x : x + m]:
                acc = mix(acc * U(0xA0761D6478BD642F) + h)
            yield acc
        else:
            yield hashes[:0]


SKETCHES = "doc_id long, n_shingles long, sig1 long, sig2 long, sketch array<long>"


def sketches(docs: DataFrame, shingle: int, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            count, sig1, sig2, kept, ends = [], [], [], [], [0]
            for a, b in slices(off):
                for s in shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], shingle):
                    count.append(len(s))
                    sig1.append(int(mix(s).sum()) if len(s) else 0)
                    sig2.append(int((mix(s ^ U(0x5851F42D4C957F2D)) * U(0x14057B7EF767814F)).sum()) if len(s) else 0)
                    kept.append(s[:size])
                    ends.append(ends[-1] + min(len(s), size))
            values = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sig1, sig2)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))],
                names=["doc_id", "n_shingles", "sig1", "sig2", "sketch"],
            )

    return runtime.id_text(docs).mapInArrow(of_batches(run), SKETCHES)


def prefix_reach(size: int, similar: int) -> int:
    """How many of its retained values a document must be listed under, rarest first, to meet every similar one.

    The values that two similar sketches share are at least Bin(size, similar / 100). The reach leaves a chance of at
    most MISSED, by the exact lower tail, that a pair at the threshold shares too few to meet.
    """
    return size - max(least_shared(size, similar), 1) + 1


def least_shared(size: int, similar: int) -> int:
    """The most that Bin(size, similar / 100) falls short of with a chance of at most MISSED, by the exact lower tail."""
    share, tail, least = similar / 100, 0.0, 0
    while least < size:
        tail += math.comb(size, least) * share**least * (1 - share) ** (size - least)
        if tail > MISSED:
            break
        least += 1
    return least


def _could_match(similar: int, size: int):
    """Of joined classes a and b: sizes and the estimate from the union's sketch leave similarity possible.

    A union that the sketch holds whole gives the similarity itself; of a larger one the sketch is a sample, of which a
    pair at the threshold shares fewer than least_shared values with a chance of at most MISSED.
    """
    sizes = F.expr(f"100 * least(n_a, n_b) >= {similar} * greatest(n_a, n_b)")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, size)
    both = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union))
    whole = (F.col("n_a") <= F.size("sketch_a")) & (F.col("n_b") <= F.size("sketch_b")) & (F.size(union) < size)
    return sizes & F.when(whole, both * 100 >= similar * F.size(union)).otherwise(both >= least_shared(size, similar))


def _side(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similar: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= similar * union."""

    def run(batches):
        for batch in batches:
            (left, at), (right, to) = text_buffers(batch.column(2)), text_buffers(batch.column(3))
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                (x,) = shingle_sets(left[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]), shingle)
                (y,) = shingle_sets(right[to[i] : to[i + 1]], np.array([0, to[i + 1] - to[i]]), shingle)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= similar * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(of_batches(run), "a long, b long")


def full_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """rep and set (64-bit hashes, ascending) of each text."""

    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            sets = [s.tobytes() for a, b in slices(off) for s in shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "set"])

    return texts.select("doc_id", "text").mapInArrow(of_batches(run), "rep long, set binary")


def links_between(left: list[np.ndarray], right: list[np.ndarray], similar: int) -> np.ndarray:
    """left x right: whether two sets are similar. Intersections are products of incidence matrices, some columns at a time."""
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    column, owner = dense[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for x in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [x, x + COLUMNS])
        incidence = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        incidence[owner[a:b], column[a:b] - x] = 1
        common += incidence[: len(left)] @ incidence[len(left) :].T
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return 100 * common >= similar * (sizes - common)


def block_links(placed: DataFrame, texts: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Links (a, b) between components of a family (rep, root, family, n_shingles): enough of them to join all that are linked.

    A family is cut into blocks of bounded size; each pair of blocks is one task's group.
    """
    size = placed.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = placed.join(size, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    with_sets = own.join(full_sets(texts, shingle), "rep")
    dealt = with_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))

    def run(table: pa.Table) -> pa.Table:
        x, y, block = table.column("x")[0].as_py(), table.column("y")[0].as_py(), table.column("block").to_numpy()
        rep, root = table.column("rep").to_numpy(), table.column("root").to_numpy()
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in table.column("set")]
        i, j = np.flatnonzero(block == x), np.flatnonzero(block == y)
        out: list[tuple[int, int]] = []
        if len(i) and len(j):
            linked = links_between([sets[k] for k in i], [sets[k] for k in j], similar) & (root[i][:, None] != root[j][None, :])
            leader: dict[int, int] = {}

            def find(r: int) -> int:
                while (up := leader.get(r, r)) != r:
                    leader[r] = leader.get(up, up)
                    r = up
                return r

            for p, q in zip(*np.nonzero(linked)):
                m, n = find(int(root[i[p]])), find(int(root[j[q]]))
                if m != n:
                    leader[max(m, n)] = min(m, n)
                    out.append((int(rep[i[p]]), int(rep[j[q]])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return dealt.select("family", "x", "y", "block", "rep", "root", "set").groupBy("family", "x", "y").applyInArrow(of_group(run), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similar: int = SIMILAR, size: int = SKETCH) -> DataFrame:
    """Returns doc_id, n_shingles, component_id (least doc_id reachable by links of at least `similar` hundredths) and kept."""
    docs = runtime.id_text(docs)
    with runtime.merge_joins(docs.sparkSession):
        members, roots = _members_and_roots(docs, shingle, similar, size)
    out = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _members_and_roots(docs: DataFrame, shingle: int, similar: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, rep) of all documents, and (id, root) of the classes that links join to a smaller one."""
    drawn = runtime.stored(sketches(docs, shingle, size), "sketches")
    key = ["sig1", "sig2", "n_shingles"]
    classes = drawn.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = drawn.select("doc_id", *key).join(classes, key, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    reps = runtime.stored(drawn.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id")).hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "sketch"), "classes")

    values = reps.select("rep", F.size("sketch").alias("held"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("holders")).where("holders > 1")
    own = Window.partitionBy("rep")
    whole = F.col("held") - F.ceil(F.col("held") * similar / F.lit(100)) + 1
    reach = F.when(F.col("held") * 100 <= size * similar, whole).otherwise(prefix_reach(size, similar))
    postings = (
        values.join(shared, "v")
        .withColumn("place", F.col("held") - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "v")))
        .where(F.col("place") <= reach)
        .select("v", "rep")
    )
    postings = runtime.stored(postings, "postings")
    # lists with the same members are one
    lists = postings.groupBy("v").agg(F.count("*").alias("m"), F.min("rep").alias("least"), F.max("rep").alias("most"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("x2"))
    lists = lists.where("m > 1").groupBy("m", "x1", "x2", "least", "most").agg(F.min("v").alias("v"))
    listed = runtime.stored(postings.join(lists.select("v", "least", "most"), "v"), "lists")
    # merge joins: what is listed grows with the corpus, so the plan is the same at every size
    texts = runtime.stored(docs.join(listed.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    def tested(pairs: DataFrame) -> DataFrame:
        near = pairs.join(_side(reps, "a"), "a").join(_side(reps, "b"), "b").where(_could_match(similar, size)).select("a", "b")
        tables.append(runtime.stored(verified(near, texts, shingle, similar), "verified"))
        return tables[-1]

    tables: list[DataFrame] = []
    star = listed.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    roots = components(tested(star))

    label = lambda lists, roots: lists.join(roots.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed_lists = lambda labelled: labelled.groupBy("v").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("v")

    # members compared with the last of their list, where it is not yet in their component
    labelled = label(listed, roots)
    of_last = labelled.where("rep = most").select("v", F.col("root").alias("last_root"))
    turned = labelled.join(of_last, "v").where("root <> last_root and most <> rep").select(F.least("most", "rep").alias("a"), F.greatest("most", "rep").alias("b")).distinct()
    roots = components(tested(turned.join(star, ["a", "b"], "left_anti")), roots)

    # families: what lists of several components hold together; all pairs of their members' full sets, in blocks
    mixed = runtime.stored(label(listed.select("v", "rep"), roots).join(mixed_lists(label(listed.select("v", "rep"), roots)), "v", "left_semi"), "mixed")
    if not mixed.isEmpty():
        meets = mixed.join(mixed.groupBy("v").agg(F.min("rep").alias("b")), "v").select(F.col("rep").alias("a"), "b")
        families = components(meets)
        placed = mixed.select("rep", "root").distinct().join(families.select(F.col("id").alias("rep"), F.col("root").alias("family")), "rep", "left").withColumn("family", F.coalesce("family", "rep"))
        tables.append(runtime.stored(block_links(placed.join(reps.select("rep", "n_shingles"), "rep"), texts, shingle, similar), "verified"))
        roots = components(tables[-1], roots)
        runtime.discard(families)
    runtime.discard(reps, postings, listed, texts, mixed, *tables)
    return members, roots


def op1(spark, sf_dir: str) -> DataFrame:
    """The digest query over documents: see near_duplicates."""
    return near_duplicates(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"))
