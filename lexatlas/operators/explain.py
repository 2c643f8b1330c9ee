"""Explaining clusters and pairs: term sums, c-TF-IDF labels, representatives, overrides, shared terms and chunks."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.distribution import discard, ship, stored
from lexatlas.functions.text import GENERIC_TERMS, LABEL_TOKEN, WORD, informative, literal, stop_words, terms, window_chunks
from lexatlas.operators import tfidf

MOST_LABEL_LENGTH = 120
#: Words whose terms a worker counts together.
WORDS = 1 << 20
#: Letters of the texts whose terms are in one range of hashes.
RANGE = 1 << 23


def simple_labels(weighted: DataFrame, clusters: DataFrame, limit: int = 3) -> DataFrame:
    """cluster_id and label, its heaviest terms by summed weight. clusters: doc_id, cluster_id."""
    return _labelled(weighted.join(clusters, "doc_id").groupBy("cluster_id", "term").agg(F.sum("weight").alias("total")), limit)


def _labelled(sums: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy(F.round("total", 9).desc(), "term")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " / ").alias("label"))


def simple_labels_of(docs: DataFrame, clusters: DataFrame, limit: int = 3) -> DataFrame:
    """simple_labels() of the TF-IDF weights of texts, by codes: only terms that may be among the heaviest are spelled out, each from a document that holds it."""
    sums = tfidf.coded_weights(docs).join(clusters, "doc_id").groupBy("cluster_id", "code").agg(F.sum("weight").alias("total"), F.min("doc_id").alias("doc_id"))
    order = Window.partitionBy("cluster_id").orderBy(F.round("total", 9).desc())
    near = stored(sums.withColumn("r", F.rank().over(order)).where(F.col("r") <= limit).drop("r"), "heaviest")
    return _labelled(tfidf.spelled(near, docs), limit)


def described(docs: DataFrame, between: str):
    """Title, path and text of a document, as far as docs has them; nulls are empty."""
    return F.concat_ws(between, *[F.coalesce(c, F.lit("")) for c in ("title", "relative_path", "text") if c in docs.columns])


def _telling(word: str) -> tuple[bool, bool]:
    """Of a label's word: whether it has three letters or more that are not generic, and whether it has more than digits; informative() asks for both."""
    parts = re.findall(WORD, word)
    return any(len(p) > 2 and p not in GENERIC_TERMS for p in parts), any(not p.isdigit() for p in parts)


def _batch_counts(clusters: DataFrame, key: str, emit, schema: str) -> DataFrame:
    """emit() of the counted terms of each batch's words: (clusters, words as an array, whether a word is telling (two flags), cluster, first, second (-1: none), tf)."""
    ship(clusters.sparkSession)
    gone = set(stop_words())
    words = clusters.select(key, F.regexp_extract_all(F.lower(described(clusters, "\n")), F.lit(LABEL_TOKEN), F.lit(0)).alias("words"))

    def run(batches):
        for batch in (part for whole in batches for part in tfidf.slices(whole, 1, WORDS)):
            offsets, values = tfidf.listed(batch.column(1))
            owner = batch.column(0).dictionary_encode(null_encoding="encode")
            coded = values.dictionary_encode()
            known = coded.dictionary.to_pylist()
            keep = np.array([w not in gone for w in known], bool)
            flags = np.array([_telling(w) for w in known], bool).reshape(-1, 2)
            word = coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            row, word = row[keep[word]], word[keep[word]]
            joined = np.flatnonzero(row[1:] == row[:-1])
            first, second = np.concatenate([word, word[joined]]), np.concatenate([np.full(len(word), -1), word[joined + 1]])
            cluster = owner.indices.to_numpy().astype(np.int64)[np.concatenate([row, row[joined]])]
            wide = len(known) + 1
            found, tf = np.unique((cluster * wide + first) * wide + second + 1, return_counts=True)
            second, first, cluster = found % wide - 1, found // wide % wide, found // wide // wide
            yield from emit(owner.dictionary, coded.dictionary, flags, cluster, first, second, tf)

    return words.mapInArrow(run, schema)


def _term_counts(clusters: DataFrame, key: str) -> DataFrame:
    """key, term, telling (as informative() says) and tf. Workers count the terms of a batch before any are shuffled."""
    kind = dict(clusters.dtypes)[key]

    def emit(owners, known, flags, cluster, first, second, tf):
        two = second >= 0
        text = known.take(pa.array(first))
        pairs = pc.binary_join_element_wise(text.filter(pa.array(two)), known.take(pa.array(second[two])), " ")
        telling = (flags[first] | (flags[second] & two[:, None])).all(axis=1) & (two | (pc.utf8_length(text).to_numpy() >= 3))
        for some, spelt in ((~two, text.filter(pa.array(~two))), (two, pairs)):
            yield pa.RecordBatch.from_arrays([owners.take(pa.array(cluster[some])), spelt, pa.array(telling[some]), pa.array(tf[some])], [key, "term", "telling", "tf"])

    counted = _batch_counts(clusters, key, emit, f"`{key}` {kind}, term string, telling boolean, tf long")
    return counted.groupBy(key, "term").agg(F.any_value("telling").alias("telling"), F.sum("tf").alias("tf"))


def _words_hashed(words: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) for w in words.to_pylist()], np.uint64)


def _scored_terms(clusters: DataFrame, limit: int, key: str) -> DataFrame:
    """Stored key, term, raw (tf * idf) of telling terms, of each cluster all that may be among the first; and key and square, whose sum is that of all its terms.

    The terms that a batch has of a cluster are sent as one text for each range of hashes, in which all counts of a term meet once.
    """
    kind = dict(clusters.dtypes)[key]
    # stored, so that what a join in clusters shuffles for it does not stay on disk
    sizes = stored(clusters.agg((F.count_distinct(key) + F.coalesce(F.max(F.col(key).isNull().cast("int")), F.lit(0))).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("letters")), "sizes")
    n, letters = sizes.first()
    discard(sizes)
    ranges = max(clusters.sparkSession.sparkContext.defaultParallelism, -(-letters // RANGE))

    def emit(owners, known, flags, cluster, first, second, tf):
        hashes, two = _words_hashed(known), second >= 0
        x = hashes[first] + np.where(two, hashes[second] * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at = tfidf.block_of((x ^ (x >> np.uint64(32))).view(np.int64), ranges)
        long = pc.utf8_length(known).to_numpy() >= 3 if len(known) else np.zeros(0, bool)
        telling = (flags[first] | (flags[second] & two[:, None])).all(axis=1) & (two | long[first])
        order = np.lexsort((~telling, at, cluster))
        cluster, at, telling, first, second, tf = (a[order] for a in (cluster, at, telling, first, second, tf))
        heads = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (at[1:] != at[:-1])])) if len(at) else np.zeros(0, np.int64)
        ends = np.append(heads, len(at))
        words = pa.concat_arrays([known, pa.array([""])])
        mixed = pc.binary_join_element_wise(words.take(pa.array(first)), pc.if_else(pa.array(second >= 0), pc.binary_join_element_wise(pa.scalar(" "), words.take(pa.array(np.where(second >= 0, second, len(known)))), ""), ""), "")
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), mixed), "\n")
        told = np.add.reduceat(telling.astype(np.int32), heads).astype(np.int32) if len(heads) else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([owners.take(pa.array(cluster[heads])), pa.array(at[heads]), texts, pa.array(told), tfidf.lists(tf.astype(np.int64), ends)], [key, "at", "terms", "told", "tf"])

    # scores are rounded to nine digits, and no cluster's norm is above its sum of weights
    slack = 1e-9 * letters * (math.log((1 + max(1, n)) / 2) + 1)

    def meet(table: pa.Table) -> pa.Table:
        owner = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        ends, tf = tfidf.listed(table.column("tf"))
        tf, sizes = tf.to_numpy(zero_copy_only=False), np.diff(ends)
        terms = pc.split_pattern(table.column("terms").combine_chunks(), "\n").flatten().dictionary_encode()
        term = terms.indices.to_numpy().astype(np.int64)
        told = np.arange(len(term)) - np.repeat(ends[:-1], sizes) < np.repeat(table.column("told").to_numpy(), sizes)
        wide = max(1, len(terms.dictionary))
        telling = np.zeros(wide, bool)
        telling[term[told]] = True
        found, back = np.unique(np.repeat(owner.indices.to_numpy().astype(np.int64), sizes) * wide + term, return_inverse=True)
        who, term = found // wide, found % wide
        raw = np.bincount(back, tf, len(found)) * (np.log((1 + n) / (1 + np.bincount(term, minlength=wide))) + 1)[term]
        squares = np.bincount(who, raw * raw, len(owner.dictionary)).astype(float)
        good = np.flatnonzero(telling[term])
        good = good[np.lexsort((-raw[good], who[good]))]
        begins = np.searchsorted(who[good], np.arange(len(owner.dictionary)))
        stops = np.append(begins[1:], len(good))
        # the least weight that counts: that of the last of the first ones
        least = np.where(stops - begins >= limit, np.append(raw[good], 0.0)[np.minimum(begins + limit - 1, len(good))], 0.0) - slack
        good = good[raw[good] >= least[who[good]]]
        none = lambda rows, of: pa.nulls(rows, of)
        kept, all_of = len(good), len(owner.dictionary)
        return pa.table({
            key: pa.concat_arrays([owner.dictionary.take(pa.array(who[good])), owner.dictionary]), "term": pa.concat_arrays([terms.dictionary.take(pa.array(term[good])), none(all_of, pa.string())]),
            "raw": pa.concat_arrays([pa.array(raw[good]), none(all_of, pa.float64())]), "square": pa.concat_arrays([none(kept, pa.float64()), pa.array(squares)]),
        })

    sent = _batch_counts(clusters, key, emit, f"`{key}` {kind}, at int, terms string, told int, tf array<long>")
    return stored(sent.groupBy("at").applyInArrow(meet, f"`{key}` {kind}, term string, raw double, square double"), "scored")


def cluster_terms(clusters: DataFrame, limit: int = 6, key: str = "cluster_id") -> DataFrame:
    """cluster_id, rank, term, score by TF-IDF with one row of counts for each cluster.

    clusters: cluster_id, text, and title and relative_path, whose words count too, if it has them. Each document's terms are counted by itself: a bigram over the end of one document and the start of the next, which
    joining the texts would add, does not count.
    """
    found = _scored_terms(clusters, limit, key)
    norms = found.groupBy(key).agg(F.sqrt(F.sum("square")).alias("norm"))
    scored = found.where("term is not null").join(norms, key).withColumn("score", F.round(F.col("raw") / F.col("norm"), 9))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(key, "rank", "term", F.round("score", 4).alias("score"))


def representatives(docs: DataFrame, label_terms: DataFrame, limit: int = 3) -> DataFrame:
    """cluster_id, rank, doc_id, score: how many of the cluster's terms a document holds, and up to 0.5 for its length.

    docs: cluster_id, doc_id, text, and title and relative_path, which are searched too and break ties, if it has them;
    label_terms: cluster_id and terms (array), one row a cluster.
    """
    tie = ["relative_path"] if "relative_path" in docs.columns else []
    lean = docs.select("cluster_id", "doc_id", *tie, F.lower(described(docs, " ")).alias("_all"), F.length(F.coalesce("text", F.lit(""))).alias("_n"))
    hits = F.aggregate(F.transform("terms", lambda t: F.contains("_all", t).cast("int")), F.lit(0), lambda acc, x: acc + x)
    scored = lean.join(label_terms, "cluster_id").select("cluster_id", "doc_id", *tie, F.round(hits + F.least(F.col("_n") / F.lit(10000.0), F.lit(0.5)), 4).alias("score"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc("score"), *tie, "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("cluster_id", "rank", "doc_id", "score")


def signatures(clusters: DataFrame) -> DataFrame:
    """cluster_id, size and signature of doc_id members, the digest of their sorted list as JSON.

    The ids of a cluster come sorted to one task, which digests them batch by batch: no list of all is ever held.
    """
    ship(clusters.sparkSession)
    kind = dict(clusters.dtypes)["cluster_id"]
    item = F.to_json(F.array(F.col("doc_id").cast("string")))
    rows = clusters.select("cluster_id", F.col("doc_id").cast("string").alias("i"), F.substring(item, 2, F.length(item) - 2).alias("item"))

    def run(batches):
        now, size, digest = None, 0, None

        def done():
            digest.update(b"]")
            return pa.RecordBatch.from_arrays([pa.array([now], schema[0].type), pa.array([size], pa.int64()), pa.array(["cluster_" + digest.hexdigest()[:16]])], ["cluster_id", "size", "signature"])

        schema = None
        for batch in batches:
            schema, ids, items = batch.schema, batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(ids):
                if digest is None or ids[at] != now:
                    if digest is not None:
                        yield done()
                    now, size, digest = ids[at], 0, hashlib.sha256(b"[")
                upto = next((k for k in range(at + 1, len(ids)) if ids[k] != now), len(ids))
                digest.update((("," if size else "") + ",".join(items[at:upto])).encode())
                size, at = size + upto - at, upto
        if digest is not None:
            yield done()

    dealt = rows.repartition("cluster_id").sortWithinPartitions("cluster_id", "i").select("cluster_id", "item")
    return dealt.mapInArrow(run, f"cluster_id {kind}, size long, signature string")


def apply_overrides(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """labels (signature, label) with display_label and source: a manual label for its signature wins."""
    manual = overrides.select("signature", "manual_label")
    joined = labels.join(manual, "signature", "left")
    return joined.select(*labels.columns, F.coalesce("manual_label", "label").alias("display_label"), F.when(F.col("manual_label").isNotNull(), "manual").otherwise("generated").alias("source"))


def manual_label(label: str) -> str:
    """One-spaced and 1 to MOST_LABEL_LENGTH characters long, or ValueError."""
    out = " ".join(label.split())
    if not 1 <= len(out) <= MOST_LABEL_LENGTH:
        raise ValueError(f"a label has 1 to {MOST_LABEL_LENGTH} characters")
    return out


def shared_terms(pairs: DataFrame, limit: int = 8) -> DataFrame:
    """pair_id, rank, term, score: terms of both texts by the product of their weights, fitted on the two texts alone.

    pairs: pair_id, side (two values), text.
    """
    counts = pairs.select("pair_id", "side", F.explode(terms(F.col("text"), LABEL_TOKEN, stop_words())).alias("term")).groupBy("pair_id", "side", "term").agg(F.count("*").alias("tf"))
    both = Window.partitionBy("pair_id", "term")
    raw = counts.withColumn("df", F.count("*").over(both)).withColumn("raw", F.col("tf") * (F.log(F.lit(3.0) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy("pair_id", "side").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    weighted = raw.where("df = 2").join(norms, ["pair_id", "side"]).groupBy("pair_id", "term").agg(F.exp(F.sum(F.log(F.col("raw") / F.col("norm")))).alias("product"))
    scored = weighted.where(informative(F.col("term"), of_label=False)).withColumn("score", F.round("product", 9))
    order = Window.partitionBy("pair_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("pair_id", "rank", "term", F.round("score", 4).alias("score"))


def chunk_matches(pairs: DataFrame, limit: int = 3) -> DataFrame:
    """pair_id, rank, source_chunk, target_chunk, score: the most similar chunks of the two texts, similar at all.

    pairs: pair_id, side ('source' or 'target'), text. TF-IDF is fitted on all chunks of both.
    """
    chunks = pairs.select("pair_id", "side", F.posexplode(window_chunks(F.col("text"))).alias("chunk", "text"))
    n = chunks.groupBy("pair_id").agg(F.count("*").alias("n"))
    counts = chunks.select("pair_id", "side", "chunk", F.explode(terms(F.col("text"), LABEL_TOKEN, stop_words())).alias("term")).groupBy("pair_id", "side", "chunk", "term").agg(F.count("*").alias("tf"))
    df = Window.partitionBy("pair_id", "term")
    raw = counts.withColumn("df", F.count("*").over(df)).join(n, "pair_id").withColumn("raw", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy("pair_id", "side", "chunk").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    weighted = raw.join(norms, ["pair_id", "side", "chunk"]).select("pair_id", "side", "chunk", "term", (F.col("raw") / F.col("norm")).alias("w"))
    side = lambda s: weighted.where(F.col("side") == s).select("pair_id", "term", F.col("chunk").alias(f"{s}_chunk"), F.col("w").alias(f"w_{s}"))
    scored = side("source").join(side("target"), ["pair_id", "term"]).groupBy("pair_id", "source_chunk", "target_chunk").agg(F.round(F.sum(F.col("w_source") * F.col("w_target")), 9).alias("score"))
    order = Window.partitionBy("pair_id").orderBy(F.desc("score"), "source_chunk", "target_chunk")
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("pair_id", "rank", "source_chunk", "target_chunk", F.round("score", 4).alias("score"))


def words_in_both(left, right, limit: int = 10):
    """Column: informative words of two texts, longest first."""
    words = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$")))
    both = F.array_except(F.array_intersect(words(left), words(right)), literal(list(GENERIC_TERMS)))
    ordered = F.array_sort(F.transform(both, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(ordered, lambda x: x["w"]), 1, limit)


def lexical_score(docs: DataFrame, source: int, target: int) -> DataFrame:
    """Cosine of two documents, fitted on the two alone."""
    two = docs.where(F.col("doc_id").isin(source, target))
    weighted = tfidf.weights(two, token=LABEL_TOKEN)
    return weighted.groupBy("term").agg(F.collect_list("weight").alias("w")).where(F.size("w") == 2).agg(F.round(F.coalesce(F.sum(F.element_at("w", 1) * F.element_at("w", 2)), F.lit(0.0)), 4).alias("score"))


def pair_scores(pairs: DataFrame) -> DataFrame:
    """pair_id and lexical_score, the cosine of the two sides fitted on them alone; no row where they share no term."""
    counts = pairs.select("pair_id", "side", F.explode(terms(F.col("text"), LABEL_TOKEN, stop_words())).alias("term")).groupBy("pair_id", "side", "term").agg(F.count("*").alias("tf"))
    both = Window.partitionBy("pair_id", "term")
    raw = counts.withColumn("df", F.count("*").over(both)).withColumn("raw", F.col("tf") * (F.log(F.lit(3.0) / (1 + F.col("df"))) + 1))
    norms = raw.groupBy("pair_id", "side").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")).groupBy("pair_id").agg(F.product("norm").alias("norms"))
    shared = raw.where("df = 2").groupBy("pair_id", "term").agg(F.product("raw").alias("p")).groupBy("pair_id").agg(F.sum("p").alias("dot"))
    return shared.join(norms, "pair_id").select("pair_id", F.round(F.col("dot") / F.col("norms"), 4).alias("lexical_score"))
