"""Rule statistics of whole texts and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every document's words and word pairs are hashed to BUCKETS buckets. Counts over all documents give the raw multinomial,
those over documents of the target (label quality = 1) the trusted one, both smoothed by ALPHA. A document's score is
the mean over its n-grams of log(target / raw); it is kept unless a base rule fails or the score is under THRESHOLD.

Results: rows without doc_id are dropped; a null or empty text has zero everywhere, fails the base rules and scores 0;
each of several rows with one doc_id gets its own result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import runtime
from lexatlas.llm.textkernel import SPACE, U, Words, mix, of_batches, slices, text_buffers

BUCKETS, ALPHA, THRESHOLD = 1 << 16, 1.0, -0.2
WINDOW, FEWEST_WORDS, MOST_REPEATED = 8, 20, 30
PARTS = 64
#: Characters that count as symbols. Fixed values.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def keyed(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that tell documents apart."""
    return mix(hashes + doc.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))


def duplicate_lines(words: Words) -> np.ndarray:
    """Of each document: lines with a word that equal an earlier one, byte for byte."""
    data, off = words.data, words.offsets
    out = np.zeros(len(off) - 1, np.int64)
    for d in np.flatnonzero(per_document(data == 0x0A, off)):
        lines = [x for x in data[off[d] : off[d + 1]].tobytes().split(b"\n") if x.strip()]  # strip() takes off just the white space between words
        out[d] = len(lines) - len(set(lines))
    return out


def repeated_words(words: Words, n: int) -> np.ndarray:
    """Of each document: words that lie in an n-word window which occurs twice or more in it."""
    hashes, valid = words.windows(n)
    at = np.flatnonzero(valid)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if len(at):
        key = keyed(hashes[at], words.doc[at])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + n, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return per_document(inside, words.first)


def statistics(words: Words) -> dict[str, np.ndarray]:
    data, off = words.data, words.offsets
    return {
        "n_words": words.count.astype(np.int64), "word_chars": per_document(_FIRST_BYTE[data] & ~SPACE[data], off), "n_symbols": per_document(_SYMBOL[data], off),
        "n_dup_lines": duplicate_lines(words), "n_repeat_words": repeated_words(words, WINDOW),
    }


def gram_buckets(words: Words, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the words and of the word pairs of a run."""
    pairs, valid = words.windows(2)
    return [((words.hash & U(buckets - 1)).astype(np.int64), words.doc), ((pairs[valid] & U(buckets - 1)).astype(np.int64), words.doc[valid])]


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> np.ndarray:
    """Counts of each bucket over all documents and over those of the target (2 x buckets; a fixed size, whatever the input)."""
    texts = runtime.id_text(docs)
    named = trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("trusted")).distinct()
    flagged = texts.join(named.hint("merge"), "doc_id", "left").select("text", "trusted")  # the target grows with the corpus: the same plan at every size

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            target = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for a, b in slices(off):
                words = Words(data[off[a] : off[b]], off[a : b + 1] - off[a], lower=True)
                for bucket, doc in gram_buckets(words, buckets):
                    total[0] += np.bincount(bucket, minlength=buckets)
                    total[1] += np.bincount(bucket[target[a:b][doc]], minlength=buckets)
        parts = np.split(total, PARTS, axis=1)
        yield pa.RecordBatch.from_pydict({"part": list(range(PARTS)), "counts": [p.tobytes() for p in parts]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"part": table.column("part")[:1], "counts": [total.tobytes()]})

    rows = flagged.mapInArrow(run, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary").collect()
    out = np.zeros((2, buckets), np.int64)
    for part, counts in rows:
        width = buckets // PARTS
        out[:, part * width : (part + 1) * width] = np.frombuffer(counts, np.int64).reshape(2, width)
    return out


def log_ratio(counts: np.ndarray, alpha: float) -> np.ndarray:
    smooth = (counts + alpha) / (counts + alpha).sum(axis=1, keepdims=True)
    return np.log(smooth[1]) - np.log(smooth[0])


def score_documents(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score.

    trusted: doc_id of the documents that make the target.
    """
    weights = log_ratio(bucket_counts(docs, trusted, buckets), alpha)

    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            found: dict[str, list] = {k: [] for k in (*COUNTS, "score")}
            for a, b in slices(off):
                run_data, run_off = data[off[a] : off[b]], off[a : b + 1] - off[a]
                exact = Words(run_data, run_off, lower=False)
                for k, v in statistics(exact).items():
                    found[k].append(v)
                total, n = np.zeros(b - a), np.zeros(b - a, np.int64)
                for bucket, doc in gram_buckets(Words(run_data, run_off, lower=True), buckets):
                    total += np.bincount(doc, weights[bucket], b - a)
                    n += np.bincount(doc, minlength=b - a)
                found["score"].append(total / np.maximum(n, 1))
            columns = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}
            failed = (columns["n_words"] < FEWEST_WORDS) | (100 * columns["n_repeat_words"] > MOST_REPEATED * columns["n_words"])
            kept = ~failed & (columns["score"] >= threshold)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{k: columns[k] for k in COUNTS}, "base_failed": failed, "kept": kept, "score": columns["score"].astype(np.float64)})

    return runtime.id_text(docs).mapInArrow(of_batches(run), f"doc_id long, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, kept boolean, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    """The digest query over documents, with documents labelled quality = 1 as the target: see score_documents."""
    docs, labels = runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "labels")
    return score_documents(docs.select("doc_id", "text"), labels.where("quality = 1").select("doc_id"))
