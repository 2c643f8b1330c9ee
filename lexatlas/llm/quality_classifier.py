"""Positive-unlabelled quality classifier: non-negative unbiased risk, logistic loss.

Trusted positives are training rows labelled 1; unlabelled web text is a sample of all documents; the class prior is
the share of 1 among labelled training rows. With g the model and l the logistic loss, training minimises

    prior * mean_P l(g, +) + max(0, mean_U l(g, -) - prior * mean_P l(g, -))

(where the second term would go below zero, its gradient is followed upwards instead). Features come from the text
alone: rates of character classes and of their pairs, repetition of words, word triples and lines, case, word lengths.
Training reads at most MOST_POSITIVE and MOST_UNLABELLED rows, those with the least hashes of doc_id (ties: the smaller
doc_id first); scoring reads every document. The prior is kept within LEAST_PRIOR and 1 - LEAST_PRIOR.

Results: rows without doc_id are dropped; null and empty texts have zero features and get the model's score for these;
a label counts once for a doc_id (the largest, if several differ); without positives every score is the prior; without
labels the prior is 0.5. Extra columns are no inputs, whatever their names; keep() returns them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import runtime
from lexatlas.llm.quality_rules import duplicate_lines, keyed, per_document
from lexatlas.llm.textkernel import SPACE, Words, give_back, of_batches, slices, text_buffers

MOST_POSITIVE, MOST_UNLABELLED = 8_000, 12_000
#: Documents and bytes whose features are made at a time; rows of the sample that are prepared at a time.
SLICE_DOCS, FEATURE_BYTES, STEP_ROWS = 256, 1 << 19, 1024
LEAST_PRIOR = 0.05
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
STEPS, RATE, DECAY = 250, 0.05, 1e-4
KNOTS = (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98)

#: Character classes: lower, upper, digit, space, line feed, other white space, lead and later bytes of other letters, then single marks and the rest.
_MARKS = b".,;:!?|#*$%&<>()\"'-_/@+="
CLASSES = 9 + len(_MARKS)


def _class_table() -> np.ndarray:
    table = np.full(256, 8, np.uint8)
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[0x20], table[0x0A] = 3, 4
    table[[9, 11, 12, 13]] = 5
    table[0xC0:], table[0x80:0xC0] = 6, 7
    for k, mark in enumerate(_MARKS):
        table[mark] = 9 + k
    return table


_CLASS = _class_table()
DENSE = 12
WIDTH = DENSE + CLASSES + CLASSES * CLASSES
#: With the hinges of the dense features.
WIDE = WIDTH + DENSE * len(KNOTS)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x WIDTH."""
    n = len(offsets) - 1
    words = Words(data, offsets, lower=False)
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    cls = _CLASS[data].astype(np.int64)
    size = np.maximum(np.diff(offsets), 1)
    count = np.maximum(words.count, 1)
    single = np.bincount(doc_of_byte * CLASSES + cls, minlength=n * CLASSES).reshape(n, CLASSES)
    joined = np.flatnonzero(doc_of_byte[1:] == doc_of_byte[:-1])
    pair = np.bincount((doc_of_byte[joined] * CLASSES + cls[joined]) * CLASSES + cls[joined + 1], minlength=n * CLASSES**2).reshape(n, CLASSES**2)
    letters = np.maximum(single[:, 0] + single[:, 1] + single[:, 6], 1)

    def repeats(hashes, doc):
        if not len(hashes):
            return np.zeros(n)
        _, first = np.unique(keyed(hashes, doc), return_index=True)
        total = np.bincount(doc, minlength=n)
        return (total - np.bincount(doc[first], minlength=n)) / np.maximum(total, 1)

    triples, valid = words.windows(3)
    follows = np.zeros(len(words.hash), bool)
    follows[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    first_class = _CLASS[data[words.start]] if len(words.start) else np.zeros(0, np.uint8)
    last_class = _CLASS[data[words.end - 1]] if len(words.end) else first_class
    lines = single[:, 4] + 1
    dense = np.stack([
        np.log1p(np.diff(offsets)) / 10, per_document(~SPACE[data], offsets) / count / 10, single[:, 1] / letters, repeats(words.hash, words.doc), repeats(triples[valid], words.doc[valid]),
        per_document(follows, words.first) / count, duplicate_lines(words) / lines, np.minimum(count / lines, 200) / 100, per_document(first_class == 1, words.first) / count,
        per_document(first_class > 7, words.first) / count, per_document(last_class > 7, words.first) / count, single[:, 2] / size,
    ], axis=1)
    return np.concatenate([dense, np.sqrt(single / size[:, None]), np.sqrt(pair / size[:, None])], axis=1).astype(np.float32)


def batch_features(column: pa.Array):
    data, off = text_buffers(column)
    for a, b in slices(off, FEATURE_BYTES, SLICE_DOCS):
        yield features(data[off[a] : off[b]], off[a : b + 1] - off[a])


class Model:
    """Standardised features and hinges of the dense ones, linear, logistic."""

    def __init__(self, *samples: np.ndarray):
        """Means and scales of the rows of all samples, a few rows at a time."""
        self.knots = np.quantile(np.concatenate([x[:, :DENSE] for x in samples]), KNOTS, axis=0).astype(np.float32)
        n = sum(map(len, samples))
        mean = sum((wide.sum(axis=0, dtype=np.float64) for wide in self._steps(samples)), np.zeros(WIDE)) / n
        spread = sum((np.square(wide - mean).sum(axis=0) for wide in self._steps(samples)), np.zeros(WIDE)) / n
        self.mean, self.scale = mean.astype(np.float32), np.maximum(np.sqrt(spread), 1e-3).astype(np.float32)
        self.weights, self.bias = np.zeros(WIDE, np.float32), 0.0

    def _steps(self, samples):
        for x in samples:
            for k in range(0, len(x), STEP_ROWS):
                yield self._hinges(x[k : k + STEP_ROWS, :WIDTH])

    def _hinges(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.maximum(x[:, None, :DENSE] - self.knots, 0).reshape(len(x), -1)], axis=1)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        out = self._hinges(x)
        out -= self.mean
        out /= self.scale
        return np.clip(out, -8, 8, out=out)

    def fill(self, x: np.ndarray) -> np.ndarray:
        """Turn rows of WIDE columns, the first WIDTH of them features, into the model's inputs in place."""
        for k in range(0, len(x), STEP_ROWS):
            x[k : k + STEP_ROWS] = self.inputs(x[k : k + STEP_ROWS, :WIDTH])
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights + self.bias, -30, 30).astype(np.float64)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """Of the scores before the logistic function: the two terms of the non-negative risk, the second before it is cut at zero."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def risk_steps(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives to step along: of the risk, or of minus its second term where that is below zero."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    as_positive, as_negative = prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if risk(zp, zu, prior)[1] >= 0:
        return -as_positive - prior * (1 - sigmoid(zp)) / len(zp), as_negative
    return as_positive, -as_negative


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Model:
    """Minimise the non-negative risk by Adam over the whole sample. The samples (rows of WIDE columns) become the inputs, in place."""
    model = Model(positive, unlabelled)
    p, u = model.fill(positive), model.fill(unlabelled)
    model.bias = float(np.log(prior / (1 - prior)))
    first, second = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for t in range(1, steps + 1):
        dp, du = risk_steps(p @ model.weights + model.bias, u @ model.weights + model.bias, prior)
        gradient = np.append(p.T @ dp.astype(np.float32) + u.T @ du.astype(np.float32) + DECAY * model.weights, dp.sum() + du.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = RATE / (1 + t / 100) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        model.weights = (model.weights - move[:-1]).astype(np.float32)
        model.bias -= float(move[-1])
    return model


def fold(column="doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def _sample_features(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents with some ids (as many as a sample's bound at most), in rows of WIDE columns of which the first WIDTH are filled."""

    def run(batches):
        for batch in batches:
            for x in batch_features(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "n": [len(x)]})

    chosen = runtime.stored(docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text").mapInArrow(of_batches(run), "x binary, n long"), "sample")
    out = np.empty((chosen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], WIDE), np.float32)
    at = 0
    for r in chosen.toLocalIterator():  # one partition at a time, straight into place
        out[at : at + r.n, :WIDTH] = np.frombuffer(r.x, np.float32).reshape(-1, WIDTH)
        at += r.n
    runtime.discard(chosen)
    # rows arrive in any order; sums should not depend on it
    order = np.lexsort((out[:, 3], out[:, 1], out[:, 0]))
    for k in range(0, WIDTH, 64):
        out[:, k : k + 64] = out[order, k : k + 64]
    return out


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[Model | None, float]:
    """(model, prior) learnt from labels (doc_id, quality) of training rows."""
    texts = runtime.id_text(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality in (0, 1)").where(fold() != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg("quality"), F.count("*")).first()
    prior = float(np.clip(share[0] if share[0] is not None else 0.5, LEAST_PRIOR, 1 - LEAST_PRIOR))
    bounded = lambda ids, salt, most: ids.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(most)
    positive = _sample_features(texts, bounded(known.where("quality = 1"), 1, most_positive))
    unlabelled = _sample_features(texts, bounded(texts, 2, most_unlabelled))
    if not len(positive) or not len(unlabelled):
        return None, prior
    model = train(positive, unlabelled, prior)
    del positive, unlabelled
    give_back()
    return model, prior


def score(docs: DataFrame, model: Model | None, prior: float) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches):
        for batch in batches:
            scores = [np.full(len(x), prior) if model is None else model.score(x) for x in batch_features(batch.column(1))]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": np.concatenate(scores) if scores else np.zeros(0)})

    return runtime.id_text(docs).mapInArrow(of_batches(run), "doc_id long, score double")


def keep(docs: DataFrame, model: Model | None, prior: float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            scores = [np.full(len(x), prior) if model is None else model.score(x) for x in batch_features(batch.column(at))]
            yield batch.filter(pa.array((np.concatenate(scores) if scores else np.zeros(0)) >= threshold))

    return docs.mapInArrow(of_batches(run), docs.schema)


def op7(spark, sf_dir: str) -> DataFrame:
    """The digest query: every document's score, learnt from labels of rows that aren't held out."""
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text")
    model, prior = fit(docs, runtime.table(spark, sf_dir, "labels"))
    scored = score(docs, model, prior)
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
