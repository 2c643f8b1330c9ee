"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

Features are the square roots of the shares of hashed byte n-grams (2 to 4 bytes) of the whole lower-cased text, in which
every run of ASCII characters that are no letters is one space. Languages whose mean features, less those of all languages,
are most alike are joined, by the average similarity of their groups, until about as many families remain as the square
root of the number of languages; given families may be used instead. A softmax model tells families; within a family each
pair of languages has a machine (squared hinge loss), the language with most votes wins (ties: the larger sum of margins,
then the smaller name).

Training reads, of the documents with a language and a letter, at most MOST_PER_LANGUAGE of each language, those with the
least hashes of doc_id, and MOST_ROWS / languages where that is less; prediction reads every document whole.

Results: rows without doc_id are dropped; a null text and one without a letter get UNKNOWN and score 0, and so does every
text where nothing was learnt; repeated rows are kept, each with its own result; if one doc_id has several texts or
languages, each row counts for training; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.llm import runtime
from lexatlas.llm.textkernel import give_back, of_batches, slices, text_buffers

UNKNOWN = "und"
MOST_PER_LANGUAGE, MOST_ROWS = 1000, 8000
FOLDS, HELD_OUT = 5, 0
SIZES, BITS = (2, 3, 4), 12
WIDTH = 1 << BITS
SLICE_DOCS, SLICE_BYTES = 256, 1 << 19
STEPS, RATE, DECAY = 200, 0.05, 1e-5
#: Features are small: the models see them times this.
SCALE = 20.0

#: Bytes that stay: ASCII letters in lower case and all bytes of other characters; the rest becomes a space.
_FOLDED = np.full(256, 0x20, np.uint8)
_FOLDED[97:123] = np.arange(97, 123)
_FOLDED[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """documents x WIDTH, of lower-cased texts."""
    n = len(offsets) - 1
    folded = _FOLDED[data]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    space = folded == 0x20
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1] & (doc[1:] == doc[:-1]))
    folded, doc = folded[keep].astype(np.uint32), doc[keep]
    out = np.zeros(n * WIDTH)
    value = folded.copy()
    for k in range(1, max(SIZES)):
        if len(folded) <= k:
            break
        value = (value[:-1] << np.uint32(8)) | folded[k:]
        if k + 1 not in SIZES:
            continue
        inside = doc[: len(value)] == doc[k:]
        bucket = ((value ^ np.uint32(0x85EBCA6B * k & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out += np.bincount((doc[: len(value)] * WIDTH + bucket)[inside], minlength=n * WIDTH)
    out = out.reshape(n, WIDTH)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def batch_features(column: pa.Array):
    data, off = text_buffers(column)
    for a, b in slices(off, SLICE_BYTES, SLICE_DOCS):
        yield features(data[off[a] : off[b]], off[a : b + 1] - off[a])


def families_of(means: np.ndarray, names: list[str]) -> list[list[str]]:
    """Groups of the most alike languages, about the square root of their number."""
    groups = [[k] for k in range(len(names))]
    own = means - means.mean(axis=0)  # what all languages share says nothing of kinship
    unit = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    alike = unit @ unit.T
    while len(groups) > max(1, round(len(names) ** 0.5)):
        x, y = max(combinations(range(len(groups)), 2), key=lambda p: (alike[np.ix_(groups[p[0]], groups[p[1]])].mean(), -p[0], -p[1]))
        groups[x] = sorted(groups[x] + groups.pop(y))
    return [[names[k] for k in g] for g in groups]


def _descend(x: np.ndarray, width: int, slope) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of `width` linear outputs by Adam over all rows; slope(z): the loss's derivative by the outputs."""
    both = np.zeros((x.shape[1] + 1, width), np.float32)
    first, second = np.zeros_like(both), np.zeros_like(both)
    for t in range(1, STEPS + 1):
        d = slope(x @ both[:-1] + both[-1]).astype(np.float32)
        gradient = np.concatenate([x.T @ d + DECAY * both[:-1], d.sum(axis=0, keepdims=True)])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        both -= (RATE / (1 + t / 50) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return both[:-1], both[-1]


class Model:
    """Families by a softmax, pairs of a family's languages by linear support vector machines."""

    def __init__(self, x: np.ndarray, lang: np.ndarray, families: list[list[str]] | None = None):
        self.names = sorted(set(lang.tolist()))
        means = np.stack([x[lang == name].mean(axis=0) for name in self.names])
        self.families = [[n for n in f if n in self.names] for f in families] if families else families_of(means, self.names)
        self.families = [f for f in self.families if f] + [[n] for n in self.names if not any(n in f for f in self.families)]
        family_of = {name: k for k, f in enumerate(self.families) for name in f}
        own = np.array([family_of[name] for name in lang.tolist()])
        share = np.bincount(own, minlength=len(self.families))
        weight = (1 / np.maximum(share, 1) / len(self.families))[own][:, None]
        target = np.eye(len(self.families))[own]
        scaled = x * np.float32(SCALE)
        self.w, self.b = _descend(scaled, len(self.families), lambda z: weight * (_softmax(z) - target))
        self.pairs, machines = [], []
        for f in self.families:
            for one, two in combinations(f, 2):
                rows = np.flatnonzero((lang == one) | (lang == two))
                sign = np.where(lang[rows] == one, 1.0, -1.0)
                even = np.where(sign > 0, 0.5 / (sign > 0).sum(), 0.5 / (sign < 0).sum())
                w, b = _descend(scaled[rows], 1, lambda z, s=sign, e=even: (-2 * e * s * np.maximum(1 - s * z[:, 0], 0))[:, None])
                self.pairs.append((one, two))
                machines.append((w[:, 0], b[0]))
        self.pw = np.stack([w for w, _ in machines], 1) if machines else np.zeros((WIDTH, 0), np.float32)
        self.pb = np.array([b for _, b in machines], np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row, and its score: the family's probability times the mean certainty of the language's machines."""
        scaled = x * np.float32(SCALE)
        family = _softmax((scaled @ self.w + self.b).astype(np.float64))
        margins = (scaled @ self.pw + self.pb).astype(np.float64)
        best = family.argmax(axis=1)
        names, score = np.empty(len(x), object), family[np.arange(len(x)), best]
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            votes, sums, sure = (np.zeros((len(rows), len(f))) for _ in range(3))
            for p, (one, two) in enumerate(self.pairs):
                if one not in f:
                    continue
                m, a, b = margins[rows, p], f.index(one), f.index(two)
                for at, z in ((a, m), (b, -m)):
                    votes[:, at] += z > 0
                    sums[:, at] += z
                    sure[:, at] += 1 / (1 + np.exp(-np.clip(2 * z, -30, 30)))
            ranked = np.lexsort((-np.arange(len(f))[None, :].repeat(len(rows), 0), sums, votes), axis=1)[:, -1] if len(rows) else np.zeros(0, int)
            names[rows] = np.array(f, object)[ranked]
            if len(f) > 1:
                score[rows] *= sure[np.arange(len(rows)), ranked] / (len(f) - 1)
        return names.tolist(), score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def training_fold(column="doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS))


def _lowered(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the lower-cased text (null where nothing can be told) and other columns."""
    runtime.prepare(docs.sparkSession)
    text = F.when(F.col("text").rlike(r"\p{L}"), F.lower("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more).where("doc_id is not null")


def fit(docs: DataFrame, most_per_language: int = MOST_PER_LANGUAGE, most_rows: int = MOST_ROWS, families: list[list[str]] | None = None) -> Model | None:
    """A model of docs (doc_id, text, lang), or None if no row can be learnt from."""
    known = _lowered(docs.where("lang is not null"), "lang").where("text is not null").where(training_fold() != HELD_OUT)
    # only ids, hashes and languages meet here
    keys = runtime.stored(known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")), "languages")
    n = keys.select("lang").distinct().count()
    if not n:
        return None
    each = max(1, min(most_per_language, most_rows // n))
    # the share of rows that surely holds the least hashes goes to the windows, so that no language meets whole in one task
    counts = keys.groupBy("lang").agg(F.count("*").alias("n"))
    span = float(1 << 64)
    share = F.least(F.lit(1.0), (F.lit(2.0 * each) + 64) / F.col("n"))
    few = keys.join(F.broadcast(counts) if n <= most_rows else counts, "lang").where((F.col("h").cast("double") + span / 2) / span <= share)
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= each).select("doc_id", "lang")

    def run(batches):
        for batch in batches:
            at, names = 0, batch.column(1).to_pylist()
            for x in batch_features(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "lang": [names[at : at + len(x)]]}, schema=pa.schema([("x", pa.binary()), ("lang", pa.list_(pa.string()))]))
                at += len(x)

    picked = known.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi").select("text", "lang")
    found = runtime.stored(picked.mapInArrow(of_batches(run), "x binary, lang array<string>"), "sample")
    x, lang = np.empty((found.agg(F.coalesce(F.sum(F.size("lang")), F.lit(0))).first()[0], WIDTH), np.float32), []
    for r in found.toLocalIterator():  # one partition at a time, straight into place
        x[len(lang) : len(lang) + len(r.lang)] = np.frombuffer(r.x, np.float32).reshape(-1, WIDTH)
        lang += r.lang
    runtime.discard(found, keys)
    # rows arrive in any order; sums should not depend on it
    lang = np.array(lang, object)
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], x @ np.arange(WIDTH, dtype=np.float32), lang.astype(str)))
    model = Model(x[order], lang[order], families)
    give_back()
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""

    def run(batches):
        for batch in batches:
            told = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            names, score, at = np.full(len(told), UNKNOWN, object), np.zeros(len(told)), 0
            if model is not None:
                for x in batch_features(batch.column(1)):
                    names[at : at + len(x)], score[at : at + len(x)] = model.predict(x)
                    at += len(x)
            names[~told], score[~told] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": score})

    return _lowered(docs).mapInArrow(of_batches(run), "doc_id long, lang_pred string, score double")


def op12(spark, sf_dir: str) -> DataFrame:
    """The digest query: every document's language, learnt from rows that aren't held out."""
    docs = runtime.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, fit(docs))
    return found.select("doc_id", (training_fold() == HELD_OUT).alias("held_out"), "lang_pred", "score")
