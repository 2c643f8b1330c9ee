"""Periodic runs of words, found with a suffix tree by Stoye and Gusfield's smaller-half traversal.

Words are maximal stretches of bytes that are no ASCII white space. A run of a text is a stretch of consecutive words
with smallest period q that no neighbouring word extends keeping that period, of at least LEAST_LENGTH words and of at
least LEAST_EXPONENT periods. The internal nodes of the suffix tree are the intervals of the suffix array whose suffixes
share their first D words. For each node the suffixes of all children but the largest are listed; a listed suffix i and
i + D (or i - D) in two different children of the node make a branching tandem repeat of period D: its two halves are
equal, and the word after it breaks the period. Rotating one to the left while the period holds gives the start of its
run; repeats that end in the same run (those of multiples of its period too) are merged, the least period stays.

Each text is handled whole, in one task; the trees of many texts are built together, as one array, about a megabyte of
text at a time (a longer text by itself, with some 200 bytes of memory a word).

Results: rows without doc_id are dropped; null, empty and blank texts have no words and no runs; repeated rows are kept,
each with its own result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import runtime
from lexatlas.llm.textkernel import of_batches, slices, text_buffers

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Suffixes of smaller children that are looked up at a time.
STEP = 1 << 20

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Suffixes:
    """Sorted suffixes of several texts of coded words; suffixes of two texts never share a word.

    ranks[k] tells, of any two places of one text, whether their next 2**k words are equal (a text's end equals nothing).
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        n = len(codes)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.first, self.end = offsets[:-1][doc], offsets[1:][doc]
        key = doc * (int(codes.max(initial=0)) + 1) + codes
        self.order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int32)
        open_ = np.arange(n)
        self.ranks, size = [], 1
        values = key[self.order]
        while True:
            # suffixes that are alike so far stand together, and take the place of the first of them as their rank
            head = np.ones(len(open_), bool)
            head[1:] = values[1:] != values[:-1]
            rank[self.order[open_]] = open_[np.maximum.accumulate(np.where(head, np.arange(len(open_)), 0))]
            self.ranks.append(rank.copy())
            alone = head.copy()
            alone[:-1] &= head[1:]
            open_ = open_[~alone]
            if not len(open_):
                break
            at = self.order[open_]
            after = np.where(at + size < self.end[at], rank[np.minimum(at + size, n - 1)] + 1, 0)
            values = rank[at].astype(np.int64) * (n + 1) + after
            sort = np.argsort(values, kind="stable")
            self.order[open_], values = at[sort], values[sort]
            size *= 2
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)

    def _descend(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        shared = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            rank, size = self.ranks[k], 1 << k
            x, y = (a - shared - size, b - shared - size) if back else (a + shared, b + shared)
            inside = (x >= self.first[a]) if back else (x < self.end[a]) & (y < self.end[b])
            equal = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
            shared[equal] += size
        return shared

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from the places a and b (pairs of one text, a and b different) on."""
        return self._descend(a, b, False)

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words that end just before the places a < b."""
        return self._descend(a, b, True)

    def shared_with_last(self) -> np.ndarray:
        """Of each suffix in order, the words it shares with the one before; 0 at both ends."""
        out = np.zeros(len(self.order) + 1, np.int64)
        base = self.ranks[0][self.order]
        same = np.flatnonzero(base[1:] == base[:-1]) + 1
        out[same] = self.common(self.order[same - 1], self.order[same])
        return out


def _reach(shared: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each border at: the interval [low, high) of suffixes around it that share at least shared[at] words."""
    zero = np.flatnonzero(shared == 0)
    levels = int(np.diff(zero).max(initial=1)).bit_length()
    least = [shared]
    for k in range(levels):
        last, size = least[-1], 1 << k
        least.append(np.minimum(last[:-size], last[size:]) if len(last) > size else last[:0])
    depth, low, high = shared[at], at.copy(), at + 1
    for k in range(levels, -1, -1):
        size, row = 1 << k, least[k]
        if not len(row):
            continue
        ok = low >= size
        ok &= row[np.where(ok, low - size, 0)] >= depth
        low[ok] -= size
        ok = high + size <= len(shared)
        ok &= row[np.where(ok, high, 0)] >= depth
        high[ok] += size
    return low - 1, high


def _smaller_children(shared: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """low, high, depth of a node and [begin, end) of a child, for all children of the nodes of the borders at but a largest one of each node."""
    low, high = _reach(shared, at)
    order = np.lexsort((at, high, low))
    at, low, high = at[order], low[order], high[order]
    head = np.ones(len(at), bool)
    head[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    node = np.cumsum(head) - 1
    begin = np.where(head, low, np.roll(at, 1))
    last = np.roll(head, -1)
    begin, end, node = np.concatenate([begin, at[last]]), np.concatenate([at, high[last]]), np.concatenate([node, node[last]])
    largest = np.lexsort((begin - end, node))
    lead = np.ones(len(largest), bool)
    lead[1:] = node[largest][1:] != node[largest][:-1]
    take = largest[~lead]
    depth = shared[at[head]]
    return low[head][node[take]], high[head][node[take]], depth[node[take]], begin[take], end[take]


def branching_repeats(suffixes: Suffixes, least_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of branching tandem repeats, those of periods that are too long for a run of their text left out."""
    n = len(suffixes.order)
    shared = suffixes.shared_with_last()
    at = np.flatnonzero(shared)
    text = suffixes.order[at]
    at = at[shared[at] * least_exponent <= suffixes.end[text] - suffixes.first[text]]
    if not len(at):
        return at, at
    low, high, depth, begin, end = _smaller_children(shared, at)
    upto, found = np.concatenate([[0], np.cumsum(end - begin)]), []
    for x in range(0, int(upto[-1]), STEP):
        child = np.searchsorted(upto, np.arange(x, min(x + STEP, int(upto[-1]))), "right") - 1
        leaf = suffixes.order[begin[child] + np.arange(x, x + len(child)) - upto[child]]
        for way in (1, -1):
            other = leaf + way * depth[child]
            inside = (other >= 0) & (other < n)
            place = suffixes.place[np.where(inside, other, 0)]
            hit = inside & (place >= low[child]) & (place < high[child]) & ((place < begin[child]) | (place >= end[child]))
            found.append(np.minimum(leaf, other)[hit] * (n + 1) + depth[child][hit])
    both = np.unique(np.concatenate(found))
    return both // (n + 1), both % (n + 1)


def runs_of(codes: np.ndarray, offsets: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of coded words, by start, then period; offsets part the texts."""
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none
    suffixes = Suffixes(codes, offsets)
    place, period = branching_repeats(suffixes, least_exponent)
    if not len(place):
        return none, none, none
    start, end = place - suffixes.common_before(place, place + period), place + 2 * period
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    least &= end - start >= np.maximum(least_length, least_exponent * period)
    start, end, period = start[least], end[least], period[least]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _of_texts(texts: list[list[bytes]], least_length: int, least_exponent: int):
    """Of texts as lists of words: counts of runs, their starts (in the text), lengths, periods, and the texts without repeated periods."""
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
    code = defaultdict(count().__next__)
    codes = np.fromiter((code[w] for words in texts for w in words), np.int64, int(offsets[-1]))
    start, end, period = runs_of(codes, offsets, least_length, least_exponent)
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, end, -1)
    kept = np.cumsum(step[:-1]) == 0
    doc = np.searchsorted(offsets, start, "right") - 1
    counts = np.bincount(doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    cut = [b" ".join(compress(words, kept[a:b]) if counts[k] else words) for k, (words, a, b) in enumerate(zip(texts, offsets[:-1], offsets[1:]))]
    return np.diff(offsets), counts, start - offsets[doc], end - start, period, cut


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT, rewrite=None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; words numbered from 0) and the collapsed text of each document.

    collapsed joins by one space the words that no run contains after its first period. rewrite(doc_id, words), if given,
    makes the list of words that is looked at out of a text's words.
    """

    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            raw = data.tobytes()
            for a, b in slices(off):
                texts = [raw[off[k] : off[k + 1]].split() for k in range(a, b)]
                if rewrite is not None:
                    texts = [rewrite(i, words) for i, words in zip(ids[a:b], texts)]
                n_words, counts, start, length, period, cut = _of_texts(texts, least_length, least_exponent)
                fields = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), fields)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(n_words, pa.int64()), listed, pa.array(cut, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return runtime.id_text(docs).mapInArrow(of_batches(run), RUNS)


def periodic_tail(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: in a tenth of the documents the words from one on repeat with a period."""
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole = words[a : a + p]
    return words[:a] + (whole * (-(-(n - a) // p)))[: n - a]


def op11(spark, sf_dir: str) -> DataFrame:
    """The digest query: number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(runtime.table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=periodic_tail)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return shown.select(
        "doc_id", "n_runs", F.col("r.start").alias("start"), (-F.col("r.less")).alias("length"), F.col("r.period").alias("period"),
        F.floor(-1000 * F.col("r.less") / F.col("r.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
