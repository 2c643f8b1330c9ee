"""Periodic runs, language identification and the Merkle manifest against brute force, on awkward rows and on empty tables."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from lexatlas.llm import language_id, merkle_manifest, periodic_runs, runtime  # noqa: E402

random.seed(5)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, tree string, h string"


def words(n, kinds):
    return " ".join(random.choices("abcdefghijklmnopqrstuvwxyz"[:kinds], k=n))


TEXTS = (
    [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "a  b\na b a b\ta b", "x a b a b a b a b a y", "no-break space   é é é é é é É"]
    + [words(random.randint(1, 60), k) for k in (1, 2, 2, 2, 3, 3, 4) for _ in range(12)]
    + [(words(random.randint(2, 40), 5) + " ") * random.randint(4, 9) + words(9, 3) for _ in range(12)]
    + [" ".join(["ab"] * 3000), words(4000, 26) + " " + "p q r s t " * 700, ("a " * 7 + "b ") * 40]
)
ROWS = [(11 * k, t, [None, "de", "en", "", "=en"][k % 5], None if k % 4 == 0 else "s", None if k % 7 == 0 else k) for k, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(*r, 1, "x", "y") for r in [*ROWS, ROWS[9], ROWS[9], (None, "no id", "en", "s", 1)]]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def brute_runs(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs(docs):
    got = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect())
    want = []
    for i, t, *_ in [*ROWS, ROWS[9], ROWS[9]]:
        w = brute.WORD.findall(t or "")
        runs = brute_runs(w)
        want.append((i, len(w), runs, collapsed(w, runs)))
    assert got == sorted(want)
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0


@pytest.mark.parametrize("least, exponent", [(2, 2), (5, 3), (6, 4)])
def test_runs_of_every_short_text(least, exponent):
    texts = [w for n in range(1, 11) for w in itertools.product((0, 1), repeat=n)] + [tuple(random.choices(range(3), k=40)) for _ in range(300)]
    offsets = np.cumsum([0, *map(len, texts)])
    start, end, period = periodic_runs.runs_of(np.array([c for w in texts for c in w]), offsets, least, exponent)
    doc = np.searchsorted(offsets, start, "right") - 1
    got = {}
    for d, s, e, q in zip(doc, start - offsets[doc], end - offsets[doc], period):
        got.setdefault(int(d), []).append((int(s), int(e - s), int(q)))
    assert got == {k: runs for k, w in enumerate(texts) if (runs := brute_runs(w, least, exponent))}


def test_one_text_of_megabytes():
    """A long text with one word a third of the time, and a period of thousands of words."""
    rng = np.random.default_rng(3)
    part = rng.integers(1, 5000, 150_000)
    part[rng.random(len(part)) < 0.3] = 0
    codes = np.concatenate([part, np.tile(part[:20_011], 5), np.zeros(40_000, np.int64)])
    start, end, period = periodic_runs.runs_of(codes, np.array([0, len(codes)]))
    found = {(int(s), int(q)): int(e) for s, e, q in zip(start, end, period)}
    assert any(q == 20_011 and e - s >= 100_055 for (s, q), e in found.items())
    assert any(q == 1 and e == len(codes) for (s, q), e in found.items())
    for (s, q), e in found.items():
        assert (codes[s : e - q] == codes[s + q : e]).all() and (s == 0 or codes[s - 1] != codes[s - 1 + q]) and (e == len(codes) or codes[e] != codes[e - q])


def test_op11_tail():
    for k in range(300):
        w = [str(x).encode() for x in range(k % 23)]
        h, n = zlib.crc32(str(k).encode()), k % 23
        want = w
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert periodic_runs.periodic_tail(k, w) == want


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(level, f):
    return [sha(*level[k : k + f]) for k in range(0, len(level), f)]


def way(level, k, f):
    """Siblings of node k up to the root, and that root."""
    out = []
    while len(level) > 1:
        first = k // f * f
        out += [x for j, x in enumerate(level[first : first + f], first) if j != k]
        level, k = up(level, f), k // f
    return out, level[0]


def leaf(i, t, lang, source, n):
    return sha(field(i), field(source), field(lang), field(n), field(t))


def brute_manifest(rows, f):
    trees = {}
    for r in rows:
        trees.setdefault((r[2] is not None, (r[2] or "").encode()), []).append(((r[0] is not None, r[0] or 0), leaf(*r)))
    names = sorted(trees)
    roots = [way([x for _, x in sorted(trees[k])], 0, f)[1] for k in names]
    out = []
    for k, name in enumerate(names):
        level = [x for _, x in sorted(trees[name])]
        above, root = way(roots, k, f)
        for j, ((_, i), x) in enumerate(sorted(trees[name])):
            out.append((i, x, j, len(level), roots[k], root, "".join(way(level, j, f)[0] + above)))
    return sorted(out)


@pytest.mark.parametrize("fanout, levels", [(2, 12), (2, 2), (3, 1), (5, 3)])
def test_manifest(docs, fanout, levels):
    rows = [*ROWS, ROWS[9], ROWS[9], (None, "no id", "en", "s", 1)]
    shown = merkle_manifest.folded(merkle_manifest.manifest(docs, fanout, levels), "leaf", fanout).collect()
    got = sorted((r.doc_id or 0, r.leaf, r.pos, r.n, r.subroot, r.root, r.proof) for r in shown)
    assert got == brute_manifest(rows, fanout)
    assert all(r.folded_root == r.root for r in shown)


def test_manifest_sees_tampering(docs):
    rows = merkle_manifest.manifest(docs, other=F.sha2(F.lit("x"), 256))
    assert all(r.folded_root != r.root for r in merkle_manifest.folded(rows, "other").collect())
    assert merkle_manifest.manifest(docs.where("false")).count() == 0
    one = merkle_manifest.folded(merkle_manifest.manifest(docs.where("doc_id = 0")), "leaf").collect()
    assert [(r.leaf, r.root, r.proof, r.folded_root) for r in one] == [(one[0].leaf,) * 2 + ("", one[0].leaf)]


SYLLABLES = {"aa": "er the ing and", "ab": "er the ung und", "ba": "eau é le ción", "bb": "ado ñ la ción", "bc": "ado o ão da"}


def spoken(lang, n):
    return "".join(random.choice(SYLLABLES[lang].split()) + random.choice(["", "", " "]) for _ in range(n))


def test_language_id(spark):
    rows = [(k, spoken(lang, random.randint(30, 300)), lang) for k in range(600) for lang in [random.choice(list(SYLLABLES))]]
    odd = [(9000, None, "aa"), (9001, "", "aa"), (9002, " 12 !? ", "ab"), (9003, rows[0][1], None), (9003, rows[0][1], None), (9004, spoken("ba", 200_000), "ba"), (None, "the", "aa")]
    docs = spark.createDataFrame([(*r, 1) for r in rows + odd], "doc_id long, text string, lang string, h int").repartition(4)
    model = language_id.fit(docs)
    assert len(model.families) == 2 and ["aa", "ab"] in [sorted(f) for f in model.families]
    assert {frozenset(p) for p in model.pairs} == {frozenset(p) for f in model.families for p in itertools.combinations(f, 2)}
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()]
    assert len(got) == len(rows) + len(odd) - 1
    said = {i: (p, s) for i, p, s in got}
    assert [said[k] for k in (9000, 9001, 9002)] == [("und", 0.0)] * 3
    assert said[9003] == said[0] and said[9004][0] == "ba" and sum(i == 9003 for i, *_ in got) == 2
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(said[k][0] == rows[k][2] for k in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for *_, s in got)
    blind = docs.withColumn("lang", F.when(language_id.training_fold() != 0, F.col("lang")))
    assert sorted(r for r in language_id.predict(docs, language_id.fit(blind)).collect()) == sorted(r for r in language_id.predict(docs, model).collect())


def test_language_id_learns_nothing_or_one(spark):
    docs = spark.createDataFrame([(1, "the ing", None), (2, "and er", None)], "doc_id long, text string, lang string")
    assert language_id.fit(docs) is None and language_id.fit(docs.where("false")) is None
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, None).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(k, "the ing", "aa") for k in range(20)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.predict(one, language_id.fit(one)).collect()} == {("aa", 1.0)}
    assert language_id.predict(docs.where("false"), language_id.fit(one)).count() == 0


def test_op12_on_tables(spark, small_dir):
    truth = {r.doc_id: r.lang for r in runtime.table(spark, small_dir, "documents").collect()}
    rows = [r for r in language_id.op12(spark, small_dir).collect() if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.9 * len(rows) > 0


def test_words_part_at_ascii_space_only():
    for t in TEXTS:
        assert [w.decode() for w in (t or "").encode().split()] == re.findall(r"[^\x20\x09-\x0D]+", t or "")
