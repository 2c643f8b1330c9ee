"""Queries and scores against SQLite's FTS5, for rows read at once and for the stored index as it changes."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexatlas.functions.text import match_excerpt
from lexatlas.operators import fts, index

COLUMNS = ("document_id", "title", "relative_path", "text")
random.seed(8)
WORDS = ["alpha", "alphabet", "beta", "Bêta", "gamma", "delta", "alp", "foo_bar", "x1"]
ROWS = [(f"d{k:02d}", " ".join(random.choices(WORDS, k=random.randint(0, 3))), f"{random.choice(WORDS)}/{k}.txt", " ".join(random.choices(WORDS, k=random.randint(0, 14)))) for k in range(24)]
ROWS += [("d90", None, "n/90.txt", ""), ("d91", "", "n/91.txt", None), ("d92", "alpha. beta", "n/92.txt", "alpha " * 40 + "beta")]
SCHEMA = "document_id string, title string, relative_path string, text string"


def fts5(rows):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(document_id UNINDEXED, title, relative_path, text)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)

    def ask(query):
        return sorted((i, round(s, 8)) for i, s in con.execute("SELECT document_id, bm25(t) FROM t WHERE t MATCH ?", (query,)))

    return ask


def phrase():
    made = random.choice([lambda: random.choice(WORDS), lambda: f'"{random.choice(WORDS)} {random.choice(WORDS)}"', lambda: f"{random.choice(['a', 'al', 'alp', 'bet', 'f'])}*", lambda: f'"{random.choice(WORDS)} al" *', lambda: f"{random.choice(WORDS)} + {random.choice(WORDS)}"])()
    return "^" + made if random.random() < 0.1 else made


def group():
    if random.random() < 0.2:
        return "NEAR({}{})".format(" ".join(random.choice(WORDS) for _ in range(random.randint(1, 2))), random.choice(["", ", 2", ", 0"]))
    return random.choice(["", "", "", "text:", "title : ", "{title text}:", "-text:", "- {title relative_path} : "]) + phrase()


def expression(depth):
    if depth == 0 or random.random() < 0.3:
        return " ".join(group() for _ in range(random.choice([1, 1, 2])))
    if random.random() < 0.2:
        return f"{random.choice(['', 'text:', 'title:'])}({expression(depth - 1)})"
    return f"{expression(depth - 1)} {random.choice(['AND', 'OR', 'NOT'])} {expression(depth - 1)}"


FIXED = ['erst*', '"alpha beta"', "alp*", "title:beta", "alpha beta", "foo_bar", "NEAR(alpha beta gamma, 3)", "alpha OR alpha", '"" alpha', '"" AND alpha', '""', "alpha NOT beta gamma", "document_id:d01", "NEAR", "near alpha", "text:(alpha OR title:beta)", "^alpha", "alpha AND (beta)"]
BAD = ["foo-bar", "C++", '"open', "foo AND", "  ", "alpha (beta)", "nothing:alpha", "NEAR(alpha, x)", "foo(bar)", "*a", "a b)", "alpha AND OR beta", "- alpha", "^NEAR(a b)", "a , b"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], SCHEMA + ", length int").repartition(2).cache()


def answer(found, stats, query):
    return sorted((r.document_id, round(r.score, 8)) for r in fts.ranked(found, stats, query, "document_id").collect())


def test_grammar_and_scores_of_fts5(spark, docs):
    ask = fts5(ROWS)
    stats = fts.statistics(docs, COLUMNS[1:]).cache()
    for text in FIXED + [expression(2) for _ in range(24)]:
        try:
            want = ask(text)
        except sqlite3.OperationalError:
            with pytest.raises(fts.QueryError):
                fts.parse(text, COLUMNS)
            continue
        query = fts.parse(text, COLUMNS)
        assert answer(fts.occurrences(docs, query, COLUMNS[1:], "document_id"), stats, query) == want, text


def test_what_is_no_query():
    ask = fts5(ROWS)
    for text in BAD:
        with pytest.raises(fts.QueryError):
            fts.parse(text, COLUMNS)
        with pytest.raises(sqlite3.OperationalError):
            if not ask(text):  # a blank one raises in some versions, and finds nothing in others
                raise sqlite3.OperationalError


QUESTIONS = ["alpha", '"alpha beta"', "alp*", "title:beta OR text:\"foo bar\"", "NEAR(alpha gamma, 2) NOT delta", "al* AND bet*"]


def check(spark, folder, rows, turn=[0]):
    """Two of the questions, others each time."""
    ask, turn[0] = fts5(rows), turn[0] + 2
    for text in (QUESTIONS + QUESTIONS)[turn[0] % 6 :][:2]:
        found = index.matches(spark, folder, text)
        got = [] if found is None else sorted((r.document_id, round(r.score, 8)) for r in found.collect())
        assert got == ask(text), text


def test_index_follows_changes(spark, docs, tmp_path):
    folder = str(tmp_path / "index")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    now = {r[0]: r for r in ROWS}
    check(spark, folder, [])
    index.write(spark, folder, docs.drop("length"), ranges=5)
    check(spark, folder, list(now.values()))
    edited = [(i, "alpha beta", p, "beta alpha beta") for i, _, p, _ in ROWS[3:9]]
    index.write(spark, folder, frame([*edited, ("e1", "new", "e1.txt", "alpha gamma alpha")]), frame([(i, None, None, None) for i in ("d10", "d92", "nobody")]).select("document_id"))
    now |= {r[0]: r for r in edited} | {"e1": ("e1", "new", "e1.txt", "alpha gamma alpha")}
    del now["d10"], now["d92"]
    check(spark, folder, list(now.values()))
    # only rows that are not there come in; the others keep what was indexed
    back = [ROWS[10], ("d03", "alpha", "other.txt", "alpha"), ("e2", "beta", "e2.txt", "alphabet")]
    assert sorted(r.document_id for r in index.unindexed(spark, folder, frame(back)).collect()) == ["d10", "e2"]
    index.backfill(spark, folder, frame(back))
    now |= {"d10": ROWS[10], "e2": back[2]}
    check(spark, folder, list(now.values()))
    index.write(spark, folder, removes=frame(back).select("document_id").where("document_id = 'e2'"))
    del now["e2"]
    assert len(index.Current(spark, folder).segments) == 3  # the segment of e2 keeps d10
    index.merge(spark, folder, most=1)
    assert len(index.Current(spark, folder).segments) == 1
    check(spark, folder, list(now.values()))
    index.discard_old(spark, folder)
    assert [len(list((tmp_path / "index" / x).iterdir())) for x in ("segments", "pointers")] == [1, 1]
    check(spark, folder, list(now.values()))
    index.write(spark, folder, removes=frame(list(now.values())).select("document_id"))
    check(spark, folder, [])
    with pytest.raises(ValueError):
        index.write(spark, folder, frame([ROWS[0], ROWS[0]]))


def test_search_reads_only_its_ranges(spark, docs, tmp_path):
    folder = str(tmp_path / "index")
    index.write(spark, folder, docs.drop("length"), ranges=6)
    current = index.Current(spark, folder)
    bounds = current.part(current.segments[0][0], "bounds").collect()
    assert len(bounds) > 3
    for wanted, begun in ((["gamma"], []), ([], ["del"]), (["x1"], ["foo"])):
        plan = current.postings(wanted, begun)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        held = {r.bucket for r in bounds if any(r.first <= w <= r.last for w in wanted) or any(r.first[: len(b)] <= b <= r.last for b in begun)}
        assert len(held) < len(bounds)
        terms = {r.term for r in current.postings(wanted, begun).select("term").collect()}
        every = {r.term for r in current.postings().select("term").collect()}
        assert terms == {t for t in every if t in wanted or any(t.startswith(b) for b in begun)}


def test_shown_documents(spark, docs, tmp_path):
    folder = str(tmp_path / "index")
    index.write(spark, folder, docs.drop("length"))
    state = docs.withColumn("status", F.when(F.col("document_id") < "d05", "missing").when(F.col("document_id") < "d08", "unindexed").otherwise("active"))
    direct = state.withColumnRenamed("document_id", "doc_id").drop("length")
    for text in ("alpha beta", "foo-bar C++", "--"):
        for missing in (False, True):
            stored = [tuple(r) for r in index.search(spark, folder, state, text, 5, missing).orderBy("rank").collect()]
            assert [(r[0], r[1], round(r[4], 9)) for r in stored] == [(r.rank, r.doc_id, round(r.score, 9)) for r in fts.search(direct, text, 5, missing).orderBy("rank").collect()]
            assert all(missing or i >= "d08" for _, i, *_ in stored)
    assert fts.search(direct, "alpha", 0).count() == 0


def test_excerpts_of_fts5(spark):
    random.seed(21)
    texts = [" ".join(random.choice(["alpha", "béta", "gamma"] + ["w", "x", "yes", "no", "z."] * 6) + random.choice(["", "", "", ",", ".", ":", "!", " -"]) for _ in range(random.randint(1, 70))) for _ in range(150)]
    texts += ["  (alpha) beta.", "alpha", "w " * 40 + "alpha  ", "one. two: " * 20 + "gamma. alpha beta"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text)")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", enumerate(texts))
    want = dict(con.execute("SELECT rowid, snippet(t, 0, '[', ']', ' ... ', 16) FROM t WHERE t MATCH 'alpha OR beta OR gamma'"))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.s for r in docs.select("id", match_excerpt(F.col("text"), ["alpha", "beta", "gamma"]).alias("s")).collect()}
    assert {k: got[k] for k in want} == want and len(want) > 100


def test_excerpts_look_sentences_up_once(spark):
    """The beginning of a hit's sentence is looked up once a hit, not in every comparison with the hits near it."""
    shown = spark.createDataFrame([("a",)], "text string").select(match_excerpt(F.col("text"), ["alpha"]).alias("s"))
    assert shown._jdf.queryExecution().analyzed().expressions().mkString().count("array_max(") == 1
