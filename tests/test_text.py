"""Text expressions and extractors on small cases."""

import pytest
from pyspark.sql import functions as F

from lexatlas.functions import text as T
from lexatlas.operators import fts
from lexatlas.sources import extract


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_normalised_and_first_line(spark):
    raw = "Title line\n\nLots   of\tspace."
    assert one(spark, T.normalised(F.col("t")), t=raw) == "Title line Lots of space."
    assert one(spark, T.first_line(F.col("t")), t="\n  \n" + raw) == "Title line"
    assert one(spark, T.first_line(F.col("t")), t=" \n ") is None
    assert extract.plain(raw, [], "a")["title"] == "Title line"


@pytest.mark.parametrize("size, overlap", [(10, 3), (5, 0), (7, 9), (1, 0), (100, 10)])
def test_window_chunks(spark, size, overlap):
    raw = "abcdefghij klmnopqrstuvwxyz0123"
    step = size - min(overlap, size - 1)
    want, at = [], 0
    while True:
        want.append(raw[at : at + size].strip(" "))
        if at + size >= len(raw):
            break
        at += step
    assert one(spark, T.window_chunks(F.col("t"), size, overlap), t=raw) == [c for c in want if c]
    assert one(spark, T.window_chunks(F.col("t"), size, overlap), t="") == []


def test_paragraph_chunks(spark):
    got = one(spark, T.paragraph_chunks(F.col("t"), 20, 4), t="first part\n\nsecond\n\nthird part here\n\n" + "x" * 45)
    assert got[0] == "first part\n\nsecond"
    assert got[1].startswith("cond\n\nthird") or got[1].startswith("ond\n\nthird")
    assert all("x" * 5 not in c for c in got[:2]) and got[-1].endswith("x")
    assert one(spark, T.paragraph_chunks(F.col("t"), 20, 4), t=" \n\n ") == []


def test_snippet_centres_on_the_earliest_hit_and_excerpt_on_the_first_term(spark):
    raw = "a " * 200 + "needle " + "b " * 200 + "other " + "c " * 200
    s = one(spark, T.snippet(F.col("t"), ["other", "needle"]), t=raw)
    assert "needle" in s and s.startswith("...") and s.endswith("...")
    e = one(spark, T.excerpt(F.col("t"), ["other", "needle"]), t=raw)
    assert "other" in e and "needle" not in e
    assert one(spark, T.snippet(F.col("t"), ["zzz"]), t="short") == "short"


def test_markdown():
    got = extract.markdown("---\ntopic: maps\ntags: [a, b]\nkeys:\n- lost\n---\n# Head #\n```python\n# no\n[x](y)\n```\nSee [[target|label]] and [t](u \"v\") ![i](p) [[plain]].", [], "stem")
    assert got["title"] == "Head"
    assert got["links"] == ["target", "plain", "u"]
    assert "maps a b" in got["text"] and "label" in got["text"] and "python" not in got["text"] and "lost" not in got["text"]
    assert got["sections"] == ["Head"]
    spaced = extract.markdown("---\n- a: one\nk:\n- b: lost\nm: \"[x, y]\"\n- c: three\n---\n## Two \t words ##\n[[ far   target | the\n label ]] [a  b](u)", [], "stem")
    assert spaced["metadata"] == '{"frontmatter": {"- a": "one", "- c": "three", "k": "", "m": ["x", "y"]}, "frontmatter_keys": ["- a", "- c", "k", "m"], "link_count": 2}'
    assert spaced["links"] == ["far target", "u"] and spaced["sections"] == ["Two words"] and spaced["text"] == "one x y three Two words the label a b"
    open_ended = extract.markdown("---\ntopic: maps\nbody", [], "stem")
    assert "topic: maps" in open_ended["text"]


def test_latex():
    got = extract.latex(
        "\\title{A Map}\\author{N. N.}\n% gone \\cite{never}\n\\begin{abstract}Short.\\end{abstract}\n\\section{One}\\label{s:1}\n\\begin{theorem}[Main]All $x$.\\end{theorem}\\caption{Cap}\\cite[p. 1]{k1, k2}\\citep{k1}\\bibliography{refs}", [], "stem"
    )
    assert got["title"] == "A Map" and got["sections"] == ["One"]
    assert got["links"] == ["cite:k1", "cite:k2", "bib:refs"]
    levels = extract.latex("\\chapter{One}\n\\subsection*{Two}\n\\begin{lemma}[A  b]\\label{l:  1}text\\end{lemma}next", [], "stem")
    assert levels["text"] == "chapter One subsection Two lemma A b l: 1text next" and levels["sections"] == ["One", "Two"]
    assert '"latex_labels": ["l: 1", "lemma:A b"]' in levels["metadata"]
    assert "abstract Short." in got["text"] and "section One" in got["text"] and "theorem Main All x ." in got["text"] and "gone" not in got["text"]


def test_html():
    assert extract.html_text("<p>One<br>two</p><div>a&amp;b</div><script>s()</script>") == "One two a&b s()"
    assert extract.html_text(None) == "" == extract.html_text("")


def test_skip_reasons():
    assert extract.extract("a/b.pdf", b"")["skip_reason"] and extract.extract("b.png", b"")["skip_reason"]
    assert extract.extract("a.txt", b"\xff ok")["warnings"]


def test_query_grammar():
    assert fts.parse("a b").op == "and" and fts.parse("a OR b").op == "or" and fts.parse("a NOT b").op == "not"
    assert fts.parse('"two words"').words == ["two", "words"] and fts.parse("alp*").prefix and fts.parse("title:beta").column == "title"
    for bad in ("foo-bar", "C++", '"open', "foo AND", "  "):
        with pytest.raises(fts.QueryError):
            fts.parse(bad)
    assert fts.phrases(fts.or_fallback("foo-bar C++")) == ["foo", "bar", "c"]
    assert fts.or_fallback("--") is None


def test_search(spark):
    docs = spark.createDataFrame(
        [(1, "Éclair", "a.txt", "sweet and light", "active"), (2, "beta", "b.txt", "light light heavy", "active"), (3, "gamma", "c.txt", "light", "missing"), (4, "delta", "d.txt", "light", "unindexed")],
        "doc_id long, title string, relative_path string, text string, status string",
    )
    ids = lambda q, **k: [r.doc_id for r in fts.search(docs, q, **k).orderBy("rank").collect()]
    assert ids("ECLAIR") == [1] and ids("light") == [2, 1] and set(ids("light", include_missing=True)) == {1, 2, 3}
    assert ids("title:beta") == [2] and ids("hea*") == [2] and ids('"light heavy"') == [2] and ids("light NOT heavy") == [1]
    assert ids("sweet-nothing") == [1] and ids("--") == []
