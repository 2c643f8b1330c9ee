"""Text expressions: normalising, tokens, n-grams, chunks, snippets. All are columns, evaluated in the JVM."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token of the full-text index, of TF-IDF (two characters or more), of cluster labels, of shared words. Fixed values.
FTS_TOKEN = r"[\p{L}\p{N}]+"
TFIDF_TOKEN = r"[\p{L}\p{N}_]{2,}"
LABEL_TOKEN = r"(?<![\p{L}\p{N}_])[a-zA-Z][a-zA-Z0-9_-]+(?![\p{L}\p{N}_])"
WORD = r"[a-z0-9]+"
#: Letters with marks that the full-text index folds, and what they become. Fixed values.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"

#: Terms that say nothing about a cluster or a pair. Fixed values.
GENERIC_TERMS = (
    "abstract", "analysis", "and", "approach", "are", "based", "between", "chapter", "conclusion", "data", "document", "documents", "example", "examples", "experiment",
    "experiments", "figure", "file", "introduction", "method", "methods", "model", "models", "note", "notes", "paper", "papers", "present", "problem", "results", "section",
    "show", "shown", "study", "table", "text", "that", "the", "their", "this", "through", "using", "when", "where", "which", "with", "work",
)

CHUNK_SIZE, CHUNK_OVERLAP = 2000, 200


def stop_words(listing: str | None = None) -> list[str]:
    """English stop words: those of a listing (the fenced block of the fixtures' section on stop words), or Spark's own list."""
    path = Path(listing) if listing else Path(__file__).resolve().parents[2] / "FIXTURES.md"
    if path.exists():
        found = re.search(r"## 3\. Stop-word list.*?```\n(.*?)```", path.read_text(), re.DOTALL)
        if found:
            return found[1].split()
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def literal(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def normalised(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; null if there is none."""
    lines = F.filter(F.transform(F.split(text, r"\R"), normalised), lambda x: x != "")
    return F.get(lines, F.lit(0))


def fts_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), F.lit(FTS_TOKEN), F.lit(0))


def terms(text: Column, token: str, stop: list[str], bigrams: bool = True) -> Column:
    """Lower-case tokens without stop words, then the bigrams of what is left."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(token), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(*stop))
    return with_bigrams(words) if bigrams else words


def with_bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def window_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Character windows that step by size - overlap until one reaches the end, trimmed, empty ones dropped."""
    size = max(1, size)
    step = size - min(max(0, overlap), size - 1)
    length = F.length(text)
    count = F.when(length <= size, 1).otherwise(F.ceil((length - size) / F.lit(step)).cast("int") + 1)
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.trim(F.substring(text, k * step + 1, F.lit(size))))
    return F.when(length > 0, F.filter(cut, lambda c: c != "")).otherwise(F.array().cast("array<string>"))


def paragraph_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Paragraphs packed up to size, each new chunk opening with the end of the one before; one that is too long is cut in windows."""
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    none = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(text, r"\n\n"), F.trim), lambda p: normalised(p) != "")

    def step(acc: Column, p: Column) -> Column:
        now = acc["now"]
        joined = F.when(now == "", p).otherwise(F.concat(now, F.lit("\n\n"), p))
        closed = F.when(now == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(now)))
        tail = F.trim(F.substring(now, F.greatest(F.length(now) - overlap + 1, F.lit(1)), F.lit(overlap))) if overlap else F.lit("")
        opened = F.when((now == "") | (tail == ""), p).otherwise(F.concat(tail, F.lit("\n\n"), p))
        long = F.struct(F.concat(closed, window_chunks(p, size, overlap)).alias("out"), F.lit("").alias("now"))
        return F.when(F.length(p) > size, long).when(F.length(joined) <= size, F.struct(acc["out"].alias("out"), joined.alias("now"))).otherwise(F.struct(closed.alias("out"), opened.alias("now")))

    done = F.aggregate(parts, F.struct(none.alias("out"), F.lit("").alias("now")), step)
    packed = F.when(done["now"] == "", done["out"]).otherwise(F.concat(done["out"], F.array(done["now"])))
    return F.when(normalised(text) == "", none).when(F.contains(text, F.lit("\n\n")), packed).otherwise(window_chunks(text, size, overlap))


def _window(compact: Column, at: Column, width: int) -> Column:
    """width characters around a hit (1-based, 0 for none), a third of them before it, with dots where text is left out."""
    start = F.greatest(F.lit(0), F.least(at - 1 - width // 3, F.length(compact) - width))
    start = F.when(at > 0, start).otherwise(0)
    body = F.trim(F.substring(compact, start + 1, F.lit(width)))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + width < F.length(compact), "...").otherwise(""))


def snippet(text: Column, needles: list[str], width: int = 240) -> Column:
    """Around the earliest place of any needle."""
    compact = normalised(text)
    places = F.filter(F.array(*[F.instr(F.lower(compact), n) for n in needles] or [F.lit(0)]), lambda p: p > 0)
    return _window(compact, F.coalesce(F.array_min(places), F.lit(0)), width)


def excerpt(text: Column, needles: list[str], width: int = 220) -> Column:
    """Around the first needle, in their order, that occurs."""
    compact = normalised(text)
    places = F.filter(F.array(*[F.instr(F.lower(compact), n) for n in needles] or [F.lit(0)]), lambda p: p > 0)
    return _window(compact, F.coalesce(F.get(places, F.lit(0)), F.lit(0)), width)


def preview(text: Column, width: int = 1200) -> Column:
    """One-spaced, and cut with dots after width characters."""
    compact = normalised(text)
    return F.when(F.length(compact) > width, F.concat(F.rtrim(F.substring(compact, 1, width)), F.lit("..."))).otherwise(compact)


def informative(term: Column, of_label: bool = True) -> Column:
    """A term with a word of three letters or more that is not generic; a label's term also has three characters and is no number."""
    words = F.regexp_extract_all(F.lower(term), F.lit(WORD), F.lit(0))
    telling = F.exists(words, lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC_TERMS))
    return telling & (F.length(F.trim(term)) >= 3) & F.exists(words, lambda w: ~w.rlike("^[0-9]+$")) if of_label else telling


def match_excerpt(text: Column, words: list[str], width: int = 16, dots: str = " ... ") -> Column:
    """The window of width tokens that holds most different words: hits in [], dots where text is left out.

    Tokens are those of the full-text index. Every hit offers two windows. The first opens at it, and is then drawn so that
    its hits stand in the middle, within the text; the second opens where the hit's sentence begins, if that is before
    it (only in texts longer than a window). A window counts 1000 for each different word in it and 1 for each further hit; a sentence
    adds 100, the text's first one 120. The best window is shown, of equal ones the first. A text without a hit gives its
    first tokens.
    """
    is_word = lambda t: t.isin(*words) if words else F.lit(False)

    def score(found: Column) -> Column:
        return 999 * F.size(F.array_distinct(F.transform(found, lambda y: y["t"]))) + F.size(found)

    def best(hits: Column, begins: Column, n: Column) -> Column:
        """The first token of the window that is shown."""

        # a window of width tokens has at most as many hits: only those around a hit are looked at
        def at_hit(x: Column, k: Column) -> Column:
            middle = lambda found: x["i"] - F.floor((width - (F.element_at(found, -1)["i"] + 1 - x["i"])) / F.lit(2)).cast("int")
            offer = lambda found: F.struct((-score(found)).alias("less"), (2 * x["i"]).alias("turn"), F.greatest(F.least(middle(found), n - width), F.lit(0)).alias("start"))
            return _let(F.filter(F.slice(hits, k + 1, F.lit(width)), lambda y: y["i"] < x["i"] + width), offer)

        def at_sentence(x: Column, k: Column) -> Column:
            # the beginning is looked up once a hit, not for each hit near it
            return _let(F.array_max(F.filter(begins, lambda b: b <= x["i"])), lambda begin: of_sentence(x, k, begin))

        def of_sentence(x: Column, k: Column, begin: Column) -> Column:
            near = F.slice(hits, F.greatest(k + 1 - width, F.lit(1)), F.lit(2 * width))
            more = _let(F.filter(near, lambda y: (y["i"] >= begin) & (y["i"] < begin + width)), score) + F.when(begin == 0, 120).otherwise(100)
            # a sentence that begins so far back that the hit is outside counts what it holds near it, and loses to the hit's own window
            return F.struct(F.when((begin < x["i"]) & (n > width), -more).otherwise(0).alias("less"), (2 * x["i"] + 1).alias("turn"), begin.alias("start"))

        offered = F.concat(F.transform(hits, at_hit), F.transform(hits, at_sentence))
        return F.coalesce(F.array_min(offered)["start"], F.lit(0))

    def drawn(tokens: Column, placed: Column, start: Column) -> Column:
        shown = F.transform(F.slice(placed, start + 1, F.lit(width)), lambda x: F.when(is_word(x["t"]), F.regexp_replace(F.get(tokens, x["i"]), rf"^({FTS_TOKEN})", "[$1]")).otherwise(F.get(tokens, x["i"])))
        body = F.array_join(shown, "")
        cut = start + width < F.size(tokens)
        return F.concat(F.when(start > 0, F.lit(dots)).otherwise(F.regexp_extract(text, r"^[^\p{L}\p{N}]*", 0)), F.when(cut, F.concat(F.regexp_replace(body, r"[^\p{L}\p{N}\]]+$", ""), F.lit(dots))).otherwise(body))

    def of_tokens(tokens: Column) -> Column:
        placed = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.get(fts_tokens(t), F.lit(0)).alias("t")))
        return _let(placed, lambda p: of_places(tokens, p))

    def of_places(tokens: Column, placed: Column) -> Column:
        # a sentence begins at the first token, and where . or : and white space stand before one
        ends = F.transform(tokens, lambda t, i: F.when(t.rlike(r"[.:][ \t\n\r]+$"), i + 1).otherwise(0))
        parts = F.struct(F.filter(placed, lambda x: is_word(x["t"])).alias("hits"), F.array_distinct(F.concat(F.array(F.lit(0)), ends)).alias("begins"))
        return _let(parts, lambda x: _let(best(x["hits"], x["begins"], F.size(tokens)), lambda start: drawn(tokens, placed, start)))

    return _let(F.regexp_extract_all(text, F.lit(rf"{FTS_TOKEN}[^\p{{L}}\p{{N}}]*"), F.lit(0)), of_tokens)


def _let(value: Column, use) -> Column:
    """use(value), where the value is evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
