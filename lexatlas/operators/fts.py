"""Full-text search: a query grammar of phrases, beginnings, NEAR groups and column filters, and BM25 ranking of phrases."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.functions.text import MARKED, PLAIN, fts_tokens, normalised

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Distinct words of a query.
MOST_TERMS = 4096


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, term, tf of each document's tokens, and the document's length."""
    tokens = docs.select(F.col(key), fts_tokens(F.col(text)).alias("tokens"))
    return tokens.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, words: list[str] | DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score (smaller is better) of documents that hold any of the words (a list, or a frame with a column term).

    The index statistics cover every row of docs, whatever its status.
    """
    if isinstance(words, DataFrame):
        words = [r.term for r in words.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    terms = sorted({w for w in words if w is not None})
    if len(terms) > MOST_TERMS:
        raise ValueError(f"a query has at most {MOST_TERMS} words")
    held = docs.select(F.col(key), fts_tokens(F.col(text)).alias("tokens")).select(key, F.size("tokens").alias("length"), F.filter("tokens", lambda t: t.isin(*terms) if terms else F.lit(False)).alias("found"))
    stats = held.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    # only the query's words leave the row
    hits = held.select(key, "length", F.explode("found").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw > 0, raw).otherwise(IDF_FLOOR)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy(key).agg((-F.sum(idf * weight)).alias("score"))


@dataclass
class Query:
    """Phrases joined by a boolean expression.

    A phrase has words, may only be begun in its last word (prefix) or in earlier ones (begun, their places), may have to open
    its column (first), and may be bound to columns (None: all). near holds phrases that stand within a distance of each other.
    """

    op: str  # phrase, near, and, or, not
    words: list[str] = field(default_factory=list)
    prefix: bool = False
    column: str | None = None
    parts: list[Query] = field(default_factory=list)
    columns: frozenset[str] | None = None
    begun: tuple[int, ...] = ()
    first: bool = False
    distance: int = 10

    def leaves(self) -> list[Query]:
        return [self] if self.op == "phrase" else [x for p in self.parts for x in p.leaves()]

    def blank(self) -> bool:
        return self.op in ("phrase", "near") and not any(x.words for x in self.leaves())


class QueryError(ValueError):
    pass


#: A quoted string, a bare word, a mark, or anything else that is not white space.
_LEX = re.compile(r'[ \t\n\r]*(?:"((?:[^"]|"")*)"|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:,+*^-])|(\S))')


def parse(text: str, columns: tuple[str, ...] | None = None) -> Query:
    """The query that a text means; QueryError if it means none.

    Phrases ("several words", one + "after the other", begun*, ^first in its column), NEAR(phrases, distance), filters
    (column:, {several columns}:, -column:, also before parentheses), and by binding power words side by side (both), NOT,
    AND, OR. columns: the names that filters may use; None allows any name, but no filter by what is left out.
    """
    found, at = [], 0
    while text[at:].strip(" \t\n\r"):
        m = _LEX.match(text, at)
        quoted, bare, mark, other = m.groups()
        if other is not None:
            raise QueryError(text[at:])
        found.append(("string", quoted.replace('""', '"'), False) if quoted is not None else ("string", bare, True) if bare is not None else (mark, mark, True))
        if found[-1] in (("string", "AND", True), ("string", "OR", True), ("string", "NOT", True)):
            found[-1] = (bare, bare, True)
        at = m.end()
    if not found:
        raise QueryError("blank")
    reader = _Reader(found, columns)
    tree = reader.joined("OR")
    if reader.kind():
        raise QueryError(reader.tokens[reader.at][1])
    return tree


class _Reader:
    BINDS = {"OR": "AND", "AND": "NOT", "NOT": None}

    def __init__(self, tokens, columns):
        self.tokens, self.columns, self.at = tokens, columns, 0

    def kind(self, ahead: int = 0):
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else None

    def take(self, *kinds: str) -> str:
        if self.kind() not in kinds:
            raise QueryError(f"one of {kinds} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def joined(self, op: str | None) -> Query:
        if op is None:
            return self.unit()
        left = self.joined(self.BINDS[op])
        while self.kind() == op:
            self.at += 1
            left = Query(op.lower(), parts=[left, self.joined(self.BINDS[op])])
        return left

    def unit(self) -> Query:
        begin = self.at
        names = self.filter()
        if self.kind() == "(":
            self.at += 1
            inner = self.joined("OR")
            self.take(")")
            return inner if names is None else _bound(inner, names)
        self.at = begin
        tree = self.group()
        while self.kind() in ("string", "^", "{", "-"):
            right = self.group()
            tree = right if tree.blank() else tree if right.blank() else Query("and", parts=[tree, right])
        return tree

    def filter(self) -> frozenset[str] | None:
        """The columns of a filter that stands here."""
        without = self.kind() == "-"
        if not (without or self.kind() == "{" or (self.kind() == "string" and self.kind(1) == ":")):
            return None
        self.at += without
        if self.kind() == "{":
            self.at += 1
            names = [self.take("string")]
            while self.kind() == "string":
                names.append(self.take("string"))
            self.take("}")
        else:
            names = [self.take("string")]
        self.take(":")
        if self.columns is None:
            if without:
                raise QueryError("which columns there are is not known")
            return frozenset(names)
        known = {c.lower(): c for c in self.columns}
        if any(n.lower() not in known for n in names):
            raise QueryError(f"no such column: {names}")
        chosen = frozenset(known[n.lower()] for n in names)
        return frozenset(self.columns) - chosen if without else chosen

    def group(self) -> Query:
        names = self.filter()
        if self.kind() == "string" and self.kind(1) == "(":
            if self.tokens[self.at][1:] != ("NEAR", True):
                raise QueryError(self.tokens[self.at][1])
            self.at += 2
            parts, distance = [self.phrase()], 10
            while self.kind() == "string":
                parts.append(self.phrase())
            if self.kind() == ",":
                self.at += 1
                number = self.take("string")
                if not re.fullmatch("[0-9]+", number):
                    raise QueryError(number)
                distance = int(number)
            self.take(")")
            parts = [p for p in parts if p.words]
            out = parts[0] if len(parts) == 1 else Query("near", parts=parts, distance=distance)
        elif self.kind() == "^":
            self.at += 1
            out = self.phrase()
            out.first = True
        else:
            out = self.phrase()
        return out if names is None else _bound(out, names)

    def phrase(self) -> Query:
        words, begun = [], []
        while True:
            words += fold(self.take("string"))
            if self.kind() == "*":
                self.at += 1
                begun += [len(words) - 1] if words else []
            if self.kind() != "+":
                break
            self.at += 1
        prefix = bool(words) and len(words) - 1 in begun
        return Query("phrase", words, prefix, begun=tuple(sorted(set(begun) - {len(words) - 1})))


def _bound(tree: Query, names: frozenset[str]) -> Query:
    """The query with all its phrases bound to some columns."""
    for leaf in tree.leaves():
        leaf.columns = names if leaf.columns is None else leaf.columns & names
        leaf.column = next(iter(leaf.columns)) if len(leaf.columns) == 1 else None
    return tree


def fold(text: str) -> list[str]:
    """A text's tokens as the index has them."""
    return re.findall(r"[^\W_]+", text.lower().translate(str.maketrans(MARKED, PLAIN)))


def or_fallback(text: str) -> Query | None:
    """Any of the words of a text that is no query; None without words."""
    words = [Query("phrase", fold(w)) for w in re.findall(r"\w+", text)]
    words = [w for w in words if w.words]
    tree = words[0] if words else None
    for w in words[1:]:
        tree = Query("or", parts=[tree, w])
    return tree


def _phrase_at(tokens, words: list[str], prefix: bool):
    """Whether the words stand next to each other among the tokens, the last one perhaps only begun."""
    *head, last = words

    def final(x):
        return x.startswith(last) if prefix else x == last

    if not head:
        return F.exists(tokens, final)
    n = len(words)

    def at(p):
        return (F.slice(tokens, p, F.lit(n - 1)) == F.array(*map(F.lit, head))) & final(F.coalesce(F.get(tokens, p + n - 2), F.lit("")))

    return F.when(F.size(tokens) >= n, F.exists(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), at)).otherwise(False)


def matches(query: Query, columns: list[str]):
    """Predicate of a query over array columns of tokens; a phrase without words matches nothing."""
    if query.op == "near" or any(x.first or x.begun for x in query.leaves()):
        raise ValueError("NEAR, ^ and words begun inside a phrase are matched by ranked()")
    if query.op == "phrase":
        if not query.words:
            return F.lit(False)
        cols = [query.column] if query.column else columns
        found = F.lit(False)
        for c in cols:
            tokens = F.col(c)
            hit = _phrase_at(tokens, query.words, query.prefix)
            found = found | hit
        return found
    left, right = (matches(p, columns) for p in query.parts)
    return {"and": left & right, "or": left | right, "not": left & ~right}[query.op]


def phrases(query: Query) -> list[str]:
    return query.words if query.op == "phrase" else [w for p in query.parts[: 1 if query.op == "not" else None] for w in phrases(p)]


def occurrences(docs: DataFrame, query: Query, columns: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    """key, length (tokens of the row), col, term, pos: where the words of a query stand in rows that hold any."""
    wanted, begun = words_of(query)
    tokenised = docs.select(F.col(key), *[fts_tokens(F.col(c)).alias(f"_{k}") for k, c in enumerate(columns)])
    length = sum((F.size(f"_{k}") for k in range(len(columns))), F.lit(0)).cast("long")

    def places(k: int, c: str):
        marked = F.transform(f"_{k}", lambda t, i: F.struct(F.lit(c).alias("col"), t.alias("term"), i.alias("pos")))
        return F.filter(marked, lambda x: is_wanted(x["term"], wanted, begun))

    found = tokenised.select(key, length.alias("length"), F.explode(F.concat(*[places(k, c) for k, c in enumerate(columns)])).alias("x"))
    return found.select(key, "length", "x.col", "x.term", "x.pos")


def words_of(query: Query) -> tuple[list[str], list[str]]:
    """The whole words and the beginnings of words that a query looks for."""
    wanted, begun = set(), set()
    for leaf in query.leaves():
        for j, w in enumerate(leaf.words):
            (begun if _is_begun(leaf, j) else wanted).add(w)
    if len(wanted) + len(begun) > MOST_TERMS:
        raise ValueError(f"a query has at most {MOST_TERMS} words")
    return sorted(wanted), sorted(begun)


def _is_begun(leaf: Query, j: int) -> bool:
    return j in leaf.begun or (leaf.prefix and j == len(leaf.words) - 1)


def is_wanted(term, wanted: list[str], begun: list[str]):
    out = term.isin(*wanted) if wanted else F.lit(False)
    for b in begun:
        out = out | term.startswith(b)
    return out


def statistics(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: n, the rows of an index, and mean_length, their mean number of tokens."""
    length = sum((F.size(fts_tokens(F.col(c))) for c in columns), F.lit(0))
    return docs.agg(F.count("*").alias("n"), F.avg(length).alias("mean_length"))


SLOT = "term string, p int, j int, size int"


def phrase_hits(found: DataFrame, leaves: list[Query], key: str = "doc_id") -> DataFrame:
    """key, length, col, p, start: the hits of the phrases (by number) among the occurrences of their words.

    Every occurrence says where a phrase would begin whose j-th word it is; a phrase stands where all its words say so.
    """
    spark = found.sparkSession
    slots = [(w, p, j, len(leaf.words), _is_begun(leaf, j)) for p, leaf in enumerate(leaves) for j, w in enumerate(leaf.words)]
    whole, begun = [s[:4] for s in slots if not s[4]], [s[:4] for s in slots if s[4]]
    placed = found.join(F.broadcast(spark.createDataFrame(whole, SLOT)), "term")  # the words of the query
    if begun:
        literal = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p"), F.lit(j).alias("j"), F.lit(n).alias("size")) for w, p, j, n in begun])
        fits = found.withColumn("s", F.explode(F.filter(literal, lambda s: F.startswith(F.col("term"), s["w"]))))
        placed = placed.unionByName(fits.select(*found.columns, "s.p", "s.j", "s.size"))
    placed = placed.select(key, "length", "col", "p", "size", (F.col("pos") - F.col("j")).alias("start"))
    single = placed.where("size = 1").drop("size")
    several = placed.where("size > 1").groupBy(key, "length", "col", "p", "start", "size").agg(F.count("*").alias("met")).where("met = size").drop("size", "met")
    hits = several.unionByName(single) if any(len(leaf.words) > 1 for leaf in leaves) else single
    allowed = F.lit(True)
    for p, leaf in enumerate(leaves):
        if leaf.columns is not None:
            allowed = allowed & ((F.col("p") != p) | (F.col("col").isin(*leaf.columns) if leaf.columns else F.lit(False)))
        if leaf.first:
            allowed = allowed & ((F.col("p") != p) | (F.col("start") == 0))
    return hits.where(allowed)


def _near(hits: DataFrame, members: list[int], leaves: list[Query], distance: int, key: str) -> DataFrame:
    """hits with ok: whether, for those of some phrases, all these stand close by.

    The phrases' latest hits up to one of them are close if each begins at most its own length and the distance before it;
    a hit is close if such a place follows within the same span.
    """
    mine = F.col("p").isin(*members)
    place = Window.partitionBy(key, "col").orderBy("start")
    before, after = place.rangeBetween(Window.unboundedPreceding, 0), place.rangeBetween(0, Window.unboundedFollowing)
    reach = {p: len(leaves[p].words) + distance for p in members}
    met = F.lit(True)
    for p in members:
        met = met & (F.max(F.when(F.col("p") == p, F.col("start"))).over(before) >= F.col("start") - reach[p])
    span = F.coalesce(*[F.when(F.col("p") == p, F.lit(reach[p])) for p in members])
    some = hits.where(mine & F.col("ok")).withColumn("_met", F.when(F.coalesce(met, F.lit(False)), F.col("start")))
    some = some.withColumn("ok", F.coalesce(F.min("_met").over(after) <= F.col("start") + span, F.lit(False))).drop("_met")
    return hits.where(~(mine & F.col("ok"))).unionByName(some)


def ranked(found: DataFrame, stats: DataFrame, query: Query, key: str = "doc_id") -> DataFrame:
    """key and score (smaller is better) of the rows that match a query, whatever their status.

    found: the occurrences of its words; stats: n and mean_length of all rows. A phrase weighs by the rows that hold it; it
    adds to a row's score where its part of the query matches there, as often as it stands there (in a NEAR group: close by).
    """
    leaves = query.leaves()
    hits = phrase_hits(found, leaves, key).withColumn("ok", F.lit(True))
    number = {id(leaf): p for p, leaf in enumerate(leaves)}

    def groups(q: Query) -> list[Query]:
        return [q] if q.op == "near" else [g for p in q.parts for g in groups(p)]

    for g in groups(query):
        hits = _near(hits, [number[id(p)] for p in g.parts], leaves, g.distance, key)
    weight = lambda df: F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(0.0))
    idf = lambda df: F.when(weight(df) > 0, weight(df)).otherwise(IDF_FLOOR)
    part = lambda f: f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    if all(q.op == "or" for q in _inner(query)):
        # any of the phrases: rows of (document, phrase), however many phrases there are
        per = hits.groupBy(key, "length", "p").agg(F.count("*").alias("f"))
        held = per.groupBy("p").agg(F.count("*").alias("df"))
        return per.join(F.broadcast(held), "p").crossJoin(F.broadcast(stats)).groupBy(key).agg((-F.sum(idf(F.col("df")) * part(F.col("f")))).alias("score"))
    counted = hits.groupBy(key, "length").agg(*[x for p in range(len(leaves)) for x in (F.count_if((F.col("p") == p) & F.col("ok")).alias(f"f{p}"), F.max(F.col("p") == p).alias(f"h{p}"))])
    held = counted.agg(*[F.count_if(f"h{p}").alias(f"d{p}") for p in range(len(leaves))])

    def matched(q: Query):
        if q.op == "phrase":
            return F.col(f"f{number[id(q)]}") > 0
        if not q.parts:
            return F.lit(False)
        first, *rest = [matched(x) for x in q.parts]
        for x in rest:
            first = first | x if q.op == "or" else first & ~x if q.op == "not" else first & x
        return first

    def score(q: Query, given):
        if q.op == "phrase":
            p = number[id(q)]
            return F.when(given & matched(q), idf(F.col(f"d{p}")) * part(F.col(f"f{p}"))).otherwise(0.0)
        inside = given & matched(q)
        return sum((score(x, inside) for x in (q.parts[:1] if q.op == "not" else q.parts)), F.lit(0.0))

    scored = counted.where(matched(query)).crossJoin(F.broadcast(held)).crossJoin(F.broadcast(stats))  # one row each
    return scored.select(key, (-score(query, F.lit(True))).alias("score"))


def _inner(query: Query) -> list[Query]:
    return [] if query.op == "phrase" else [query, *[x for p in query.parts for x in _inner(p)]]


def read_query(text: str, columns: tuple[str, ...]) -> Query | None:
    """The query of a text, any of its words if it means none; None if it has no words either."""
    try:
        return parse(text, columns)
    except QueryError:
        return or_fallback(text)


def best(scored: DataFrame, docs: DataFrame, limit: int, include_missing: bool = False, key: str = "doc_id") -> DataFrame:
    """rank, key, relative_path, title, score of the best matches among documents that may be shown."""
    wanted = ["active", "missing"] if include_missing else ["active"]
    shown = docs.where(F.col("status").isin(wanted)).select(key, "relative_path", "title").join(scored, key)
    top = shown.orderBy(F.round("score", 9), "relative_path").limit(max(0, limit))
    rank = F.row_number().over(Window.orderBy(F.round("score", 9), "relative_path"))  # over `limit` rows
    return top.select(rank.alias("rank"), key, "relative_path", normalised(F.col("title")).alias("title"), "score")


def search(docs: DataFrame, text: str, limit: int = 10, include_missing: bool = False, columns: tuple[str, ...] = ("title", "relative_path", "text")) -> DataFrame:
    """Ranked documents that match a query text: rank, doc_id, relative_path, title, score.

    docs: doc_id, title, relative_path, text, status. A text that is no query counts as any of its words. Every row of docs
    counts for the statistics; a stored index (operators.index) answers the same without reading all texts.
    """
    query = read_query(text, columns)
    if query is None:
        return docs.select(F.lit(0).alias("rank"), "doc_id", "relative_path", "title", F.lit(0.0).alias("score")).where(F.lit(False))
    return best(ranked(occurrences(docs, query, columns), statistics(docs, columns), query), docs, limit, include_missing)


def _with_prefix(query: Query) -> Query:
    return Query(query.op, query.words, query.prefix, f"t_{query.column}" if query.column else None, [_with_prefix(p) for p in query.parts])
