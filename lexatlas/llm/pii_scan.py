"""Personal data: base patterns, and identifiers found by bootstrapped contextual extraction.

A mention is a token with a digit or an @, or a run that a base pattern takes whole (a card or phone number with spaces).
The words around it, in lower case and wherever they stand, are its lexical patterns: the two words before it, the word
before it, and the words on both sides; other mentions count as the word "#", the ends of the text as "^" and "$". So
contexts may overlap, and no word or value is too long. Seeds are mentions that base patterns accept. Patterns and
instances (values) form a graph, scored in rounds; an edge weighs ln(1 + its mentions):

    pattern  = sum(weight * score) / (sum(weight of seeds and harmless) + sum(weight * score of unseen) + SMOOTHING),
               if it has LEAST_SEEDS distinct seeds
    instance = 1 for seeds, 0 for harmless values (fewer than DIGITS digits, no seed),
               else 1 - product of (1 - score) over its patterns scoring at least LEAST_SCORE

An unseen value thus speaks for a pattern as far as it is believed itself, and never against it. Unseen instances that
reach LEAST_SCORE are added as kind "context". All of it is column expressions, aggregations and joins on patterns and
instances.

Results: rows without doc_id are dropped; null or empty texts have no spans; each of several rows with one doc_id has
its own result; spans that overlap base ones are not added; columns of docs named base or spans give way to the scan's,
others keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexatlas.llm import runtime
from lexatlas.llm.spans import by_kind, count_of, joined, labelled, match_places, overlaps, redacted

KINDS = ("email", "ip", "card", "phone", "context")
#: Base patterns, written so that they neither backtrack over long runs nor recurse. Fixed values.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?=(?:[\x20-]?[0-9]){15})(?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Numbers of at most 255 with any leading zeros.
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
VALID_IP = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: Marks, then a phone or card number with its spaces, or a token with a digit or an @.
MENTION = rf"(?<!\S)[^\s0-9+A-Za-z@]*+(?:{PHONE}|{CARD}|[^\s0-9@]*+[0-9@]\S*+)"
ROUNDS, SMOOTHING, LEAST_SEEDS, LEAST_SCORE, DIGITS = 3, 1.0, 3, 0.7, 5


def luhn(match: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    doubled = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.length(digits).between(16, 19) & (F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0)


def phone_digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)


def value_is_seed(value: Column) -> Column:
    """A mention's value, without marks around it, is a whole base match."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return whole(EMAIL) | value.rlike(VALID_IP) | (whole(CARD) & luhn(value)) | (whole(PHONE) & phone_digits(value))


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges: pattern, value, seed, harmless (booleans), weight. Returns value and score of unseen instances."""
    patterns_of = lambda scored: (
        scored.groupBy("pattern")
        .agg(
            (F.sum(F.col("weight") * F.col("score")) / (F.sum(F.when(F.col("seed") | F.col("harmless"), F.col("weight")).otherwise(F.col("weight") * F.col("score"))) + SMOOTHING)).alias("pattern_score"),
            F.count_if("seed").alias("seeds"),
        )
        .where((F.col("seeds") >= LEAST_SEEDS) & (F.col("pattern_score") >= LEAST_SCORE))
        .select("pattern", "pattern_score")
    )
    unseen = ~F.col("seed") & ~F.col("harmless")
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        fresh = edges.where(unseen).join(patterns_of(scored), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.least("pattern_score", F.lit(0.999999)))))).alias("found"))
        scored = edges.join(fresh, "value", "left").select("pattern", "value", "seed", "harmless", "weight", F.when(F.col("seed"), 1.0).when(F.col("harmless"), 0.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("score"))
    return scored.where(unseen & (F.col("score") >= LEAST_SCORE)).groupBy("value").agg(F.max("score").alias("score"))


def contexts(text: Column, n_mentions: Column) -> Column:
    """Of each mention, its patterns: the texts between mentions are cut to words, and a mention counts as the word #."""
    words = F.transform(F.split(text, MENTION, -1), lambda gap: F.filter(F.split(F.lower(gap), r"\s+"), lambda w: w != ""))
    ends = F.transform(words, lambda w: F.struct(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)).alias("tail"), F.get(w, F.lit(0)).alias("head")))
    blank = F.array().cast("array<string>")
    tail = lambda ends, k: F.coalesce(F.get(ends, k)["tail"], blank)
    mark = lambda k: F.when(k > 0, F.array(F.lit("#"))).otherwise(F.array(F.lit("^"), F.lit("^")))

    def of(ends: Column) -> Column:
        def patterns(k: Column) -> Column:
            left = F.concat(tail(ends, k - 2), mark(k - 1), tail(ends, k - 1), mark(k), tail(ends, k))
            one, two = F.element_at(left, -1), F.element_at(left, -2)
            right = F.coalesce(F.get(ends, k + 1)["head"], F.when(k + 1 < n_mentions, "#").otherwise("$"))
            return F.array(F.concat_ws(" ", two, one, F.lit("_")), F.concat_ws(" ", one, F.lit("_")), F.concat_ws(" ", one, F.lit("_"), right))

        return F.transform(F.sequence(F.lit(0), n_mentions - 1), patterns)

    # through an array of one, so that the words are cut once
    return F.flatten(F.transform(F.array(ends), of))


def find_pii(docs: DataFrame, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """Adds base and spans, arrays of (rank, kind, start, end) by kind and start, to the columns of docs, or those in keep."""
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    given = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_given")
    text = docs.where("doc_id is not null").select(given, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    get = lambda pattern, group=0: F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))
    got = text.withColumns({"_email": get(EMAIL), "_ip": get(IP), "_card": get(CARD), "_phone": get(PHONE), "_context": get(MENTION)})
    where = lambda kind, pattern: match_places(F.col("_text"), pattern, F.col(f"_{kind}"))
    base = F.concat(
        labelled(where("email", EMAIL), "email", 0),
        labelled(where("ip", IP), "ip", 1, F.transform("_ip", lambda m: m.rlike(VALID_IP))),
        labelled(where("card", CARD), "card", 2, F.transform("_card", luhn)),
        labelled(where("phone", PHONE), "phone", 3, F.transform("_phone", phone_digits)),
    )
    mentions = F.arrays_zip(where("context", MENTION).alias("place"), F.col("_context").alias("raw"), contexts(F.col("_text"), F.size("_context")).alias("patterns"))
    scanned = got.select("_given", F.monotonically_increasing_id().alias("_row"), base.alias("_base"), F.when(F.size("_context") > 0, mentions).alias("_mentions"))
    scanned = runtime.stored(scanned, "scanned")

    found = scanned.where("_mentions is not null").select("_row", "_base", F.explode("_mentions").alias("m"))
    lead = F.length(F.regexp_extract("m.raw", r"^[^A-Za-z0-9+]*", 0))
    value = F.regexp_replace(F.regexp_replace("m.raw", r"^[^A-Za-z0-9+]+", ""), r"[^A-Za-z0-9]+$", "")
    found = found.select("_row", "_base", F.col("m.patterns").alias("patterns"), value.alias("value"), (F.col("m.place.start") + lead).alias("start"))
    found = found.withColumn("end", F.col("start") + F.length("value")).where(F.length(F.regexp_replace("value", "[^0-9@]", "")) > 0)
    found = found.withColumn("seed", value_is_seed(F.col("value"))).withColumn("harmless", ~F.col("seed") & (F.length(F.regexp_replace("value", "[^0-9]", "")) < DIGITS))
    edges = found.select(F.explode("patterns").alias("pattern"), "value", "seed", "harmless").groupBy("pattern", "value", "seed", "harmless").agg(F.log1p(F.count("*").cast("double")).alias("weight"))
    learnt = score_graph(runtime.stored(edges, "graph"), rounds).select("value")
    added = found.where(~F.col("seed") & ~F.col("harmless") & ~overlaps(F.struct("start", "end"), F.col("_base"))).join(learnt, "value", "left_semi")
    added = added.groupBy("_row").agg(F.collect_list(F.struct(F.lit(4).alias("rank"), F.lit("context").alias("kind"), "start", "end")).alias("_added"))
    both = scanned.select("_given", "_row", "_base").join(added, "_row", "left")
    spans = by_kind(F.concat("_base", F.coalesce("_added", F.array().cast(both.schema["_base"].dataType))))
    return both.select("_given.*", by_kind(F.col("_base")).alias("base"), spans.alias("spans"))


def redact_pii(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """docs with every found span replaced by a mark; texts without any stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = find_pii(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("given")))
    clean = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    return found.select(*(clean.alias(c) if c == "text" else F.col("doc_id") if c == "doc_id" else F.col("given").getField(c).alias(c) for c in docs.columns))


def op5(spark, sf_dir: str) -> DataFrame:
    """The digest query over documents: see find_pii."""
    docs = runtime.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_pii(docs, keep=["doc_id"])
    return found.select("doc_id", *(count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
