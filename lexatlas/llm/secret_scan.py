"""Secret scans: base patterns, and random-looking tokens by a battery of randomness tests with false-discovery control.

A candidate is a token of 20 or more characters of [A-Za-z0-9+/_-] with a letter and a digit. Its encoding is inferred
from its characters (hex, base32, base62, base64), which fixes the alphabet of m symbols. The battery:

* chi-squared: X2 = m/n * sum(count**2) - n against the uniform law of the alphabet;
* runs above and below the alphabet's middle, and the serial correlation of neighbouring symbols, both as z scores.

The three p-values under the uniform law are combined by Fisher's method into one. Against it stands "this is prose":
X2 against symbols that repeat with the encoding's index of coincidence, and the likelihood ratio of uniform symbols to
prose-like ones, the smaller of both p-values doubled. A token is a finding if the battery's combined p-value is at
least RANDOM and the one of prose clears Benjamini-Hochberg at LEVEL among the candidates of its encoding and length
class. P-values are rounded up to a fixed grid, so that the thresholds come from a table of bounded size. All of it is
column expressions and joins with bounded tables.

Results: rows without doc_id are dropped; null or empty texts have no spans; each of several rows with one doc_id has
its own result; spans that overlap base ones are not added; columns of docs named base or spans give way to the scan's,
others keep their names and values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexatlas.llm import runtime
from lexatlas.llm.spans import by_start, count_of, joined, labelled, match_places, overlaps, redacted

#: Base patterns. Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 8

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Encoding -> (alphabet, index of coincidence of prose written in it).
ENCODINGS = {
    "hex": ("0123456789abcdef", 0.12),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.08),
    "base62": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 0.066),
    "base64": ("+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", 0.066),
}
#: Prose's classes (lower, upper, digit, mark): shares of the first, steps from each, and the shares of a to z (rare ones raised).
FIRST = (0.6, 0.2, 0.15, 0.05)
STEPS = (0.83, 0.04, 0.03, 0.10, 0.60, 0.27, 0.05, 0.08, 0.12, 0.08, 0.65, 0.15, 0.66, 0.16, 0.14, 0.04)
LETTERS = (0.080, 0.014, 0.030, 0.040, 0.135, 0.017, 0.018, 0.030, 0.075, 0.004, 0.008, 0.045, 0.026, 0.078, 0.060, 0.024, 0.006, 0.067, 0.068, 0.073, 0.037, 0.013, 0.012, 0.005, 0.010, 0.008)
#: Shares of 0 to f: numbers with few letters, words of a to f, and the upper half of an ASCII letter's byte.
HEX_NUMBERS = (0.093,) * 10 + (0.07 / 6,) * 6
HEX_WORDS = (0.01,) * 10 + (0.234, 0.081, 0.108, 0.144, 0.252, 0.081)
HEX_UPPER = (0.004, 0.004, 0.12, 0.05, 0.03, 0.02, 0.49, 0.242) + (0.005,) * 8
LENGTH_CLASSES = (32, 64, 128)
#: Least combined p-value of the battery for a random token, and the rate of false discoveries.
RANDOM, LEVEL = 1e-4, 0.01
#: Grid of -log10 p: steps to the unit and its end.
GRID, GRID_END = 20, 40


def _encoding(token: Column) -> Column:
    lower = F.when(token.rlike("^[0-9a-f]+$") | token.rlike("^[0-9A-F]+$"), "hex").when(token.rlike("^[A-Z2-7]+$"), "base32").when(token.rlike("^[A-Za-z0-9]+$"), "base62")
    return lower.otherwise("base64")


def _logs(shares) -> str:
    return "array(" + ", ".join(f"{math.log(x):.6f}D" for x in shares) + ")"


def _log_ratio() -> Column:
    """Natural log of uniform to prose likelihood of a token with encoding, n and m. One-case tokens may also be uniform over their own letters."""
    total = lambda weights: f"aggregate({weights}, 0D, (acc, x) -> acc + x)"
    # hex: codes are 0 to 15
    alone = lambda shares: total(f"transform(codes, c -> element_at({_logs(shares)}, cast(c as int) + 1))")
    phase = lambda k: total(f"transform(codes, (c, i) -> if(i % 2 = {k}, element_at({_logs(HEX_UPPER)}, cast(c as int) + 1), {math.log(1 / 16):.6f}D))")
    hexadecimal = f"-n * ln(16D) - greatest({alone(HEX_NUMBERS)}, {alone(HEX_WORDS)}, {phase(0)}, {phase(1)})"
    # others: capitals alone are read as small letters
    folded = "if(token rlike '[a-z]', token, lower(token))"
    kinds = f"transform(split({folded}, ''), c -> case when c between 'a' and 'z' then 0 when c between 'A' and 'Z' then 1 when c between '0' and '9' then 2 else 3 end)"
    emitted = f"transform(split(lower(token), ''), c -> case when c between 'a' and 'z' then element_at({_logs(LETTERS)}, ascii(c) - 96) when c between '0' and '9' then {math.log(0.1):.6f}D else {math.log(0.25):.6f}D end)"
    stepped = f"zip_with(slice(kinds, 1, size(kinds) - 1), slice(kinds, 2, size(kinds) - 1), (x, y) -> element_at({_logs(STEPS)}, 4 * x + y + 1))"
    one_case = "not (token rlike '[a-z]' and token rlike '[A-Z]')"
    uniform = f"case when encoding = 'base32' or not ({one_case}) then -n * ln(m) else -n * ln(m - 26) - ln(2D) end"
    prose = f"element_at({_logs(FIRST)}, element_at(kinds, 1) + 1) + {total(stepped)} + {total(emitted)}"
    mixed = f"element_at(transform(array({kinds}), kinds -> {uniform} - ({prose})), 1)"
    return F.expr(f"if(encoding = 'hex', {hexadecimal}, {mixed})")


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n, z_uniform, z_runs, z_serial, uniform_p (the three combined) and log_p (-log10 of the p-value of prose) to rows with a token."""
    pick = lambda k: F.create_map(*[x for e, v in ENCODINGS.items() for x in (F.lit(e), F.lit(v[k]))])[F.col("encoding")]
    out = tokens.withColumn("encoding", _encoding(F.col("token"))).withColumn("n", F.length("token").cast("double"))
    out = out.withColumn("alphabet", pick(0)).withColumn("s2", pick(1)).withColumn("m", F.length("alphabet").cast("double"))
    symbols = F.expr("transform(split(if(encoding = 'hex', lower(token), token), ''), c -> cast(locate(c, alphabet) - 1 as double))")
    out = out.withColumn("codes", symbols)
    squares = F.expr("aggregate(sequence(1, length(alphabet)), cast(0 as double), (acc, k) -> acc + pow(n - length(replace(if(encoding = 'hex', lower(token), token), substr(alphabet, k, 1), '')), 2))")
    out = out.withColumn("chi", F.col("m") / F.col("n") * squares - F.col("n"))
    out = out.withColumn("z_uniform", (F.col("chi") - (F.col("m") - 1)) / F.sqrt(2 * (F.col("m") - 1)))
    # under prose: mean and variance of sum(count**2) with S2 and S3 = 1.3 * S2**2
    s2, s3, n, m = F.col("s2"), F.lit(1.3) * F.col("s2") ** 2, F.col("n"), F.col("m")
    mean = m * (n - 1) * s2 + m - n
    sd = m / n * F.sqrt(F.greatest(4 * n**3 * (s3 - s2**2) + 2 * n**2 * (s2 - 2 * s3 + s2**2), F.lit(1.0)))
    z = F.least((F.col("chi") - mean) / sd, F.lit(0.0))
    out = out.withColumn("log_p", F.when(z < 0, z**2 / 2 / F.log(F.lit(10.0)) + F.log10(F.lit(2.0))).otherwise(0.0))
    ratio = _log_ratio() / F.log(F.lit(10.0))
    out = out.withColumn("log_p", F.greatest(F.greatest(F.col("log_p"), ratio) - F.log10(F.lit(2.0)), F.lit(0.0)))
    # runs above and below the middle
    out = out.withColumn("high", F.expr("aggregate(codes, cast(0 as double), (acc, c) -> acc + if(c >= m / 2, 1, 0))"))
    out = out.withColumn("runs", F.expr("1 + aggregate(zip_with(slice(codes, 2, size(codes) - 1), slice(codes, 1, size(codes) - 1), (x, y) -> if((x >= m / 2) = (y >= m / 2), 0D, 1D)), 0D, (acc, x) -> acc + x)"))
    mixed = 2 * F.col("high") * (n - F.col("high"))
    out = out.withColumn("z_runs", F.when(mixed > 2 * n, (F.col("runs") - mixed / n - 1) / F.sqrt(F.greatest(mixed * (mixed - n) / (n**2 * (n - 1)), F.lit(1e-9)))).otherwise(99.0))
    # serial correlation of neighbours
    out = out.withColumn("mean", F.expr("aggregate(codes, 0D, (acc, c) -> acc + c) / n"))
    out = out.withColumn("spread", F.expr("aggregate(codes, 0D, (acc, c) -> acc + (c - mean) * (c - mean))"))
    lagged = F.expr("aggregate(zip_with(slice(codes, 2, size(codes) - 1), slice(codes, 1, size(codes) - 1), (x, y) -> (x - mean) * (y - mean)), 0D, (acc, x) -> acc + x)")
    out = out.withColumn("z_serial", F.when(F.col("spread") > 0, lagged / F.greatest(F.col("spread"), F.lit(1e-9)) * F.sqrt(n)).otherwise(99.0))
    # Fisher: with h the sum of -ln p of three tests, p = exp(-h) * (1 + h + h**2 / 2); -ln of a two-sided normal p is close to 0.717 |z| + 0.416 z**2
    minus_log = lambda z: 0.717 * z + 0.416 * z**2
    h = minus_log(F.greatest("z_uniform", F.lit(0.0))) + minus_log(F.abs("z_runs")) + minus_log(F.abs("z_serial"))
    out = out.withColumn("h", h).withColumn("uniform_p", F.expr("exp(-h) * (1 + h + h * h / 2)")).drop("h")
    return out.drop("alphabet", "s2", "m", "codes", "chi", "high", "runs", "mean", "spread")


def discoveries(tested: DataFrame, level: float = LEVEL) -> DataFrame:
    """Rows that the battery lets pass as random and whose p-value of prose clears Benjamini-Hochberg in their stratum."""
    stratum = F.concat_ws("/", "encoding", sum(((F.col("n") >= x).cast("int") for x in LENGTH_CLASSES), F.lit(0)))
    placed = tested.withColumn("stratum", stratum).withColumn("bin", F.floor(F.least(F.col("log_p"), F.lit(float(GRID_END))) * GRID).cast("int"))
    counts = placed.groupBy("stratum", "bin").agg(F.count("*").alias("c"))  # at most strata x grid rows
    within = Window.partitionBy("stratum")
    ranked = counts.withColumn("above", F.sum("c").over(within.orderBy(F.desc("bin")))).withColumn("all", F.sum("c").over(within))
    thresholds = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(GRID))) <= level * F.col("above") / F.col("all")).groupBy("stratum").agg(F.min("bin").alias("least_bin"))
    return placed.join(F.broadcast(thresholds), "stratum").where((F.col("uniform_p") >= RANDOM) & (F.col("bin") >= F.col("least_bin")))


def find_secrets(docs: DataFrame, level: float = LEVEL, keep: list[str] | None = None) -> DataFrame:
    """Adds base (spans of the base patterns) and spans (all, by start), arrays of (rank, kind, start, end), to the columns of docs, or those in keep."""
    columns = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    given = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_given")
    text = docs.where("doc_id is not null").select(given, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    get = lambda pattern, group=0: F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))
    got = text.withColumns({"_assign": get(ASSIGN), "_access": get(ACCESS), "_hex": get(HEX), "_random": get(CANDIDATE)})
    got = got.withColumn("_value", F.when(F.size("_assign") > 0, get(ASSIGN, 2)).otherwise(F.array().cast("array<string>")))
    where = lambda kind, pattern: match_places(F.col("_text"), pattern, F.col(f"_{kind}"))
    base = F.concat(
        labelled(where("assign", ASSIGN), "assign", 0, F.transform("_value", lambda v: F.length(v) >= LEAST_VALUE)),
        labelled(where("access", ACCESS), "access", 1),
        labelled(where("hex", HEX), "hex", 2),
    )
    plausible = F.transform("_random", lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
    candidates = F.filter(
        F.zip_with(where("random", CANDIDATE), F.zip_with("_random", plausible, lambda t, ok: F.struct(t.alias("token"), ok.alias("ok"))), lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), t["token"].alias("token"), t["ok"].alias("ok"))),
        lambda c: c["ok"],
    )
    scanned = got.select("_given", F.monotonically_increasing_id().alias("_row"), base.alias("_base"), F.when(F.size("_random") > 0, candidates).alias("_candidates"))
    scanned = runtime.stored(scanned, "scanned")
    tokens = scanned.where("_candidates is not null").select("_row", "_base", F.explode("_candidates").alias("c")).where(~overlaps(F.col("c"), F.col("_base")))
    tested = battery(tokens.select("_row", "c.start", "c.end", "c.token"))
    added = discoveries(tested, level).groupBy("_row").agg(F.collect_list(F.struct(F.lit(3).alias("rank"), F.lit("random").alias("kind"), "start", "end")).alias("_added"))
    both = scanned.select("_given", "_row", "_base").join(added, "_row", "left")
    spans = by_start(F.concat("_base", F.coalesce("_added", F.array().cast(both.schema["_base"].dataType))))
    return both.select("_given.*", by_start(F.col("_base")).alias("base"), spans.alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by a mark; texts without any stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = find_secrets(docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("given")))
    clean = F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    return found.select(*(clean.alias(c) if c == "text" else F.col("doc_id") if c == "doc_id" else F.col("given").getField(c).alias(c) for c in docs.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    """The digest query over documents: see find_secrets."""
    docs = runtime.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_secrets(docs, keep=["doc_id"])
    return found.select("doc_id", *(count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
