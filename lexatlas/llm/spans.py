"""Places of regular-expression matches as native column expressions.

Spark returns matches but not where they are. The pieces between them (split by the same expression) and their lengths
give the places: both walk the text leftmost and without overlap. Sums run in chunks, so a text with very many matches
costs little more than their number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
SPAN = "struct<start:long,end:long>"


def match_places(text: Column, pattern: str, matches: Column) -> Column:
    """Array of (start, end), in characters, of the matches that regexp_extract_all(text, pattern, 0) returned."""
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
    empty = F.array().cast(f"array<{SPAN}>")

    def place(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        return F.struct((start + x["size"]).alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["size"]).alias("end")))).alias("out"))

    def chunk(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(steps, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["pos"].alias("pos"), empty.alias("out")), place)
        return F.struct(part["pos"].alias("pos"), F.concat(acc["out"], F.array(part["out"])).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    chunks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / F.lit(CHUNK)).cast("int"))
    return F.when(F.size(matches) > 0, F.flatten(F.aggregate(chunks, start, chunk)["out"])).otherwise(empty)


def labelled(places: Column, kind: str, rank: int, keep: Column | None = None) -> Column:
    """Places as (rank, kind, start, end); keep: an array of as many booleans."""
    if keep is not None:
        zipped = F.zip_with(places, keep, lambda p, k: F.struct(p["start"].alias("start"), p["end"].alias("end"), k.alias("keep")))
        places = F.filter(zipped, lambda x: x["keep"])
    return F.transform(places, lambda p: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), p["start"].alias("start"), p["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_start(spans: Column) -> Column:
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))), lambda s: F.struct(s["rank"], s["kind"], s["start"], s["end"]))


def by_kind(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"], s["start"], s["end"], s["kind"])))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (span["start"] < o["end"]) & (o["start"] < span["end"]))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span (by start, overlapping ones as one) replaced by a mark."""
    first = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        fresh = F.struct(s["end"].alias("pos"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        return F.when(s["start"] >= acc["pos"], fresh).otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out")))

    done = F.aggregate(by_start(spans), first, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, (done["pos"] + 1).cast("int"), F.length(text)))).otherwise(text)
