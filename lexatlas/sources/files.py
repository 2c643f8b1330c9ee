"""Directory scans and snapshot tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexatlas.distribution import ship
from lexatlas.functions import ids
from lexatlas.operators.state import upsert
from lexatlas.sources.extract import IMAGES, extracted

TEXT_SUFFIXES = ("txt", "md", "markdown", "tex")
#: Directories that a scan leaves out, besides hidden ones. Fixed values.
IGNORED = ("venv", "node_modules", "__pycache__")


def discover(spark: SparkSession, root: str, pdf: bool = True, images: bool = False) -> DataFrame:
    """relative_path, suffix, content, size_bytes, modified and sha256 of the files under a root (order them by path when they are shown).

    Only files of wanted names are opened. Hidden folders and those of IGNORED are left out; Spark itself leaves out names that begin with . or _.
    """
    ship(spark)
    wanted = [*TEXT_SUFFIXES, *["pdf"] * pdf, *(sorted(IMAGES) if images else [])]
    either = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in wanted)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + either + "}").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/{1,3}", "/"), "^" + _quoted(base) + "/", "")
    listed = files.select(path.alias("relative_path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    parts = F.split("relative_path", "/")
    hidden = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.startswith(".") | p.isin(*IGNORED))
    suffix = F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1))
    kept = listed.withColumn("suffix", suffix).where(F.col("suffix").isin(wanted) & ~hidden)
    return kept.withColumn("sha256", F.sha2("content", 256))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def scan(spark: SparkSession, root: str, min_chars: int = 80, fingerprint: str = "") -> DataFrame:
    """What a state merge wants of a scan, with the extracted fields: see operators.state.classify."""
    found = discover(spark, root).withColumn("x", extracted("relative_path", "content"))
    corpus = ids.corpus_id(F.lit(root))
    return found.select(
        corpus.alias("corpus_id"), ids.document_id(corpus, F.col("relative_path")).alias("document_id"), "relative_path", "sha256", "size_bytes", F.lit(fingerprint).alias("fingerprint"),
        F.col("x.skip_reason").alias("skip_reason"), F.length("x.text").cast("long").alias("char_count"), "x.title", "x.text", "x.method", "x.metadata", "x.sections", "x.links", "x.warnings",
    )


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Write tables as the next snapshot of a folder, then its numbered pointer.

    Pointers are only added, and readers take the highest one, so they see the old or the new snapshot whole. Two writers
    at once may take one number: the second one fails.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    spark = next(iter(tables.values())).sparkSession
    _point(spark, folder, (version, sorted(tables), None, None, None, None))
    return version


#: parts: of a table that is kept in buckets, the version that holds each; schema: its columns, as JSON; epoch: of a stream, the last one that is in.
POINTER = "version string, tables array<string>, parts map<string,map<string,string>>, schemas map<string,string>, buckets int, epoch long"
BUCKETS = 64


def _point(spark: SparkSession, folder: str, row: tuple) -> None:
    number = 1 + (_highest(spark, folder) or 0)
    spark.createDataFrame([row], POINTER).coalesce(1).write.json(f"{folder}/pointers/{number:012d}")


def _pointer(spark: SparkSession, folder: str):
    number = _highest(spark, folder)
    return None if number is None else spark.read.schema(POINTER).json(f"{folder}/pointers/{number:012d}").first()


def merge(spark: SparkSession, folder: str, table: str, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), removes: DataFrame | None = None, buckets: int = BUCKETS, epoch: int | None = None) -> bool:
    """Upsert rows into a table that a folder keeps in buckets of its keys, and take others (their keys) out: only the buckets that change are written.

    The next pointer names, for every bucket, the version that holds it. An epoch that is in already changes nothing (False),
    so a batch that is played again does not count twice. keys are unique in new; columns in keep stay as they were first.
    """
    at = _pointer(spark, folder)
    if at is not None and epoch is not None and at.epoch is not None and epoch <= at.epoch:
        return False
    parts, schemas = (dict(at.parts or {}), dict(at.schemas or {})) if at else ({}, {})
    own = dict(parts.get(table) or {})
    buckets = (at.buckets if at else None) or buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    gone = new.select(*keys).limit(0) if removes is None else removes.select(*keys)
    touched = [str(r.b) for r in new.select(bucket.alias("b")).union(gone.select(bucket.alias("b"))).distinct().collect()]  # at most one row a bucket
    held = [f"{folder}/{own[b]}/{table}/_bucket={b}" for b in touched if b in own]
    old = spark.read.schema(new.schema).parquet(*held) if held else new.limit(0)
    rows = upsert(old.join(gone, keys, "left_anti"), new, keys, keep) if held else new
    version = uuid.uuid4().hex
    rows.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{folder}/{version}/{table}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{version}/{table}")
    written = {s.getPath().getName().split("=")[1] for s in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place) if s.getPath().getName().startswith("_bucket=")}
    own = {b: v for b, v in own.items() if b not in touched} | {b: version for b in written}
    tables = sorted({*(at.tables if at else ()), table})
    _point(spark, folder, (at.version if at else version, tables, parts | {table: own}, schemas | {table: new.schema.json()}, buckets, epoch if epoch is not None or at is None else at.epoch))
    return True


def discard_old(spark: SparkSession, folder: str) -> None:
    """Delete the versions and pointers that the current pointer does not name. No reader may still use them."""
    at, number = _pointer(spark, folder), _highest(spark, folder)
    if at is None:
        return
    names = {at.version, "pointers", "project"} | {v for own in (at.parts or {}).values() for v in own.values()}
    jvm = spark._jvm.org.apache.hadoop.fs
    for top, keep in ((folder, names), (f"{folder}/pointers", {f"{number:012d}"})):
        place = jvm.Path(top)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in store.listStatus(place):
            if status.isDirectory() and status.getPath().getName() not in keep:
                store.delete(status.getPath(), True)


def _highest(spark: SparkSession, folder: str) -> int | None:
    """The number of the newest whole pointer."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/pointers")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return None
    whole = [int(s.getPath().getName()) for s in store.listStatus(place) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(whole, default=None)


def current(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    at = _pointer(spark, folder)
    if at is None:
        raise FileNotFoundError(f"no snapshot in {folder}")
    out = {}
    for name in at.tables:
        if name not in (at.parts or {}):
            out[name] = spark.read.parquet(f"{folder}/{at.version}/{name}")
            continue
        schema = StructType.fromJson(json.loads(at.schemas[name]))
        paths = [f"{folder}/{v}/{name}/_bucket={b}" for b, v in sorted(at.parts[name].items())]
        out[name] = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return out


def init_project(spark: SparkSession, folder: str, name: str, force: bool = False, **settings: str) -> dict[str, str]:
    """Write a project's settings (name, seed, ...) to folder/project, a JSON line; ValueError for a blank name, an error if it exists and is not forced."""
    if not name.strip():
        raise ValueError("a project needs a name")
    found = {"project_name": name.strip(), "map_seed": "42"} | settings
    spark.createDataFrame([(found,)], "settings map<string,string>").coalesce(1).write.mode("overwrite" if force else "errorifexists").json(f"{folder}/project")
    return found


def project(spark: SparkSession, folder: str) -> dict[str, str]:
    """The settings of a project."""
    return dict(spark.read.schema("settings map<string,string>").json(f"{folder}/project").first().settings)
