"""Sinks: JSON and HTML of a map, reports, backups with checksums."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents_json(documents: DataFrame, points: DataFrame) -> DataFrame:
    """One JSON line for each document with its point, without the text."""
    shown = documents.drop("text").join(points, "doc_id", "left")
    return shown.select(F.to_json(F.struct(*sorted(shown.columns))).alias("value"))


def write_json(rows: DataFrame, folder: str) -> None:
    """Lines of JSON, a file for each partition."""
    rows.write.mode("errorifexists").text(folder)


def map_json(points: DataFrame, clusters: DataFrame, warnings: list[str], most: int = 1000) -> str:
    """The whole map as one JSON document; a map has at most `most` points (its cap), ValueError beyond."""
    listed = [json.loads(x) for x in points.orderBy("doc_id").limit(most + 1).toJSON().collect()]
    if len(listed) > most:
        raise ValueError(f"a map has at most {most} points")
    groups = [json.loads(x) for x in clusters.orderBy("cluster_id").limit(most).toJSON().collect()]
    return json.dumps({"points": listed, "clusters": groups, "cluster_labels": {str(c["cluster_id"]): c["display_label"] for c in groups}, "warnings": warnings}, sort_keys=True)


def map_html(payload: str, title: str = "Map") -> str:
    """A page that holds the map's JSON and draws its points."""
    data = payload.replace("<", "\\u003c")
    draw = (
        "const m=JSON.parse(document.getElementById('map').textContent),c=document.querySelector('svg');"
        "for(const p of m.points){const d=document.createElementNS('http://www.w3.org/2000/svg','circle');"
        "d.setAttribute('cx',p.x);d.setAttribute('cy',p.y);d.setAttribute('r',.01);"
        "d.setAttribute('fill','hsl('+(p.cluster_id*47%360)+' 60% 50%)');"
        "const t=document.createElementNS('http://www.w3.org/2000/svg','title');t.textContent=p.doc_id+' '+p.cluster_label;d.append(t);c.append(d)}"
    )
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><svg viewBox="-1.1 -1.1 2.2 2.2" width="800" height="800"></svg><script type="application/json" id="map">{data}</script><script>{draw}</script></body></html>'


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """relative_path, size_bytes and sha256 of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^.*?" + _escaped(folder.split(":")[-1].rstrip("/")) + "/", "")
    return files.select(path.alias("relative_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def _escaped(text: str) -> str:
    import re

    return re.escape(text)


def backup(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write tables to folder/data and their files' checksums to folder/manifest, which is returned."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/data/{name}")
    spark = next(iter(tables.values())).sparkSession
    listed = checksums(spark, f"{folder}/data")
    listed.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def inspect(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a backup whose content is not what its manifest says: relative_path and problem (missing, changed, unknown)."""
    said = spark.read.parquet(f"{folder}/manifest").select("relative_path", F.col("sha256").alias("said"))
    both = said.join(checksums(spark, f"{folder}/data").select("relative_path", "sha256"), "relative_path", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("said").isNull(), "unknown").when(F.col("sha256") != F.col("said"), "changed")
    return both.select("relative_path", problem.alias("problem")).where("problem is not null")


def restore(spark: SparkSession, folder: str, target: str, force: bool = False, dry_run: bool = False) -> dict[str, DataFrame]:
    """Tables of a sound backup, written to a target folder (which must not exist, unless forced) and read from there.

    ValueError if a file is not what the manifest says. A dry run checks, and reads the backup itself.
    """
    wrong = inspect(spark, folder).limit(5).collect()
    if wrong:
        raise ValueError("backup is damaged: " + ", ".join(f"{r.relative_path} {r.problem}" for r in wrong))
    names = [r[0] for r in spark.read.parquet(f"{folder}/manifest").select(F.split("relative_path", "/")[0]).distinct().collect()]  # one row a table
    for name in [] if dry_run else names:
        spark.read.parquet(f"{folder}/data/{name}").write.mode("overwrite" if force else "errorifexists").parquet(f"{target}/{name}")
    return {name: spark.read.parquet(f"{folder}/data/{name}" if dry_run else f"{target}/{name}") for name in names}


def payload_lines(rows: DataFrame) -> DataFrame:
    """Clusters, pairs, reports or a validation's issues as a JSON line each, fields by name."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value"))


def demo(documents: DataFrame, points: DataFrame, clip: int = 160) -> tuple[DataFrame, DataFrame]:
    """documents (doc_id, relative_path, text, ...) and points for a public page: stable ids from paths, also in neighbour lists, stamps and long texts taken out."""
    named = documents.select("doc_id", F.concat(F.lit("demo_doc_"), F.substring(F.sha2("relative_path", 256), 1, 12)).alias("demo_id"))
    compact = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    short = F.when(F.length(compact) <= clip, compact).otherwise(F.concat(F.rtrim(F.substring(compact, 1, clip - 3)), F.lit("...")))
    shown = documents.join(named, "doc_id").select(F.col("demo_id").alias("document_id"), "relative_path", short.alias("excerpt"), F.lit("synthetic-demo").alias("updated_at"))
    pairs = points.select("doc_id", F.posexplode("neighbours").alias("k", "n")).join(named.select(F.col("doc_id").alias("other"), F.col("demo_id").alias("to")), F.col("n.neighbour") == F.col("other"))
    near = pairs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "to", "n.score"))).alias("all")).select("doc_id", F.transform("all", lambda x: F.struct(x["to"].alias("document_id"), x["score"].alias("score"))).alias("neighbours"))
    places = points.drop("neighbours").join(near, "doc_id", "left").join(named, "doc_id").drop("doc_id").withColumnRenamed("demo_id", "document_id")
    return shown, places
