"""Ships the package to the executors' Python workers, as a zip file added to the Spark context once, and keeps tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_lexatlas_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexatlas-")) / "lexatlas_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(Path(root.name) / path.relative_to(root)))
    context.addPyFile(str(target))
    context._lexatlas_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A new place for a table in the folder of spark.checkpoint.dir, deleted when the application ends.

    Where that is unset and all runs in one process (tests), in a local temporary folder; an error on a cluster without it.
    """
    context = spark.sparkContext
    run = getattr(context, "_lexatlas_tables", None)
    if run is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="lexatlas-")
        run = context._lexatlas_tables = f"{found.rstrip('/')}/lexatlas-tables/{uuid.uuid4().hex}"
        place = spark._jvm.org.apache.hadoop.fs.Path(run)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(place)
        store.deleteOnExit(place)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut lineage: the rows as a table in the shared folder, with a folder for each value of `by`. What was shuffled for it is deleted once it is written."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexatlas_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for path in (getattr(df, "_lexatlas_path", None) for df in frames):
        if path is not None:
            spark = next(df for df in frames if df is not None).sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with n, their place (from 0) in an order: by a range sort and the counts of its partitions."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits of the id count the rows of a partition
    kept = stored(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sorted")
    counts = kept.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    return kept.join(F.broadcast(counts.select("_part", (before - F.col("_from")).alias("_shift"))), "_part").withColumn("n", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
