"""Session helpers: shared scratch tables, input reading, sizing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.distribution import ship

DOC_SCHEMA = "doc_id long, text string"
#: Rows and bytes of an Arrow batch that a Python worker gets at once, unless the session says otherwise.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def prepare(spark: SparkSession) -> None:
    """Ship the package, and bound the batches of workers where the session has no setting of its own."""
    ship(spark)
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one if that is unset and all run in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark.sparkContext, "_lexatlas_scratch", None)
        if found is None:
            found = tempfile.mkdtemp(prefix="lexatlas-")
            spark.sparkContext._lexatlas_scratch = found
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) on the JVM side."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the application's scratch folder, which goes when the application ends."""
    context = spark.sparkContext
    run = getattr(context, "_lexatlas_run", None)
    if run is None:
        run = context._lexatlas_run = f"{shared_dir(spark)}/lexatlas/{uuid.uuid4().hex}"
        store, target = _hadoop(spark, run)
        store.mkdirs(target)
        store.deleteOnExit(target)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as a table in the shared folder and read it back."""
    spark = df.sparkSession
    prepare(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexatlas_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_lexatlas_path", None)
        if path is None:
            continue
        store, target = _hadoop(df.sparkSession, path)
        store.delete(target, True)


@contextlib.contextmanager
def merge_joins(spark: SparkSession):
    """What is written within joins by sort and merge. A broadcast that Spark adds by itself passes through the driver; where a
    method writes dozens of tables, its threads and buffers add up there."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text with null as empty; rows without doc_id and extra columns go."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id is not null")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
