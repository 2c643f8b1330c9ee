"""Beyond the batch engine: the same state merge fed by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexatlas.sources.files import merge


def stream_documents(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, keys: tuple[str, ...] = ("document_id",)):
    """Upsert each micro-batch of a parquet file stream into the table documents of a folder, which is kept in buckets.

    A batch writes only the buckets that it changes; one that is played again, after a failure, changes nothing.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        merge(batch.sparkSession, folder, "documents", batch.dropDuplicates(list(keys)), list(keys), epoch=epoch)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
