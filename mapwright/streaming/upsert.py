"""An extension for streams: chunk files merged into the store as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mapwright.operators.store import ChunkStore
from mapwright.sources.catalog import CHUNK


def upsert_stream(spark: SparkSession, folder: str, store: ChunkStore, collection: str, checkpoint: str, once: bool = True):
    """Start a query that upserts new chunk files of ``folder``; with ``once`` it ends when all are in.

    Within one micro-batch the last row of a key wins, by file time, file name and place in the
    file; a row without embedding stops the query, as it does an upsert. Reruns of a batch are
    harmless, as the merge is by key.
    """

    def merge(batch: DataFrame, _: int) -> None:
        last = F.row_number().over(W.partitionBy("chunk_id").orderBy(F.col("place").desc(), F.col("at").desc()))
        rows = batch.withColumn("at", F.monotonically_increasing_id()).withColumn("_n", last).where("_n = 1").drop("_n", "place", "at")
        if not rows.isEmpty():
            store.index(collection, rows)

    # Offsets within a file come with the split that holds them, rows of a split in order.
    meta = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start")
    stream = spark.readStream.schema(CHUNK).json(folder).withColumn("place", meta)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
