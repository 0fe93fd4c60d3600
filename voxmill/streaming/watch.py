"""Volumes as they arrive: a folder of voxel files as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from voxmill.volume import Shape, Volume


def watch(spark: SparkSession, folder: str, schema: StructType | str, shape: Shape, process: Callable[[Volume], Volume], output: str, checkpoint: str) -> StreamingQuery:
    """Processes every new Parquet file of whole images once and writes the results
    under output by batch, so that a repeated batch overwrites its own."""

    def batch(rows, number: int) -> None:
        process(Volume(rows, shape)).voxels.write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
