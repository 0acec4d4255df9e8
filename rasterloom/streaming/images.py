"""Blob counts of images that arrive in a folder: an extension of the batch reader, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def watch_images(spark: SparkSession, path: str, handle: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Call handle(files: path, modificationTime, length, content) for each micro-batch of new files, once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: handle(df)).start()
