"""Scanning files as they arrive: the batch scan applied to each micro-batch of a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators import rules
from veilspark.sources import uploads

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """(file_id, name, text) of new files under a folder; file_id is a hash of the path."""
    df = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_a_batch).load(path)
    return df.where(F.col("length") <= uploads.MOST_BYTES).select(F.xxhash64("path").alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("name"), uploads.decode(F.col("content")).alias("text"))


def hit_stream(files: DataFrame) -> DataFrame:
    """Rule hits of a stream of files: a map, so it needs no state and no watermark."""
    return rules.hit_rows(files.where("text is not null"))


def scan_to(files: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends hits to a Parquet table, exactly once a file."""
    w = hit_stream(files).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
