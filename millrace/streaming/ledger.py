"""Incremental work: a stream of attempts, routed by status, each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def attempts(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """The parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_attempts(stream: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """Each key once within the watermark, whatever arrives again."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, kind: str, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Rows of each kind in tumbling windows; rows later than the watermark don't count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, out: str, checkpoint: str, by: str) -> None:
    """Process what is there and end; a later run takes up where this one ended."""
    query = stream.writeStream.format("parquet").partitionBy(by).option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
