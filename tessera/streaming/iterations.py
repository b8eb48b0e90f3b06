"""Iteration logs as a stream: an extension for watching an alignment while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.text import ITERATION


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the logs in a folder as they come, with the file's name."""
    return spark.readStream.schema(ITERATION).option("sep", "\t").option("header", True).csv(folder).withColumn("file", F.col("_metadata.file_name"))


def windowed(events: DataFrame, ts: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and count of a value in tumbling windows; rows later than the watermark are left out of a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width)).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "mean", "n")
