"""Lets the session's Python workers find this package where it lies for the driver."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> None:
    """Workers that start from now on look in this package's folder too; on executors that have it elsewhere this changes nothing."""
    found = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in found:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, found)])
