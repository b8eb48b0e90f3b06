"""Preprocessed images kept beside their parameters, and read again only for the same parameters."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession


def key(tag: str, params) -> str:
    """A folder's name from an image's tag and what it was made with."""
    told = json.dumps(asdict(params) if is_dataclass(params) else params, sort_keys=True, default=str)
    return f"{tag}-{hashlib.sha256(told.encode()).hexdigest()[:16]}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def cached(df: DataFrame, folder: str, tag: str, params) -> DataFrame:
    """What was kept for the tag and parameters, or df, kept from now on."""
    path = f"{folder}/{key(tag, params)}"
    if not exists(df.sparkSession, path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
