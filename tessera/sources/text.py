"""Text sources and sinks: parameter files, iteration logs, transform JSON, GeoJSON (also zipped), YAML-like configurations."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shapes import VERTICES, shape_name, vertices_of


def parameter_key(line: Column) -> Column:
    """The key of a line "(Key value ...)"; null for any other line."""
    return F.nullif(F.regexp_extract(F.trim(line), r"^\((\S+)[^)]*\)", 1), F.lit(""))


def parameter_values(line: Column) -> Column:
    """The values of such a line without their quotes."""
    inner = F.regexp_extract(F.trim(line), r"^\(\S+\s*([^)]*)\)", 1)
    return F.filter(F.split(F.regexp_replace(inner, '"', ""), r"\s+"), lambda v: v != "")


def parameters_of(text: str) -> dict[str, list[str]]:
    """One file's map, on the driver: the first line of each key counts."""
    out: dict[str, list[str]] = {}
    for key, values in re.findall(r"^\s*\((\S+)\s*([^)]*)\)", text, re.M):
        out.setdefault(key, values.replace('"', "").split())
    return out


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, params): a map from key to values for each parameter file under the path."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    kept = lines.select("file", parameter_key(F.col("value")).alias("key"), parameter_values(F.col("value")).alias("values")).filter("key is not null")
    return kept.dropDuplicates(["file", "key"]).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("params"))


ITERATION = "iteration int, metric double, time_a double, step_size double, gradient double, iter_time double"


def read_iterations(spark: SparkSession, path: str) -> DataFrame:
    """Iteration logs with the model and resolution that their names "IterationInfo.<model>.R<res>.txt" give."""
    rows = spark.read.schema(ITERATION).option("sep", "\t").option("header", True).csv(path)
    name = F.col("_metadata.file_name")
    return rows.select(F.regexp_extract(name, r"IterationInfo\.(\d+)\.R(\d+)", 1).cast("int").alias("model"), F.regexp_extract(name, r"IterationInfo\.(\d+)\.R(\d+)", 2).cast("int").alias("resolution"), *[F.col(c.split()[0]) for c in ITERATION.split(", ")])


def series(log: DataFrame, keys: list[str], order: list[str], metric: str) -> DataFrame:
    """A log's rows with their place in their own run (iteration, from 1) and how the metric changed from the row before (delta)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumns({"iteration": F.row_number().over(w).cast("long"), "delta": F.col(metric) - F.lag(metric).over(w)})


def per_resolution(name: Column) -> Column:
    """Whether a file of transform parameters is that of one resolution: its name has more than three dotted parts."""
    return F.size(F.split(name, r"\.")) > 3


def _features(raw: bytes, name: str) -> list[dict]:
    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            members = [m for m in z.namelist() if m.endswith((".json", ".geojson"))]
            raw = z.read(members[-1]) if members else b"[]"
    data = json.loads(raw)
    return data.get("features", [data]) if isinstance(data, dict) else data


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of all features of the files (.json, .geojson, .zip) under the path; each file is parsed in one task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in VERTICES.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.string()]
        for batch in batches:
            for file in batch.to_pylist():
                name = file["path"].rsplit("/", 1)[-1]
                rows = []
                for k, feature in enumerate(_features(file["content"], name)):
                    kind = feature["geometry"]["type"]
                    rows += [(name.split(".")[0], k, *v, kind, shape_name(feature)) for v in vertices_of(feature)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return files.mapInArrow(run, VERTICES)


def write_geojson(features: DataFrame, path: str) -> None:
    """Features (set_name, feature_id, feature) as one JSON line each, a folder for each set; they read back as sets of lines."""
    features.select("set_name", F.col("feature").alias("value")).write.partitionBy("set_name").text(path)
