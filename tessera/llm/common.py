"""What the operators share: reading tables, cutting lineage, handing Arrow text to numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..workers import ready

#: Rows and bytes of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Workers give freed memory back to the system: else each keeps the most that any slice has needed, beside a full heap.
ALLOCATION = {"MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Bounds the Arrow batches of this session, and lets its Python workers find this package where it lies for the driver."""
    ready(spark)
    for name, value in ALLOCATION.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Tables of cut() that nobody has dropped.
_written: set[str] = set()


def cut(df: DataFrame, *folders: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and lost executors recompute nothing before it. folders: columns whose values lie apart, for reading some of them."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    _written.add(path)
    return _read(df, path)


def _read(df: DataFrame, path: str) -> DataFrame:
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def added(table: DataFrame, df: DataFrame) -> DataFrame:
    """A table made by cut() with more rows of the same columns."""
    df.select(*table.columns).write.mode("append").parquet(table.written_to)
    return _read(table, table.written_to)


def observed(seen: Observation) -> dict:
    """What was observed; nothing where an empty table beside it ended the plan before."""
    row = seen._jo.getRow()
    return seen.get if row.length() else {}


def drop(df: DataFrame) -> None:
    """Deletes a table made by cut() once nothing will read it again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    _written.discard(df.written_to)


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that results of this process read from; for when these have been written or are no longer wanted."""
    for path in list(_written):
        drop(_read(spark.createDataFrame([], "x int"), path))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_only(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text (null becomes empty) and the columns named; other columns don't reach the kernels."""
    return df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and the n + 1 offsets into them."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches again in slices of about `most` bytes of a text column without nulls and BATCH_ROWS rows, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = min(max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1), start + BATCH_ROWS)
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
