"""Bottom-k sketches of shingle hashes.

A shingle is each run of eight bytes of a text's UTF-8 form (a shorter text is one shingle). The sketch keeps the k
smallest of the distinct 48-bit shingle hashes. The sketch of a union is the k smallest of both sketches, so sketches
merge across texts, parts and runs. From two sketches come estimates of resemblance (Jaccard), containment and the
number of distinct shingles; a sketch with fewer than k hashes is the whole set and its answers are exact.

A null text is an empty one and has an empty sketch; two empty sketches have likeness 1, an empty and another one 0.
Repeated rows get equal results. Rows with a null doc_id come first in the order of documents, rows of equal doc_id
follow each other by text. The last document's next one is the first; a single document is its own next one. An empty
table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow, mix, partitions, slices, table

K, WIDTH = 128, 8
#: Hashes are below this; the k-th smallest over it is the share of the hash space seen.
SPACE = 1 << 48


def shingle_hashes(text: bytes) -> np.ndarray:
    """One 48-bit hash for each run of eight bytes."""
    if len(text) >= WIDTH:
        words = np.ndarray((len(text) - WIDTH + 1,), "<u8", text, 0, (1,))
        return mix(words) >> np.uint64(16)
    if text:
        return mix(np.array([int.from_bytes(text, "little") ^ (len(text) << 56)], np.uint64)) >> np.uint64(16)
    return np.zeros(0, np.uint64)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending. A guess of the k-th value spares sorting all; too low a guess is raised."""
    most = 2.0 * k / max(len(hashes), 1)
    while most < 0.5:
        found = np.unique(hashes[hashes < np.uint64(int(most * SPACE))])
        if len(found) >= k:
            return found[:k]
        most *= 4
    return np.unique(hashes)[:k]


def sketch(text: str, k: int = K) -> np.ndarray:
    return bottom(shingle_hashes(text.encode()), k)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the k smallest hashes of the union that both have."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    # a value's rank in the union is its place less the pairs before it
    rank = np.arange(1, len(both)) - (np.cumsum(twice) - twice)
    union = min(k, len(both) - int(twice.sum()))
    return float((twice & (rank <= union)).sum()) / union


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / SPACE)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    own = distinct(a, k)
    return 1.0 if not own else min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / own)


def pack(a: np.ndarray) -> str:
    """The sketch as base64 text: six bytes a hash, big-endian."""
    return base64.b64encode(a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles (estimate), fingerprint of every row of documents."""
    arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sketch(t, k) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([distinct(x, k) for x in found], pa.float64()), pa.array(map(pack, found), pa.string())], ["doc_id", "n_shingles", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_shingles double, fingerprint string")


def merged(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """key, n_shingles, fingerprint: for each value of a column the sketch of all its rows' shingles together, from fingerprints() or earlier merges.

    Tasks merge what they hold of a key before it is shuffled, so a key with a third of all rows arrives as a sketch a task. Null
    keys are a group of their own; rows without a fingerprint add nothing, and a key of such alone is left out.
    """
    arrow(prints.sparkSession)
    kind = StructType([prints.schema[key], StructField("fingerprint", StringType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out(schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array(list(held), schema.field(0).type), pa.array(map(pack, held.values()), pa.string())]
            return pa.RecordBatch.from_arrays(columns, [key, "fingerprint"])

        for batch in batches:
            for value, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if told is not None:
                    held[value] = merge(held[value], unpack(told), k) if value in held else unpack(told)[:k]
            if len(held) > MERGED:
                yield out(batch.schema)
                held.clear()
        if held:
            yield out(batch.schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted, so the rows of a key follow each other
        value, own = None, None
        for batch in batches:
            done: list[tuple] = []
            for now, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own is not None and now == value:
                    own = merge(own, unpack(told), k)
                else:
                    if own is not None:
                        done.append((value, own))
                    value, own = now, unpack(told)
            yield told_of(done, batch.schema)
        if own is not None:
            yield told_of([(value, own)], batch.schema)

    def told_of(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([v for v, _ in done], schema.field(0).type), pa.array([distinct(x, k) for _, x in done], pa.float64()), pa.array([pack(x) for _, x in done], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [key, "n_shingles", "fingerprint"])

    parts = prints.select(key, "fingerprint").mapInArrow(part, kind).repartition(key).sortWithinPartitions(key)
    return parts.mapInArrow(whole, StructType([kind[0], StructField("n_shingles", DoubleType()), kind[1]]))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced with the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Keys whose sketches a task holds at once as it merges.
MERGED = 20_000
#: Bytes of a table that a range of ids is to hold about.
RANGE = 64 << 20
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, containment_in_edited double"


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (place, guest, doc_id, text) dealt by ranges of doc_id and sorted, so that each row's next document follows it.

    A range ends with a guest: the first document of the following range, read again by its id. So no window spans the
    table, and the texts are shuffled once. The driver holds one id for each range; there is a range for each RANGE bytes that
    Spark expects of the table, twice the session's shuffle partitions at least. Null ids come first, by a hash of their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.pmod(F.xxhash64("text"), F.lit(1 << 40)) - F.lit((1 << 63) - 1) - 1).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    expected = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # the tree of comparisons that finds a row's range is an expression, so it has an end; beyond it ranges grow
    n = max(2 * partitions(spark), min(expected // RANGE, 8192))
    splits = rows.select(F.percentile_approx("key", F.array(*[F.lit((i + 1) / n) for i in range(n - 1)]), 10000)).first()[0]
    splits = sorted(set(splits or []))

    def under(low: int, high: int) -> str:
        """SQL for the number of split values under key, by halving."""
        if low == high:
            return str(low)
        half = (low + high) // 2
        return f"if(key > {splits[half]}L, {under(half + 1, high)}, {under(low, half)})"

    place = F.expr(under(0, len(splits)))
    heads = sorted((r[0], r[1]) for r in rows.select(place.alias("place"), "key").groupBy("place").agg(F.min("key")).collect())
    own = rows.withColumn("place", place).withColumn("guest", F.lit(False))
    if not heads:
        return own.select("place", "guest", "doc_id", "text")
    before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads)}  # the first head is the guest of the last range
    guests = rows.filter(F.col("key").isin(list(before))).withColumn("place", F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("key")]).withColumn("guest", F.lit(True))
    both = own.unionByName(guests)
    return both.repartition(max(partitions(spark), n // 2), "place").sortWithinPartitions("place", "guest", "key", "text").select("place", "guest", "doc_id", "text")


def beside_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document."""
    arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before: place, doc_id, text, sketch
        for batch in slices(batches, 2 << 20):
            out: list[list] = [[] for _ in range(9)]
            for place, guest, doc, text in zip(*(batch.column(c).to_pylist() for c in ("place", "guest", "doc_id", "text")), strict=True):
                own = sketch(text, k) if not (guest and (last is None or last[0] != place)) else None
                if last is not None and last[0] == place:
                    changed = edited(last[2], text)
                    other = last[3] if changed == last[2] else sketch(changed, k)
                    row = (last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(), pack(last[3]), pack(other), resemblance(last[3], other, k), resemblance(last[3], own, k), distinct(last[3], k), containment(last[3], other, k))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                last = None if guest else (place, doc, text, own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [x.split()[0] for x in OUT.split(", ")])

    return with_next(docs).mapInArrow(run, OUT)


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return beside_edits(table(spark, sf_dir, "documents"))

