"""Vector best-fit packing of token sequences.

A piece of n tokens asks for the vector (n, 1, n * n): tokens, documents, attention cost. That vector depends on n
alone, so the packing of all pieces is decided on their histogram by length, which has as many entries as a sequence
has tokens, whatever the corpus: equal bins are kept as one state with a count, and the driver never sees a document.
Pieces then find their places by their rank among the pieces of the same length.

Null texts are empty documents; an empty document is its end mark alone. Repeated rows are separate documents and
repeated ids separate documents too, told apart by numbers that their pieces get as they are written. An empty table gives an empty
result. Columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow, cut, drop, slices, table, text_only
from .tokens import default_vocabulary, encode


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most. score is "dot" (largest weighted dot product of demand and residual, after Panigrahy et al.) or "norm" (smallest weighted norm of what is left)."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    score: str = "norm"
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents, self.attention


def pieces_of(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: only one longer than `most` is cut, the first piece takes the remainder."""
    first = n % most or min(n, most)
    return [(0, first), *((s, most) for s in range(first, n, most))]


def best_fit(counts: dict[int, int], cap: Capacity) -> list[tuple[list[tuple[int, int]], int]]:
    """Packs counts[n] pieces of n tokens, longest first. Returns bins as ([(length, how many)], number of such bins).

    By "norm", placing a piece leaves its bin the best for the next piece of that length as long as it fits: that bin's
    residual is the smallest. So pieces of a length go to the best state in bulk, each bin filled before the next is
    touched. "dot" chooses the state by the product and fills its bins in the same bulk.
    """
    full = np.array(cap.vector(), float)
    weights = np.array(cap.weights)
    states: dict[tuple[int, int, int], list[list]] = {}  # residual -> [[contents, number of bins]]
    for n in sorted(counts, reverse=True):
        left = counts[n]
        need = (n, 1, n * n)
        if any(x > y for x, y in zip(need, cap.vector(), strict=True)):
            raise ValueError(f"a piece of {n} tokens fits no sequence")
        while left:
            open_ = [r for r in states if all(x >= y for x, y in zip(r, need, strict=True))]
            if open_:
                residual, demand = np.array(open_) / full, np.array(need) / full
                if cap.score == "dot":
                    # of equal products the smaller residual, by the sort below
                    rank = -(residual * demand) @ weights
                else:
                    rank = np.sqrt((((residual - demand) ** 2) * weights).sum(1))
                best = open_[int(np.lexsort((np.array(open_)[:, 1], np.array(open_)[:, 0], rank))[0])]
            else:
                best = cap.vector()
            each = min(b // x for b, x in zip(best, need, strict=True))
            if open_:
                group = states[best]
                contents, bins = group[-1]
            else:
                contents, bins = [], -(-left // each)
            used = min(bins, left // each)
            for number, many in ((used, each), (int(used < bins and left - used * each > 0), min(each, left - used * each))):
                if number and many:
                    after = tuple(b - many * x for b, x in zip(best, need, strict=True))
                    states.setdefault(after, []).append([[*contents, (n, many)], number])
                    left -= number * many
                    bins -= number
            if open_:
                if bins:
                    group[-1 if group[-1][0] is contents else group.index(next(g for g in group if g[0] is contents))][1] = bins
                else:
                    group[:] = [g for g in group if g[0] is not contents]
                    if not group:
                        del states[best]
    return [(contents, bins) for group in states.values() for contents, bins in group]


def places(packed: list[tuple[list[tuple[int, int]], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, the runs of ranks (from 0): first rank, first bin, offset of the first, pieces a bin."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    bin_ = 0
    for contents, bins in packed:
        offset = 0
        for n, many in contents:
            runs.setdefault(n, []).append((ranks.get(n, 0), bin_, offset, many))
            ranks[n] = ranks.get(n, 0) + bins * many
            offset += n * many
        bin_ += bins
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


#: Pieces of one length that a task ranks.
IN_SLOT = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encode_pieces(docs: DataFrame, vocabulary: str, most: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Every document encoded once and cut into pieces; with_ids adds the ids themselves."""
    arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(vocabulary, text), np.uint32(end_id)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(ids), most)):
                    doc.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[s : s + n].tobytes()))
                    if with_ids:
                        kept.append(ids[s : s + n].tolist())
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return text_only(docs).mapInArrow(run, PIECES + ", ids array<long>" * with_ids)


def assign(pieces: DataFrame, cap: Capacity) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length and a number of their own, _row; `pieces` is read four times, so hand in a written table.

    The rank of a piece among those of its length is its rank within (length, slot) plus the counts of the slots
    before. A length has as many slots as it takes for `IN_SLOT` pieces each, which bounds a task however many pieces share
    a length. The driver holds a number for each (length, slot).
    """
    spark = pieces.sparkSession
    slots = {r["length"]: -(-r["count"] // IN_SLOT) for r in pieces.groupBy("length").count().collect()}
    if not slots:
        return pieces.drop("_row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    by_length = F.array(*[F.lit(slots.get(n, 1)) for n in range(max(slots) + 1)])
    dealt = pieces.withColumn("slot", F.pmod(F.xxhash64("_row"), F.get(by_length, F.col("length").cast("int"))).cast("int"))
    counts: dict[int, np.ndarray] = {}
    for n, slot, many in dealt.groupBy("length", "slot").agg(F.count("*").alias("many")).toLocalIterator():
        counts.setdefault(n, np.zeros(slots[n], np.int64))[slot] = many
    before = {n: np.concatenate([[0], np.cumsum(x)[:-1]]) for n, x in counts.items()}
    found = places(best_fit({n: int(x.sum()) for n, x in counts.items()}, cap))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "slot").orderBy("_row")))
    shared = spark.sparkContext.broadcast((before, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, found = shared.value
        for batch in batches:
            length, slot, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "slot", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            by = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[by])) + 1
            for rows in np.split(by, edges) if len(by) else []:
                n = int(length[rows[0]])
                r = rank[rows] - 1 + before[n][slot[rows]]
                first, bin_, at, many = found[n]
                k = np.searchsorted(first, r, "right") - 1
                sequence[rows] = bin_[k] + (r - first[k]) // many[k]
                offset[rows] = at[k] + (r - first[k]) % many[k] * n
            keep = [c for c in batch.schema.names if c not in ("slot", "_rank", "_row")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(run, StructType(pieces.drop("_row").schema.fields).add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, cap: Capacity = Capacity(), vocabulary: str | None = None, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """All documents as pieces placed in sequences: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset."""
    pieces = encode_pieces(docs, vocabulary or default_vocabulary(), cap.tokens, end_id, with_ids)
    return assign(cut(pieces.withColumn("_row", F.monotonically_increasing_id())), cap)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
