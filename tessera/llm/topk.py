"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, but scores are never gathered: each task counts its scores in bins, the
counts are summed over all tasks, and the bin that holds a query's k-th score is refined until no more than `few` rows
beyond the sure ones are left in it, or a bin is one score wide. If more rows than are wanted tie at that score, the
same refinement goes on over their ids. A last pass then keeps the rows within the limits, and a window of at most
k + few rows a query ranks them. Ties go to the smaller id.

Queries are a stated set; they are worked on in blocks of `block` vectors, the only vectors that the driver and each task hold.
Candidates are every row, so a block costs some scans of the table and no shuffle but that of the counts.

Vectors that are null, or hold a null or non-finite component, take no part, neither do rows with a null id. A vector of
another length than a query's is no candidate of it. A query with fewer than k candidates returns all. Repeated rows are
candidates of their own; rows of the query's own id are none; of several usable rows of a query's id the one with the
smallest vector asks. An empty table gives an empty result. Columns other than the two named aren't read. Scores that 64 bits
can't hold are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import added, arrow, cut, drop, table

BINS = 256


@dataclass
class Search:
    """A block's vectors with, for each query, the range still open: low <= key <= high in scores (stage 0) or ids (stage 1)."""

    ids: np.ndarray
    vectors: np.ndarray
    k: int
    stage: np.ndarray = field(init=False)
    low: np.ndarray = field(init=False)
    high: np.ndarray = field(init=False)
    need: np.ndarray = field(init=False)  # rows still to be found within the range
    tied: np.ndarray = field(init=False)  # the k-th score, in stage 1
    done: np.ndarray = field(init=False)

    def __post_init__(self):
        n = len(self.ids)
        self.stage, self.done = np.zeros(n, np.int64), np.zeros(n, bool)
        self.low, self.high, self.tied = (np.zeros(n, np.int64) for _ in range(3))
        self.need = np.full(n, self.k, np.int64)

    def width(self) -> np.ndarray:
        return np.maximum(-(-(self.high - self.low + 1) // BINS), 1)


def scaled(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer vectors) of the usable rows, for each length of vector: floor(scale * x) of each component x as a double."""
    vectors, ids = batch.column("vector"), batch.column("id")
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    usable = (lengths > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[usable]):
        rows = pa.array(np.flatnonzero(usable & (lengths == n)))
        flat = pc.list_flatten(vectors.take(rows))
        x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, n)
        x = np.floor(scale * x)
        fine = np.isfinite(x).all(1)
        yield ids.take(rows).to_numpy(zero_copy_only=False)[fine].astype(np.int64), x[fine]


def product(candidates: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where no sum can reach 2**53, else by integers."""
    most = (np.abs(candidates).max(initial=0) * np.abs(queries).max(initial=0)) * max(queries.shape[1], 1)
    if most < 2**53:
        return np.rint(candidates @ queries.T).astype(np.int64)
    if most < 2**63:
        return candidates.astype(np.int64) @ queries.astype(np.int64).T
    raise OverflowError("scores go beyond 64 bits")


def _scores(batches: Iterator[pa.RecordBatch], search: Search, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, score by candidate and query, whether the pair counts)."""
    for batch in batches:
        for ids, x in scaled(batch, scale):
            if x.shape[1] == search.vectors.shape[1]:
                for k in range(0, len(ids), 512):
                    yield ids[k : k + 512], product(x[k : k + 512], search.vectors), ids[k : k + 512, None] != search.ids[None, :]


def count(rows: DataFrame, search: Search, scale: float) -> np.ndarray:
    """For each query and bin of its open range, how many rows are in it; over all rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        open_ = np.flatnonzero(~search.done)
        total = np.zeros(len(open_) * BINS, np.int64)
        width = search.width()[open_]
        for ids, score, counts in _scores(batches, search, scale):
            score, counts = score[:, open_], counts[:, open_]
            ids_ = np.broadcast_to(ids[:, None], score.shape)
            key = np.where(search.stage[open_] == 0, score, ids_)
            counts = counts & (key >= search.low[open_]) & (key <= search.high[open_]) & ((search.stage[open_] == 0) | (score == search.tied[open_]))
            bin_ = (key - search.low[open_]) // width + np.arange(len(open_)) * BINS
            total += np.bincount(bin_[counts], minlength=len(total))
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            rows = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(open_[rows // BINS].astype(np.int32)), pa.array((rows % BINS).astype(np.int32)), pa.array(total[rows])], ["query", "bin", "many"])

    out = np.zeros((len(search.ids), BINS), np.int64)
    summed = rows.mapInArrow(run, "query int, bin int, many long").groupBy("query", "bin").agg(F.sum("many").alias("many"))
    # at most block * BINS numbers
    for r in summed.groupBy("query").agg(F.collect_list("bin").alias("bin"), F.collect_list("many").alias("many")).toLocalIterator():
        out[r["query"], r["bin"]] = r["many"]
    return out


def narrow(search: Search, counts: np.ndarray, few: int, id_range: tuple[int, int]) -> None:
    """Moves each open query's range to the bin with its last wanted row."""
    width = search.width()
    for q in np.flatnonzero(~search.done):
        bins = counts[q]
        if search.stage[q] == 0:
            # from the highest score down
            reached = np.cumsum(bins[::-1])
            if reached[-1] <= search.need[q]:
                search.done[q] = True  # all rows within the range are wanted
                continue
            k = BINS - 1 - int(np.searchsorted(reached, search.need[q]))
            above = int(reached[BINS - 2 - k]) if k < BINS - 1 else 0
            search.low[q] += k * width[q]
            search.high[q] = min(search.low[q] + width[q] - 1, search.high[q])
            search.need[q] -= above
            if bins[k] <= search.need[q] + few:
                search.done[q] = True
            elif search.low[q] == search.high[q]:
                search.stage[q], search.tied[q] = 1, search.low[q]
                search.low[q], search.high[q] = id_range
        else:
            reached = np.cumsum(bins)
            k = int(np.searchsorted(reached, search.need[q]))
            below = int(reached[k - 1]) if k else 0
            search.low[q] += k * width[q]
            search.high[q] = min(search.low[q] + width[q] - 1, search.high[q])
            search.need[q] -= below
            # rows of one id can't be told apart, and make no difference
            if bins[k] <= search.need[q] + few or search.low[q] == search.high[q]:
                search.done[q] = True


def select(rows: DataFrame, search: Search, scale: float) -> DataFrame:
    """The rows within the limits that were found: few more than k a query."""
    shared = rows.sparkSession.sparkContext.broadcast(search)
    k_most = search.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value
        late = search.stage == 1
        least = np.where(late, search.tied, search.low)
        for ids, score, counts in _scores(batches, search, scale):
            keep = counts & (score >= least)
            keep &= ~late | (score > search.tied) | (ids[:, None] <= search.high)
            i, j = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[j]), pa.array(ids[i]), pa.array(score[i, j])], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k_most).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, id_: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, block: int = 4096, few: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row that the condition is_query admits."""
    spark = vectors.sparkSession
    arrow(spark)
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector")).filter("id is not null and vector is not null")
    wanted = vectors.filter(is_query).select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector")).filter("id is not null").filter(usable(F.col("vector"), scale))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    largest = _largest(rows, scale) if low is not None else 0
    # one row a query, dealt by the id's hash to blocks of half the most; a block alone goes to the driver
    asked = wanted.groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = -(-asked.count() // max(block // 2, 1))
    if blocks > 1:
        asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "block")
    found = None
    for number in range(blocks):
        got = (asked.filter(F.col("block") == number).drop("block") if blocks > 1 else asked).toArrow()
        by: dict[int, list] = {}
        for batch in got.to_batches():
            for ids, x in scaled(batch, scale):
                by.setdefault(x.shape[1], []).append((ids, x))
        for each in by.values():
            ids, first = np.unique(np.concatenate([i for i, _ in each]), return_index=True)
            search = Search(ids, np.concatenate([x for _, x in each])[first], k)
            if not len(ids):
                continue
            # no score is larger than this in absolute value
            bound = np.abs(search.vectors).sum(1) * largest
            search.low, search.high = -bound.astype(np.int64), bound.astype(np.int64)
            while not search.done.all():
                narrow(search, count(rows, search, scale), few, (low, high))
            got_ = select(rows, search, scale)
            if blocks == 1 and len(by) == 1:
                return got_
            # each block's results go to one table as they come
            found = cut(got_) if found is None else added(found, got_)
    if blocks > 1:
        drop(asked)
    return empty if found is None else found


def usable(vector: Column, scale: float) -> Column:
    """Neither null nor empty, and each component is a number that stays one when it is scaled."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def _largest(rows: DataFrame, scale: float) -> int:
    """The largest absolute component of the usable integer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            for _, x in scaled(batch, scale):
                most = max(most, float(np.abs(x).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["most"])

    return int(rows.mapInArrow(run, "most double").agg(F.max("most")).first()[0] or 0)


def op2_exact_topk_search(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


#: DuckDB's SQL for op2. Vectors are of one length here, so the inner product is a sum over places.
ORACLE = {
    "op2_exact_topk_search": """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
    select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
)
select query_id, rank, vec_id, score from (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s
) where rank <= 5
"""
}
