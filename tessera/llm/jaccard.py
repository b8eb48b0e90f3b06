"""N-gram Jaccard join over count-vector R-trees, and the groups that its links form.

A document's set holds the hashes of its distinct runs of `words` words. The join finds every pair whose intersection
is at least `percent` hundredths of its union. Steps:

1. Documents of equal sets are one class, led by the smallest doc_id; only leaders go on.
2. Each leader's set is hashed into groups and the counts of the groups are its point. Two sets can overlap no more than
   the sum of their points' coordinate minima, and the same bound holds for the corners of two nodes of an R-tree. There
   is a coarse point of `GROUPS` coordinates and a fine one of a quarter of the set's size; neighbouring groups of a fine one add
   up to a coarser one, so that points of two sizes can be compared.
3. Linked sets must share one of the first (1 - J) n + 1 tokens in any order common to all. The order here puts
   tokens last by how high their counter in a table of fixed size (`SLOTS`) stands over the mean, in standard deviations, so that
   passages which many documents share don't bring these together. (With 10**13 tokens in all a counter has 4 * 10**7, give or
   take 6 * 10**3, so that a token stands out from some 25,000 repeats on; what is rarer makes buckets of few chunks.)
   Leaders meet by these tokens. The coarse points of those that meet make an R-tree, packed from the leaves to a root; it is
   joined with itself from the root down, and pairs of nodes, then of points, outside the bound are passed over. A pair whose shared token stands so late in its sets that what follows it can't
   reach the least overlap is passed over too: it meets by an earlier token, or isn't linked. The rest make candidate clusters.
4. Within a cluster an R-tree of the fine points is joined with itself, and the surviving pairs are verified on the sets. A pair
   already joined through others needs no check, as only the groups are asked for. Clusters and links become groups by
   alternating large-star and small-star steps.

A token's or cluster's rows are dealt evenly into chunks, to each of which some documents of the key go too: groups of near
copies are mostly joined by these. Only where that leaves a key's chunks in several groups do its rows meet again, by pairs of
slices and across these groups alone: a token's by their coarse points, a cluster's by their fine points, and then the sets of
each surviving pair in tasks of their own.

Nothing is capped: chunks and slices change where a pair is checked, not whether. Hashes are of 51 bits (set digests of 128).

A null or empty text, or one without words, has an empty set and is linked with nothing, not with its like either. With
fewer words than a run, the whole sequence is its one element. Repeated rows share their class, and rows of one doc_id are
taken to hold one text; rows with a null doc_id are given component null and link nothing. An empty table gives an empty result. Columns other than doc_id and text
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import arrow, cut, drop, mix, observed, partitions, slices, table, text_only, utf8

GROUPS, MOST_GROUPS, SLOTS = 32, 8192, 1 << 18
#: Rows of an R-tree's leaf, and children of its inner nodes.
LEAF, FAN = 64, 8
#: Rows of a token that meet in a task at first, members of a cluster that do, and rows of a slice of what these leave.
CHUNK, MEMBERS, SLICE = 4096, 512, 4096
#: Rows of a key that each of its chunks gets, about.
PIVOTS = 4
#: Documents up to this many are broadcast by their ids, to find their texts.
FEW = 200_000
#: Edges that a task joins at once.
BLOCK = 1 << 20
#: A token's level rises where its counter is so many standard deviations over the mean of all counters.
LEVELS = (4, 16, 64)
#: Bits of a token: with two for its level and eleven for its text they fill a number.
BITS = 51
#: Elements of the sets that a chunk of a cluster holds about, as long as its documents are no longer.
WEIGHT = 1_000_000
#: Bytes of text whose words are hashed at once; the arrays for it take some hundred times as much.
SLICED = 1 << 18
#: Buckets of at most so many rows are a single leaf whose pairs are tested together with those of other buckets.
SMALL = 6


@dataclass(frozen=True)
class Join:
    words: int = 5
    percent: int = 80

    def overlap(self, a, b):
        """The least intersection of linked sets of sizes a and b: the smallest i with 100 i >= percent (a + b - i)."""
        return -(-(self.percent * (a + b)) // (100 + self.percent))

    def prefix(self, n):
        """How many first tokens one of which linked sets share: the partner has percent hundredths of n in common at least."""
        return n - -(-(self.percent * n) // 100) + 1


# --- sets

_rng = np.random.default_rng(20)
_BYTES = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n, kept for the next slice of texts."""
    found = _powers.get(int(base))
    if found is None or len(found) <= n:
        found = np.full(max(n + 1, SLICED), base, np.uint64)
        found[0] = 1
        found = _powers[int(base)] = np.multiply.accumulate(found)
    return found[: n + 1]


def all_tokens(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The run hash at each word and the text it is of, in the order of the texts, repeats included.

    Word hashes are differences of a running sum of byte values times powers of an odd number, so a text's words are
    hashed without a loop over them.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
    word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[low] * powers(_BASE, len(data))[:-1], out=total[1:])
    hashed = mix((total[end] - total[begin]) * powers(_UNDO, len(data))[begin] + (end - begin).astype(np.uint64))
    text = np.searchsorted(offsets, begin, "right") - 1
    count = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    runs = hashed[: max(len(hashed) - words + 1, 0)].copy()
    for k in range(1, words):
        runs = mix(runs + np.uint64(k)) ^ hashed[k : k + len(runs)] * _BASE
    inside = np.arange(len(runs)) + words <= first[text[: len(runs)] + 1]
    runs, owner = mix(runs[inside]), text[: len(inside)][inside]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short):
            h = hashed[first[t] : first[t] + 1].copy()
            for k in range(1, count[t]):
                h = mix(h + np.uint64(k)) ^ hashed[first[t] + k : first[t] + k + 1] * _BASE
            extra[i] = mix(h ^ np.uint64(int(count[t]) << 50))[0]
        runs, owner = np.concatenate([runs, extra]), np.concatenate([owner, short])
    return runs >> np.uint64(64 - BITS), owner


def token_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct run hashes of all texts, sorted within each, and the offsets of the texts' sets. The owner goes into the bits over a token's, so that one sort does."""
    n = len(offsets) - 1
    runs, owner = all_tokens(data, offsets, words)
    both = np.sort((owner.astype(np.uint64) << np.uint64(BITS + 2)) | runs)
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    count = np.bincount((both >> np.uint64(BITS + 2)).astype(np.int64), minlength=n)
    return both & np.uint64((1 << BITS) - 1), np.concatenate([[0], np.cumsum(count)])


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    return token_sets(*utf8(batch.column("text")), words)


def token_counts(docs: DataFrame, join: Join) -> np.ndarray:
    """How many tokens of all documents fall to each of SLOTS counters, repeats included. A task gives SLOTS numbers at most."""
    part = 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in slices(batches, SLICED):
            tokens, _ = all_tokens(*utf8(batch.column("text")), join.words)
            total += np.bincount((tokens & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        rows = [k for k in range(SLOTS // part) if total[k * part : (k + 1) * part].any()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([total[k * part : (k + 1) * part].astype(np.uint32).tobytes() for k in rows], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    parts = text_only(docs).mapInArrow(run, schema).repartition(min(SLOTS // part, partitions(docs.sparkSession)), "part").mapInArrow(add, schema)
    out = np.zeros(SLOTS, np.int64)
    for k, raw in parts.toLocalIterator():
        out[k * part : (k + 1) * part] = np.frombuffer(raw, np.int64)
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    """0 for counters near the mean, more for those that stand high over it."""
    mean = counts.mean()
    return np.searchsorted(np.array(LEVELS), (counts - mean) / max(mean, 16.0) ** 0.5, "right").astype(np.uint8)


def groups_of(n: int) -> int:
    """Coordinates of the fine point of a set of n elements: a power of two."""
    return min(max(GROUPS, 1 << max(n // 4 - 1, 0).bit_length()), MOST_GROUPS)


def point_of(tokens: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((tokens >> np.uint64(BITS - groups.bit_length() + 1)).astype(np.int64), minlength=groups)


def packed(counts: np.ndarray) -> bytes:
    """A point in bytes, as narrow as its largest coordinate lets it be."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def unpacked(raw: bytes, groups: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // groups}")


POINTS = "doc_id long, n long, digest binary, point binary, fine binary, first array<long>"


def points(docs: DataFrame, join: Join, levels: np.ndarray) -> DataFrame:
    """Of every document: the size and digest of its set, its points, and its first tokens by the levels of their counters."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in slices(batches, SLICED):
            tokens, at = _sets(batch, join.words)
            n = np.diff(at)
            owner = np.repeat(np.arange(len(n)), n)
            running = np.zeros((2, len(tokens) + 1), np.uint64)
            np.cumsum(np.stack([mix(tokens), mix(tokens ^ _BASE)]), axis=1, out=running[:, 1:])
            digest = np.ascontiguousarray(mix(running[:, at[1:]] - running[:, at[:-1]] + n.astype(np.uint64)).T)
            counts = np.bincount(owner * GROUPS + (tokens >> np.uint64(BITS - 5)).astype(np.int64), minlength=len(n) * GROUPS).reshape(-1, GROUPS)
            high = levels[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
            fine = [packed(point_of(tokens[at[i] : at[i + 1]], groups_of(int(n[i])))) for i in range(len(n))]
            ordered = np.sort((owner.astype(np.uint64) << np.uint64(BITS + 2)) | (high << np.uint64(BITS)) | tokens) & np.uint64((1 << BITS) - 1)
            rank = np.arange(len(tokens)) - np.repeat(at[:-1], n)
            chosen = rank < np.repeat(join.prefix(n), n)
            first, bounds = ordered[chosen], np.concatenate([[0], np.cumsum(np.where(n > 0, join.prefix(n), 0))])
            columns = [batch.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in digest], pa.binary()), pa.array([packed(x) for x in counts], pa.binary()), pa.array(fine, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(first.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "point", "fine", "first"])

    return text_only(docs).mapInArrow(run, POINTS)


# --- R-trees of points


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    return points if points.shape[1] == groups else points.reshape(len(points), groups, -1).sum(2)


def grow(sizes: np.ndarray, coarse: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """An R-tree packed from below: the rows of each leaf, and for each level from the leaves up to one root the nodes' least and greatest sizes and their corners.

    Rows are packed by size into slabs, and within a slab by the coordinate that varies most; node k of a level covers the nodes
    FAN k to FAN k + FAN - 1 of the level below.
    """
    order = np.argsort(sizes, kind="stable")
    leaves = []
    for k in range(0, len(order), LEAF * FAN):
        rows = order[k : k + LEAF * FAN]
        if len(rows) > LEAF:
            rows = rows[np.argsort(coarse[rows, coarse[rows].var(0).argmax()], kind="stable")]
        leaves += [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
    levels = [(np.array([sizes[x].min() for x in leaves]), np.array([sizes[x].max() for x in leaves]), np.array([coarse[x].max(0) for x in leaves]))]
    while len(levels[-1][0]) > 1:
        low, top, corner = levels[-1]
        at = np.arange(0, len(low), FAN)
        levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(top, at), np.maximum.reduceat(corner, at)))
    return leaves, levels


def descend(levels: list, join: Join) -> Iterator[tuple[int, int]]:
    """Pairs a <= b of leaves that the bound allows at every level from the root down, those of a leaf with itself first."""
    a = b = np.zeros(1, np.int64)
    for depth, (low, top, corner) in enumerate(reversed(levels)):
        if depth:
            kids = np.arange(FAN)
            a, b = (x.ravel() for x in np.broadcast_arrays(a[:, None, None] * FAN + kids[:, None], b[:, None, None] * FAN + kids))
            real = (a <= b) & (b < len(low))
            a, b = a[real], b[real]
        # sizes alone, then the nodes' corners
        near = 100 * np.minimum(top[a], top[b]) >= join.percent * np.maximum(low[a], low[b])
        a, b = a[near], b[near]
        near = np.concatenate([np.minimum(corner[a[k : k + 4096]], corner[b[k : k + 4096]]).sum(1) for k in range(0, len(a), 4096)] or [np.zeros(0)]) >= join.overlap(low[a], low[b])
        a, b = a[near], b[near]
    order = np.argsort(a != b, kind="stable")
    return zip(a[order].tolist(), b[order].tolist(), strict=True)


def survivors(sizes: np.ndarray, points: list[np.ndarray], join: Join, apart, left: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose points allow a link (the sum of coordinate minima reaches the least overlap), by pairs of leaves.

    points: of any powers of two of coordinates from GROUPS on. apart(rows, others): the matrix of pairs that matter, asked as
    the walk gets to them. left: how many elements of each set can be shared at most, where less than all.
    """
    coarse = np.concatenate([folded(p[None], GROUPS) for p in points]).astype(np.int32)
    leaves, levels = grow(sizes, coarse)
    left = sizes if left is None else left
    for a, b in descend(levels, join):
        rows, other = leaves[a], leaves[b]
        ok = apart(rows, other)
        if a == b:
            ok = ok & (np.arange(len(rows))[:, None] < np.arange(len(other))[None, :])
        if not ok.any():
            continue
        need = join.overlap(sizes[rows][:, None], sizes[other][None, :])
        ok = ok & (np.minimum(left[rows][:, None], left[other][None, :]) >= need)
        if not ok.any():
            continue
        bound = np.zeros(ok.shape, np.int32)
        for g in range(GROUPS):
            bound += np.minimum(coarse[rows, g][:, None], coarse[other, g][None, :])
        i, j = np.nonzero(ok & (bound >= need))
        fine = min(min(len(points[x]) for x in rows), min(len(points[x]) for x in other))
        if len(i) and fine > GROUPS:
            u, v = (np.concatenate([folded(points[x][None], fine) for x in leaf]).astype(np.int32) for leaf in (rows, other))
            keep = np.concatenate([np.minimum(u[i[k : k + 256]], v[j[k : k + 256]]).sum(1) for k in range(0, len(i), 256)]) >= need[i, j]
            i, j = i[keep], j[keep]
        if len(i):
            yield rows[i], other[j]


def across(label: np.ndarray, side: np.ndarray | None):
    """The pairs of rows with different labels and, if given, of different sides."""

    def apart(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        ok = label[rows][:, None] != label[other][None, :]
        return ok if side is None else ok & (side[rows][:, None] != side[other][None, :])

    return apart


def connect(sizes: np.ndarray, points: list[np.ndarray], join: Join, label: np.ndarray | None = None, side: np.ndarray | None = None, left: np.ndarray | None = None, linked=None) -> list[tuple[int, int]]:
    """Surviving pairs that join each group of rows, of those for which, if given, linked(p, q) holds. What is joined already, or has one label from the start, isn't looked at again."""
    label = np.arange(len(sizes)) if label is None else np.unique(label, return_inverse=True)[1].ravel()
    out = []
    for i, j in survivors(sizes, points, join, across(label, side), left):
        at = 0
        while at < len(i):
            p, q = int(i[at]), int(j[at])
            at += 1
            if label[p] != label[q] and (linked is None or linked(p, q)):
                label[label == max(label[p], label[q])] = min(label[p], label[q])
                out.append((p, q))
                keep = label[i[at:]] != label[j[at:]]
                i, j, at = i[at:][keep], j[at:][keep], 0
    return out


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches again as tables in each of which the rows of a key are whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = 0
        if batch.num_rows > 1 or held:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            changed = np.zeros(batch.num_rows - 1, bool)
            for c in columns:
                changed |= c[1:] != c[:-1]
            at = np.flatnonzero(changed)
            edge = int(at[-1]) + 1 if len(at) else 0
            if held:
                last = held[-1]
                same = all(last.column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys)
                if edge or not same:
                    yield pa.Table.from_batches([*held, *([batch.slice(0, edge)] if edge else [])])
                    held = []
            elif edge:
                yield pa.Table.from_batches([batch.slice(0, edge)])
        held.append(batch.slice(edge))
    if held:
        yield pa.Table.from_batches(held)


def bounds_of(found: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(max(found.num_rows - 1, 0), bool)
    for k in keys:
        c = found.column(k).to_numpy()
        changed |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [found.num_rows]])


def small_pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each bucket of 2 to SMALL rows; at: where buckets begin, and the end."""
    size = np.diff(at)
    found = []
    for n in range(2, SMALL + 1):
        begin = at[:-1][size == n]
        p, q = np.triu_indices(n, 1)
        found.append(np.stack([(begin[:, None] + p).ravel(), (begin[:, None] + q).ravel()]))
    return tuple(np.concatenate(found, axis=1))


def edges_of(ids: np.ndarray, pairs: list[np.ndarray]) -> pa.RecordBatch:
    """Pairs of rows as edges (x, y) of their ids, x < y."""
    both = np.concatenate([np.zeros((0, 2), np.int64), *pairs]).astype(np.int64)
    found = ids[both] if len(both) else both
    return pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))], ["x", "y"])


EDGES = "x long, y long"


# --- dealing groups to tasks


def pieces(rows: int, weight: str | None):
    """How many chunks hold so many rows each, and WEIGHT of the column weight."""
    by_rows = F.ceil(F.count("*") / rows)
    return (by_rows if weight is None else F.greatest(by_rows, F.ceil(F.sum(weight) / WEIGHT))).cast("int")


def in_chunks(rows: DataFrame, key: str, most: int, weight: str | None = None) -> DataFrame:
    """The rows of keys with two rows at least, dealt evenly into chunks of a task each (column part; _chunks: how many).

    About PIVOTS documents of a key, drawn by a hash, go to each of its chunks, so that chunks whose rows link with these are joined
    by them. The count is combined before it is shuffled, and the join with it can be split where a key is hot.
    """
    many = rows.groupBy(key).agg(F.count("*").alias("_n"), pieces(most, weight).alias("_chunks")).filter("_n > 1")
    pivot = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("_n")) < PIVOTS
    part = F.when(F.col("_chunks") == 1, F.array(F.lit(0))).when(pivot, F.sequence(F.lit(0), F.col("_chunks") - 1))
    return rows.join(many, key).withColumn("part", F.explode(part.otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("_chunks")).cast("int"))))).drop("_n")


def in_crossed_slices(rows: DataFrame, key: str, stars: DataFrame, most: int, weight: str | None = None) -> DataFrame:
    """What in_chunks() left: the rows of keys of several chunks that stars don't join wholly, with their labels and the slices (a, b) that meet in a task; own: the row's slice."""
    labelled = rows.join(stars.select(F.col("x").alias("doc_id"), "y"), "doc_id", "left").withColumn("label", F.coalesce("y", "doc_id")).drop("y")
    mixed = labelled.groupBy(key).agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.ceil(F.count("*") / SLICE).cast("int").alias("_slices"), pieces(most, weight).alias("_chunks"))
    both = labelled.join(mixed.filter("_low < _high and _chunks > 1").drop("_low", "_high", "_chunks"), key).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("_slices")).cast("int"))
    both = both.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    return both.withColumn("a", F.least("own", "_other")).withColumn("b", F.greatest("own", "_other")).drop("_slices", "_other")


def sorted_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "doc_id")


# --- candidate clusters


def buckets(leaders: DataFrame) -> DataFrame:
    """A row for each of a leader's first tokens and its place; what stands from there on is all that is shared if the token is the first that is."""
    return leaders.select("doc_id", F.posexplode("first").alias("at", "token")).select("token", "doc_id", "at")


def with_points(met: DataFrame, leaders: DataFrame) -> DataFrame:
    return met.join(leaders.select("doc_id", "n", "point"), "doc_id").withColumn("left", F.col("n") - F.col("at")).drop("at")


def _coarse(found: pa.Table) -> np.ndarray:
    return np.array([unpacked(x, GROUPS) for x in found.column("point").to_pylist()], np.int32).reshape(-1, GROUPS)


def candidates(met: DataFrame, leaders: DataFrame, join: Join, seen: Observation) -> DataFrame:
    """Edges that join candidate clusters, joined in each task: leaders that meet by a first token and by their coarse points allow a link. seen: the most chunks of a token."""
    dealt = with_points(in_chunks(met, "token", CHUNK).observe(seen, F.max("_chunks").alias("most")).drop("_chunks"), leaders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["token", "part"]
        for found in runs_of(batches, keys):
            at = bounds_of(found, keys)
            ids, sizes, left = (found.column(c).to_numpy() for c in ("doc_id", "n", "left"))
            points = _coarse(found)
            i, j = small_pairs(at)
            ok = np.minimum(np.minimum(points[i], points[j]).sum(1), np.minimum(left[i], left[j])) >= join.overlap(sizes[i], sizes[j])
            pairs = [np.column_stack([i[ok], j[ok]])]
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s > SMALL and (near := connect(sizes[s:e], list(points[s:e]), join, left=left[s:e])):
                    pairs.append(np.array(near) + s)
            yield edges_of(ids, pairs)

    return sorted_by(dealt, "token", "part").mapInArrow(lambda batches: contracted(run(batches)), EDGES)


def further_candidates(met: DataFrame, leaders: DataFrame, stars: DataFrame, join: Join) -> DataFrame:
    """Edges that join the clusters of a token's chunks, where the documents that all chunks have did not."""
    dealt = with_points(in_crossed_slices(met, "token", stars, CHUNK), leaders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["token", "a", "b"]
        for found in runs_of(batches, keys):
            at = bounds_of(found, keys)
            ids, sizes, left, label, own, a, b = (found.column(c).to_numpy() for c in ("doc_id", "n", "left", "label", "own", "a", "b"))
            points = _coarse(found)
            near = [np.array(connect(sizes[s:e], list(points[s:e]), join, label[s:e], own[s:e] if a[s] != b[s] else None, left[s:e])).reshape(-1, 2) + s for s, e in zip(at[:-1], at[1:], strict=True)]
            yield edges_of(ids, near)

    return sorted_by(dealt, "token", "a", "b").mapInArrow(lambda batches: contracted(run(batches)), EDGES)


# --- components


def joined(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as edges to their smallest nodes."""
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends.ravel()[: len(x)], ends.ravel()[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == label[b]).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (deeper := label[label] != label).any():
            label[deeper] = label[label[deeper]]
    away = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[away], nodes[label[away]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components with the edges of a task joined first, by blocks of BLOCK edges."""
    x, y = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[pa.RecordBatch] = []
    many = 0

    def join_held() -> tuple[np.ndarray, np.ndarray]:
        return joined(*(np.concatenate([own, *(b.column(k).to_numpy() for b in held)]) for own, k in ((x, 0), (y, 1))))

    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many > BLOCK:
            (x, y), held = join_held(), []
            if (many := len(x)) > BLOCK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
                x, y, many = x[:0], y[:0], 0
    x, y = join_held()
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])


def components(edges: DataFrame) -> DataFrame:
    """Edges (x, y) from every node to the smallest node reachable over the edges, but from that one.

    Large-star and small-star (Kiveris et al. 2014) alternate until no edge changes: a number of rounds that grows with the
    logarithm of the longest chain. Each round is a table, counted as it is written.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, rows: int | None) -> tuple[DataFrame, tuple]:
        seen = Observation()
        if rows is not None:
            # few edges need few files
            df = df.coalesce(min(partitions(spark), max(16, rows // 100_000)))
        out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("sum")))
        found = observed(seen)
        return out, (found.get("rows", 0), found.get("sum"))

    now, mark = written(edges.select(F.greatest("x", "y").cast("long").alias("x"), F.least("x", "y").cast("long").alias("y")).filter("x > y"), None)
    while mark[0]:
        both = now.unionAll(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # a key that isn't the aggregate's own is shuffled once more, and only then may the join's tasks split a node that a third of all edges lead to
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")).select(F.col("x").bitwiseXOR(F.lit(0)).alias("k"), "m")
        large = both.join(low, both["x"] == low["k"]).filter("y > x and y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))).alias("e")).select("e.*").filter("x > y").distinct()
        after, last = written(small, mark[0])
        drop(now)
        now, mark, before = after, last, mark
        if mark == before:
            break
    return now


# --- verification


def _sets_of(batches: Iterator[pa.RecordBatch], names: list[str], words: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, SLICED):
        tokens, at = _sets(batch, words)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([tokens[at[i] : at[i + 1]].tobytes() for i in range(batch.num_rows)], pa.large_binary())], [*names, "tokens"])


def shared(one: np.ndarray, other: np.ndarray) -> int:
    both = np.concatenate([one, other])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def verified(docs: DataFrame, clusters: DataFrame, join: Join, seen: Observation) -> DataFrame:
    """Edges of linked leaders that join what the chunks of each cluster hold of a group; clusters: (doc_id, cluster, n). seen: the most chunks of a cluster."""
    dealt = in_chunks(clusters, "cluster", MEMBERS, "n").observe(seen, F.max("_chunks").alias("most")).drop("_chunks", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["cluster", "part"]
        for found in runs_of(_sets_of(batches, [*keys, "doc_id"], join.words), keys):
            at = bounds_of(found, keys)
            ids, pairs = found.column("doc_id").to_numpy(), []
            for s, e in zip(at[:-1], at[1:], strict=True):
                # one row for each leader, should its row be repeated
                rows = np.array([k for k in range(s, e) if k == s or ids[k] != ids[k - 1]])
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in found.column("tokens").take(pa.array(rows))]
                sizes = np.array([len(x) for x in sets], np.int64)
                fine = [point_of(x, groups_of(len(x))) for x in sets]
                linked = lambda p, q, sets=sets, sizes=sizes: shared(sets[p], sets[q]) >= join.overlap(int(sizes[p]), int(sizes[q]))
                if near := connect(sizes, fine, join, linked=linked):
                    pairs.append(rows[np.array(near)])
            yield edges_of(ids, pairs)

    return sorted_by(of_few(_texts(docs), clusters.select("doc_id")).join(dealt, "doc_id"), "cluster", "part").mapInArrow(lambda batches: contracted(run(batches)), EDGES)


def _texts(docs: DataFrame) -> DataFrame:
    return text_only(docs.filter(F.col("doc_id").isNotNull()))


def of_few(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of these documents, if they are few enough to be told to every task, so that others needn't be shuffled; else all. ids: (doc_id), cheap to count."""
    return rows.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= FEW else rows


def further_pairs(leaders: DataFrame, clusters: DataFrame, links: DataFrame, join: Join) -> DataFrame:
    """Pairs of leaders of a cluster in different groups so far whose fine points allow a link."""
    dealt = in_crossed_slices(clusters, "cluster", links, MEMBERS, "n").join(of_few(leaders.select("doc_id", "fine"), clusters.select("doc_id")), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["cluster", "a", "b"]
        for found in runs_of(batches, keys):
            at = bounds_of(found, keys)
            ids, sizes, label, own, a, b = (found.column(c).to_numpy() for c in ("doc_id", "n", "label", "own", "a", "b"))
            for s, e in zip(at[:-1], at[1:], strict=True):
                fine = [unpacked(x, groups_of(int(n))) for x, n in zip(found.column("fine").slice(s, e - s).to_pylist(), sizes[s:e], strict=True)]
                for i, j in survivors(sizes[s:e], fine, join, across(label[s:e], own[s:e] if a[s] != b[s] else None)):
                    yield edges_of(ids, [np.column_stack([i, j]) + s])

    return sorted_by(dealt, "cluster", "a", "b").mapInArrow(run, EDGES)


def checked(docs: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """The pairs (x, y), x < y, that are linked. A pair's sets meet in the task of its x, whose pairs beyond MEMBERS are dealt to several; a task holds one x and a batch of others."""
    many = pairs.groupBy("x").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_parts"))
    dealt = pairs.join(many, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("_parts")).cast("int")).drop("_parts")
    rows = dealt.select("x", "part", F.col("y").alias("doc_id")).unionAll(dealt.select("x", "part", F.col("x").alias("doc_id")).distinct())
    rows = rows.join(of_few(_texts(docs), pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct()), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, np.zeros(0, np.uint64)
        for batch in _sets_of(batches, ["x", "doc_id"], join.words):
            found = []
            for x, y, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(raw, np.uint64)
                if x == y:
                    # ids are sorted, so the task's own one comes first
                    own, held = x, tokens
                elif x == own and shared(held, tokens) >= join.overlap(len(held), len(tokens)):
                    found.append((x, y))
            yield edges_of(np.array(found, np.int64).ravel(), [np.arange(2 * len(found)).reshape(-1, 2)])

    return sorted_by(rows, "x", "part").select("x", "doc_id", "text").mapInArrow(lambda batches: contracted(run(batches)), EDGES)


def linked_groups(docs: DataFrame, leaders: DataFrame, join: Join) -> DataFrame:
    """Edges (x, y) from each leader to the smallest one that it reaches by links, but from that one."""
    met, seen = buckets(leaders), Observation()
    stars = components(candidates(met, leaders, join, seen))
    if (observed(seen).get("most") or 0) > 1:
        stars = components(further_candidates(met, leaders, stars, join).unionAll(stars))
    named = stars.select(F.col("x").alias("doc_id"), F.col("y").alias("cluster")).unionAll(stars.select(F.col("y").alias("doc_id"), F.col("y").alias("cluster")).distinct())
    clusters = cut(named.join(leaders.select("doc_id", "n"), "doc_id"))
    drop(stars)
    seen = Observation()
    links = components(verified(docs, clusters, join, seen))
    if (observed(seen).get("most") or 0) > 1:
        pairs = cut(further_pairs(leaders, clusters, links, join).distinct())
        links = components(checked(docs, pairs, join).unionAll(links))
        drop(pairs)
    drop(clusters)
    return links


def groups(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included) of every row."""
    arrow(docs.sparkSession, 2 << 20)
    counts = token_counts(docs, join)
    sized = cut(points(docs, join, levels_of(counts)))
    classes = sized.filter("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("leader"))
    members = cut(sized.select("doc_id", "n", "digest").join(classes.select("digest", "leader"), "digest", "left").select("doc_id", "n", F.coalesce("leader", "doc_id").alias("leader")))
    lead = members.filter("doc_id = leader and n > 0").select("doc_id").distinct()
    leaders = cut(sized.join(lead, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    drop(sized)
    links = linked_groups(docs, leaders, join)
    drop(leaders)
    out = members.join(links, members["leader"] == links["x"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("y", "leader")).alias("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The documents that lead their group, each in one row, with the columns they came with.

    Of repeated rows (one doc_id, a text with words) the first by the other columns stays; rows without a doc_id or without words all stay.
    """
    gone = groups(docs, join).filter("component_id <> doc_id").select("doc_id").distinct()
    leading = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    place = "_place"
    while place in docs.columns:
        place += "_"
    # words are what all_tokens() takes for such: anything between blanks. Null or wordless rows number themselves, so that none of them meets another
    own = F.when(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0d]"), F.lit(False)), F.monotonically_increasing_id())
    plain = [F.col(c) for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith(("map", "struct", "array", "variant"))]
    first = Window.partitionBy("doc_id", own).orderBy(*plain, "doc_id")
    return leading.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).select(*docs.columns)


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), Join(words=3, percent=90))
