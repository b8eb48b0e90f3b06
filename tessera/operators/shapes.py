"""Vector shapes as tables of vertices (set_name, feature_id, part, ring, vertex, x, y, shape_type, shape_name).

Mapping vertices is arithmetic on columns when the chain of transforms is linear; B-splines go through `bspline`.
Part and ring are kept, so polygons with holes and multi-part shapes come back as they were.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.transforms import Sequence, Transform, mapped

KEY = ("set_name", "feature_id", "part", "ring")
VERTICES = "set_name string, feature_id long, part int, ring int, vertex int, x double, y double, shape_type string, shape_name string"
#: Nesting of coordinates above the vertex, by type: (parts, rings).
NESTING = {"Point": (0, 0), "MultiPoint": (0, 1), "LineString": (0, 1), "Polygon": (1, 1), "MultiLineString": (1, 1), "MultiPolygon": (2, 1)}


def vertices_of(feature: dict) -> list[tuple[int, int, int, float, float]]:
    """(part, ring, vertex, x, y) of one GeoJSON feature, of any of the six types."""
    kind, coords = feature["geometry"]["type"], feature["geometry"]["coordinates"]
    if kind not in NESTING:
        raise ValueError(f"unknown geometry {kind}")
    if kind == "Point":
        parts = [[[coords]]]
    elif kind in ("MultiPoint", "LineString"):
        parts = [[coords]]
    elif kind == "Polygon":
        parts = [coords]
    elif kind == "MultiLineString":
        parts = [[line] for line in coords]
    else:
        parts = coords
    return [(p, r, v, float(xy[0]), float(xy[1])) for p, rings in enumerate(parts) for r, ring in enumerate(rings) for v, xy in enumerate(ring)]


def shape_name(feature: dict) -> str:
    """The classification's name, or "unnamed"."""
    return ((feature.get("properties") or {}).get("classification") or {}).get("name") or "unnamed"


def scale(vertices: DataFrame, factor: float) -> DataFrame:
    return vertices.withColumns({"x": F.col("x") * factor, "y": F.col("y") * factor})


def bounding_boxes(vertices: DataFrame, *keys: str) -> DataFrame:
    return vertices.groupBy(*(keys or KEY[:2])).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n_vertices"))


def close_rings(vertices: DataFrame, keys: tuple[str, ...] = KEY, order: str = "vertex") -> DataFrame:
    """Appends each open ring's first vertex: one aggregate, whose first rows are the vertices to add."""
    others = [c for c in vertices.columns if c not in keys and c != order]
    row = F.struct(*others)
    ends = vertices.groupBy(*keys).agg(F.min_by(row, order).alias("_a"), F.max_by(F.struct("x", "y"), order).alias("_b"), F.max(order).alias("_last"))
    open_ = ends.filter((F.col("_a.x") != F.col("_b.x")) | (F.col("_a.y") != F.col("_b.y")))
    added = open_.select(*keys, (F.col("_last") + 1).cast(vertices.schema[order].dataType).alias(order), *[F.col(f"_a.{c}").alias(c) for c in others])
    return vertices.unionByName(added.select(*vertices.columns))


def transform(vertices: DataFrame, sequence: Sequence, pixels_in: bool = True, source_res: float = 1.0, pixels_out: bool = True) -> DataFrame:
    """Vertices of the moving image on the fixed one: the inverse of the composite. A linear sequence is one projection."""
    target_res = sequence.spacing[0] if sequence.spacing else 1.0
    into, out_of = (source_res if pixels_in else 1.0), (1 / target_res if pixels_out else 1.0)
    if sequence.linear:
        m = np.diag([out_of, out_of, 1.0]) @ np.linalg.inv(sequence.composite()) @ np.diag([into, into, 1.0])
        x, y = mapped(F.col("x"), F.col("y"), m)
        return vertices.withColumns({"x": x, "y": y})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xy"]) * into
            p = inverse_points(sequence, p) * out_of if batch.num_rows else p
            columns = [pa.array(p[:, "xy".index(n)]) if n in ("x", "y") else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return vertices.mapInArrow(run, vertices.schema)


def mapped_by(rows: DataFrame, sequence: Sequence, columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Output points in physical units, in two columns, to source points."""
    if sequence.linear:
        x, y = mapped(F.col(columns[0]), F.col(columns[1]), sequence.composite())
        return rows.withColumns(dict(zip(columns, (x, y), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = map_points(sequence, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]))
                yield pa.RecordBatch.from_arrays([pa.array(p[:, columns.index(n)]) if n in columns else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


# --- B-splines


def basis(u: np.ndarray) -> np.ndarray:
    """The four cubic weights at the fraction u of a cell."""
    return np.stack([(1 - u) ** 3, 3 * u**3 - 6 * u**2 + 4, -3 * u**3 + 3 * u**2 + 3 * u + 1, u**3], -1) / 6


def basis_slope(u: np.ndarray) -> np.ndarray:
    """How the weights change with u."""
    return np.stack([-((1 - u) ** 2), 3 * u**2 - 4 * u, -3 * u**2 + 2 * u + 1, u**2], -1) / 2


def displacement(t: Transform, p: np.ndarray, slope: bool = False):
    """Of points (n, 2) by a cubic B-spline grid whose coefficients are all x, then all y; none outside of the grid's support. With slope also its Jacobian (n, component, by)."""
    nx, ny = t.grid_size
    c = np.array(t.params).reshape(2, ny, nx)
    u = (p - np.array(t.grid_origin)) / np.array(t.grid_spacing)
    cell = np.floor(u).astype(int) - 1
    inside = (cell >= 0).all(1) & (cell[:, 0] + 3 < nx) & (cell[:, 1] + 3 < ny)
    out, jacobian = np.zeros_like(p), np.zeros((len(p), 2, 2))
    if inside.any():
        at, part = cell[inside], (u - np.floor(u))[inside]
        i, j = at[:, 0, None] + np.arange(4), at[:, 1, None] + np.arange(4)
        near = c[:, j[:, :, None], i[:, None, :]]
        wx, wy = basis(part[:, 0]), basis(part[:, 1])
        rows = (near * wx[None, :, None, :]).sum(-1)
        out[inside] = (rows * wy[None]).sum(-1).T
        if slope:
            by_x = ((near * basis_slope(part[:, 0])[None, :, None, :]).sum(-1) * wy[None]).sum(-1) / t.grid_spacing[0]
            by_y = (rows * basis_slope(part[:, 1])[None]).sum(-1) / t.grid_spacing[1]
            jacobian[inside] = np.stack([by_x, by_y], -1).transpose(1, 0, 2)
    return (out, jacobian) if slope else out


def forward(t: Transform, p: np.ndarray) -> np.ndarray:
    if t.linear:
        m = t.matrix()
        return p @ m[:2, :2].T + m[:2, 2]
    return p + displacement(t, p)


def map_points(sequence: Sequence, p: np.ndarray) -> np.ndarray:
    """Output points to source points: of the stacked transforms the last one maps first."""
    for i in reversed(sequence.order()):
        p = forward(sequence.transforms[i], p)
    return p


def unspline(t: Transform, p: np.ndarray, tolerance: float = 1e-6, most: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(y, residual): where y + d(y) = p, by Newton steps; residual is how far y still maps from p.

    A spline ends at the edge of its grid, so points near it may have no such y, and a folded spline may have none or several: then y is
    the step that came nearest, and the residual says so.
    """
    y = p - displacement(t, p)
    best, least = y.copy(), np.full(len(p), np.inf)
    open_ = np.arange(len(p))
    for k in range(most):
        d, jacobian = displacement(t, y[open_], slope=True)
        off = y[open_] + d - p[open_]
        far = np.abs(off).max(1, initial=0)
        nearer = far < least[open_]
        best[open_[nearer]], least[open_[nearer]] = y[open_[nearer]], far[nearer]
        going = far >= tolerance
        open_, off, jacobian = open_[going], off[going], jacobian[going]
        if not len(open_):
            break
        a, b, c, e = 1 + jacobian[:, 0, 0], jacobian[:, 0, 1], jacobian[:, 1, 0], 1 + jacobian[:, 1, 1]
        det = a * e - b * c
        newton = np.column_stack([e * off[:, 0] - b * off[:, 1], a * off[:, 1] - c * off[:, 0]]) / np.where(np.abs(det) < 0.05, 1.0, det)[:, None]
        # where the map all but folds, and every fourth step where points don't settle, the plain step y = p - d(y)
        y[open_] -= np.where((np.abs(det) < 0.05)[:, None] | (k % 4 == 3), off, newton)
    return best, least


def inverse_points(sequence: Sequence, p: np.ndarray, tolerance: float = 1e-6, residual: np.ndarray | None = None) -> np.ndarray:
    """Source points to output points. residual: gets for each point the most that a B-spline's inverse is off by; see unspline()."""
    for i in sequence.order():
        t = sequence.transforms[i]
        if t.linear:
            m = t.inverse()
            p = p @ m[:2, :2].T + m[:2, 2]
        else:
            p, off = unspline(t, p, tolerance)
            if residual is not None:
                np.maximum(residual, off, out=residual)
    return p


def mapped_boxes(sequence: Sequence, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (n, 2) that hold whatever the sequence makes of boxes of output points: by their corners where it is linear, and by the least and largest coefficients near by where it is a B-spline."""
    low, high = low.astype(float), high.astype(float)
    for k in reversed(sequence.order()):
        t = sequence.transforms[k]
        if t.linear:
            m = t.matrix()
            corners = np.stack([np.column_stack([x[:, 0], y[:, 1]]) @ m[:2, :2].T + m[:2, 2] for x in (low, high) for y in (low, high)])
            low, high = corners.min(0), corners.max(0)
            continue
        nx, ny = t.grid_size
        c = np.array(t.params).reshape(2, ny, nx)
        first = np.clip(np.floor((low - t.grid_origin) / t.grid_spacing).astype(int) - 1, 0, [nx - 1, ny - 1])
        last = np.clip(np.floor((high - t.grid_origin) / t.grid_spacing).astype(int) + 2, 0, [nx - 1, ny - 1])
        for n, ((i, j), (u, v)) in enumerate(zip(first, last, strict=True)):
            near = c[:, j : v + 1, i : u + 1].reshape(2, -1)
            low[n] += np.minimum(near.min(1), 0)
            high[n] += np.maximum(near.max(1), 0)
    return low, high


# --- rasters


def counted(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run of n numbers, one run after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def fill_edges(size: tuple[int, int], a: np.ndarray, b: np.ndarray, polygon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(polygon, y * width + x) of the pixels of polygons, from the integer ends (n, 2) of the edges of their closed rings: filled by the even-odd rule along scan lines, and their outlines. A pixel may come more than once."""
    w, h = size
    (x0, y0), (x1, y1) = a.T, b.T
    # where scan lines cut edges: an edge is cut from its lower end on, up to but without its upper one
    low, top = np.maximum(np.minimum(y0, y1), 0), np.minimum(np.maximum(y0, y1), h)
    n = np.maximum(top - low, 0)
    edge, y = np.repeat(np.arange(len(n)), n), counted(low, n)
    x = x0[edge] + (y - y0[edge]) * (x1 - x0)[edge] / np.where(y1 == y0, 1, y1 - y0)[edge]
    cut = polygon[edge]
    order = np.lexsort((x, y, cut))
    x, y, cut = x[order], y[order], cut[order]
    left, right = np.maximum(np.ceil(x[::2]).astype(np.int64), 0), np.minimum(np.floor(x[1::2]).astype(np.int64), w - 1)
    n = np.maximum(right - left + 1, 0)
    inner, inner_of = np.repeat(y[::2] * w, n) + counted(left, n), np.repeat(cut[::2], n)
    # the outline, by as many steps as the edge's longer side has pixels
    n = steps(a, b) + 1
    edge, k = np.repeat(np.arange(len(n)), n), counted(np.zeros(len(n), np.int64), n)
    x, y = (np.rint(p[edge] + (q - p)[edge] * k / (n - 1)[edge]).astype(np.int64) for p, q in ((x0, x1), (y0, y1)))
    seen = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    return np.concatenate([inner_of, polygon[edge[seen]]]), np.concatenate([inner, y[seen] * w + x[seen]])


def fill(size: tuple[int, int], rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of the pixels of one polygon, its rings filled by the even-odd rule along scan lines, with its outline. Vertices are cut to integers."""
    rings = [np.trunc(r).astype(np.int64) for r in rings]
    a, b = np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    pixel = np.unique(fill_edges(size, a, b, np.zeros(len(a), np.int64))[1])
    return pixel // size[0], pixel % size[0]


def steps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many steps of a pixel an edge's outline takes."""
    return np.maximum(np.abs(b - a).max(1, initial=0), 1)


def in_order(vertices: DataFrame) -> DataFrame:
    """Vertices sorted by feature, all of a feature in one task, with their number in it (`_n`, from 1). They are shuffled only where they aren't dealt by their feature already."""
    w = Window.partitionBy("set_name", "feature_id").orderBy("part", "ring", "vertex", "x", "y")
    return vertices.withColumn("_n", F.row_number().over(w))


def features_in(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The vertices of whole features from in_order()'s batches, and where each feature begins; about so many rows at a time, or one feature, are held beside a batch."""
    held: list[pa.RecordBatch] = []
    n = 0

    def whole() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return table, np.flatnonzero(table.column("_n").to_numpy() == 1)

    for batch in batches:
        first = np.flatnonzero(batch.column("_n").to_numpy() == 1)
        if len(first) and n + first[-1] >= rows:
            held.append(batch.slice(0, first[-1]))
            yield whole()
            held, n = [], 0
            batch = batch.slice(first[-1])
        held.append(batch)
        n += batch.num_rows
    if n:
        yield whole()


#: Vertices that are painted together, pixels that are filled at once, and the largest raster that is held whole.
TOGETHER, AT_ONCE, HELD = 1 << 18, 1 << 20, 1 << 22


def paint(size: tuple[int, int], points: np.ndarray, first: np.ndarray, part: np.ndarray, ring: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature's place, y * width + x) of the pixels of one set's features, a later one over an earlier one; `first` is where each feature's vertices begin.

    Where features cover the raster more than once they are painted from the last one back, and one whose box holds no free pixel any
    more is left out, as nothing of it would be seen. Else the pixels of some features at a time are sent on.
    """
    w, h = size
    a = np.trunc(points).astype(np.int64)
    n = np.diff(first, append=len(a))
    begins = np.zeros(len(a), bool)
    begins[first] = True
    begins[1:] |= part[1:] != part[:-1]
    polygon = np.cumsum(begins) - 1
    feature = np.repeat(np.arange(len(first)), n)[np.flatnonzero(begins)]
    begins[1:] |= ring[1:] != ring[:-1]
    start = np.flatnonzero(begins)
    follows = np.arange(1, len(a) + 1)
    follows[np.append(start[1:], len(a)) - 1] = start
    b = a[follows]
    low, high = np.maximum(np.minimum.reduceat(a, first), 0), np.minimum(np.maximum.reduceat(a, first), [w - 1, h - 1]) + 1
    area = np.maximum(high - low, 0).prod(1)
    work = area + np.add.reduceat(steps(a, b), first)
    todo = np.flatnonzero(area)[::-1]
    held = np.full(w * h, -1, np.int64) if w * h <= min(HELD, area.sum()) else None
    while len(todo):
        group, todo = np.split(todo, [max(np.searchsorted(np.cumsum(work[todo]), AT_ONCE), 1)])
        rows = counted(first[group], n[group])
        of, pixel = fill_edges(size, a[rows], b[rows], polygon[rows])
        of = feature[of]
        if held is None:
            order = np.lexsort((of, pixel))
            of, pixel = of[order], pixel[order]
            last = np.append(pixel[1:] != pixel[:-1], True)
            yield of[last], pixel[last]
            continue
        np.maximum.at(held, pixel, of)
        free = np.zeros((h + 1, w + 1), np.int64)
        free[1:, 1:] = (held < 0).reshape(h, w).cumsum(0).cumsum(1)
        (x0, y0), (x1, y1) = low[todo].T, high[todo].T
        todo = todo[free[y1, x1] - free[y0, x1] - free[y1, x0] + free[y0, x0] > 0]
    if held is not None:
        pixel = np.flatnonzero(held >= 0)
        yield held[pixel], pixel


def rasterise(vertices: DataFrame, size: tuple[int, int], labels: bool = True) -> DataFrame:
    """(set_name, y, x, v): v is feature_id + 1, a later feature over an earlier one, or 255. Tasks paint some of a set's features over each other before they send pixels on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in features_in(batches, TOGETHER):
            part, ring, ids, x, y = (table.column(c).to_numpy() for c in ("part", "ring", "feature_id", "x", "y"))
            points, sets = np.column_stack([x, y]), table.column("set_name").take(pa.array(first)).to_pylist()
            edges = [0, *(k for k in range(1, len(first)) if sets[k] != sets[k - 1]), len(first)]
            for i, j in itertools.pairwise(edges):
                start, end = first[i], first[j] if j < len(first) else len(ids)
                for of, pixel in paint(size, points[start:end], first[i:j] - start, part[start:end], ring[start:end]):
                    for k in range(0, len(of), AT_ONCE):
                        found, at = ids[first[i:j]][of[k : k + AT_ONCE]], pixel[k : k + AT_ONCE]
                        yield pa.RecordBatch.from_arrays([pa.array([sets[i]], pa.string()).take(pa.array(np.zeros(len(at), np.int64))), pa.array(found), pa.array(at // size[0]), pa.array(at % size[0])], ["set_name", "feature_id", "y", "x"])

    own = vertices.select("set_name", F.col("feature_id").cast("long").alias("feature_id"), *KEY[2:], "vertex", "x", "y")
    filled = in_order(own).mapInArrow(run, "set_name string, feature_id long, y long, x long")
    v = (F.max("feature_id") + 1) if labels else F.lit(255)
    return filled.groupBy("set_name", "y", "x").agg(v.cast("long").alias("v"))


def label_boxes(labels: DataFrame) -> DataFrame:
    """(set_name, label, x, y, w, h, area) of each label of a raster (set_name, y, x, v)."""
    g = labels.filter("v > 0").groupBy("set_name", F.col("v").alias("label")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("_x"), F.max("y").alias("_y"), F.count("*").alias("area"))
    return g.select("set_name", "label", "x", "y", (F.col("_x") - F.col("x") + 1).alias("w"), (F.col("_y") - F.col("y") + 1).alias("h"), "area")


def told(table: pa.Table, first: np.ndarray) -> list[str]:
    """Features as GeoJSON text, as json.dumps() writes it, polygon rings closed, from their sorted vertices and where each begins."""
    # numbers of a whole column are written at once
    x, y = (json.dumps(table.column(c).to_pylist())[1:-1].split(", ") for c in "xy")
    points = [f"[{u}, {v}]" for u, v in zip(x, y, strict=True)]
    part, ring, x, y = (table.column(c).to_numpy() for c in ("part", "ring", "x", "y"))
    begins = np.zeros(len(points), bool)
    begins[first] = True
    begins[1:] |= part[1:] != part[:-1]
    parts = begins.copy()
    begins[1:] |= ring[1:] != ring[:-1]
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(points))
    open_ = ((x[start] != x[end - 1]) | (y[start] != y[end - 1])) & (end - start > 1)
    kinds, names = (table.column(c).take(pa.array(first)).to_pylist() for c in ("shape_type", "shape_name"))
    # rings of a feature, and whether each begins a part
    edges = np.append(np.searchsorted(start, first), len(start)).tolist()
    start, end, open_, parts = start.tolist(), end.tolist(), open_.tolist(), parts[start].tolist()
    tails: dict[str | None, str] = {}
    out = []
    for k, (kind, name) in enumerate(zip(kinds, names, strict=True)):
        nested: list[list[str]] = []
        for r in range(edges[k], edges[k + 1]):
            if parts[r]:
                nested.append([])
            close = f", {points[start[r]]}" if open_[r] and kind in ("Polygon", "MultiPolygon") else ""
            nested[-1].append(f"[{', '.join(points[start[r] : end[r]])}{close}]")
        if kind == "MultiPolygon":
            coords = f"[{', '.join(f'[{", ".join(rings)}]' for rings in nested)}]"
        elif kind == "MultiLineString":
            coords = f"[{', '.join(rings[0] for rings in nested)}]"
        elif kind == "Polygon":
            coords = f"[{', '.join(nested[0])}]"
        else:
            coords = {"Point": points[start[edges[k]]], "MultiPoint": nested[0][0], "LineString": nested[0][0]}[kind]
        if name not in tails:
            tails[name] = json.dumps({"classification": {"name": name}})
        out.append(f'{{"type": "Feature", "geometry": {{"type": "{kind}", "coordinates": {coords}}}, "properties": {tails[name]}}}')
    return out


def to_geojson(vertices: DataFrame) -> DataFrame:
    """(set_name, feature_id, feature): each feature as GeoJSON text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in features_in(batches, 10000):
            keys = [table.column(c).take(pa.array(first)).combine_chunks() for c in ("set_name", "feature_id")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(told(table, first), pa.string())], ["set_name", "feature_id", "feature"])

    own = vertices.select("set_name", F.col("feature_id").cast("long").alias("feature_id"), *KEY[2:], "vertex", "x", "y", "shape_type", "shape_name")
    return in_order(own).mapInArrow(run, "set_name string, feature_id long, feature string")


def from_arrays(spark: SparkSession, items: list[dict], set_name: str = "shapes") -> DataFrame:
    """Vertices of shapes at hand: each a dict of "array" (n, 2), "shape_type" (a name of NESTING in any case) and "shape_name"."""
    kinds = {k.lower(): k for k in NESTING}
    rows = []
    for k, item in enumerate(items):
        kind = kinds.get(str(item.get("shape_type", "polygon")).lower())
        a = np.asarray(item["array"], float)
        if kind is None or a.ndim != 2 or a.shape[1] != 2 or not len(a):
            raise ValueError(f"shape {k}: not an array of vertices of one of {', '.join(NESTING)}")
        rows += [(set_name, k, 0, 0, v, float(x), float(y), kind, item.get("shape_name") or "unnamed") for v, (x, y) in enumerate(a)]
    return spark.createDataFrame(rows, VERTICES)


def add(vertices: DataFrame, more: DataFrame) -> DataFrame:
    """The features of both in the first one's sets, those that are added counted on from the last one there."""
    last = vertices.groupBy("set_name").agg(F.max("feature_id").alias("_last"))
    counted_on = more.join(F.broadcast(last), "set_name", "left").withColumn("feature_id", F.col("feature_id") + F.coalesce(F.col("_last") + 1, F.lit(0)))
    return vertices.unionByName(counted_on.select(*vertices.columns))


def update(vertices: DataFrame, moved: DataFrame) -> DataFrame:
    """The same vertices at the places that `moved` has for them (by set, feature, part, ring and vertex); others stay where they are."""
    keys = [*KEY, "vertex"]
    joined = vertices.join(moved.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y")), keys, "left")
    return joined.withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")}).select(*vertices.columns)


def counts(vertices: DataFrame) -> DataFrame:
    """(set_name, shape_type, shape_name, n_shapes): how many features a set has of each."""
    return vertices.groupBy("set_name", "shape_type", "shape_name").agg(F.countDistinct("feature_id").alias("n_shapes"))
