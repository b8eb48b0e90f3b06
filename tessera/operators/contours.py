"""Label rasters back to polygons: outlines along pixel edges, simplified, one label a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shapes import VERTICES


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Closed rings of corner points (x, y) around the foreground, which lies to the left of each step; holes are rings of their own."""
    padded = np.pad(mask.astype(bool), 1)
    steps: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for dy, dx, a, b in ((-1, 0, (1, 0), (0, 0)), (1, 0, (0, 1), (1, 1)), (0, -1, (0, 0), (0, 1)), (0, 1, (1, 1), (1, 0))):
        beside = np.roll(padded, (-dy, -dx), (0, 1))
        for y, x in zip(*np.nonzero(padded & ~beside), strict=True):
            steps.setdefault((x - 1 + a[0], y - 1 + a[1]), []).append((x - 1 + b[0], y - 1 + b[1]))
    out = []
    while steps:
        start = min(steps)
        ring, at, came = [start], start, None
        while True:
            choices = steps[at]
            # where two corners touch, the turn that stays with the same pixel
            if len(choices) > 1 and came is not None:
                turn = lambda c: (at[0] - came[0]) * (c[1] - at[1]) - (at[1] - came[1]) * (c[0] - at[0])  # noqa: B023, E731
                k = min(range(len(choices)), key=lambda i: turn(choices[i]))
            else:
                k = 0
            after = choices.pop(k)
            if not choices:
                del steps[at]
            came, at = at, after
            if at == start:
                break
            ring.append(at)
        points = np.array(ring)
        ahead, behind = np.roll(points, -1, 0) - points, points - np.roll(points, 1, 0)
        out.append(points[ahead[:, 0] * behind[:, 1] != ahead[:, 1] * behind[:, 0]])
    return out


def area(ring: np.ndarray) -> float:
    after = np.roll(ring, -1, 0)
    return abs(float((ring[:, 0] * after[:, 1] - after[:, 0] * ring[:, 1]).sum())) / 2


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """The points of a line without those that lie within the tolerance of what is left (Douglas and Peucker 1973)."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, p = line[b] - line[a], line[a + 1 : b] - line[a]
        length = float(np.hypot(*d))
        far = np.abs(d[0] * p[:, 1] - d[1] * p[:, 0]) / length if length else np.hypot(p[:, 0], p[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return line[keep]


def largest(mask: np.ndarray, share: float = 0.01) -> np.ndarray:
    """The largest outline, simplified within a share of its length."""
    ring = max(outlines(mask), key=area).astype(float)
    closed = np.vstack([ring, ring[:1]])
    length = float(np.hypot(*np.diff(closed, axis=0).T).sum())
    return simplify(closed, share * length)[:-1]


def label_polygons(labels: DataFrame, name: str = "unnamed", share: float = 0.0) -> DataFrame:
    """Vertices of each label of a raster (set_name, y, x, v): its largest outline is the polygon; coordinates are those of the raster."""

    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy() for c in "yx")
        mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
        mask[y - y.min(), x - x.min()] = True
        ring = largest(mask, share) + [x.min(), y.min()]
        n = len(ring)
        const = lambda v, t: pa.array([v] * n, t)
        return pa.table({"set_name": const(table.column("set_name")[0].as_py(), pa.string()), "feature_id": const(table.column("v")[0].as_py() - 1, pa.int64()), "part": const(0, pa.int32()), "ring": const(0, pa.int32()), "vertex": pa.array(range(n), pa.int32()), "x": ring[:, 0].astype(float), "y": ring[:, 1].astype(float), "shape_type": const("Polygon", pa.string()), "shape_name": const(name, pa.string())})

    own = labels.filter("v > 0").select("set_name", F.col("v").cast("long").alias("v"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    return own.groupBy("set_name", "v").applyInArrow(run, VERTICES)
