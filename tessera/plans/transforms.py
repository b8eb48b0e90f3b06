"""Plane transforms: maps of points in physical units, on the driver as 3x3 matrices and in queries as Column expressions.

A transform has a kind, parameters and a centre c. With R the rotation by an angle and t a shift:
euler [angle, tx, ty]: R (x - c) + c + t; similarity [scale, angle, tx, ty]: scale R (x - c) + c + t;
affine [a11, a12, a21, a22, tx, ty]: A (x - c) + c + t; translation [tx, ty]: x + t.
A chain of them is folded into one matrix before a query runs, so that mapping points is arithmetic in one projection
whatever the length of the chain.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINEAR = ("euler", "similarity", "affine", "translation")
#: The names of transforms and interpolators in parameter files.
FILE_KINDS = {"EulerTransform": "euler", "SimilarityTransform": "similarity", "AffineTransform": "affine", "TranslationTransform": "translation", "BSplineTransform": "bspline"}
INTERPOLATORS = {"FinalNearestNeighborInterpolator": "nearest", "FinalLinearInterpolator": "linear", "FinalBSplineInterpolator": "bspline"}


@dataclass(frozen=True)
class Transform:
    """One edge's map from the fixed to the moving image, with the grid of its output: size (x, y) in pixels, spacing, origin."""

    kind: str
    params: tuple[float, ...]
    center: tuple[float, float] = (0.0, 0.0)
    size: tuple[int, int] = (0, 0)
    spacing: tuple[float, float] = (1.0, 1.0)
    origin: tuple[float, float] = (0.0, 0.0)
    interpolator: str = "nearest"
    grid_size: tuple[int, int] = (0, 0)
    grid_spacing: tuple[float, float] = (1.0, 1.0)
    grid_origin: tuple[float, float] = (0.0, 0.0)

    @property
    def linear(self) -> bool:
        return self.kind in LINEAR

    def matrix(self, pixels: bool = False, yx: bool = False) -> np.ndarray:
        """The homogeneous 3x3 matrix; in pixel units centre and shift are divided by the spacing; yx swaps the axes."""
        if not self.linear:
            raise ValueError(f"{self.kind} has no matrix")
        p = self.params
        if self.kind == "affine":
            a, t = np.array(p[:4]).reshape(2, 2), np.array(p[4:])
        elif self.kind == "translation":
            a, t = np.eye(2), np.array(p)
        else:
            scale, angle = (1.0, p[0]) if self.kind == "euler" else p[:2]
            c, s = math.cos(angle), math.sin(angle)
            a, t = scale * np.array([[c, -s], [s, c]]), np.array(p[-2:])
        center = np.zeros(2) if self.kind == "translation" else np.array(self.center)
        if pixels:
            center, t = center / self.spacing, t / self.spacing
        out = np.eye(3)
        out[:2, :2], out[:2, 2] = a, center + t - a @ center
        return out[np.ix_([1, 0, 2], [1, 0, 2])] if yx else out

    def inverse(self) -> np.ndarray:
        return np.linalg.inv(self.matrix())


def from_map(entry: dict) -> Transform:
    """A transform from the key-to-values map of a parameter file; values are lists of strings."""
    one = lambda key, default: entry.get(key, default)
    floats = lambda key, default: tuple(float(x) for x in one(key, default))
    ints = lambda key, default: tuple(int(float(x)) for x in one(key, default))
    name = one("Transform", [""])[0]
    if name not in FILE_KINDS:
        raise ValueError(f"unknown transform {name!r}")
    return Transform(
        FILE_KINDS[name], floats("TransformParameters", []), floats("CenterOfRotationPoint", [0, 0]), ints("Size", [0, 0]), floats("Spacing", [1, 1]), floats("Origin", [0, 0]),
        INTERPOLATORS.get(one("ResampleInterpolator", [""])[0], "nearest"), ints("GridSize", [0, 0]), floats("GridSpacing", [1, 1]), floats("GridOrigin", [0, 0]),
    )


@dataclass(frozen=True)
class Sequence:
    """Transforms in the order they were added, each in a group. Output size and spacing are those of the last one."""

    transforms: tuple[Transform, ...] = ()
    groups: tuple[int, ...] = ()
    size: tuple[int, int] | None = None
    spacing: tuple[float, float] | None = None

    def add(self, transforms, groups=None) -> Sequence:
        """Appended groups are counted on from the largest one so far; without groups each transform is one of its own."""
        transforms = tuple(transforms)
        groups = tuple(range(len(transforms))) if groups is None else tuple(groups)
        start = max(self.groups, default=-1) + 1
        out = Sequence((*self.transforms, *transforms), (*self.groups, *(g + start for g in groups)))
        return replace(out, size=out.transforms[-1].size, spacing=out.transforms[-1].spacing) if out.transforms else out

    def append(self, other: Sequence) -> Sequence:
        return self.add(other.transforms, other.groups)

    def order(self) -> list[int]:
        """Places in the order in which the composite stacks them: groups ascending, reversed within a group."""
        return [i for g in sorted(set(self.groups)) for i in reversed([k for k, x in enumerate(self.groups) if x == g])]

    def composite(self) -> np.ndarray:
        """One matrix from output to source points: of the stacked transforms the last one maps first."""
        out = np.eye(3)
        for i in self.order():
            out = out @ self.transforms[i].matrix()
        return out

    def with_spacing(self, spacing: tuple[float, float]) -> Sequence:
        """The same extent at another spacing: sizes are rounded up."""
        size = tuple(up(n * old / new) for n, old, new in zip(self.size, self.spacing, spacing, strict=True))
        return replace(self, size=size, spacing=tuple(spacing))

    @property
    def linear(self) -> bool:
        return all(t.linear for t in self.transforms)


def reindexed(rows: DataFrame, key: str, place: str, groups: str) -> DataFrame:
    """Many sequences as one table: adds each transform's group, counted on from the groups of those before it, and its place in the reversed order. groups: how far a transform's groups reach."""
    w = Window.partitionBy(key).orderBy(place)
    before = F.coalesce(F.sum(groups).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"seq_idx": F.col(groups) + before, "reversed": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(place)))})


def read_sequence(data: str | dict) -> Sequence:
    """A sequence from transform JSON: under a key that is "initial" alone each entry is its own group, a list under any other key is one group."""
    entries = json.loads(data) if isinstance(data, str) else data
    transforms, groups, group = [], [], 0
    for key, value in entries.items():
        listed = value if isinstance(value, list) else [value]
        for entry in listed:
            transforms.append(from_map(entry))
            groups.append(group)
            group += key == "initial"
        group += key != "initial"
    return Sequence().add(transforms, groups)


# --- made transforms


def rotation_bound(w: float, h: float, degrees: float) -> tuple[float, float]:
    c, s = abs(math.cos(math.radians(degrees))), abs(math.sin(math.radians(degrees)))
    return h * s + w * c, h * c + w * s


def up(x, digits: int | None = None):
    """The next whole number, of what x is when it is rounded to so many digits; of a number or a column, as all sizes here can be either."""
    if isinstance(x, Column):
        return F.ceil(x if digits is None else F.round(x, digits))
    return math.ceil(x if digits is None else round(x, digits))


def rotation(size: tuple[int, int], spacing: float, degrees: float) -> Transform:
    """Turns an image about its centre and moves it into the bound of the turned one."""
    bound = rotation_bound(*size, degrees)
    center = tuple((b - 1) / 2 * spacing for b in bound)
    old = tuple((n - 1) / 2 * spacing for n in size)
    shift = tuple(o - c for o, c in zip(old, center, strict=True))
    return Transform("euler", (math.radians(degrees), *shift), center, tuple(up(b, 9) for b in bound), (spacing, spacing))


def flip(size: tuple[int, int], spacing: float, axis: str) -> Transform:
    """"h" mirrors x, "v" mirrors y, about the centre."""
    a = {"h": (-1.0, 0.0, 0.0, 1.0), "v": (1.0, 0.0, 0.0, -1.0)}[axis]
    return Transform("affine", (*a, 0.0, 0.0), tuple((n - 1) / 2 * spacing for n in size), size, (spacing, spacing))


def crop(box: tuple[int, int, int, int], spacing: float) -> Transform:
    """The box (x, y, w, h) in pixels becomes the image."""
    return Transform("translation", (box[0] * spacing, box[1] * spacing), size=(box[2], box[3]), spacing=(spacing, spacing))


def uncrop(cropped: Transform, size: tuple[int, int]) -> Transform:
    """Back to the image that was cropped."""
    return replace(cropped, params=tuple(-p for p in cropped.params), size=size)


def identity(size: tuple[int, int], spacing: float) -> Transform:
    return Transform("euler", (0.0, 0.0, 0.0), size=size, spacing=(spacing, spacing))


# --- Column expressions


def mapped(x: Column, y: Column, m: np.ndarray) -> tuple[Column, Column]:
    """(x, y) through a folded matrix."""
    k = [[float(v) for v in row] for row in m]
    return x * k[0][0] + y * k[0][1] + k[0][2], x * k[1][0] + y * k[1][1] + k[1][2]


def euler_columns(x: Column, y: Column, angle: Column, tx: Column, ty: Column, cx: Column, cy: Column, inverse: bool = False) -> tuple[Column, Column]:
    """A turn whose parameters are columns, for joins with a table of transforms."""
    c, s = F.cos(angle), F.sin(angle)
    if inverse:
        u, v = x - cx - tx, y - cy - ty
        return c * u + s * v + cx, c * v - s * u + cy
    u, v = x - cx, y - cy
    return c * u - s * v + cx + tx, s * u + c * v + cy + ty


def affine_columns(x: Column, y: Column, a: tuple[Column, Column, Column, Column], tx: Column, ty: Column, cx: Column, cy: Column, inverse: bool = False) -> tuple[Column, Column]:
    if inverse:
        det = a[0] * a[3] - a[1] * a[2]
        u, v = x - cx - tx, y - cy - ty
        return (a[3] * u - a[1] * v) / det + cx, (a[0] * v - a[2] * u) / det + cy
    u, v = x - cx, y - cy
    return a[0] * u + a[1] * v + cx + tx, a[2] * u + a[3] * v + cy + ty


@dataclass(frozen=True)
class OutputRule:
    """The grid that an image is written on: a given resolution, else the target's own; the size follows at the same extent."""

    size: tuple[int, int]
    spacing: float
    output_res: float | None = None
    notes: tuple[str, ...] = field(default=())

    def grid(self) -> tuple[tuple[int, int], float]:
        new = self.output_res or self.spacing
        return tuple(up(n * self.spacing / new) for n in self.size), new
