"""Pairwise alignment: multi-resolution optimisation of a metric over transform parameters, one edge a task.

From the coarsest level of a pyramid to the base, seeded random samples of the fixed image are compared with the moving one
under the transform, and parameters follow the gradient with a step that decays as a / (k + A)**alpha. Edges depend on
their two images alone, so all edges of a graph are aligned at once as groups of one table.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..plans.transforms import FILE_KINDS, Sequence, Transform
from ..sources.text import parameters_of
from .shapes import basis, displacement, map_points

METRICS = ("mean_squares", "correlation", "mutual_information")


@dataclass(frozen=True)
class Model:
    """One stage: a kind of transform, a metric, and how long it is optimised. The defaults are those of the reference's rigid model.

    steps: the largest step of a point at each resolution, in physical units, the last ones where a pyramid has fewer levels; none:
    two pixels of the level. grid, schedule: of a B-spline, the final spacing of its grid and its multiple at each resolution. centred:
    as the first stage and without a mask, begin with the images' centres on each other.
    """

    kind: str = "euler"
    metric: str = "mutual_information"
    resolutions: int = 10
    iterations: int = 200
    samples: int = 10000
    bins: int = 16
    seed: int = 1
    steps: tuple[float, ...] = ()
    grid: float = 100.0
    schedule: tuple[float, ...] = (1,)
    centred: bool = False


#: The reference's models with its budgets; translation is an addition. A pyramid ends earlier where the smaller side falls under 24.
STEPS = (100.0, 75.0, 66.0, 50.0, 25.0, 15.0, 10.0, 10.0, 5.0, 1.0)
HALVES = (512, 392, 256, 128, 64, 32, 16, 4, 2, 1)
_BASE = {
    "rigid": Model(steps=STEPS, centred=True),
    "similarity": Model("similarity", bins=32, steps=STEPS, centred=True),
    "affine": Model("affine", bins=32, steps=STEPS, centred=True),
    "nl": Model("bspline", samples=50000, bins=32, steps=(100, 90, 70, 50, 40, 30, 20, 10, 1, 1), grid=100, schedule=HALVES),
}
MODELS = {
    **_BASE,
    "translation": Model("translation"),
    "fi_correction": Model(resolutions=4, iterations=75, steps=(100, 50, 20, 10)),
    "nl-reduced": Model("bspline", resolutions=5, iterations=150, samples=50000, bins=32, steps=(50, 40, 30, 20), grid=100, schedule=(392, 256, 128, 64, 32)),
    "nl-mid": Model("bspline", resolutions=5, samples=50000, bins=32, steps=(100, 70, 50, 30, 10), grid=150, schedule=(512, 128, 64, 32, 2)),
    "rigid-expanded": Model(iterations=500, samples=30000, steps=STEPS, centred=True),
    "nl3": Model("bspline", resolutions=1, iterations=1000, samples=125000, bins=32, steps=(10,), grid=200, schedule=(8,)),
    "nl2": Model("bspline", samples=15000, bins=32, steps=(25, 20, 15, 10, 10, 8, 5, 5, 5, 2), grid=75, schedule=HALVES),
    **{f"{name}_test": replace(m, iterations=10) for name, m in _BASE.items()},
    **{f"{name}_ams": replace(m, metric="mean_squares") for name, m in _BASE.items()},
    **{f"{name}_anc": replace(m, metric="correlation") for name, m in _BASE.items()},
}
#: The names that the reference's configurations use for the same models.
MODELS |= {name.replace("-", "_"): m for name, m in MODELS.items()}


def model_of(entry: dict) -> Model:
    """A model from the key-to-values map of a parameter file; keys that have no field here are left alone."""
    one = lambda key, default: (entry.get(key) or [default])[0]
    numbers = lambda key: tuple(float(x) for x in entry.get(key, ()))
    kind, metric = str(one("Transform", "EulerTransform")), str(one("Metric", "AdvancedMattesMutualInformation"))
    if kind not in FILE_KINDS or metric not in FILE_METRICS:
        raise ValueError(f"no model for {kind} by {metric}")
    out = Model(FILE_KINDS[kind], FILE_METRICS[metric])
    whole = {"resolutions": "NumberOfResolutions", "iterations": "MaximumNumberOfIterations", "samples": "NumberOfSpatialSamples", "bins": "NumberOfHistogramBins"}
    return replace(
        out, **{field: int(float(one(key, getattr(out, field)))) for field, key in whole.items()}, steps=numbers("MaximumStepLength"), grid=float(one("FinalGridSpacingInPhysicalUnits", out.grid)),
        schedule=numbers("GridSpacingSchedule") or out.schedule, centred=str(one("AutomaticTransformInitialization", "false")).lower() == "true",
    )


#: The names of metrics in parameter files.
FILE_METRICS = {"AdvancedMattesMutualInformation": "mutual_information", "AdvancedMeanSquares": "mean_squares", "AdvancedNormalizedCorrelation": "correlation"}


def models_of(names, models: dict[str, Model] = MODELS) -> tuple[Model, ...]:
    """A path's stages: names of models, models, key-to-values maps, or paths of parameter files. One that isn't known is refused before anything is aligned."""
    out = []
    for name in names:
        if isinstance(name, Model):
            out.append(name)
        elif isinstance(name, dict):
            out.append(model_of(name))
        elif name in models:
            out.append(models[name])
        elif os.path.isfile(name):
            with open(name) as file:
                out.append(model_of(parameters_of(file.read())))
        else:
            raise ValueError(f"model {name} is not known")
    return tuple(out)


START = {"euler": (0.0, 0.0, 0.0), "similarity": (1.0, 0.0, 0.0, 0.0), "affine": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), "translation": (0.0, 0.0)}


class Unit:
    """A plane's values in 0..1, worked out where they are asked for; the plane is held as it came."""

    def __init__(self, plane: np.ndarray):
        self.plane, self.shape, self.size = plane, plane.shape, plane.size
        self.low, self.high = float(plane.min()), float(plane.max())

    def __getitem__(self, at) -> np.ndarray:
        a = self.plane[at].astype(float)
        return (a - self.low) / (self.high - self.low) if self.high > self.low else np.zeros_like(a)


class Slope:
    """np.gradient() of a plane along an axis, worked out where it is asked for."""

    def __init__(self, plane: np.ndarray | Unit, axis: int):
        self.plane, self.axis, self.shape, self.size = plane, axis, plane.shape, plane.size

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        low, high = list(at), list(at)
        low[self.axis], high[self.axis] = np.maximum(at[self.axis] - 1, 0), np.minimum(at[self.axis] + 1, self.shape[self.axis] - 1)
        return (self.plane[tuple(high)] - self.plane[tuple(low)]) / np.maximum(high[self.axis] - low[self.axis], 1)


#: Pixels of the largest planes that are held as floats beside their own type, and that are halved at once.
HELD = 1 << 20


def halved(plane: np.ndarray | Unit) -> np.ndarray:
    h, w = (n // 2 for n in plane.shape)
    out, rows = np.empty((h, w)), max(HELD // max(plane.shape[1], 1) // 2, 1)
    for k in range(0, h, rows):
        a = plane[2 * k : 2 * min(k + rows, h)][:, : 2 * w]
        out[k : k + rows] = (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) / 4
    return out


def sampled(plane: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values at (x, y), and which lie inside."""
    h, w = plane.shape
    inside = (p[:, 0] >= 0) & (p[:, 0] <= w - 1) & (p[:, 1] >= 0) & (p[:, 1] <= h - 1)
    q = np.clip(p, 0, [w - 1, h - 1])
    n = np.minimum(np.floor(q).astype(int), [max(w - 2, 0), max(h - 2, 0)])
    f = q - n
    at = lambda dy, dx: plane[np.minimum(n[:, 1] + dy, h - 1), np.minimum(n[:, 0] + dx, w - 1)]
    top, low = at(0, 0) * (1 - f[:, 0]) + at(0, 1) * f[:, 0], at(1, 0) * (1 - f[:, 0]) + at(1, 1) * f[:, 0]
    return top * (1 - f[:, 1]) + low * f[:, 1], inside


def cost(metric: str, a: np.ndarray, b: np.ndarray, bins: int) -> float:
    """Lower is better; a and b are in 0..1."""
    if len(a) < 16:
        return 1e3
    if metric == "mean_squares":
        return float(((a - b) ** 2).mean())
    if metric == "correlation":
        a, b = a - a.mean(), b - b.mean()
        return -float((a * b).sum() / max(np.sqrt((a * a).sum() * (b * b).sum()), 1e-12))
    # a joint histogram with linear shares of neighbouring bins, so that the cost is smooth
    x, y = a * (bins - 1), b * (bins - 1)
    i, j = np.minimum(x.astype(int), bins - 2), np.minimum(y.astype(int), bins - 2)
    f, g = x - i, y - j
    joint = np.zeros(bins * bins)
    for di, wi in ((0, 1 - f), (1, f)):
        for dj, wj in ((0, 1 - g), (1, g)):
            joint += np.bincount((i + di) * bins + j + dj, wi * wj, bins * bins)
    joint = joint.reshape(bins, bins) / joint.sum()
    pa_, pb = joint.sum(1), joint.sum(0)
    full = joint > 0
    return -float((joint[full] * np.log(joint[full] / np.outer(pa_, pb)[full])).sum())


def slope(metric: str, a: np.ndarray, b: np.ndarray, bins: int) -> np.ndarray:
    """How cost() changes with each value of b."""
    n = len(a)
    if metric == "mean_squares":
        return 2 * (b - a) / n
    if metric == "correlation":
        a, b = a - a.mean(), b - b.mean()
        s = max(np.sqrt((a * a).sum() * (b * b).sum()), 1e-12)
        return -a / s + (a * b).sum() / s * b / max((b * b).sum(), 1e-12)
    x, y = a * (bins - 1), b * (bins - 1)
    i, j = np.minimum(x.astype(int), bins - 2), np.minimum(y.astype(int), bins - 2)
    f, g = x - i, y - j
    joint = np.zeros(bins * bins)
    for di, wi in ((0, 1 - f), (1, f)):
        for dj, wj in ((0, 1 - g), (1, g)):
            joint += np.bincount((i + di) * bins + j + dj, wi * wj, bins * bins)
    joint = joint.reshape(bins, bins) / n
    gain = np.log((joint + 1e-9) / (np.outer(joint.sum(1), joint.sum(0)) + 1e-9))
    return -(bins - 1) / n * ((1 - f) * (gain[i, j + 1] - gain[i, j]) + f * (gain[i + 1, j + 1] - gain[i + 1, j]))


def pyramid(fixed: np.ndarray, moving: np.ndarray, resolutions: int) -> tuple[list[np.ndarray | Unit], list[np.ndarray | Unit]]:
    """Levels of both planes from the base on; a large base stays in its own type."""
    levels_f, levels_m = ([one if one.size > HELD else one[:]] for one in (Unit(fixed), Unit(moving)))
    for _ in range(resolutions - 1):
        if min(*levels_f[-1].shape, *levels_m[-1].shape) < 24:
            break
        levels_f.append(halved(levels_f[-1]))
        levels_m.append(halved(levels_m[-1]))
    return levels_f, levels_m


def places(mask: np.ndarray | None) -> np.ndarray | None:
    """Where a level's mask has pixels, as y * width + x."""
    if mask is None:
        return None
    found = np.flatnonzero(mask)
    if not len(found):
        raise ValueError("a mask without pixels")
    return found.astype(np.uint32) if mask.size < 1 << 32 else found


def draw(rng: np.random.Generator, shape: tuple[int, int], n: int, within: np.ndarray | None) -> np.ndarray:
    """n random points (x, y) of a level, within half a pixel of its mask's places() where there are any."""
    h, w = shape
    if within is None:
        return np.column_stack([rng.uniform(0, w - 1, n), rng.uniform(0, h - 1, n)])
    k = within[rng.integers(0, len(within), n)].astype(np.int64)
    return np.clip(np.column_stack([k % w, k // w]) + rng.uniform(-0.5, 0.5, (n, 2)), 0, [w - 1, h - 1])


def level_of(mask: np.ndarray | None, level: int) -> np.ndarray | None:
    if mask is None:
        return None
    out = mask > 0
    for k in range(level):
        out = halved(out if k else out.view(np.uint8))
    # a small mask stays where its mean falls under a half
    return (out > 0) & (out >= min(0.5, out.max()))


def step_of(model: Model, level: int, levels: int, res: float, k: int) -> float:
    """The longest step of iteration k: decaying from the resolution's own, two pixels at most where none is given or it is longer than the image's levels bear."""
    own = model.steps[max(len(model.steps) - 1 - level, 0)] if model.steps else 2 * res
    return min(own, 2 * res) / (k / 20 + 1) ** 0.9


def align(fixed: np.ndarray, moving: np.ndarray, model: Model, spacing: float = 1.0, start: Sequence = Sequence(), fixed_mask: np.ndarray | None = None, moving_mask: np.ndarray | None = None) -> tuple[Transform, list[tuple[int, int, float]]]:
    """The transform from fixed to moving points (physical units), and (resolution, iteration, cost) as it went.

    start: what maps points before it, as one group's transforms do; what is found comes after. Where there are masks, points are
    drawn from the fixed one alone and count only where they come to lie in the moving one.
    """
    if model.kind == "bspline":
        return align_grid(fixed, moving, model, spacing, start, fixed_mask, moving_mask)
    rng = np.random.default_rng(model.seed)
    levels_f, levels_m = pyramid(fixed, moving, model.resolutions)
    h, w = fixed.shape
    center = ((w - 1) / 2 * spacing, (h - 1) / 2 * spacing)
    params = np.array(START[model.kind])
    if model.centred and not start.transforms and fixed_mask is None:
        params[-2:] += (np.array(moving.shape[::-1]) - fixed.shape[::-1]) / 2 * spacing
    reach = max(w, h) / 2 * spacing
    # a unit step of each parameter moves the image's edge by about one physical unit
    scale = np.array([1 / reach] * (len(params) - 2) + [1.0, 1.0])
    log = []
    for level in range(len(levels_f) - 1, -1, -1):
        f, m = levels_f[level], levels_m[level]
        within, other = places(level_of(fixed_mask, level)), level_of(moving_mask, level)
        res = spacing * 2**level
        # a block's mean stands at its centre
        shift = (2**level - 1) / 2 * spacing

        def value(p: np.ndarray, began: np.ndarray, ref: np.ndarray, m=m, other=other, res=res, shift=shift) -> float:
            matrix = Transform(model.kind, tuple(p), center).matrix()
            q = (began @ matrix[:2, :2].T + matrix[:2, 2] - shift) / res
            got, inside = sampled(m, q)
            if other is not None:
                inside &= sampled(other, q)[0] > 0.5
            return cost(model.metric, ref[inside], got[inside], model.bins)

        eps = 0.5 * res
        best = None
        for k in range(model.iterations):
            n = min(model.samples, f.size)
            at = draw(rng, f.shape, n, within)
            ref, _ = sampled(f, at)
            began = map_points(start, at * res + shift)
            grad = np.array([value(params + d, began, ref) - value(params - d, began, ref) for d in np.diag(scale * eps)])
            size = np.linalg.norm(grad)
            if size > 0:
                params = params - scale * grad / size * step_of(model, level, len(levels_f), res, k)
            if k % 10 == 9 or k == model.iterations - 1:
                log.append((len(levels_f) - 1 - level, k, value(params, began, ref)))
            # the mean of the last third is steadier than the last step
            if k >= model.iterations * 2 // 3:
                best = params if best is None else best + params
        params = best / (model.iterations - model.iterations * 2 // 3)
    return Transform(model.kind, tuple(float(x) for x in params), center, (w, h), (spacing, spacing)), log


def grid_over(low: np.ndarray, high: np.ndarray, cell: float, size: tuple[int, int], spacing: float) -> Transform:
    """A B-spline at rest whose support covers the box, so that no point of it falls out."""
    n = np.ceil((high - low) / cell).astype(int) + 4
    return Transform("bspline", (0.0,) * (2 * int(n[0]) * int(n[1])), size=size, spacing=(spacing, spacing), grid_size=tuple(int(x) for x in n), grid_spacing=(cell, cell), grid_origin=tuple(float(x) for x in low - 1.5 * cell))


def regridded(old: Transform, new: Transform) -> Transform:
    """The new grid with the displacements of the old one at its points; what smoothing takes off is put back in some rounds."""
    nx, ny = new.grid_size
    at = np.stack(np.meshgrid(np.arange(nx), np.arange(ny)), -1).reshape(-1, 2) * new.grid_spacing + new.grid_origin
    want, c = displacement(old, at), np.zeros((nx * ny, 2))
    for _ in range(6):
        c = c + want - displacement(replace(new, params=tuple(c.T.ravel())), at)
    return replace(new, params=tuple(c.T.ravel()))


def align_grid(fixed: np.ndarray, moving: np.ndarray, model: Model, spacing: float, start: Sequence, fixed_mask: np.ndarray | None, moving_mask: np.ndarray | None) -> tuple[Transform, list[tuple[int, int, float]]]:
    """align() for a B-spline: coefficients follow the metric's own slope through the moving image's, each by the mean of the points it moves; the grid is refined with the pyramid."""
    rng = np.random.default_rng(model.seed)
    levels_f, levels_m = pyramid(fixed, moving, model.resolutions)
    h, w = fixed.shape
    edge = np.array([[x, y] for x in np.linspace(0, w - 1, 17) for y in np.linspace(0, h - 1, 17)]) * spacing
    edge = map_points(start, edge)
    low, high = edge.min(0) - spacing, edge.max(0) + spacing
    t, log = None, []
    for level in range(len(levels_f) - 1, -1, -1):
        f, m = levels_f[level], levels_m[level]
        within, other = places(level_of(fixed_mask, level)), level_of(moving_mask, level)
        res, shift = spacing * 2**level, (2**level - 1) / 2 * spacing
        # a cell larger than the image moves it as one; the final grid is reached at the last level
        cell = model.grid * (model.schedule[max(len(model.schedule) - 1 - level, 0)] if level else model.schedule[-1])
        fresh = grid_over(low, high, float(min(cell, max(high - low))), (w, h), spacing)
        t = fresh if t is None else regridded(t, fresh)
        nx, ny = t.grid_size
        slopes = np.gradient(m) if m.size <= HELD else (Slope(m, 0), Slope(m, 1))
        c, speed, best = np.array(t.params), np.zeros(2 * nx * ny), None
        for k in range(model.iterations):
            at = draw(rng, f.shape, min(model.samples, f.size), within)
            ref, _ = sampled(f, at)
            began = map_points(start, at * res + shift)
            u = (began - t.grid_origin) / t.grid_spacing
            first = np.floor(u).astype(int) - 1
            wx, wy = basis(u[:, 0] - np.floor(u[:, 0])), basis(u[:, 1] - np.floor(u[:, 1]))
            inside = (first >= 0).all(1) & (first[:, 0] + 3 < nx) & (first[:, 1] + 3 < ny)
            first = np.where(inside[:, None], first, 0)
            node = (first[:, 1, None, None] + np.arange(4)[:, None]) * nx + first[:, 0, None, None] + np.arange(4)
            weight = wy[:, :, None] * wx[:, None, :] * inside[:, None, None]
            q = (began + np.column_stack([(c[: nx * ny][node] * weight).sum((1, 2)), (c[nx * ny :][node] * weight).sum((1, 2))]) - shift) / res
            got, counts = sampled(m, q)
            if other is not None:
                counts &= sampled(other, q)[0] > 0.5
            if counts.sum() < 16:
                break
            rows = np.flatnonzero(counts)
            along = slope(model.metric, ref[rows], got[rows], model.bins) / res
            node, weight = node[rows].reshape(len(rows), -1), weight[rows].reshape(len(rows), -1)
            share = np.bincount(node.ravel(), weight.ravel(), nx * ny)
            pull = [np.bincount(node.ravel(), (weight * (along * sampled(g, q[rows])[0])[:, None]).ravel(), nx * ny) / (share + 0.01 * share.max() + 1e-12) for g in (slopes[1], slopes[0])]
            speed = 0.7 * speed + 0.3 * np.concatenate(pull)
            size = np.abs(speed).max()
            if size > 0:
                c = c - speed / size * step_of(model, level, len(levels_f), res, k) / 2
            if k % 10 == 9 or k == model.iterations - 1:
                log.append((len(levels_f) - 1 - level, k, cost(model.metric, ref[rows], got[rows], model.bins)))
            if k >= model.iterations * 2 // 3:
                best = c if best is None else best + c
        after = replace(t, params=tuple(float(x) for x in (c if best is None else best / (model.iterations - model.iterations * 2 // 3))))
        # few iterations of long steps can end worse than they began: then the level leaves the grid as it was
        at = draw(rng, f.shape, min(model.samples, f.size), within)
        ref, _ = sampled(f, at)
        began = map_points(start, at * res + shift)
        costs = []
        for grid in (t, after):
            got, counts = sampled(m, (began + displacement(grid, began) - shift) / res)
            costs.append(cost(model.metric, ref[counts], got[counts], model.bins))
        t = after if costs[1] <= costs[0] else t
    return t, log


RESULT = "edge_id string, stage int, kind string, params array<double>, center array<double>, size array<int>, spacing double, grid_size array<int>, grid_spacing array<double>, grid_origin array<double>, cost double, iterations int, log array<struct<resolution: int, iteration: int, metric: double>>"


def align_stages(fixed: np.ndarray, moving: np.ndarray, models: tuple[Model, ...], spacing: float = 1.0, fixed_mask: np.ndarray | None = None, moving_mask: np.ndarray | None = None, match: bool = False) -> list[tuple[Transform, list[tuple[int, int, float]]]]:
    """align() for each stage, begun from the stages before it; together the transforms are one group. match: the moving image's values are first given the fixed one's distribution."""
    if match:
        moving = histogram_match(moving, fixed)
    out = []
    for model in models:
        done = [t for t, _ in out]
        out.append(align(fixed, moving, model, spacing, Sequence().add(done, [0] * len(done)), fixed_mask, moving_mask))
    return out


def transform_of(r) -> Transform:
    """A row of register_edges() as a transform."""
    grid = {k: tuple(r[k]) for k in ("grid_size", "grid_spacing", "grid_origin") if r["kind"] == "bspline"}
    return Transform(r["kind"], tuple(r["params"]), tuple(r["center"]), tuple(r["size"]), (r["spacing"], r["spacing"]), **grid)


def register_edges(edges: DataFrame, models, spacing: float = 1.0, match: bool = False) -> DataFrame:
    """edges: (edge_id, fixed, moving, h, w, mh, mw, dtype) with the planes as binary, and where there are such columns fixed_mask and moving_mask (a byte a pixel, or null), mdtype (the moving plane's own type) and res (the edge's own spacing).

    A row for each edge and stage, each edge aligned in a task of its own. models: the stages of all edges, or of each by its id.
    """
    of = {k: (v,) if isinstance(v, Model) else tuple(v) for k, v in models.items()} if isinstance(models, dict) else None
    every = None if of is not None else (models,) if isinstance(models, Model) else tuple(models)
    kind = to_arrow_schema(_parse_datatype_string(RESULT))

    def run(batches):
        for batch in batches:
            # planes and masks are read where Arrow has them
            planes = {c: batch.column(c) for c in ("fixed", "moving", "fixed_mask", "moving_mask") if c in batch.schema.names}
            for n, r in enumerate(batch.select([c for c in batch.schema.names if c not in planes]).to_pylist()):
                raw = {c: column[n].as_buffer() for c, column in planes.items() if column[n].is_valid}
                shapes = {"fixed": (r["h"], r["w"]), "moving": (r["mh"], r["mw"])}
                fixed, moving = (np.frombuffer(raw[k], r["dtype"] if k == "fixed" else r.get("mdtype") or r["dtype"]).reshape(shapes[k]) for k in shapes)
                masks = [np.frombuffer(raw[f"{k}_mask"], np.uint8).reshape(shapes[k]) if f"{k}_mask" in raw else None for k in shapes]
                res, out = r.get("res") or spacing, []
                for k, (t, log) in enumerate(align_stages(fixed, moving, of[r["edge_id"]] if of is not None else every, res, *masks, match)):
                    out.append({
                        "edge_id": r["edge_id"], "stage": k, "kind": t.kind, "params": list(t.params), "center": list(t.center), "size": list(t.size), "spacing": res, "grid_size": list(t.grid_size), "grid_spacing": list(t.grid_spacing),
                        "grid_origin": list(t.grid_origin), "cost": log[-1][2] if log else None, "iterations": len(log), "log": [dict(zip(("resolution", "iteration", "metric"), x, strict=True)) for x in log],
                    })
                yield pa.RecordBatch.from_pylist(out, kind)

    return edges.repartition("edge_id").mapInArrow(run, RESULT)


def histogram_match(source: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The source's values mapped so that its distribution is the reference's."""
    values, inverse, counts = np.unique(source, return_inverse=True, return_counts=True)
    ref, ref_counts = np.unique(reference, return_counts=True)
    mapped = np.interp(np.cumsum(counts) / source.size, np.cumsum(ref_counts) / reference.size, ref)
    return mapped[inverse].reshape(source.shape)
