"""A project end to end: preprocess planes, align every edge, map images and shapes along their paths.

Planes and edges are tables, and all edges are aligned by one job, each in a task of its own. Planes for alignment are gathered
per image in one row, so one that is larger than `most_pixels` is shrunk further, by a whole step; pixels are mapped at full size by tiles.
Writing is `runner`'s.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pixels as px
from .operators import register, resample, shapes
from .plans.graph import Edge, Graph
from .plans.transforms import OutputRule, Sequence, Transform, crop, flip, identity, rotation, uncrop
from .sources.cache import cached


@dataclass(frozen=True)
class Prepro:
    """How an image is made fit for alignment, in this order: channels, projection, contrast, inversion, own functions; then shrinking, turning, mirroring, cropping.

    as_uint8: planes of 8 bits; else values stay as they are. use_mask: alignment keeps to the image's mask, if it has one. crop_to_mask:
    the box, where none is given, is that of the mask.
    """

    image_type: str = "FL"
    channels: tuple[int, ...] = ()
    max_projection: bool = True
    contrast: bool = False
    invert: bool = False
    custom: tuple = ()
    downsampling: int = 1
    rotate: float = 0
    flip: str | None = None
    box: tuple[int, int, int, int] | None = None
    as_uint8: bool = True
    use_mask: bool = True
    crop_to_mask: bool = False

    def __post_init__(self):
        # a channel or a list of them, a box as any four numbers
        object.__setattr__(self, "channels", (self.channels,) if isinstance(self.channels, int) else tuple(self.channels or ()))
        object.__setattr__(self, "box", None if self.box is None else tuple(int(x) for x in self.box))
        if self.image_type not in ("FL", "BF") or self.flip not in (None, "h", "v") or self.downsampling < 1 or (self.box is not None and len(self.box) != 4) or not all(map(callable, self.custom)):
            raise ValueError(f"not a preprocessing: {self}")

    def effective(self) -> Prepro:
        """Fluorescence is never inverted; bright field is neither projected nor enhanced."""
        return replace(self, invert=False) if self.image_type == "FL" else replace(self, max_projection=False, contrast=False)

    def with_override(self, other: Prepro | None) -> Prepro:
        """Another's fields where they differ from the defaults, this one's elsewhere."""
        if other is None:
            return self
        return replace(self, **{f.name: getattr(other, f.name) for f in fields(Prepro) if getattr(other, f.name) != f.default and f.name != "custom"}, custom=other.custom or self.custom)

    def told(self, given_only: bool = False) -> dict:
        """The fields as plain values, own functions by their names; given_only: those that aren't the defaults."""
        out = asdict(self) | {"custom": [f.__name__ for f in self.custom], "channels": list(self.channels), "box": None if self.box is None else list(self.box)}
        blank = {f.name: [] if f.name in ("custom", "channels") else f.default for f in fields(Prepro)}
        return {k: v for k, v in out.items() if not given_only or v != blank[k]}


class Encoder(json.JSONEncoder):
    """Writes numpy's numbers and arrays and preprocessing as plain JSON."""

    def default(self, o):
        if isinstance(o, np.generic):
            return o.item()
        if isinstance(o, np.ndarray):
            return o.tolist()
        return o.told() if isinstance(o, Prepro) else super().default(o)


def intensity(image: DataFrame, prepro: Prepro, rgb: bool = False) -> DataFrame:
    """One channel from an image's pixels, of 8 bits unless told otherwise."""
    p = prepro.effective()
    if rgb:
        out = px.grayscale_image(image)
    else:
        out = px.select_channels(image, list(p.channels)) if p.channels else image
        out = px.rescale(out) if p.as_uint8 else out
        out = px.max_projection(out) if p.max_projection else px.single_channel(out, 0)
    if p.contrast:
        out = out.withColumn("v", px.contrast(F.col("v")))
    if p.invert or (p.image_type == "BF" and rgb):
        out = out.withColumn("v", px.invert(F.col("v"), 255.0 if p.as_uint8 or rgb else 65535.0))
    for f in p.custom:
        out = f(out)
    return out


def spatial(image: DataFrame, prepro: Prepro, size: tuple[int, int], res: float) -> tuple[DataFrame, list[Transform], tuple[int, int], float]:
    """The pixels after the spatial steps, the transforms that undo them, the new size and spacing."""
    out, steps = image, []
    if prepro.downsampling > 1:
        k = prepro.downsampling
        out, size, res = px.shrink(out, k), (size[0] // k, size[1] // k), res * k
    for t in ([rotation(size, res, prepro.rotate)] if prepro.rotate else []) + ([] if prepro.flip is None else [None]):
        t = t or flip(size, res, prepro.flip)
        seq = Sequence().add([t])
        m = _pixels(seq, res)
        turned = resample.nearest(out.select("y", "x", "v"), t.size, m)
        out = turned.select(F.lit("image").alias("image_id"), F.lit(0).alias("channel"), "y", "x", "v")
        size = t.size
        steps.append(t)
    if prepro.box:
        out = px.crop(out, *prepro.box)
        steps.append(crop(prepro.box, res))
        size = prepro.box[2:]
    return out, steps, size, res


def _pixels(seq: Sequence, res: float):
    import numpy as np

    return np.diag([1 / res, 1 / res, 1]) @ seq.composite() @ np.diag([seq.spacing[0], seq.spacing[1], 1])


def mask_of(mask: DataFrame) -> DataFrame:
    """A mask's pixels as 0 and 1, of one channel."""
    return px.single_channel(mask, 0).withColumn("v", px.threshold_mask(F.col("v")).cast("double"))


@dataclass(frozen=True)
class Plane:
    """An image made fit for alignment: its pixels, mask, size and spacing, and what undoes its spatial steps."""

    pixels: DataFrame
    mask: DataFrame | None
    size: tuple[int, int]
    res: float
    steps: tuple[Transform, ...]
    dtype: str
    told: dict  # what it was made from and with


@dataclass
class Project:
    graph: Graph
    pixels: dict[str, DataFrame]  # image -> (image_id, channel, y, x, v)
    sizes: dict[str, tuple[int, int]]
    prepro: dict[str, Prepro] = field(default_factory=dict)
    rgb: set[str] = field(default_factory=set)
    found: dict[str, tuple[Transform, ...]] = field(default_factory=dict)  # source -> its edge's stages
    initial: dict[str, list[Transform]] = field(default_factory=dict)
    masks: dict[str, DataFrame] = field(default_factory=dict)  # image -> (image_id, channel, y, x, v)
    logs: dict[str, list[tuple]] = field(default_factory=dict)  # source -> (stage, resolution, iteration, metric)
    most_pixels: int = 1 << 26
    #: A folder for preprocessed planes, which are read again for the same image and preprocessing; none keeps nothing.
    cache: str | None = None

    def plane(self, name: str, override: Prepro | None = None) -> Plane:
        p = self.prepro.get(name, Prepro()).with_override(override)
        w, h = self.sizes[name]
        p = replace(p, downsampling=max(p.downsampling, math.ceil(math.sqrt(w * h / self.most_pixels))))
        mask = mask_of(self.masks[name]) if name in self.masks and (p.use_mask or p.crop_to_mask) else None
        if p.crop_to_mask and p.box is None and mask is not None:
            # the box after shrinking, turning and mirroring, as a box that is given
            turned = spatial(mask, replace(p, box=None), (w, h), self.graph.nodes[name].image_res)[0]
            box = px.mask_box(turned).first()
            p = p if box is None else replace(p, box=tuple(int(box[c]) for c in "xywh"))
        res = self.graph.nodes[name].image_res
        out, steps, size, spacing = spatial(intensity(self.pixels[name], p, name in self.rgb), p, (w, h), res)
        return Plane(out, spatial(mask, p, (w, h), res)[0] if mask is not None and p.use_mask else None, size, spacing, tuple(steps), "float32" if p.custom or not p.as_uint8 else "uint8", {"image": self.graph.nodes[name].image, "mask": self.graph.nodes[name].mask, "size": [w, h], "prepro": p.told()})

    def _rows(self, spark: SparkSession, planes: dict[str, Plane], masks: bool) -> DataFrame:
        """(name, h, w, dtype, data): whole planes, or masks, one a row."""
        rows = spark.createDataFrame([], "name string, h int, w int, dtype string, data binary")
        for key, p in planes.items():
            if (own := p.mask if masks else p.pixels) is not None:
                plane = resample.to_tiles(own, 1 << 30, "uint8" if masks else p.dtype).select(F.lit(key).alias("name"), "h", "w", "dtype", "data")
                if self.cache:
                    plane = cached(plane, self.cache, f"{key.replace('/', '-')}-{'mask' if masks else 'plane'}", p.told)
                rows = rows.unionByName(plane)
        return rows

    def register(self, spark: SparkSession, models: dict[str, register.Model] = register.MODELS, match: bool = False) -> None:
        """Aligns every edge that isn't yet, by all its stages in turn and all edges in one job. Source images move onto their edge's target."""
        edges = [e for e in self.graph.edges if not e.registered]
        stages = {e.source: register.models_of(e.params, models) for e in edges}
        if not edges:
            return
        # a plane for each image, and others where an edge has its own preprocessing
        planes, of = {}, {}
        for e in edges:
            for end, name, own in (("source", e.source, e.source_prepro), ("target", e.target, e.target_prepro)):
                key = name if own is None else f"{e.source}/{end}"
                of[e.source, end] = key
                if key not in planes:
                    planes[key] = self.plane(name, own)
        rows, masks = self._rows(spark, planes, False), self._rows(spark, planes, True).select("name", F.col("data").alias("mask"))
        table = rows.join(masks, "name", "left")
        told = spark.createDataFrame([(e.source, of[e.source, "target"], of[e.source, "source"], planes[of[e.source, "target"]].res) for e in edges], "edge_id string, fixed_name string, moving_name string, res double")
        fixed = table.select(F.col("name").alias("fixed_name"), "h", "w", "dtype", F.col("data").alias("fixed"), F.col("mask").alias("fixed_mask"))
        moving = table.select(F.col("name").alias("moving_name"), F.col("h").alias("mh"), F.col("w").alias("mw"), F.col("dtype").alias("mdtype"), F.col("data").alias("moving"), F.col("mask").alias("moving_mask"))
        pairs = told.join(fixed, "fixed_name").join(moving, "moving_name").drop("fixed_name", "moving_name")
        results: dict[str, list] = {}
        for r in register.register_edges(pairs, stages, match=match).orderBy("edge_id", "stage").collect():
            results.setdefault(r["edge_id"], []).append(register.transform_of(r))
            self.logs.setdefault(r["edge_id"], []).extend((r["stage"], x["resolution"], x["iteration"], x["metric"]) for x in r["log"])
        for e in edges:
            self.found[e.source] = tuple(results[e.source])
            for end, name in (("source", e.source), ("target", e.target)):
                self.initial.setdefault(name, list(planes[of[e.source, end]].steps))
            # the source's own steps are those of the plane that was aligned
            self.initial[e.source] = list(planes[of[e.source, "source"]].steps)
        self.graph.edges = [replace(e, registered=True, transforms=self.found[e.source]) if e.source in self.found else e for e in self.graph.edges]

    def hops(self, name: str) -> list[Edge]:
        return self.graph.transform_paths().get(self.graph.nodes[name].attached_to or name, [])

    def target_of(self, name: str) -> str:
        hops = self.hops(name)
        return hops[-1].target if hops else self.graph.nodes[name].attached_to or name

    def sequence(self, name: str) -> Sequence:
        """From the path's end to the image: its own steps, then each hop's."""
        node = self.graph.nodes[name]
        name = node.attached_to or name
        out = Sequence().add(self.initial.get(name, []))
        for e in self.hops(name):
            out = out.add(e.transforms, [0] * len(e.transforms))
        if not out.transforms:
            out = out.add([identity(self.sizes[name], node.image_res)])
        return out

    def output(self, name: str, to_original_size: bool = True) -> Sequence:
        """What writes an image: to_original_size undoes the last target's crop, so that all of it is covered; the spacing is the image's output_res, else the target's own resolution."""
        target = self.target_of(name)
        sequence, res = self.sequence(name), self.graph.nodes[target].image_res
        if self.hops(name):
            box = [t for t in self.initial.get(target, []) if t.kind == "translation"]
            if to_original_size and box:
                (w, h), spacing = self.sizes[target], box[0].spacing[0]
                turned = [t for t in self.initial[target] if t.kind != "translation"]
                size = turned[-1].size if turned else tuple(int(n * res / spacing) for n in (w, h))
                sequence = sequence.add([uncrop(box[0], size)])
        elif name in self.sizes:
            # an image without a path is written as it is
            sequence = Sequence().add([identity(self.sizes[name], self.graph.nodes[name].image_res)])
        size, spacing = OutputRule(sequence.size, sequence.spacing[0], self.graph.nodes[name].output_res or res).grid()
        return replace(sequence, size=size, spacing=(spacing, spacing))

    def transformed(self, name: str, tile: int = 512, kind: str = "nearest", sequence: Sequence | None = None) -> DataFrame:
        """All channels of an image on its target's grid, as tiles."""
        tiles = resample.to_tiles(self.pixels[name], tile)
        return resample.resample_tiles(tiles, self.sizes[name], sequence or self.sequence(name), self.graph.nodes[name].image_res, tile, kind)

    def shapes(self, vertices: DataFrame, name: str) -> DataFrame:
        """A shape set attached to an image, on the target's grid."""
        node = self.graph.shapes.get(name, name)
        return shapes.transform(vertices, self.sequence(node), source_res=self.graph.nodes[node].image_res)
