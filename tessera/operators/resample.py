"""Resampling: output pixels from source pixels through a folded transform, by pixels or by tiles.

By pixels it is a join on a computed key, made of built-in expressions. By tiles each output tile's source rectangle is found
from its four corners, the tiles that it touches by their numbers (an equality join in place of a range join), and a
task interpolates one output tile from those. What lies outside the source is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.transforms import Sequence, mapped, read_sequence
from .shapes import map_points, mapped_boxes

TILES = "image_id string, channel int, ty int, tx int, y0 long, x0 long, h int, w int, dtype string, data binary"


def grid(spark: SparkSession, w: int, h: int) -> DataFrame:
    """The output's pixels (y, x), made by range: no shuffle."""
    return spark.range(w * h).select(F.floor(F.col("id") / w).alias("y"), (F.col("id") % w).alias("x"))


def nearest(source: DataFrame, size: tuple[int, int], matrix: np.ndarray) -> DataFrame:
    """Resamples source (y, x, v) on an output of size (w, h): matrix maps output pixels to source pixels. The nearest pixel is floor(s + 1/2)."""
    x, y = mapped(F.col("x").cast("double"), F.col("y").cast("double"), matrix)
    wanted = grid(source.sparkSession, *size).withColumns({"sx": F.floor(F.round(x, 9) + 0.5), "sy": F.floor(F.round(y, 9) + 0.5)})
    found = source.select(F.col("y").cast("long").alias("sy"), F.col("x").cast("long").alias("sx"), "v")
    return wanted.join(found, ["sy", "sx"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def tile_index(spark: SparkSession, w: int, h: int, tile: int) -> DataFrame:
    """A regular grid of tiles over the output; the last ones are cut at its edge."""
    nx, ny = -(-w // tile), -(-h // tile)
    t = spark.range(nx * ny).select(F.floor(F.col("id") / nx).cast("int").alias("ty"), (F.col("id") % nx).cast("int").alias("tx"))
    return t.select("ty", "tx", (F.col("ty") * tile).alias("y0"), (F.col("tx") * tile).alias("x0"), F.least(F.lit(tile), F.lit(h) - F.col("ty") * tile).alias("h"), F.least(F.lit(tile), F.lit(w) - F.col("tx") * tile).alias("w"))


def source_tiles(index: DataFrame, matrix: np.ndarray, size: tuple[int, int], tile: int, halo: int = 2) -> DataFrame:
    """(ty, tx, sy, sx): the source tiles that each output tile needs, from the box of its four mapped corners and a halo; none where it lies outside."""
    corners = [mapped((F.col("x0") + dx * (F.col("w") - 1)).cast("double"), (F.col("y0") + dy * (F.col("h") - 1)).cast("double"), matrix) for dx in (0, 1) for dy in (0, 1)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    box = index.select("ty", "tx", (F.floor(F.least(*xs)) - halo).alias("ax"), (F.ceil(F.greatest(*xs)) + halo).alias("bx"), (F.floor(F.least(*ys)) - halo).alias("ay"), (F.ceil(F.greatest(*ys)) + halo).alias("by"))
    return tiles_in(box, size, tile)


def spline_boxes(index: DataFrame, sequence: Sequence, source_res: float, halo: int = 2) -> DataFrame:
    """(ty, tx, ax, bx, ay, by): the source box of each output tile through a sequence with B-splines, from bounds on their coefficients."""

    def run(batches):
        for batch in batches:
            ty, tx, y0, x0, h, w = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ty", "tx", "y0", "x0", "h", "w"))
            low, high = mapped_boxes(sequence, np.column_stack([x0, y0]) * sequence.spacing, np.column_stack([x0 + w - 1, y0 + h - 1]) * sequence.spacing)
            a, b = np.floor(low / source_res).astype(np.int64) - halo, np.ceil(high / source_res).astype(np.int64) + halo
            yield pa.RecordBatch.from_arrays([pa.array(ty.astype(np.int32)), pa.array(tx.astype(np.int32)), *map(pa.array, (a[:, 0], b[:, 0], a[:, 1], b[:, 1]))], ["ty", "tx", "ax", "bx", "ay", "by"])

    return index.mapInArrow(run, "ty int, tx int, ax long, bx long, ay long, by long")


def tiles_in(box: DataFrame, size: tuple[int, int], tile: int) -> DataFrame:
    """(ty, tx, sy, sx): the tiles of a source of size (w, h) that each box meets."""
    w, h = size
    inside = box.filter((F.col("bx") >= 0) & (F.col("by") >= 0) & (F.col("ax") < w) & (F.col("ay") < h))
    tiles = lambda a, b, n: F.sequence(F.floor(F.greatest(F.col(a), F.lit(0)) / tile).cast("int"), F.floor(F.least(F.col(b), F.lit(n - 1)) / tile).cast("int"))
    return inside.withColumn("sy", F.explode(tiles("ay", "by", h))).withColumn("sx", F.explode(tiles("ax", "bx", w))).select("ty", "tx", "sy", "sx")


def interpolate(plane: np.ndarray, origin: tuple[int, int], p: np.ndarray, size: tuple[int, int], kind: str) -> np.ndarray:
    """Values at source points p (x, y) from a plane whose corner lies at origin (x, y) of a source of size (w, h); 0 outside."""
    w, h = size
    p = np.round(p, 9)
    inside = (p[:, 0] >= -0.5) & (p[:, 0] < w - 0.5) & (p[:, 1] >= -0.5) & (p[:, 1] < h - 0.5)
    at = lambda x, y: plane[np.clip(y - origin[1], 0, plane.shape[0] - 1), np.clip(x - origin[0], 0, plane.shape[1] - 1)].astype(float)
    if kind == "nearest":
        n = np.floor(p + 0.5).astype(np.int64)
        return np.where(inside, at(n[:, 0], n[:, 1]), 0.0)
    q = np.clip(p, 0, [w - 1, h - 1])
    n = np.floor(q).astype(np.int64)
    f = q - n
    m = np.minimum(n + 1, [w - 1, h - 1])
    top = at(n[:, 0], n[:, 1]) * (1 - f[:, 0]) + at(m[:, 0], n[:, 1]) * f[:, 0]
    low = at(n[:, 0], m[:, 1]) * (1 - f[:, 0]) + at(m[:, 0], m[:, 1]) * f[:, 0]
    return np.where(inside, top * (1 - f[:, 1]) + low * f[:, 1], 0.0)


#: Side of the blocks that pixels as rows are packed to before larger tiles are put together from them.
BLOCK = 512


def to_tiles(pixels: DataFrame, tile: int, dtype: str = "float64") -> DataFrame:
    """Pixels (image_id, channel, y, x, v) as tiles; pixels that are missing are 0. Rows are packed by blocks, so that a task holds a block's rows and no more than a tile's bytes."""
    side = min(tile, BLOCK)

    def made(head: pa.Table, at: tuple[int, int], corner: tuple[int, int], data: np.ndarray) -> pa.Table:
        one = lambda v, t: pa.array([v], t)
        told = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, data.nbytes], np.int32)), pa.py_buffer(data)])
        return pa.table({"image_id": head.column("image_id").slice(0, 1), "channel": head.column("channel").slice(0, 1), "ty": one(at[0], pa.int32()), "tx": one(at[1], pa.int32()), "y0": one(corner[0], pa.int64()), "x0": one(corner[1], pa.int64()), "h": one(data.shape[0], pa.int32()), "w": one(data.shape[1], pa.int32()), "dtype": one(dtype, pa.string()), "data": told})

    def pack(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy().astype(np.int64) for c in "yx")
        at = int(y[0] // tile), int(x[0] // tile)
        y0, x0 = (k * tile + int(v[0] - k * tile) // side * side for k, v in zip(at, (y, x), strict=True))
        data = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), dtype)
        data[y - y0, x - x0] = table.column("v").to_numpy()
        return made(table, at, (y0, x0), data)

    def join(table: pa.Table) -> pa.Table:
        y, x, h, w = (table.column(c).to_numpy().astype(np.int64) for c in ("y0", "x0", "h", "w"))
        at = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        corner = at[0] * tile, at[1] * tile
        data, blocks = np.zeros((int((y + h).max()) - corner[0], int((x + w).max()) - corner[1]), dtype), table.column("data")
        for k, (v, u) in enumerate(zip(y - corner[0], x - corner[1], strict=True)):
            data[v : v + h[k], u : u + w[k]] = np.frombuffer(blocks[k].as_buffer(), dtype).reshape(h[k], w[k])
        return made(table, at, corner, data)

    own = pixels.select("image_id", F.col("channel").cast("int").alias("channel"), "y", "x", F.col("v").cast("double").alias("v"))
    blocks = [F.floor(F.pmod(c, F.lit(tile)) / side) for c in "yx"] if tile > side else []
    packed = own.groupBy("image_id", "channel", F.floor(F.col("y") / tile), F.floor(F.col("x") / tile), *blocks).applyInArrow(pack, TILES)
    return packed.groupBy("image_id", "channel", "ty", "tx").applyInArrow(join, TILES) if blocks else packed


def to_pixels(tiles: DataFrame) -> DataFrame:
    def unpack(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = r["h"] * r["w"]
                k = np.arange(n)
                yield pa.RecordBatch.from_arrays([pa.array([r["image_id"]] * n), pa.array(np.full(n, r["channel"], np.int32)), pa.array(r["y0"] + k // r["w"]), pa.array(r["x0"] + k % r["w"]), pa.array(np.frombuffer(r["data"], r["dtype"]).astype(float))], ["image_id", "channel", "y", "x", "v"])

    return tiles.mapInArrow(unpack, "image_id string, channel int, y long, x long, v double")


def resample_tiles(tiles: DataFrame, source_size: tuple[int, int], sequence: Sequence, source_res: float, tile: int, kind: str = "nearest") -> DataFrame:
    """Output tiles of every channel on the sequence's grid. An output tile that nothing reaches isn't made."""
    (w, h), spacing = sequence.size, sequence.spacing
    spark = tiles.sparkSession
    index = tile_index(spark, w, h, tile)
    m = None
    if sequence.linear:
        m = np.diag([1 / source_res, 1 / source_res, 1]) @ sequence.composite() @ np.diag([spacing[0], spacing[1], 1])
        needs = source_tiles(index, m, source_size, tile).join(index, ["ty", "tx"])
    else:
        needs = tiles_in(spline_boxes(index, sequence, source_res), source_size, tile).join(index, ["ty", "tx"])
    given = tiles.select("image_id", "channel", F.col("ty").alias("sy"), F.col("tx").alias("sx"), F.col("y0").alias("py"), F.col("x0").alias("px"), F.col("h").alias("ph"), F.col("w").alias("pw"), "dtype", "data")

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r = rows[0]
        ax, ay = min(p["px"] for p in rows), min(p["py"] for p in rows)
        plane = np.zeros((max(p["py"] + p["ph"] for p in rows) - ay, max(p["px"] + p["pw"] for p in rows) - ax), r["dtype"])
        for p in rows:
            plane[p["py"] - ay : p["py"] - ay + p["ph"], p["px"] - ax : p["px"] - ax + p["pw"]] = np.frombuffer(p["data"], p["dtype"]).reshape(p["ph"], p["pw"])
        y, x = np.mgrid[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]]
        p = np.column_stack([x.ravel(), y.ravel()]).astype(float)
        p = p @ m[:2, :2].T + m[:2, 2] if m is not None else map_points(sequence, p * spacing) / source_res
        out = interpolate(plane, (ax, ay), p, source_size, kind)
        out = out.astype(r["dtype"]) if r["dtype"].startswith("float") else np.floor(out + (0.5 if kind == "linear" else 0)).astype(r["dtype"])
        one = lambda v, t: pa.array([v], t)
        return pa.table({"image_id": one(r["image_id"], pa.string()), "channel": one(r["channel"], pa.int32()), "ty": one(r["ty"], pa.int32()), "tx": one(r["tx"], pa.int32()), "y0": one(r["y0"], pa.int64()), "x0": one(r["x0"], pa.int64()), "h": one(r["h"], pa.int32()), "w": one(r["w"], pa.int32()), "dtype": one(r["dtype"], pa.string()), "data": one(out.tobytes(), pa.binary())})

    joined = needs.join(given, ["sy", "sx"])
    return joined.groupBy("image_id", "channel", "ty", "tx").applyInArrow(run, TILES)


def resample_plane(plane: np.ndarray, sequence: Sequence, source_res: float, kind: str = "nearest") -> np.ndarray:
    """A whole plane in one task, through any sequence."""
    w, h = sequence.size
    y, x = np.mgrid[0:h, 0:w]
    p = np.column_stack([x.ravel() * sequence.spacing[0], y.ravel() * sequence.spacing[1]]).astype(float)
    p = map_points(sequence, p) / source_res
    return interpolate(plane, (0, 0), p, plane.shape[::-1], kind).reshape(h, w)


def transform_image(tiles: DataFrame, source_size: tuple[int, int], transforms, source_res: float, tile: int = 512, kind: str = "nearest") -> DataFrame:
    """All channels of an image, colours too, through a sequence, transform JSON, or a list of key-to-values maps that count as one group."""
    return resample_tiles(tiles, source_size, sequence_of(transforms), source_res, tile, kind)


def sequence_of(transforms) -> Sequence:
    if isinstance(transforms, Sequence):
        return transforms
    return read_sequence({"all": transforms} if isinstance(transforms, list) else transforms)
