"""Images of several formats by one entry: TIFF, CZI, PNG, .npy, chunked directories, the engine's own tiles, and arrays at hand.

`info` reads what a file says of its image, `read` its tiles. TIFF, CZI and .npy are sought by tiles or blocks in the tasks; a PNG
is one stream, so it is decoded whole, in one task.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes
from ..operators.pixels import threshold_mask, whole
from ..operators.resample import to_pixels
from . import images
from .images import ARROW, NAMES, TILES, Info, opened, reader
from .text import read_geojson


def suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def info(spark: SparkSession, source) -> Info:
    """Size, channels, type and colours of an image: a path, or an array (y, x), (channel, y, x) or (y, x, 3 or 4)."""
    if isinstance(source, np.ndarray):
        a, rgb = channels_first(source)
        return Info((a.shape[2], a.shape[1]), a.shape[0], str(a.dtype), rgb)
    kind = suffix(source)
    if kind in ("tif", "tiff"):
        return images.tiff_info(source)
    if kind == "czi":
        return czi_info(source)
    if kind == "png":
        return png_info(reader(source)(0, 33))
    if kind == "npy":
        shape, dtype, _ = npy_head(reader(source))
        rgb = is_rgb(shape)
        h, w, c = (*shape[:2], shape[2]) if rgb else (*shape[-2:], shape[0] if len(shape) == 3 else 1)
        return Info((w, h), c, str(dtype), rgb)
    if kind in ("zarr", "tiles"):
        df = images.read_chunks(spark, source) if kind == "zarr" else images.read_tiles(spark, source).filter("level = 0")
        r = df.agg(F.max(F.col("x0") + F.col("w")).alias("w"), F.max(F.col("y0") + F.col("h")).alias("h"), (F.max("channel") + 1).alias("c"), F.first("dtype").alias("dtype")).first()
        return Info((int(r["w"]), int(r["h"])), int(r["c"]), r["dtype"])
    raise ValueError(f"{source}: no reader for .{kind}")


def read(spark: SparkSession, source, name: str | None = None, tile: int = 512, level: int = 0, channel: int | None = None) -> DataFrame:
    """One level of an image as tiles, of all channels or one; a channel that isn't there gives the first."""
    found = info(spark, source)
    if channel is not None and channel >= found.channels:
        channel = 0
    kind = "" if isinstance(source, np.ndarray) else suffix(source)
    if level and kind not in ("tif", "tiff", "zarr", "tiles"):
        raise ValueError(f"{source}: only one level")
    if isinstance(source, np.ndarray):
        out = from_array(spark, source, tile)
    elif kind in ("tif", "tiff"):
        out = images.read_tiff(spark, source, level, channel)
    elif kind == "czi":
        out = read_czi(spark, source, channel)
    elif kind == "png":
        out = read_png(spark, source, tile)
    elif kind == "npy":
        out = read_npy(spark, source, tile)
    else:
        out = images.read_chunks(spark, source, level) if kind == "zarr" else images.read_tiles(spark, source).filter(F.col("level") == level)
    out = out if channel is None else out.filter(F.col("channel") == channel)
    return out if name is None else out.withColumn("image_id", F.lit(name))


#: Suffixes of files of shapes.
SHAPES = ("json", "geojson", "zip")


def read_mask(spark: SparkSession, source, size: tuple[int, int], name: str = "mask") -> DataFrame:
    """A mask's pixels (image_id, channel, y, x, v), 1 within it and 0 without: an image, an array, or a file of shapes that are filled on a raster of size (w, h)."""
    if isinstance(source, str) and suffix(source) in SHAPES:
        drawn = shapes.rasterise(read_geojson(spark, source).withColumn("set_name", F.lit(name)), size, labels=False)
        named = drawn.select(F.lit(name).alias("image_id"), F.lit(0).alias("channel"), "y", "x", F.lit(1.0).alias("v"))
        return whole(named, *size)
    pixels = to_pixels(read(spark, source, name, channel=0))
    return pixels.withColumn("v", threshold_mask(F.col("v")).cast("double"))


# --- arrays


def is_rgb(shape: tuple[int, ...]) -> bool:
    """Three axes whose last is shorter than five."""
    return len(shape) == 3 and shape[-1] < 5


def channels_first(a: np.ndarray) -> tuple[np.ndarray, bool]:
    """(channel, y, x), and whether the channels are colours that stood last."""
    if a.ndim == 2:
        return a[None], False
    if a.ndim != 3:
        raise ValueError(f"an image has two or three axes, not {a.ndim}")
    return (np.moveaxis(a, -1, 0), True) if is_rgb(a.shape) else (a, False)


def cuts(w: int, h: int, tile: int) -> list[tuple[int, int, int, int, int, int]]:
    """(ty, tx, y0, x0, h, w) of a grid of tiles."""
    return [(y // tile, x // tile, y, x, min(tile, h - y), min(tile, w - x)) for y in range(0, h, tile) for x in range(0, w, tile)]


def from_array(spark: SparkSession, a: np.ndarray, tile: int = 512, name: str = "array") -> DataFrame:
    """An array that the driver holds, sent out by tiles."""
    a, _ = channels_first(a)
    rows = [(name, 0, c, ty, tx, y, x, h, w, str(a.dtype), bytearray(np.ascontiguousarray(a[c, y : y + h, x : x + w]).tobytes())) for c in range(len(a)) for ty, tx, y, x, h, w in cuts(a.shape[2], a.shape[1], tile)]
    return spark.createDataFrame(rows, TILES)


def _row(name: str, channel: int, ty: int, tx: int, y0: int, x0: int, block: np.ndarray) -> pa.RecordBatch:
    block = np.ascontiguousarray(block).astype(block.dtype.newbyteorder("="))
    return pa.RecordBatch.from_pylist([dict(zip(NAMES, (name, 0, channel, ty, tx, y0, x0, *block.shape, str(block.dtype), block.tobytes()), strict=True))], ARROW)


def _named(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]


# --- .npy


def npy_head(read) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the values begin) of an array file in C order."""
    head = io.BytesIO(read(0, 1 << 12))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran or dtype.hasobject:
        raise ValueError("only arrays of numbers in C order are read")
    return shape, dtype, head.tell()


def read_npy(spark: SparkSession, path: str, tile: int) -> DataFrame:
    """An array file as tiles; a task seeks the rows of its strip of tiles and no others."""
    shape, dtype, begin = npy_head(reader(path))
    rgb = is_rgb(shape)
    h, w, channels = (*shape[:2], shape[2]) if rgb else (*shape[-2:], shape[0] if len(shape) == 3 else 1)
    strips = [(c, y) for c in range(1 if rgb else channels) for y in range(0, h, tile)]
    width = w * (channels if rgb else 1) * dtype.itemsize
    code, name = dtype.str, _named(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = opened(path)
        file = system.open_input_file(where)
        for batch in batches:
            for r in batch.to_pylist():
                n = min(tile, h - r["y"])
                strip = np.frombuffer(file.read_at(n * width, begin + (r["c"] * h + r["y"]) * width), code).reshape(n, w, -1)
                for x in range(0, w, tile):
                    for c in range(strip.shape[2]):
                        yield _row(name, r["c"] + c, r["y"] // tile, x // tile, r["y"], x, strip[:, x : x + tile, c])

    return spark.createDataFrame(strips, "c int, y long").repartition(max(len(strips) // 4, 1)).mapInArrow(run, TILES)


# --- PNG

#: Samples a pixel by colour type.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_info(head: bytes) -> Info:
    if head[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head[16:29])
    if interlaced or depth not in (8, 16):
        raise ValueError("only PNGs of 8 or 16 bits without interlacing are read")
    # alpha is left out; a palette gives colours
    colours = 3 if kind in (2, 3, 6) else 1
    return Info((w, h), colours, f"uint{depth}", colours == 3)


def png_array(raw: bytes) -> np.ndarray:
    """(y, x, channel) of a PNG, without alpha."""
    told = png_info(raw)
    w, h = told.size
    depth, kind = raw[24], raw[25]
    at, data, palette = 8, b"", None
    while at < len(raw):
        n, tag = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        data += body if tag == b"IDAT" else b""
        palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if tag == b"PLTE" else palette
        at += 12 + n
    step = PNG_SAMPLES[kind] * depth // 8
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * step)
    out = np.zeros((h + 1, w * step + step), np.uint8)  # a row above and a pixel before, of zeros
    for y in range(h):
        how, line, above = lines[y, 0], lines[y, 1:], out[y]
        row = out[y + 1]
        if how == 0:
            row[step:] = line
        elif how == 1:
            row[step:] = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            row[step:] = line + above[step:]
        else:
            # each byte leans on the one before it
            for k in range(step, len(row)):
                left, up, corner = int(row[k - step]), int(above[k]), int(above[k - step])
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[k] = (int(line[k - step]) + guess) & 255
    pixels = np.ascontiguousarray(out[1:, step:]).view(">u2" if depth == 16 else np.uint8).reshape(h, w, PNG_SAMPLES[kind])
    if kind == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, : told.channels].astype(told.dtype)


def read_png(spark: SparkSession, path: str, tile: int) -> DataFrame:
    name = _named(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                a = png_array(raw)
                for ty, tx, y, x, h, w in cuts(a.shape[1], a.shape[0], tile):
                    for c in range(a.shape[2]):
                        yield _row(name, c, ty, tx, y, x, a[y : y + h, x : x + w, c])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, TILES)


# --- CZI

#: Fixed values of the public format: pixel types as (samples, type), their samples blue first; compressions that are read.
CZI_PIXELS = {0: (1, "uint8"), 1: (1, "uint16"), 2: (1, "float32"), 3: (3, "uint8"), 4: (3, "uint16")}
CZI_PLAIN, CZI_ZSTD0, CZI_ZSTD1 = 0, 5, 6


@dataclass(frozen=True)
class Block:
    """A sub-block of a CZI file: where it lies and which part of the mosaic it holds, at full size."""

    place: int
    pixel: int
    compression: int
    start: dict
    size: dict
    stored: dict

    @property
    def full(self) -> bool:
        return all(self.size[d] == self.stored[d] for d in "XY")


def czi_blocks(path: str) -> list[Block]:
    """The file's directory of sub-blocks."""
    read = reader(path)
    if read(0, 10) != b"ZISRAWFILE":
        raise ValueError(f"{path}: not a CZI file")
    # after a segment's 32 bytes: versions, two numbers left free, two identifiers, the part, and where the directory is
    directory = struct.unpack("<q", read(32 + 52, 8))[0]
    count = struct.unpack("<i", read(directory + 32, 4))[0]
    at, out = directory + 32 + 128, []
    for _ in range(count):
        _, pixel, place, _, compression, _, _, n = struct.unpack("<2siqiiB5si", read(at, 32))
        dims = [struct.unpack("<4siifi", read(at + 32 + 20 * k, 20)) for k in range(n)]
        name = [d[0].rstrip(b"\0").decode() for d in dims]
        out.append(Block(place, pixel, compression, dict(zip(name, (d[1] for d in dims), strict=True)), dict(zip(name, (d[2] for d in dims), strict=True)), dict(zip(name, (d[4] or d[2] for d in dims), strict=True))))
        at += 32 + 20 * n
    return out


def _mosaic(blocks: list[Block]) -> tuple[list[Block], int, int]:
    """The blocks of the full size, of the first scene, time and depth, and the mosaic's corner."""
    full = [b for b in blocks if b.full and all(b.start.get(d, 0) == min(x.start.get(d, 0) for x in blocks) for d in "STZ")]
    if not full:
        raise ValueError("no sub-blocks of the full size")
    return full, min(b.start["X"] for b in full), min(b.start["Y"] for b in full)


def czi_info(path: str) -> Info:
    full, x, y = _mosaic(czi_blocks(path))
    if full[0].pixel not in CZI_PIXELS:
        raise ValueError(f"{path}: pixel type {full[0].pixel} isn't read")
    samples, dtype = CZI_PIXELS[full[0].pixel]
    w, h = (max(b.start[d] + b.size[d] for b in full) - low for d, low in (("X", x), ("Y", y)))
    channels = samples if samples == 3 else 1 + max(b.start.get("C", 0) for b in full)
    return Info((w, h), channels, dtype, samples == 3)


def czi_plane(raw: bytes, compression: int, shape: tuple[int, int, int], dtype: str) -> np.ndarray:
    if compression in (CZI_ZSTD0, CZI_ZSTD1):
        import zstandard

        head, packed = 0, False
        if compression == CZI_ZSTD1:
            # a short head: its length, then whether the low and high bytes stand apart
            head = raw[0]
            packed = head == 3 and bool(raw[2] & 1)
        raw = zstandard.ZstdDecompressor().decompress(raw[head:], max_output_size=int(np.prod(shape)) * np.dtype(dtype).itemsize)
        if packed:
            raw = np.frombuffer(raw, np.uint8).reshape(2, -1).T.tobytes()
    elif compression != CZI_PLAIN:
        raise ValueError(f"compression {compression} isn't supported")
    return np.frombuffer(raw, np.dtype(dtype).newbyteorder("<"), int(np.prod(shape))).reshape(shape)


def read_czi(spark: SparkSession, path: str, channel: int | None = None, greyscale: bool = False) -> DataFrame:
    """The mosaic's sub-blocks as tiles, one a task's turn; where blocks overlap, the later one covers the earlier, as they are dealt to tiles by what isn't covered.

    Tiles are numbered in the order of the directory, as a mosaic needs no grid: they are for to_pixels() and retiled(). greyscale: of
    colours one grey channel, weighted as grayscale() does.
    """
    full, x, y = _mosaic(czi_blocks(path))
    told, name = czi_info(path), _named(path)
    # later blocks of a channel lie over earlier ones: the order is kept as the tile's number
    rows = [(k, b.place, b.pixel, b.compression, b.start.get("C", 0), b.start["Y"] - y, b.start["X"] - x, b.size["Y"], b.size["X"]) for k, b in enumerate(full) if channel is None or told.rgb or b.start.get("C", 0) == channel]
    parts = spark.createDataFrame(rows, "k int, place long, pixel int, compression int, c int, y long, x long, h int, w int").repartition(max(-(-len(rows) // 8), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = opened(path)
        file = system.open_input_file(where)
        for batch in batches:
            for r in batch.to_pylist():
                metadata, _, n = struct.unpack("<iiq", file.read_at(16, r["place"] + 32))
                dims = struct.unpack("<i", file.read_at(4, r["place"] + 32 + 16 + 28))[0]
                data = r["place"] + 32 + max(256, 16 + 32 + 20 * dims) + metadata
                samples, dtype = CZI_PIXELS[r["pixel"]]
                plane = czi_plane(file.read_at(n, data), r["compression"], (r["h"], r["w"], samples), dtype)
                if samples == 3:
                    plane = plane[:, :, ::-1]
                    if greyscale:
                        from ..operators.pixels import GREY

                        yield _row(name, 0, r["k"], 0, r["y"], r["x"], sum(np.floor(plane[:, :, c] * GREY[c]) for c in range(3)).astype(dtype))
                        continue
                for c in range(samples):
                    if channel is None or r["c"] + c == channel:
                        yield _row(name, r["c"] + c, r["k"], 0, r["y"], r["x"], plane[:, :, c])

    return parts.mapInArrow(run, TILES)


def retiled(tiles: DataFrame, tile: int) -> DataFrame:
    """Tiles of any sizes and places as those of a grid. Where they overlap, the one of the larger number covers the other."""
    cut = lambda a, n: F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / tile).cast("int"))
    met = tiles.withColumnRenamed("ty", "_k").withColumnRenamed("tx", "_l").withColumn("ty", F.explode(cut("y0", "h"))).withColumn("tx", F.explode(cut("x0", "w")))

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("_k", "ascending"), ("_l", "ascending")]).to_pylist()
        r = rows[0]
        y0, x0 = r["ty"] * tile, r["tx"] * tile
        h, w = (min(tile, max(p[a] + p[n] for p in rows) - low) for a, n, low in (("y0", "h", y0), ("x0", "w", x0)))
        out = np.zeros((h, w), r["dtype"])
        for p in rows:
            block = np.frombuffer(p["data"], p["dtype"]).reshape(p["h"], p["w"])
            top, left = max(p["y0"], y0), max(p["x0"], x0)
            part = block[top - p["y0"] : y0 + h - p["y0"], left - p["x0"] : x0 + w - p["x0"]]
            out[top - y0 : top - y0 + part.shape[0], left - x0 : left - x0 + part.shape[1]] = part
        row = (r["image_id"], r["level"], r["channel"], r["ty"], r["tx"], y0, x0, h, w, r["dtype"], out.tobytes())
        return pa.Table.from_pylist([dict(zip(NAMES, row, strict=True))], ARROW)

    return met.groupBy("image_id", "level", "channel", "ty", "tx").applyInArrow(run, TILES)
