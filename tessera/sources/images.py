"""Image sources and sinks as tile tables: TIFF in tiles or strips with deflate, LZW or no compression and pyramids, and chunked directories.

Reading a file needs its directory alone on the driver's side; each task then seeks and decodes its own tiles. Writing compresses
tiles in tasks; a TIFF's are appended by the driver one after the other, a chunked directory's are files that tasks write.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pixels import pyramid_sizes

TILES = "image_id string, level int, channel int, ty int, tx int, y0 long, x0 long, h int, w int, dtype string, data binary"
NAMES = [x.split()[0] for x in TILES.split(", ")]
#: Sizes of TIFF field types, and the tags that are read and written.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8, 18: 8}
CODES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 18: "Q"}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, SAMPLES, PLANAR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SUB_IFDS, FORMAT = 256, 257, 258, 259, 262, 270, 277, 284, 322, 323, 324, 325, 330, 339
STRIP_OFFSETS, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 273, 278, 279, 317


def directories(read) -> list[dict]:
    """The file's image directories in order; each has its tags, and the reduced levels under "levels". read(offset, n): bytes of the file."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]

    def one(at: int) -> tuple[dict, int]:
        count = struct.unpack(order + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
        at += 8 if big else 2
        entry = 20 if big else 12
        table = read(at, count * entry + (8 if big else 4))
        tags: dict = {"order": order}
        for k in range(count):
            base = k * entry
            tag, kind = struct.unpack_from(order + "HH", table, base)
            n = struct.unpack_from(order + ("Q" if big else "I"), table, base + 4)[0]
            place, room = base + (12 if big else 8), 8 if big else 4
            if kind not in CODES:
                continue
            data = table[place : place + n * SIZES[kind]]
            if n * SIZES[kind] > room:
                data = read(struct.unpack_from(order + ("Q" if big else "I"), table, place)[0], n * SIZES[kind])
            tags[tag] = data if kind == 2 else struct.unpack(f"{order}{n}{CODES[kind]}", data)
        return tags, struct.unpack_from(order + ("Q" if big else "I"), table, count * entry)[0]

    out = []
    while at:
        tags, at = one(at)
        tags["levels"] = [one(x)[0] for x in tags.get(SUB_IFDS, ())]
        out.append(tags)
    return out


def opened(path: str):
    """(file system, path there) of a path or URI, in the driver or a task."""
    from pyarrow import fs

    # a plain path may hold what a URI may not
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def reader(path: str):
    """read(offset, n) of a file, in blocks kept for the next small reads."""
    system, where = opened(path)
    file, blocks = system.open_input_file(where), {}

    def read(offset: int, n: int) -> bytes:
        if n > BLOCK:
            return file.read_at(n, offset)
        out = b""
        for k in range(offset // BLOCK, (offset + n - 1) // BLOCK + 1):
            if k not in blocks:
                blocks[k] = file.read_at(min(BLOCK, max(file.size() - k * BLOCK, 0)), k * BLOCK)
            out += blocks[k]
        return out[offset % BLOCK : offset % BLOCK + n]

    return read


#: Bytes that a small read takes with it.
BLOCK = 1 << 16


def unpacked_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bits first, a code's width growing one code early; 256 clears, 257 ends."""
    out, at, width, bits, held = bytearray(), 0, 9, 0, 0
    table, last = [bytes([k]) for k in range(256)] + [b"", b""], b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out += word
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def dtype_of(tags: dict) -> str:
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    return f"{kind}{tags.get(BITS, (8,))[0] // 8}"


PARTS = "image_id string, level int, channel int, ty int, tx int, y0 long, x0 long, h int, w int, rows int, columns int, samples int, place long, bytes long, compression int, predictor int, code string"
#: The compressions that are read.
PLAIN, LZW, DEFLATE = 1, 5, (8, 32946)


def parts_of(page: dict, level: int, before: int, name: str) -> Iterator[tuple]:
    """A row of PARTS for each tile or strip of a page's level: where its bytes lie and what they hold. channel: its first one."""
    w, h, samples = page[WIDTH][0], page[LENGTH][0], page.get(SAMPLES, (1,))[0]
    tiled = TILE_OFFSETS in page
    tw, th = (page[TILE_WIDTH][0], page[TILE_LENGTH][0]) if tiled else (w, min(page.get(ROWS_PER_STRIP, (h,))[0], h))
    offsets, counts = (page[TILE_OFFSETS], page[TILE_COUNTS]) if tiled else (page[STRIP_OFFSETS], page[STRIP_COUNTS])
    planar = page.get(PLANAR, (1,))[0] == 2 and samples > 1
    nx, ny = -(-w // tw), -(-h // th)
    compression = page.get(COMPRESSION, (PLAIN,))[0]
    if compression not in (PLAIN, LZW, *DEFLATE):
        raise ValueError(f"{name}: compression {compression} isn't supported")
    for k, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, k = divmod(k, nx * ny)
        ty, tx = divmod(k, nx)
        y0, x0 = ty * th, tx * tw
        yield name, level, before + plane, ty, tx, y0, x0, min(th, h - y0), min(tw, w - x0), th if tiled else min(th, h - y0), tw, 1 if planar else samples, at, n, compression, page.get(PREDICTOR, (1,))[0], page["order"] + dtype_of(page)


def decoded(part: dict, data: bytes) -> np.ndarray:
    """(y, x, sample) of a part, cut to the image."""
    if part["compression"] == LZW:
        data = unpacked_lzw(data)
    elif part["compression"] != PLAIN:
        data = zlib.decompress(data)
    shape = part["rows"], part["columns"], part["samples"]
    tile = np.frombuffer(data, part["code"], int(np.prod(shape))).reshape(shape)
    if part["predictor"] == 2:
        tile = np.cumsum(tile, axis=1, dtype=tile.dtype)
    tile = tile[: part["h"], : part["w"]]
    return np.ascontiguousarray(tile).astype(tile.dtype.newbyteorder("="))


def series_of(pages: list[dict]) -> list[dict]:
    """The largest series: the pages as large as the first of the largest ones."""
    most = max(p[WIDTH][0] * p[LENGTH][0] for p in pages)
    first = next(p for p in pages if p[WIDTH][0] * p[LENGTH][0] == most)
    return [p for p in pages if (p[WIDTH], p[LENGTH]) == (first[WIDTH], first[LENGTH])]


def largest_series(pages: DataFrame, key: str, place: str, size: str) -> DataFrame:
    """(key, largest, n): of each file's pages the place of the largest, the first of equals, and how many there are."""
    return pages.groupBy(key).agg(F.max_by(place, F.struct(size, -F.col(place))).alias("largest"), F.count("*").alias("n"))


def files_at(path: str) -> list[str]:
    """The file, or the TIFF files right in a folder, by name."""
    from pyarrow import fs

    system, where = opened(path)
    if system.get_file_info(where).type != fs.FileType.Directory:
        return [path]
    found = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(where)) if f.base_name.lower().endswith((".tif", ".tiff")))
    return [f"{path.rstrip('/')}/{name}" for name in found]


def read_tiff(spark: SparkSession, path: str, level: int | None = None, channel: int | None = None) -> DataFrame:
    """Levels and channels of the TIFF files at the path as tiles; pages of equal size are channels.

    The driver reads the files' directories alone, and tasks then seek the tiles that they decode: of a level or channel, where one is
    asked for, no others are read. The files must be where both driver and tasks can open them; those of a store that only Spark
    opens are read whole, each by one task (decode_files).
    """
    if "://" in path and path.split("://")[0] not in SEEKING:
        return decode_files(spark.read.format("binaryFile").load(path).select("path", "content"), level, channel)
    rows = []
    for file in files_at(path):
        name, before = _stem(file), 0
        for page in series_of(directories(reader(file))):
            for k, tags in enumerate([page, *page["levels"]]):
                if level is None or k == level:
                    rows += [(file, *part) for part in parts_of(tags, k, before, name) if channel is None or part[2] <= channel < part[2] + part[11]]
            before += page.get(SAMPLES, (1,))[0]
    names = [x.split()[0] for x in PARTS.split(", ")]
    # some dozens of tiles a task
    parts = spark.createDataFrame(rows, "file string, " + PARTS).repartition(max(-(-len(rows) // 32), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict = {}
        for batch in batches:
            for part in batch.to_pylist():
                file = part.pop("file")
                if file not in readers:
                    system, where = opened(file)
                    readers[file] = system.open_input_file(where)
                tile = decoded(part, readers[file].read_at(part["bytes"], part["place"]))
                yield from tiles_of(part, tile, channel)

    return parts.mapInArrow(run, TILES)


#: Schemes that pyarrow's file systems open.
SEEKING = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def tiles_of(part: dict, tile: np.ndarray, channel: int | None) -> Iterator[pa.RecordBatch]:
    """A decoded part as rows of TILES, one for each of its channels that is asked for."""
    for c in range(part["samples"]):
        if channel is None or part["channel"] + c == channel:
            row = (part["image_id"], part["level"], part["channel"] + c, *(part[k] for k in ("ty", "tx", "y0", "x0", "h", "w")), str(tile.dtype), np.ascontiguousarray(tile[:, :, c]).tobytes())
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], ARROW)


def decode_files(files: DataFrame, level: int | None = None, channel: int | None = None) -> DataFrame:
    """TIFF files as rows (path, content) as tiles, each file in one task; content up to what a row can hold."""
    names = [x.split()[0] for x in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                raw, before = file["content"], 0
                for page in series_of(directories(lambda at, n, raw=raw: raw[at : at + n])):
                    for k, tags in enumerate([page, *page["levels"]]):
                        if level is None or k == level:
                            for row in parts_of(tags, k, before, _stem(file["path"])):
                                part = dict(zip(names, row, strict=True))
                                yield from tiles_of(part, decoded(part, raw[part["place"] : part["place"] + part["bytes"]]), channel)
                    before += page.get(SAMPLES, (1,))[0]

    return files.mapInArrow(run, TILES)


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".")[0]


@dataclass(frozen=True)
class Info:
    """What a file says of its image, without its pixels. levels: the sizes (w, h) from the full one down."""

    size: tuple[int, int]
    channels: int
    dtype: str
    rgb: bool = False
    levels: tuple[tuple[int, int], ...] = ()
    names: tuple[str, ...] = ()
    res: float | None = None


def xml_info(description: str) -> tuple[tuple[str, ...], float | None]:
    """(channel names, physical size of a pixel) from the description that goes with an image; nothing of another text."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(description)
    except ElementTree.ParseError:
        return (), None
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    found = [e for e in root.iter() if local(e) == "Pixels"][:1]
    names = tuple(c.get("Name") or "" for p in found for c in p if local(c) == "Channel")
    res = next((float(p.get("PhysicalSizeX")) for p in found if p.get("PhysicalSizeX")), None)
    return names if all(names) else (), res


def tiff_info(path: str) -> Info:
    pages = directories(reader(files_at(path)[0]))
    series = series_of(pages)
    first = series[0]
    samples = first.get(SAMPLES, (1,))[0]
    rgb = len(series) == 1 and samples in (3, 4) and first.get(PHOTOMETRIC, (1,))[0] == 2
    names, res = xml_info(pages[0].get(DESCRIPTION, b"").rstrip(b"\0").decode("utf-8", "replace"))
    channels = sum(p.get(SAMPLES, (1,))[0] for p in series)
    sizes = tuple((p[WIDTH][0], p[LENGTH][0]) for p in (first, *first["levels"]))
    return Info(sizes[0], channels, str(np.dtype(first["order"] + dtype_of(first)).newbyteorder("=")), rgb, sizes, names if len(names) == channels else (), res)


def is_rgb(spark: SparkSession, path: str) -> bool:
    """Whether the TIFF holds colours, three or four samples a pixel."""
    return tiff_info(path).rgb


ARROW = pa.schema([("image_id", pa.string()), *((n, pa.int32()) for n in ("level", "channel", "ty", "tx")), ("y0", pa.int64()), ("x0", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("dtype", pa.string()), ("data", pa.binary())])


def tiff_bytes(levels: list[np.ndarray], tile: int = 256, description: str = "", rgb: bool = False) -> bytes:
    """A pyramidal BigTIFF with deflated tiles. levels: (channel, y, x) arrays, or (y, x, 3) with rgb; a page for each channel, reduced levels as sub-directories."""
    out = io.BytesIO()
    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
    pages = [[lv] for lv in (levels[0],)] if rgb else [[lv[c] for lv in levels] for c in range(levels[0].shape[0])]
    if rgb:
        pages = [levels]
    link = 8

    def directory(plane: np.ndarray, sub: list[int], first: bool) -> int:
        h, w = plane.shape[:2]
        offsets, counts = [], []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                block = np.zeros((tile, tile, *plane.shape[2:]), plane.dtype)
                part = plane[y : y + tile, x : x + tile]
                block[: part.shape[0], : part.shape[1]] = part
                data = zlib.compress(block.astype(plane.dtype.newbyteorder("<")).tobytes(), 6)
                offsets.append(out.tell())
                counts.append(len(data))
                out.write(data)
        samples = plane.shape[2] if plane.ndim == 3 else 1
        entries = [
            (WIDTH, 4, [w]), (LENGTH, 4, [h]), (BITS, 3, [plane.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]),
            *([(DESCRIPTION, 2, description.encode() + b"\0")] if first and description else []), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]),
            (TILE_OFFSETS, 16, offsets), (TILE_COUNTS, 16, counts), *([(SUB_IFDS, 18, sub)] if sub else []), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[plane.dtype.kind]] * samples),
        ]
        body = []
        for tag, kind, values in sorted(entries):
            data = values if kind == 2 else struct.pack(f"<{len(values)}{CODES[kind]}", *values)
            if len(data) > 8:
                place = out.tell()
                out.write(data)
                data = struct.pack("<Q", place)
            body.append(struct.pack("<HHQ", tag, kind, len(values)) + data.ljust(8, b"\0"))
        at = out.tell()
        out.write(struct.pack("<Q", len(body)) + b"".join(body) + struct.pack("<Q", 0))
        return at

    for k, page in enumerate(pages):
        sub = [directory(level, [], False) for level in page[1:]]
        at = directory(page[0], sub, k == 0)
        end = out.tell()
        out.seek(link)
        out.write(struct.pack("<Q", at))
        link = end - 8
        out.seek(end)
    return out.getvalue()


def halved_tiles(tiles: DataFrame, w: int, h: int, tile: int) -> DataFrame:
    """The next level of tiles (without a level) of an image of size (w, h): means of 2 x 2 pixels as doubles; what fills no block is left out."""
    w, h = w // 2, h // 2

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ty, tx = rows[0]["ty"] // 2, rows[0]["tx"] // 2
        y0, x0 = ty * tile, tx * tile
        out = np.zeros((2 * min(tile, h - y0), 2 * min(tile, w - x0)))
        for r in rows:
            block = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"])
            y, x = r["y0"] - 2 * y0, r["x0"] - 2 * x0
            part = out[y : y + r["h"], x : x + r["w"]]
            part[:] = block[: part.shape[0], : part.shape[1]]
        out = (out[::2, ::2] + out[1::2, ::2] + out[::2, 1::2] + out[1::2, 1::2]) / 4
        row = (rows[0]["image_id"], rows[0]["channel"], ty, tx, y0, x0, *out.shape, "float64", out.tobytes())
        return pa.Table.from_pylist([dict(zip([n for n in NAMES if n != "level"], row, strict=True))], pa.schema([f for f in ARROW if f.name != "level"]))

    inside = tiles.filter((F.floor(F.col("ty") / 2) * tile < h) & (F.floor(F.col("tx") / 2) * tile < w))
    return inside.groupBy("image_id", "channel", F.floor(F.col("ty") / 2), F.floor(F.col("tx") / 2)).applyInArrow(run, ", ".join(x for x in TILES.split(", ") if x != "level int"))


def with_pyramid(tiles: DataFrame, w: int, h: int, tile: int) -> DataFrame:
    """Tiles of the full size (their own size `tile`) with those of all levels below: means of whole blocks of the full size, cut down to integers."""
    out, level = tiles.drop("level").withColumn("level", F.lit(0)).select(*NAMES), tiles.drop("level")
    for k, _ in enumerate(pyramid_sizes(w, h, tile)[1:], 1):
        level = halved_tiles(level, w >> (k - 1), h >> (k - 1), tile)
        out = out.unionByName(level.withColumn("level", F.lit(k)).select(*NAMES))
    return out


def compressed(tiles: DataFrame, tile: int, dtype: str, rgb: bool = False) -> DataFrame:
    """(level, channel, ty, tx, data): tiles filled up to full size, as the type that is written, deflated in the tasks; with rgb the three channels of a place together."""
    order = np.dtype(dtype).newbyteorder("<")
    whole = np.dtype(dtype).kind != "f"

    def block(r: dict) -> np.ndarray:
        out = np.zeros((tile, tile), order)
        own = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"])
        out[: r["h"], : r["w"]] = np.floor(np.round(own, 9)) if whole and own.dtype.kind == "f" else own
        return out

    schema = "level int, channel int, ty int, tx int, data binary"
    arrow = pa.schema([("level", pa.int32()), ("channel", pa.int32()), ("ty", pa.int32()), ("tx", pa.int32()), ("data", pa.binary())])
    if rgb:

        def three(table: pa.Table) -> pa.Table:
            rows = table.sort_by("channel").to_pylist()
            data = zlib.compress(np.stack([block(r) for r in rows[:3]], -1).tobytes(), 6)
            return pa.Table.from_pylist([{"level": rows[0]["level"], "channel": 0, "ty": rows[0]["ty"], "tx": rows[0]["tx"], "data": data}], arrow)

        return tiles.groupBy("level", "ty", "tx").applyInArrow(three, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("level", "channel", "ty", "tx")} | {"data": zlib.compress(block(r).tobytes(), 6)}], arrow)

    return tiles.mapInArrow(run, schema)


def write_tiff(tiles: DataFrame, path: str, size: tuple[int, int], channels: int, dtype: str, tile: int = 256, names: tuple[str, ...] = (), rgb: bool = False, res: float = 1.0, pyramid: bool = True) -> None:
    """Writes an image's tiles of the full size (without a level, of size `tile`) as a pyramidal BigTIFF. Tiles that are missing are 0.

    Tasks make the levels and compress them; the driver appends tile by tile in order, holding one and the places of all.
    """
    w, h = size
    tiles = tiles.drop("level")
    sizes = pyramid_sizes(w, h, tile) if pyramid else [(w, h)]
    ready = compressed(with_pyramid(tiles, w, h, tile) if pyramid else tiles.withColumn("level", F.lit(0)), tile, dtype, rgb)
    samples, pages = (3, 1) if rgb else (1, channels)
    empty = zlib.compress(bytes(tile * tile * samples * np.dtype(dtype).itemsize), 6)
    system, where = opened(path)
    with system.open_output_stream(where) as out:
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
        first = TiffPage(size, samples, np.dtype(dtype), tile, image_xml(h, w, list(names) or [f"C{k}" for k in range(channels)], str(np.dtype(dtype)), rgb, res), len(sizes) - 1)
        rest = [TiffPage(s, samples, np.dtype(dtype), tile, "", 0) for s in sizes[1:]]
        later = TiffPage(size, samples, np.dtype(dtype), tile, "", len(sizes) - 1)
        # every directory and its arrays have a fixed length, so all directories stand before the tiles and are written with their places at the end
        plan, at = [], 16
        for page in range(pages):
            own = [first if page == 0 else later, *rest]
            starts = []
            for d in own:
                starts.append(at)
                at += d.length
            plan.append((own, starts))
        body = at
        places: dict[tuple, tuple[int, int]] = {}
        data_at = body
        rows = ready.orderBy("channel", "level", "ty", "tx").toLocalIterator(prefetchPartitions=True)
        # tiles go to a file beside it first, as the directories with their places come before them
        with system.open_output_stream(where + ".tiles") as side:
            for r in rows:
                places[r["channel"], r["level"], r["ty"], r["tx"]] = (data_at, len(r["data"]))
                side.write(r["data"])
                data_at += len(r["data"])
            blank = (data_at, len(empty))
            side.write(empty)
        for page, (own, starts) in enumerate(plan):
            following = plan[page + 1][1][0] if page + 1 < pages else 0
            for level, (d, start) in enumerate(zip(own, starts, strict=True)):
                found = [places.get((page, level, ty, tx), blank) for ty in range(d.ny) for tx in range(d.nx)]
                out.write(d.packed(start, found, starts[1:] if level == 0 else [], following if level == 0 else 0))
        with system.open_input_stream(where + ".tiles") as side:
            while chunk := side.read(1 << 24):
                out.write(chunk)
    system.delete_file(where + ".tiles")


class TiffPage:
    """A directory of fixed length: its entries, then the arrays that they point at."""

    def __init__(self, size: tuple[int, int], samples: int, dtype: np.dtype, tile: int, description: str, levels: int):
        self.size, self.samples, self.dtype, self.tile = size, samples, dtype, tile
        self.description, self.levels = description.encode() + b"\0" if description else b"", levels
        self.nx, self.ny = -(-size[0] // tile), -(-size[1] // tile)
        self.length = len(self.packed(0, [(0, 0)] * (self.nx * self.ny), [0] * levels, 0))

    def packed(self, start: int, places: list[tuple[int, int]], sub: list[int], following: int) -> bytes:
        entries = [
            (WIDTH, 4, [self.size[0]]), (LENGTH, 4, [self.size[1]]), (BITS, 3, [self.dtype.itemsize * 8] * self.samples), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [2 if self.samples == 3 else 1]), *([(DESCRIPTION, 2, self.description)] if self.description else []),
            (SAMPLES, 3, [self.samples]), (PLANAR, 3, [1]), (TILE_WIDTH, 4, [self.tile]), (TILE_LENGTH, 4, [self.tile]), (TILE_OFFSETS, 16, [p for p, _ in places]), (TILE_COUNTS, 16, [n for _, n in places]), *([(SUB_IFDS, 18, sub)] if sub else []), (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[self.dtype.kind]] * self.samples),
        ]
        fixed = 8 + 20 * len(entries) + 8
        table, more = b"", b""
        for tag, kind, values in sorted(entries):
            data = values if kind == 2 else struct.pack(f"<{len(values)}{CODES[kind]}", *values)
            if len(data) > 8:
                place = start + fixed + len(more)
                more += data + b"\0" * (-len(data) % 8)
                data = struct.pack("<Q", place)
            table += struct.pack("<HHQ", tag, kind, len(values)) + data.ljust(8, b"\0")
        return struct.pack("<Q", len(entries)) + table + struct.pack("<Q", following) + more


def write_chunks(tiles: DataFrame, path: str, size: tuple[int, int], channels: int, dtype: str, tile: int, names: tuple[str, ...] = (), pyramid: bool = True, colors: tuple[str, ...] = ()) -> None:
    """Writes an image's tiles of the full size as a chunked directory with its levels and metadata. Each task writes the files of its own chunks; to write one again makes the same file."""
    w, h = size
    tiles = tiles.drop("level")
    sizes = pyramid_sizes(w, h, tile) if pyramid else [(w, h)]
    ready = compressed(with_pyramid(tiles, w, h, tile) if pyramid else tiles.withColumn("level", F.lit(0)), tile, dtype)
    system, where = opened(path)
    code = "|u1" if dtype == "uint8" else np.dtype(dtype).newbyteorder("<").str

    def write(system, name: str, data: bytes) -> None:
        with system.open_output_stream(f"{where}/{name}") as out:
            out.write(data)

    for k, (w_, h_) in enumerate(sizes):
        system.create_dir(f"{where}/{k}", recursive=True)
        write(system, f"{k}/.zarray", json.dumps({"zarr_format": 2, "shape": [channels, h_, w_], "chunks": [1, tile, tile], "dtype": code, "compressor": {"id": "zlib", "level": 6}, "fill_value": 0, "order": "C", "filters": None}).encode())
    write(system, ".zgroup", json.dumps({"zarr_format": 2}).encode())
    write(system, ".zattrs", multiscales(len(sizes), list(names) or [f"C{k}" for k in range(channels)], dtype, colors).encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = opened(path)
        for batch in batches:
            for r in batch.to_pylist():
                write(own, f"{r['level']}/{r['channel']}.{r['ty']}.{r['tx']}", r["data"])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["written"])

    ready.mapInArrow(run, "written long").agg(F.sum("written")).collect()


def read_chunks(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """One level of a chunked directory that write_chunks() made, as tiles."""
    system, where = opened(path)
    with system.open_input_stream(f"{where}/{level}/.zarray") as f:
        told = json.loads(f.read())
    (channels, h, w), tile, name = told["shape"], told["chunks"][1], path.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
    rows = [(c, ty, tx) for c in range(channels) for ty in range(-(-h // tile)) for tx in range(-(-w // tile))]
    parts = spark.createDataFrame(rows, "channel int, ty int, tx int").repartition(max(-(-len(rows) // 32), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        own, _ = opened(path)
        for batch in batches:
            for r in batch.to_pylist():
                file = f"{where}/{level}/{r['channel']}.{r['ty']}.{r['tx']}"
                if own.get_file_info(file).type == fs.FileType.NotFound:
                    continue
                with own.open_input_stream(file) as f:
                    block = np.frombuffer(zlib.decompress(f.read()), told["dtype"]).reshape(tile, tile)
                y0, x0 = r["ty"] * tile, r["tx"] * tile
                block = np.ascontiguousarray(block[: h - y0, : w - x0])
                row = (name, level, r["channel"], r["ty"], r["tx"], y0, x0, *block.shape, str(block.dtype.newbyteorder("=")), block.tobytes())
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row, strict=True))], ARROW)

    return parts.mapInArrow(run, TILES)


def planes(tiles: DataFrame, image_id: str, level: int = 0, size: tuple[int, int, int] | None = None) -> np.ndarray:
    """(channel, y, x) of one image's level, gathered on the driver; for images that fit there. size: its shape, if tiles may be missing, which are 0."""
    rows = tiles.filter((F.col("image_id") == image_id) & (F.col("level") == level)).collect()
    c, h, w = size or (max(x) for x in zip(*((r["channel"] + 1, r["y0"] + r["h"], r["x0"] + r["w"]) for r in rows), strict=True))
    out = np.zeros((c, h, w), rows[0]["dtype"])
    for r in rows:
        out[r["channel"], r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"])
    return out


def write_tiles(tiles: DataFrame, path: str) -> None:
    """The engine's own format: Parquet by level and channel, so that a read of one channel touches its files alone."""
    tiles.write.partitionBy("level", "channel").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TILES).parquet(path).select(*NAMES)


def image_xml(h: int, w: int, names: list[str], dtype: str, rgb: bool = False, spacing: float = 1.0) -> str:
    """The description that goes with a written image."""
    from xml.sax.saxutils import quoteattr

    channels = "".join(f'<Channel ID="Channel:0:{k}" Name={quoteattr(n)} SamplesPerPixel="{3 if rgb else 1}"/>' for k, n in enumerate(names))
    return f'<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image ID="Image:0"><Pixels ID="Pixels:0" DimensionOrder="XYCZT" Type="{dtype}" SizeX="{w}" SizeY="{h}" SizeC="{3 if rgb else len(names)}" SizeZ="1" SizeT="1" PhysicalSizeX="{spacing}" PhysicalSizeY="{spacing}">{channels}</Pixels></Image></OME>'


def multiscales(levels: int, names: list[str], dtype: str, colors: tuple[str, ...] = ()) -> str:
    """The metadata of a chunked group: its levels, and each channel's name, window and, if given, colour."""
    top = int(np.iinfo(dtype).max) if np.dtype(dtype).kind in "ui" else 1
    channels = [{"label": n, "window": {"start": 0, "end": top}} | ({"color": colors[k].lstrip("#")} if colors else {}) for k, n in enumerate(names)]
    return json.dumps({"multiscales": [{"version": "0.1", "datasets": [{"path": str(k)} for k in range(levels)]}], "omero": {"channels": channels}})
