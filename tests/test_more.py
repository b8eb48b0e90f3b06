"""Image formats, writers, non-linear alignment, masks, output rules and changes of shape sets and graphs."""

import io
import itertools
import json
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from tessera import cli, config, plots, queries, runner
from tessera.operators import pixels as px
from tessera.operators import register, resample, shapes
from tessera.plans import graph
from tessera.plans import transforms as tf
from tessera.plans.graph import Graph
from tessera.project import Prepro, Project
from tessera.sources import formats, images
from tests.test_engine import array, blobs, frame


def plane_of(tiles, channel=0):
    return images.planes(tiles.filter(f"channel = {channel}").withColumn("channel", tiles["channel"] - channel), tiles.first()["image_id"])[0]


# --- formats


def packed_lzw(data):
    table, out, width, held, bits, word = {bytes([k]): k for k in range(256)}, bytearray(), 9, 0, 0, b""

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            out.append(held >> (bits - 8) & 255)
            bits -= 8
            held &= (1 << bits) - 1

    put(256)
    for k in range(len(data)):
        b = data[k : k + 1]
        if word + b in table:
            word += b
            continue
        put(table[word])
        table[word + b] = len(table) + 2
        if len(table) + 2 == 4094:
            put(256)
            table, width = {bytes([k]): k for k in range(256)}, 9
        elif len(table) + 2 >= 1 << width:
            width += 1
        word = b
    put(table[word])
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def test_lzw():
    rng = np.random.default_rng(0)
    for data in (b"a" * 3000, bytes(rng.integers(0, 4, 9000, np.uint8)), bytes(rng.integers(0, 256, 20_000, np.uint8))):
        assert images.unpacked_lzw(packed_lzw(data)) == data


def strip_tiff(a, compression):
    """A little-endian TIFF of strips of seven rows."""
    h, w = a.shape
    strips = [a[y : y + 7].tobytes() for y in range(0, h, 7)]
    strips = [packed_lzw(s) if compression == 5 else s for s in strips]
    at = 8
    offsets = list(itertools.accumulate([at, *map(len, strips)]))[:-1]
    directory = at + sum(map(len, strips))
    n = len(strips)
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 16), (259, 3, 1, compression), (262, 3, 1, 1), (273, 4, n, directory + 200), (277, 3, 1, 1), (278, 3, 1, 7), (279, 4, n, directory + 200 + 4 * n)]
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", directory) + b"".join(strips) + table.ljust(200, b"\0") + struct.pack(f"<{n}I", *offsets) + struct.pack(f"<{n}I", *map(len, strips))


@pytest.mark.parametrize("compression", [1, 5])
def test_strips(spark, tmp_path, compression):
    a = np.random.default_rng(1).integers(0, 300, (40, 33)).astype("<u2")
    (tmp_path / "s.tif").write_bytes(strip_tiff(a, compression))
    assert (plane_of(formats.read(spark, str(tmp_path / "s.tif"))) == a).all()
    assert formats.info(spark, str(tmp_path / "s.tif")) == formats.Info((33, 40), 1, "uint16", False, ((33, 40),))


def test_levels_and_channels_are_read_alone(spark, tmp_path):
    rng = np.random.default_rng(2)
    full = rng.integers(0, 60_000, (3, 100, 90)).astype("uint16")
    (tmp_path / "p.tif").write_bytes(images.tiff_bytes([full, full[:, ::2, ::2]], 32))
    df = images.read_tiff(spark, str(tmp_path / "p.tif"), level=1, channel=2)
    assert {(r["level"], r["channel"]) for r in df.collect()} == {(1, 2)} and df.count() == 4
    assert (plane_of(df.withColumn("level", df["level"] * 0), 2) == full[2, ::2, ::2]).all()
    assert (plane_of(formats.read(spark, str(tmp_path / "p.tif"), channel=7)) == full[0]).all()
    with pytest.raises(ValueError, match="no reader"):
        formats.read(spark, "x.bmp")


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "float32"])
def test_written_tiff_and_chunks(spark, tmp_path, dtype):
    rng = np.random.default_rng(3)
    a = (rng.uniform(0, 250, (2, 150, 200))).astype(dtype)
    tiles = formats.from_array(spark, a, 32).drop("level")
    images.write_tiff(tiles, str(tmp_path / "w.tiff"), (200, 150), 2, dtype, 32, ("one", "two"), res=0.5)
    told = formats.info(spark, str(tmp_path / "w.tiff"))
    assert told.size == (200, 150) and told.channels == 2 and told.names == ("one", "two") and told.res == 0.5 and told.levels == ((200, 150), (100, 75), (50, 37))
    images.write_chunks(tiles, str(tmp_path / "w.zarr"), (200, 150), 2, dtype, 32)
    for c in range(2):
        assert (plane_of(formats.read(spark, str(tmp_path / "w.tiff"), channel=c), c) == a[c]).all()
        assert (plane_of(formats.read(spark, str(tmp_path / "w.zarr"), channel=c), c) == a[c]).all()
        for level in (1, 2):
            f, (w, h) = 1 << level, told.levels[level]
            block = a[c, : h * f, : w * f].reshape(h, f, w, f).astype(float).mean((1, 3))
            want = block if dtype == "float32" else np.floor(np.round(block, 9))
            for path in ("w.tiff", "w.zarr"):
                got = formats.read(spark, str(tmp_path / path), level=level, channel=c)
                assert plane_of(got.withColumn("level", got["level"] * 0), c) == pytest.approx(want, rel=1e-6)


def test_written_colours_and_missing_tiles(spark, tmp_path):
    a = np.random.default_rng(4).integers(0, 255, (70, 64, 3)).astype("uint8")
    tiles = formats.from_array(spark, a, 32).drop("level").filter("not (ty = 1 and tx = 1)")
    images.write_tiff(tiles, str(tmp_path / "c.tiff"), (64, 70), 3, "uint8", 32, rgb=True)
    assert formats.info(spark, str(tmp_path / "c.tiff")).rgb
    want = a.copy()
    want[32:64, 32:64] = 0
    for c in range(3):
        assert (plane_of(formats.read(spark, str(tmp_path / "c.tiff"), channel=c), c) == want[:, :, c]).all()


def png(a, kind, depth, palette=b""):
    """A PNG whose lines go through the five filters in turn."""
    raw, step = [], a.shape[2] * depth // 8
    lines = [np.frombuffer(np.ascontiguousarray(line).astype(">u2" if depth == 16 else "u1").tobytes(), np.uint8).astype(int) for line in a]
    for y, line in enumerate(lines):
        up = lines[y - 1] if y else np.zeros_like(line)
        left, corner = (np.concatenate([np.zeros(step, int), x[:-step]]) for x in (line, up))
        p = left + up - corner
        near = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * line, left, up, (left + up) // 2, near][y % 5]
        raw.append(bytes([y % 5]) + bytes(((line - guess) % 256).astype("u1")))
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, kind, 0, 0, 0)
    data = zlib.compress(b"".join(raw))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("kind", "depth", "samples"), [(0, 8, 1), (0, 16, 1), (2, 8, 3), (2, 16, 3), (4, 8, 2), (6, 8, 4), (3, 8, 1)])
def test_png(spark, tmp_path, kind, depth, samples):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 8 if kind == 3 else 1 << depth, (23, 17, samples))
    palette = rng.integers(0, 256, (8, 3)).astype("u1")
    (tmp_path / "x.png").write_bytes(png(a, kind, depth, palette.tobytes() if kind == 3 else b""))
    want = palette[a[:, :, 0]] if kind == 3 else a[:, :, : {1: 1, 2: 1, 3: 3, 4: 3}[samples]]
    told = formats.info(spark, str(tmp_path / "x.png"))
    assert told.channels == want.shape[2] and told.rgb == (want.shape[2] == 3)
    tiles = formats.read(spark, str(tmp_path / "x.png"), tile=8)
    for c in range(want.shape[2]):
        assert (plane_of(tiles, c) == want[:, :, c]).all()


@pytest.mark.parametrize("shape", [(50, 40), (3, 50, 40), (50, 40, 3)])
def test_arrays_and_npy(spark, tmp_path, shape):
    a = np.random.default_rng(6).integers(0, 1000, shape).astype("uint16")
    np.save(tmp_path / "a.npy", a)
    first, rgb = formats.channels_first(a)
    for source in (a, str(tmp_path / "a.npy")):
        assert formats.info(spark, source).rgb == rgb == (shape[-1] == 3) and formats.info(spark, source).size == (40, 50)
        tiles = formats.read(spark, source, "named", tile=16)
        assert tiles.first()["image_id"] == "named"
        for c in range(len(first)):
            assert (plane_of(tiles, c) == first[c]).all()


def czi(blocks):
    """A CZI file of (channel, y, x, plane, compression); a plane of three samples is blue first. The last block is a half-size one."""
    import zstandard

    out, entries = bytearray(544), []
    for c, y, x, plane, compression in [*blocks, (0, 0, 0, None, 0)]:
        half = plane is None
        plane = np.zeros((4, 4), "u1") if half else plane
        raw = plane.tobytes()
        if compression == 5:
            raw = zstandard.compress(raw)
        elif compression == 6:
            raw = b"\x03\x01\x01" + zstandard.compress(np.frombuffer(raw, "u1").reshape(-1, 2).T.tobytes())
        pixel = {(2, "u1"): 0, (2, "u2"): 1, (3, "u1"): 3}[plane.ndim, plane.dtype.str[1:]]
        h, w = plane.shape[:2]
        scale = 2 if half else 1
        dims = [(b"X", x, w * scale, w), (b"Y", y, h * scale, h), (b"C", c, 1, 1)]
        entry = struct.pack("<2siqiiB5si", b"DV", pixel, len(out), 0, compression, 2 if half else 0, b"", len(dims)) + b"".join(struct.pack("<4siifi", d, s, n, float(s), k) for d, s, n, k in dims)
        entries.append(entry)
        head = struct.pack("<iiq", 5, 0, len(raw)) + entry
        body = head.ljust(256, b"\0") + b"<m/> " + raw
        out += b"ZISRAWSUBBLOCK".ljust(16, b"\0") + struct.pack("<qq", len(body), len(body)) + body
    place = len(out)
    body = struct.pack("<i", len(entries)).ljust(128, b"\0") + b"".join(entries)
    out += b"ZISRAWDIRECTORY".ljust(16, b"\0") + struct.pack("<qq", len(body), len(body)) + body
    out[:16] = b"ZISRAWFILE".ljust(16, b"\0")
    struct.pack_into("<q", out, 32 + 52, place)
    return bytes(out)


@pytest.mark.parametrize(("dtype", "compression"), [("u1", 0), ("u2", 0), ("u2", 5), ("u2", 6)])
def test_czi_mosaic(spark, tmp_path, dtype, compression):
    a = np.random.default_rng(7).integers(0, 200, (2, 60, 50)).astype(dtype)
    blocks = [(c, 10 + y, 20 + x, np.ascontiguousarray(a[c, y : y + 32, x : x + 30]), compression) for c in range(2) for y in (0, 28) for x in (0, 20)]
    (tmp_path / "m.czi").write_bytes(czi(blocks))
    told = formats.info(spark, str(tmp_path / "m.czi"))
    assert told.size == (50, 60) and told.channels == 2 and told.dtype == {"u1": "uint8", "u2": "uint16"}[dtype] and not told.rgb
    tiles = formats.retiled(formats.read(spark, str(tmp_path / "m.czi")), 16)
    for c in range(2):
        assert (plane_of(tiles, c) == a[c]).all()
    assert (plane_of(formats.read(spark, str(tmp_path / "m.czi"), channel=9)) == a[0]).all()


def test_czi_colours(spark, tmp_path):
    a = np.random.default_rng(8).integers(0, 256, (20, 30, 3)).astype("u1")
    (tmp_path / "c.czi").write_bytes(czi([(0, 0, 0, np.ascontiguousarray(a[:, :, ::-1]), 0)]))
    assert formats.info(spark, str(tmp_path / "c.czi")).rgb
    tiles = formats.read(spark, str(tmp_path / "c.czi"))
    for c in range(3):
        assert (plane_of(tiles, c) == a[:, :, c]).all()
    grey = plane_of(formats.read_czi(spark, str(tmp_path / "c.czi"), greyscale=True))
    assert (grey == sum(np.floor(a[:, :, c] * px.GREY[c]) for c in range(3))).all()


def test_masks_of_images_and_shapes(spark, tmp_path):
    a = np.zeros((40, 50), np.uint8)
    a[5:20, 10:30] = 9
    (tmp_path / "m.json").write_text(json.dumps([{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[10, 5], [29, 5], [29, 19], [10, 19], [10, 5]]]}, "properties": {}}]))
    np.save(tmp_path / "m.npy", a)
    for source in (a, str(tmp_path / "m.npy"), str(tmp_path / "m.json")):
        mask = formats.read_mask(spark, source, (50, 40))
        assert (array(mask, 40, 50) == (a > 0)).all()
        assert tuple(px.mask_box(mask, 2).select("x", "y", "w", "h").first()) == (8, 3, 24, 19)


@pytest.mark.parametrize("kind", ["tiff", "zarr", "tiles"])
def test_one_image_through_transforms(spark, tmp_path, kind):
    a = np.random.default_rng(14).integers(0, 250, (100, 80, 3)).astype("uint8")
    np.save(tmp_path / "a.npy", a)
    shift = tf.Transform("translation", (8.0, -5.0), size=(80, 100), spacing=(0.5, 0.5))
    (tmp_path / "t.json").write_text(config.save_transforms([], [("b", [shift])]))
    out = str(tmp_path / f"o.{kind}")
    assert cli.main(["image", str(tmp_path / "a.npy"), str(tmp_path / "t.json"), out, "--tile", "32", "--source-res", "0.5"]) == 0
    want = np.zeros_like(a)
    want[10:, :64] = a[:90, 16:]
    for c in range(3):
        got = formats.read(spark, out, channel=c)
        plane = np.zeros((100, 80), np.uint8)
        for r in got.collect():
            plane[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]] = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"])
        assert (plane == want[:, :, c]).all()
    assert kind == "tiles" or formats.info(spark, out).size == (80, 100)
    with pytest.raises(ValueError, match="channels"):
        runner.write_image(got, out, kind, (80, 100), 3, "uint8", 32, ["a"], False, 1.0)


# --- transforms


def wavy(size=(128, 128), amplitude=7, seed=3):
    rng = np.random.default_rng(seed)
    return tf.Transform("bspline", tuple(rng.uniform(-amplitude, amplitude, 2 * 9 * 9)), size=size, grid_size=(9, 9), grid_spacing=(32.0, 32.0), grid_origin=(-64.0, -64.0))


@pytest.mark.parametrize("metric", register.METRICS)
def test_grid_alignment(metric):
    moving = blobs(128, 128, 7)
    fixed = resample.resample_plane(moving, tf.Sequence().add([wavy()]), 1.0, "linear")
    found, log = register.align(fixed, moving, register.Model("bspline", metric, 4, 100, 4000, 32, grid=24, schedule=(4, 4, 2, 1)))
    got = resample.resample_plane(moving, tf.Sequence().add([found]), 1.0, "linear")
    dice = lambda a, b: 2 * ((a > 60) & (b > 60)).sum() / ((a > 60).sum() + (b > 60).sum())
    inner = (slice(12, 116),) * 2
    assert dice(got[inner], fixed[inner]) > 0.98 > dice(moving[inner], fixed[inner]) and log[-1][0] == 3


def test_slopes_are_differences():
    rng = np.random.default_rng(9)
    a, b = rng.uniform(0, 1, 400), rng.uniform(0, 1, 400)
    for metric in register.METRICS:
        slope = register.slope(metric, a, b, 16)
        for k in (3, 77, 200):
            up, down = b.copy(), b.copy()
            up[k], down[k] = b[k] + 1e-6, b[k] - 1e-6
            assert slope[k] == pytest.approx((register.cost(metric, a, up, 16) - register.cost(metric, a, down, 16)) / 2e-6, rel=2e-2, abs=2e-5)


def test_masks_keep_alignment_to_themselves():
    """The half outside the masks moves the other way and must not count."""
    left, right = blobs(128, 128, 7), blobs(128, 128, 8)
    shifted = lambda a, x: resample.resample_plane(a, tf.Sequence().add([tf.Transform("translation", (x, 0.0), size=(128, 128))]), 1.0, "linear")
    fixed, moving = np.hstack([left, right]), np.hstack([shifted(left, 6.0), shifted(right, -6.0)])
    mask = np.zeros(fixed.shape, np.uint8)
    mask[8:120, 12:112] = 1
    t, _ = register.align(fixed, moving, register.Model("translation", "mean_squares", 3, 80, 4000), fixed_mask=mask, moving_mask=mask)
    assert t.params[0] == pytest.approx(-6.0, abs=0.7) and abs(t.params[1]) < 0.7
    with pytest.raises(ValueError, match="without pixels"):
        register.align(fixed, moving, register.Model("translation"), fixed_mask=np.zeros_like(mask))


def test_models_from_files_and_maps(tmp_path):
    told = '(Transform "BSplineTransform")\n// a note\n(Metric "AdvancedMeanSquares")\n(NumberOfResolutions 3)\n(MaximumNumberOfIterations 7)\n(FinalGridSpacingInPhysicalUnits 40)\n(GridSpacingSchedule 4 2 1)\n(MaximumStepLength 9 5 1)\n'
    (tmp_path / "m.txt").write_text(told)
    want = register.Model("bspline", "mean_squares", 3, 7, steps=(9.0, 5.0, 1.0), grid=40.0, schedule=(4.0, 2.0, 1.0))
    got = register.models_of((str(tmp_path / "m.txt"), {"Transform": ["EulerTransform"], "AutomaticTransformInitialization": ["true"]}, "affine", want))
    assert got[0] == got[3] == want and got[1].centred and got[1].kind == "euler" and got[2] is register.MODELS["affine"]
    with pytest.raises(ValueError, match="no model"):
        register.model_of({"Metric": ["Other"]})


def test_centred_start():
    moving = np.pad(blobs(96, 96, 5), ((60, 0), (80, 0)))
    model = register.Model("euler", "mean_squares", 2, 40, 3000, centred=True)
    t, _ = register.align(blobs(96, 96, 5), moving, model)
    assert t.params[1:] != pytest.approx((0, 0), abs=20)


def test_bspline_tiles_equal_the_plane(spark):
    a = np.random.default_rng(10).uniform(0, 255, (200, 180))
    grid = wavy((150, 170), 12)
    for transforms in ([grid], [tf.Transform("euler", (0.2, 9.0, -12.0), (80.0, 90.0), (150, 170)), grid]):
        seq = tf.Sequence().add(transforms, [0] * len(transforms))
        for kind in ("nearest", "linear"):
            tiles = resample.transform_image(resample.to_tiles(frame(spark, a[None]), 32), (180, 200), seq, 1.0, 32, kind)
            assert array(resample.to_pixels(tiles), 170, 150) == pytest.approx(resample.resample_plane(a, seq, 1.0, kind), abs=1e-6)
    low, high = np.array([[0.0, 0.0], [64.0, 96.0]]), np.array([[31.0, 31.0], [95.0, 127.0]])
    a, b = shapes.mapped_boxes(seq, low, high)
    for k in range(2):
        inside = np.random.default_rng(k).uniform(low[k], high[k], (500, 2))
        p = shapes.map_points(seq, inside)
        assert (p >= a[k]).all() and (p <= b[k]).all()


def test_inverse_of_a_spline():
    t = wavy(amplitude=9)
    p = np.random.default_rng(11).uniform(0, 128, (3000, 2))
    q = shapes.forward(t, p)
    y, off = shapes.unspline(t, q)
    settled = off < 1e-6
    assert settled.mean() > 0.99 and shapes.forward(t, y[settled]) == pytest.approx(q[settled], abs=1e-6)
    residual = np.zeros(len(q))
    shapes.inverse_points(tf.Sequence().add([t]), q, residual=residual)
    assert (residual == off).all()


def test_fill_is_the_even_odd_rule():
    rng = np.random.default_rng(12)
    for _ in range(60):
        rings = [rng.integers(-5, 40, (int(rng.integers(3, 9)), 2)).astype(float) for _ in range(int(rng.integers(1, 3)))]
        y, x = shapes.fill((32, 30), rings)
        got = set(zip(y.tolist(), x.tolist(), strict=True))
        edges = [(tuple(r[k].astype(int)), tuple(r[(k + 1) % len(r)].astype(int))) for r in rings for k in range(len(r))]
        want = set()
        for v in range(30):
            cuts = sorted(a[0] + (v - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges if a[1] != b[1] and min(a[1], b[1]) <= v < max(a[1], b[1]))
            want |= {(v, u) for u in range(32) for s, e in zip(cuts[::2], cuts[1::2], strict=True) if s <= u <= e}
        for a, b in edges:
            n = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)
            steps = [(round(a[1] + (b[1] - a[1]) * k / n), round(a[0] + (b[0] - a[0]) * k / n)) for k in range(n + 1)]
            want |= {s for s in steps if 0 <= s[0] < 30 and 0 <= s[1] < 32}
        assert got == want


def painted(features, size):
    """The later of (id, [rings of each part]) over the earlier, each filled by itself."""
    out = {}
    for k, parts in sorted(features, key=lambda f: f[0]):
        for rings in parts:
            out |= dict.fromkeys(zip(*(c.tolist() for c in shapes.fill(size, rings)), strict=True), k + 1)
    return out


def rows_of(features, name="s"):
    return [(name, k, p, r, v, float(x), float(y), "MultiPolygon", "a") for k, parts in features for p, rings in enumerate(parts) for r, ring in enumerate(rings) for v, (x, y) in enumerate(ring)]


def test_raster_of_features_over_each_other(spark, monkeypatch):
    rng = np.random.default_rng(31)
    ring = lambda low, high: rng.uniform(low, high, (int(rng.integers(1, 7)), 2))
    many = lambda n, low, high: [(int(k), [[ring(low, high) for _ in range(int(rng.integers(1, 3)))] for _ in range(int(rng.integers(1, 3)))]) for k in rng.permutation(3 * n)[:n]]
    sets = {"a": many(400, -5, 45), "b": many(3, 10, 20), "c": [(7, [[np.array([[90.0, 90.0], [99.0, 95.0]])]])]}
    v = spark.createDataFrame([r for name, features in sets.items() for r in rows_of(features, name)], shapes.VERTICES).repartition(3)
    want = {(name, y, x, k) for name, features in sets.items() for (y, x), k in painted(features, (40, 38)).items()}
    for held in (1 << 22, 100):
        monkeypatch.setattr(shapes, "HELD", held)
        monkeypatch.setattr(shapes, "AT_ONCE", 5000)
        monkeypatch.setattr(shapes, "TOGETHER", 300)
        assert {tuple(r) for r in shapes.rasterise(v, (40, 38)).select("set_name", "y", "x", "v").collect()} == want


def test_hidden_features_are_not_filled(monkeypatch):
    rng = np.random.default_rng(32)
    features = [(k, [[np.array([[0, 0], [29, 0], [29, 29], [0, 29]]) if k % 100 == 0 else rng.integers(0, 30, (4, 2))]]) for k in range(3000)]
    points = np.concatenate([f[1][0][0] for f in features]).astype(float)
    filled, fill_edges = [], shapes.fill_edges
    monkeypatch.setattr(shapes, "fill_edges", lambda *a: filled.append(len(np.unique(a[3]))) or fill_edges(*a))
    monkeypatch.setattr(shapes, "AT_ONCE", 20000)
    zeros = np.zeros(len(points), int)
    [(of, pixel)] = shapes.paint((30, 30), points, np.arange(0, len(points), 4), zeros, zeros)
    assert sum(filled) < 200
    assert dict(zip(zip((pixel // 30).tolist(), (pixel % 30).tolist(), strict=True), (of + 1).tolist(), strict=True)) == painted(features, (30, 30))


def test_polygons_are_shuffled_once(spark):
    """Line items meet by their order for the numbers of vertices, the count, the join and the features."""
    plan = shapes.to_geojson(queries.polygons(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("lineitem") == 1


def test_geojson_text_is_that_of_json(spark):
    ring = lambda *p: [[float(x), float(y)] for x, y in p]
    a, b, c = ring((0, 0), (4, 0), (4, 1e16), (0, 0)), ring((1, 1), (-0.0, 2.5e-7)), ring((3, 3.1))
    closed = lambda r: r if r[0] == r[-1] else [*r, r[0]]
    of = {
        "Point": (c[0], [[c]]), "MultiPoint": (b, [[b]]), "LineString": (a, [[a]]), "Polygon": ([a, closed(b), c], [[a, b, c]]),
        "MultiLineString": ([b, a], [[b], [a]]), "MultiPolygon": ([[a, closed(b)], [c], [closed(b)]], [[a, b], [c], [b]]),
    }
    rows, want = [], {}
    for k, (kind, (coords, parts)) in enumerate(list(of.items()) * 40):
        name = [None, 'a "b"', "\u00e9"][k % 3]
        rows += [("s", k, p, r, v, *xy, kind, name) for p, rings in enumerate(parts) for r, one in enumerate(rings) for v, xy in enumerate(one)]
        want[k] = json.dumps({"type": "Feature", "geometry": {"type": kind, "coordinates": coords}, "properties": {"classification": {"name": name}}})
    got = shapes.to_geojson(spark.createDataFrame(rows, shapes.VERTICES).repartition(5))
    assert {r["feature_id"]: r["feature"] for r in got.collect()} == want


def test_geojson_is_written_by_column(spark, monkeypatch):
    """Numbers are written once for many features, not once a feature."""
    rows = [("s", k, 0, 0, v, k / 7, v / 3, "Polygon", "a") for k in range(2000) for v in range(4)]
    batches = shapes.in_order(spark.createDataFrame(rows, shapes.VERTICES)).coalesce(1).toArrow().to_batches(1000)
    calls, dumps = [], json.dumps
    monkeypatch.setattr(shapes.json, "dumps", lambda x: calls.append(1) or dumps(x))
    assert sum(len(shapes.told(*x)) for x in shapes.features_in(iter(batches), 4000)) == 2000
    assert len(calls) <= 12


@pytest.mark.parametrize("model", [register.Model("euler", resolutions=3, iterations=4), register.Model("bspline", resolutions=2, iterations=4, grid=40)])
def test_large_planes_align_in_their_own_type(monkeypatch, model):
    """The same parameters to the bit, with a few bytes a pixel in place of five copies as floats."""
    fixed, moving = ((blobs(1301, 1100, k) * 255 / blobs(1301, 1100, k).max()).astype(np.uint8) for k in (3, 4))
    masks = [np.ones(a.shape, np.uint8) for a in (fixed, moving)]
    masks[0][:40] = 0
    monkeypatch.setattr(register, "HELD", 1 << 30)
    want = register.align(fixed, moving, model, 1.0, tf.Sequence(), *masks)
    monkeypatch.setattr(register, "HELD", 30000)
    tracemalloc.start()
    got = register.align(fixed, moving, model, 1.0, tf.Sequence(), *masks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    register.pyramid(fixed, moving, 10)
    bare = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == want
    assert bare < 8 * fixed.size
    assert peak < 24 * fixed.size + (1 << 20) + 1500 * min(model.samples, fixed.size)


def test_large_tiles_are_put_together_from_blocks(spark):
    rng = np.random.default_rng(33)
    a = np.zeros((2, 1300, 70))
    a[:, rng.integers(0, 1300, 900), rng.integers(0, 70, 900)] = rng.integers(1, 255, (2, 900))
    pixels = frame(spark, a).filter("v > 0")
    for tile in (600, 1 << 30):
        tiles = resample.to_tiles(pixels, tile, "uint8")
        assert tiles._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInArrow") == 2
        for r in tiles.collect():
            plane = a[r["channel"], r["y0"] : r["y0"] + tile, r["x0"] : r["x0"] + tile]
            (h, w), got = np.max(np.nonzero(plane), 1) + 1, np.frombuffer(r["data"], "uint8").reshape(r["h"], r["w"])
            assert (r["ty"] * tile, r["h"], r["w"]) == (r["y0"], h, w) and (got == plane[:h, :w]).all()
        assert tiles.count() == 2 * -(-1300 // tile)


def test_register_edge_is_the_alignment_of_the_halves(spark):
    rows = queries.plane(spark, "/root/testdata/sf0.001").toPandas()
    a = np.zeros((rows["y"].max() + 1, 64))
    a[rows["y"], rows["x"]] = rows["v"]
    got = {r["edge_id"]: (list(r["params"]), r["cost"]) for r in queries.register_edge(spark, "/root/testdata/sf0.001").collect()}
    for k in (0, 1):
        half = a[:, 32 * k : 32 * k + 32]
        t, log = register.align(half, half[2:], register.MODELS["rigid"])
        assert got[f"edge{k}"] == (list(t.params), log[-1][2])


# --- shape sets


def test_changes_of_shape_sets(spark):
    one = shapes.from_arrays(spark, [{"array": [[1, 2], [3, 4], [5, 0]], "shape_type": "polygon", "shape_name": "a"}, {"array": np.array([[7, 7]]), "shape_type": "Point"}], "s")
    both = shapes.add(one, shapes.from_arrays(spark, [{"array": [[0, 0], [1, 1]], "shape_type": "linestring", "shape_name": "a"}], "s"))
    assert sorted((r["feature_id"], r["vertex"]) for r in both.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (2, 1)]
    told = {(r["shape_type"], r["shape_name"]): r["n_shapes"] for r in shapes.counts(both).collect()}
    assert told == {("Polygon", "a"): 1, ("Point", "unnamed"): 1, ("LineString", "a"): 1}
    moved = shapes.update(both, shapes.scale(both.filter("feature_id = 2"), 10))
    assert sorted((r["feature_id"], r["x"]) for r in moved.collect()) == [(0, 1.0), (0, 3.0), (0, 5.0), (1, 7.0), (2, 0.0), (2, 10.0)]
    for bad in ({"array": [[1, 2, 3]]}, {"array": [[1, 2]], "shape_type": "ball"}, {"array": []}):
        with pytest.raises(ValueError):
            shapes.from_arrays(spark, [bad])


# --- graphs


def test_resolve_long_chains_and_cycles(spark, monkeypatch):
    rng = np.random.default_rng(13)
    for edges in ([(f"n{k}", f"n{k + 1}") for k in range(20)], [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], [(f"x{k}", f"x{int(rng.integers(k + 1, 12))}") for k in range(11)] + [("x3", "x11")]):
        of = {}
        for s, t in edges:
            of.setdefault(s, []).append(t)
        want = []

        def walk(start, node, seen, of=of, want=want):
            for t in of.get(node, ()):
                if node not in seen:
                    want.append((start, len(seen), node, t))
                    walk(start, t, (*seen, node))

        for s in of:
            walk(s, s, ())
        df = spark.createDataFrame(edges, "source string, target string")
        assert sorted(map(tuple, graph.resolve(df).collect())) == sorted(want)
    assert graph.resolve(df.limit(0)).count() == 0
    monkeypatch.setattr(graph, "DEEPEST", 6)
    with pytest.raises(ValueError, match="hops"):
        graph.resolve(spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(9)], "source string, target string"))


def test_merges_and_overrides():
    g = Graph()
    for name in "abc":
        g.add_image(name)
    g.add_merge("m", ["a", "b"])
    g.add_path("a", "c", params="affine", override={"source": Prepro(rotate=90)})
    assert g.outputs() == ["m", "c"] and g.edges[0].params == ("affine",)
    g.remove_merge("m")
    assert g.outputs() == ["a", "b", "c"]
    for bad in (lambda: g.remove_merge("m"), lambda: g.add_merge("n", []), lambda: g.add_image("d", image_res=0)):
        with pytest.raises(ValueError):
            bad()
    assert Prepro(invert=True, rotate=20).with_override(Prepro(rotate=90, channels=3)) == Prepro(invert=True, rotate=90, channels=(3,))


def test_output_rules(spark):
    g = Graph()
    g.add_image("a", image_res=2.0)
    g.add_image("b", image_res=1.0, output_res=4.0)
    g.add_image("c", image_res=1.0)
    g.add_path("a", "b")
    p = Project(g, {}, {"a": (50, 40), "b": (200, 100), "c": (10, 20)}, {"b": Prepro(box=(20, 10, 100, 60))})
    p.initial = {"b": [tf.crop((20, 10, 100, 60), 1.0)], "a": []}
    shift = tf.Transform("translation", (5.0, 7.0), size=(100, 60))
    from dataclasses import replace

    g.edges = [replace(g.edges[0], registered=True, transforms=(shift,))]
    whole, cropped = p.output("a"), p.output("a", to_original_size=False)
    assert (whole.size, whole.spacing) == ((200, 100), (1.0, 1.0)) and cropped.size == (100, 60)
    # a point of the whole target, then within the crop, then on the source
    assert shapes.map_points(whole, np.array([[30.0, 40.0]])).tolist() == [[15.0, 37.0]] and shapes.map_points(cropped, np.array([[10.0, 30.0]])).tolist() == [[15.0, 37.0]]
    assert (p.output("b").size, p.output("b").spacing) == ((50, 25), (4.0, 4.0)) and p.output("c").size == (10, 20)


def test_planes_are_kept_with_their_preprocessing(spark, tmp_path):
    g = Graph()
    for name in "ac":
        g.add_image(name, f"{name}.tif")
    g.add_path("a", "c", params=("one",))
    models, plane = {"one": register.Model("translation", "mean_squares", 1, 3, 100)}, np.arange(48 * 40.0).reshape(1, 48, 40)
    kept = lambda: sorted(p.name for p in (tmp_path / "cache").iterdir())
    for k, prepro in enumerate(({}, {}, {"a": Prepro(flip="h")})):
        p = Project(g, {n: frame(spark, plane, n) for n in "ac"}, dict.fromkeys("ac", (40, 48)), prepro, cache=str(tmp_path / "cache"))
        g.reset("a")
        p.register(spark, models)
        # the same preprocessing adds nothing
        assert len(kept()) == (2, 2, 3)[k]
    assert [n.split("-")[0] for n in kept()] == ["a", "a", "c"]


def test_project_through_rigid_affine_and_grid(spark):
    c = blobs(128, 128, 7)
    seq = tf.Sequence().add([tf.Transform("euler", (-0.06, -3.0, 2.0), (63.5, 63.5), (128, 128)), wavy(amplitude=5)], [0, 0])
    a = resample.resample_plane(c, seq, 1.0, "linear")
    g = Graph()
    for name in ("a", "b", "c"):
        g.add_image(name)
    g.add_path("a", "c", params=("one", "two", "three"))
    # a second edge in the same job, with preprocessing of its own that takes back a quarter turn
    g.add_path("b", "c", params=("one",), override={"source": Prepro(rotate=90)})
    quarter = np.rot90(c, -1)
    mask = np.ones((1, 128, 128))
    p = Project(g, {n: frame(spark, v[None], n) for n, v in (("a", a), ("b", quarter), ("c", c))}, dict.fromkeys("abc", (128, 128)), masks={"c": frame(spark, mask, "c")})
    models = {"one": register.Model(metric="mean_squares", resolutions=3, iterations=80), "two": register.Model("affine", "mean_squares", 3, 80), "three": register.Model("bspline", "mean_squares", 3, 80, 4000, grid=24, schedule=(4, 2, 1))}
    p.register(spark, models)
    assert [t.kind for t in p.found["a"]] == ["euler", "affine", "bspline"] and len(p.found["b"]) == 1 and {r[0] for r in p.logs["a"]} == {0, 1, 2}
    dice = lambda x, y: 2 * ((x > 60) & (y > 60)).sum() / ((x > 60).sum() + (y > 60).sum())
    inner = (slice(20, 108),) * 2
    for name, least in (("a", 0.95), ("b", 0.95)):
        got = array(resample.to_pixels(p.transformed(name, 64, "linear")), 128, 128)
        assert dice(got[inner], c[inner]) > least, name
    assert dice(a[inner], c[inner]) < 0.93


def test_plots(tmp_path):
    log = [(0, 0, 9, -0.2), (0, 0, 19, -0.3), (0, 1, 9, -0.4), (1, 0, 9, -0.5)]
    out = plots.write_plots(log, str(tmp_path / "a"))
    text = io.open(out[0]).read()
    assert [x[-6:] for x in out] == ["_0.svg", "_1.svg"] and text.count("<polyline") == 2 and ">R1<" in text
    assert plots.curve([(0, 0.0), (10, 1.0)], (0, 10), (0, 1), (120, 70), 10) == "10.00,60.00 110.00,10.00"
